"""SentencePiece BPE encoding and decoding by a prefix table.

For a merge-type vocabulary every prefix of a text has one tokenization, and the last token of it is unique. The table
holds that last token for each prefix: of all tokens that end at a position (found by an Aho-Corasick automaton) it is the
one whose left neighbour, the last token of the prefix before it, is compatible with it, i.e. merging the two texts alone
gives back just the two. The ids are then read from the table backwards.

Two tokens are compatible if no merge over their border comes before the merges that made them; this is seen by undoing
the latest merges on either side of the border one after another.

Texts are cut, without any change of the result, where two neighbouring characters occur together in no piece, as no merge
can reach over such a place; what lies between is encoded once and kept in a bounded memo.

Where two pieces have one score (in the public vocabulary: runs of 2 and of 4 spaces), which merge comes first depends on
its place and not on the pieces alone; a part that holds such a piece is merged with a priority queue instead.

Cases: a null text is an empty one and has no ids; white space alone is encoded as the library does; characters without a
piece become byte pieces; texts of any length are taken whole; repeated rows give equal rows; an empty table gives an empty
result; columns of the added names, in any case, are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuyere.llm.shared import light_slices

SPACE = "▁"
#: Characters of a chunk that is kept: longer ones hardly ever come again.
LONGEST_KEPT = 48


class PieceModel:
    """Vocabulary of a SentencePiece BPE model with identity normalisation and byte fallback, and its prefix-table coder."""

    def __init__(self, path: str, most_chunks: int = 200_000) -> None:
        import ahocorasick
        import sentencepiece

        source = sentencepiece.SentencePieceProcessor(model_file=path)
        n = source.vocab_size()
        names = [source.id_to_piece(k) for k in range(n)]
        special = [source.is_control(k) or source.is_unknown(k) or source.is_byte(k) for k in range(n)]
        self.byte_ids = [source.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.ids = {x: k for k, x in enumerate(names) if not special[k]}
        order = sorted(self.ids.values(), key=lambda k: (-source.get_score(k), k))
        self.names, self.most_chunks = names, most_chunks
        self.score = [source.get_score(k) for k in range(n)]
        self.rank = [n] * n
        for r, k in enumerate(order):
            self.rank[k] = r
        self.whole = [x.replace(SPACE, " ").encode() for x in names]
        for k in range(n):
            if source.is_control(k):
                self.whole[k] = b""
            elif source.is_unknown(k):
                self.whole[k] = " ⁇ ".encode()
        for b, k in enumerate(self.byte_ids):
            self.whole[k] = bytes([b])
        self.decimal = [str(k) for k in range(n)]
        self.together = {x[i : i + 2] for x in self.ids for i in range(len(x) - 1)}
        self.words_only = not any(SPACE in x.lstrip(SPACE) for x in self.ids)
        letters = "A-Za-zÀ-ÖØ-öø-ÿ"
        ends = "".join(c for c in map(chr, range(33, 127)) if not c.isalpha() and not any(x[1] == c and re.match(f"[{letters}]", x) for x in self.together))
        ends = f"[{SPACE}\n{re.escape(ends)}]"  # what follows a letter in no piece
        self.words = re.compile(rf"{SPACE}*[{letters}]+(?={ends}|$)|{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        common = Counter(self.score[k] for k in self.ids.values())
        tied = [x for x, k in self.ids.items() if common[self.score[k]] > 1 and len(x) > 1]
        self.tied = re.compile("|".join(map(re.escape, tied))) if tied else None
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, k in self.ids.items():
            trace: list[tuple[int, int]] = []
            if self.merged(piece, trace) == [k]:
                if trace:
                    self.halves[k] = trace[-1]
                self.automaton.add_word(piece, (len(piece), k))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str, trace: list | None = None) -> list[int]:
        """Plain merging: always the best-scored pair, the leftmost of equals. For the tables, for ties, and for tests."""
        parts: list[str] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts) and (k := self.ids.get(both := parts[i] + parts[after[i]])) is not None:
                heapq.heappush(queue, (-self.score[k], i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, both = heapq.heappop(queue)
            if not parts[i] or after[i] >= len(parts) or parts[i] + parts[j := after[i]] != both:
                continue
            if trace is not None and parts[i] in self.ids and parts[j] in self.ids:
                trace.append((self.ids[parts[i]], self.ids[parts[j]]))
            parts[i], parts[j], after[i] = both, "", after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [k for x in parts if x for k in ([self.ids[x]] if x in self.ids else [self.byte_ids[b] for b in x.encode()])]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' texts together leaves just these two."""
        names, ids, rank, halves = self.names, self.ids, self.rank, self.halves
        a, b, before = left, right, len(rank) + 1  # a merge over the border counts if it came before this rank
        while True:
            joined = ids.get(names[a] + names[b])
            if joined is not None and rank[joined] < before:
                fits = False
                break
            can_a, can_b = a in halves, b in halves
            if not (can_a or can_b):
                fits = True
                break
            if can_a and (not can_b or rank[a] > rank[b]):
                before = rank[a]
                a = halves[a][1]
            else:
                before = rank[b] + 1  # of equal merges the left one, over the border, comes first
                b = halves[b][0]
        if len(self.fits) > 300_000:
            self.fits.clear()
        self.fits[left << 20 | right] = fits
        return fits

    def table(self, text: str) -> list[int]:
        """The last token of every prefix, -1 where no token ends (a character without a piece)."""
        last, fits = [-1] * len(text), self.fits
        for end, (length, k) in self.automaton.iter(text):
            if last[end] < 0:
                start = end - length
                if start < 0 or (left := last[start]) < 0:
                    last[end] = k
                elif (known := fits.get(left << 20 | k)) or known is None and self.compatible(left, k):
                    last[end] = k
        return last

    def backwards(self, text: str, last: list[int]) -> list[int]:
        out, at = [], len(text) - 1
        while at >= 0:
            k = last[at]
            if k < 0:
                out.extend(self.byte_ids[b] for b in reversed(text[at].encode()))
                at -= 1
            else:
                out.append(k)
                at -= len(self.names[k])
        out.reverse()
        return out

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a chunk, cut at pairs of characters that no piece holds."""
        memo, out, start = self.memo, [], 0
        for i in range(1, len(chunk) + 1):
            if i == len(chunk) or chunk[i - 1 : i + 1] not in self.together:
                part = chunk[start:i]
                got = memo.get(part)
                if got is None:
                    plain = self.tied is not None and self.tied.search(part)
                    got = tuple(self.merged(part) if plain else self.backwards(part, self.table(part)))
                    if len(part) <= LONGEST_KEPT:
                        memo[part] = got
                out.extend(got)
                start = i
        if len(memo) > self.most_chunks:
            memo.clear()
        got = tuple(out)
        if len(chunk) <= LONGEST_KEPT:
            memo[chunk] = got
        return got

    def encode(self, text: str, block: int = 1 << 20) -> list[int]:
        """Ids as the library gives them, without begin, end or sampling."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        if not self.words_only or "\n" in self.ids:
            return list(self._chunk(text))
        out: list[int] = []
        get, chunk = self.memo.get, self._chunk
        words = self.words.findall(text) if len(text) <= block else (x.group() for x in self.words.finditer(text))
        for word in words:
            out.extend(get(word) or chunk(word))
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, the space before the first removed, bytes that are no UTF-8 as U+FFFD each."""
        raw = b"".join(map(self.whole.__getitem__, ids))
        if ids and self.names[ids[0]].startswith(SPACE):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            out, at = [], 0
            while at < len(raw):
                size = next((n for n in (1, 2, 3, 4) if _is_char(raw[at : at + n])), 0)
                out.append(raw[at : at + size].decode() if size else "�")
                at += size or 1
            return "".join(out)


def _is_char(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """One per Python worker and file."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_pieces(df: DataFrame, model_path: str, *, text_col: str = "text", with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """Adds to each row: ids array<int> (if with_ids), n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded (if with_ids) and decoded_sha256 of the text that decoding the ids gives. No shuffle; columns of df that have
    one of these names are replaced. Without with_text, neither the text nor what is decoded is handed on."""
    added = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}
    if not with_ids:
        added = {k: v for k, v in added.items() if k not in ("ids", "decoded")}
    if not with_text:
        added.pop("decoded", None)
    rest = [c for c in df.columns if c.lower() not in added and c.lower() != text_col.lower()]
    keep_text = with_text and with_ids or text_col.lower() not in [c.lower() for c in df.columns]
    source = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`").alias("__text"))
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + ([f"`{text_col}` string"] if keep_text else []) + [f"{k} {v}" for k, v in added.items()])

    def code(batches):
        import pyarrow as pa

        model = piece_model(model_path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in light_slices(batches, len(rest)):
            got: dict[str, list] = {k: [] for k in added}
            for text in batch.column(batch.num_columns - 1).to_pylist():
                ids = model.encode(text or "")
                decoded = model.decode(ids)
                got["n_tokens"].append(len(ids))
                got["ids_sha256"].append(sha(",".join(map(model.decimal.__getitem__, ids)).encode()))
                got["decoded_sha256"].append(sha(decoded.encode()))
                if with_ids:
                    got["ids"].append(np.array(ids, np.int32))
                if "decoded" in added:
                    got["decoded"].append(decoded)
            kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
            columns = [batch.column(k) for k in range(batch.num_columns - (0 if keep_text else 1))] + [pa.array(v, kinds.get(k, pa.string())) for k, v in got.items()]
            names = [*rest, *([text_col] if keep_text else []), *added]
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(code, fields)
