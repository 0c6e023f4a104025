"""Token-ID output: texts to ids, packed into equal-length sequences in Arrow stream files.

A dataset is a folder of shards. Shard k holds the k-th range of document ids in ascending order:

* ``part-kkkkk.arrow``: an Arrow stream; every record batch has ``rows_per_batch`` rows (the last may have fewer) of two
  fixed-size lists: ``ids`` (``length`` unsigned 16- or 32-bit ids) and ``mask`` (``length / 8`` bytes, one bit per id,
  most significant first; 0 marks padding after the shard's last id). Every full batch takes the same number of bytes, so
  any sequence is found by arithmetic and read from a memory map without a copy.
* ``part-kkkkk.index.arrow``: document id, start in the shard, number of ids.

Cases: a null text is an empty one and still gets its end id; null document ids come first; rows with equal ids are
ordered by text and all kept; an empty table gives no shard and no row; further columns are ignored whatever their names.
"""

from __future__ import annotations

import re
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuyere.llm.shared import file_system, local_path, new_folder, one_thread, slices

#: White space other than a space and a line feed, of Python or of the tokenizer's pattern.
_OTHER_SPACE = "\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_OTHER = re.compile(rf"[{_OTHER_SPACE}]")
_PAIRS = ("  ", " \n", "\n ", "\n\n")
#: A run of Latin letters before an ASCII character that is none is a match of the tokenizer's pattern, with the space before it.
_REGULAR = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[\x00-@\[-`{-\x7f]|$)| ?[^ \n]++|[ \n]")
#: Chunks that are surely one match of the tokenizer's pattern.
_ONE_MATCH = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]++|[0-9]++|[!-/:-@\[-`{-~]++)|[ \n]")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= \S)")


class ByteBpeEncoder:
    """Encodes with the tokenizers library through a bounded memo of chunks.

    A byte-level BPE tokenizer first splits text by a pattern whose matches never reach over the boundary between a
    non-space and a single space before a non-space, nor out of a run of letters. Chunks between such boundaries are
    encoded alone, once each. The strings of added tokens are found first, as the library does, and text between them is
    encoded apart; with special_as_text they are ordinary text.
    """

    def __init__(self, path: str, most_chunks: int = 700_000, special_as_text: bool = False) -> None:
        one_thread()
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model = self.tokenizer.model
        bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.space = bytes_of(" ")[0][0]
        letters = " \n" + "".join(chr(c) for c in range(0xC0, 0x100))
        self.as_bytes = {ord(c): bytes_of(c)[0][0] for c in letters}
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        number = struct.Struct("<H" if self.dtype.itemsize == 2 else "<I").pack
        self.packed = [number(k) for k in range(self.tokenizer.get_vocab_size())]
        self.most_chunks = most_chunks
        self.memo: dict[str, bytes] = {}  # by whole chunk
        self.after_space: dict[str, bytes] = {}  # by what follows a chunk's space
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: self.packed[k] for k, t in added.items()} if not (special_as_text and all(t.special for t in added.values())) else {}
        self.plain_added = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        self.find_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def _match(self, chunk: str) -> bytes:
        """The ids of one match of the tokenizer's pattern, by the library's model alone."""
        mapped = chunk.replace(" ", self.space) if chunk.isascii() and chunk != "\n" else chunk.translate(self.as_bytes)
        return b"".join([self.packed[x.id] for x in self.model.tokenize(mapped)])

    def _chunk(self, chunk: str) -> bytes:
        got = self.memo.get(chunk)
        if got is None:
            if _ONE_MATCH.fullmatch(chunk):
                got = self._match(chunk)
            else:
                got = b"".join([self.packed[x] for x in self.tokenizer.encode(chunk, add_special_tokens=False).ids])
            self.memo[chunk] = got
        return got

    def _word(self, word: str) -> bytes:
        """The ids of a space and a word, from its chunks."""
        text = " " + word
        if _ONE_MATCH.fullmatch(text):
            got = self.after_space[word] = self._match(text)
            return got
        first, *others = _REGULAR.findall(text)
        if not others:
            got = self._chunk(text)
        else:
            head = self.after_space.get(first[1:])
            got = (self._word(first[1:]) if head is None else head) + b"".join(map(self._chunk, others))
        if "\n" not in word:  # words on both sides of a line feed seldom meet again
            self.after_space[word] = got
        return got

    def _piece(self, text: str) -> bytes:
        if len(self.memo) + len(self.after_space) > self.most_chunks:
            self.memo.clear()
            self.after_space.clear()
        if any(x in text for x in _PAIRS) or _OTHER.search(text):
            return b"".join(map(self._chunk, _BEFORE_SPACE.split(text)))
        first, *words = text.split(" ")
        got = list(map(self.after_space.get, words))
        k = -1
        for _ in range(got.count(None)):
            k = got.index(None, k + 1)
            found = self.after_space.get(words[k])
            got[k] = self._word(words[k]) if found is None else found
        return b"".join([*map(self._chunk, _REGULAR.findall(first)), *got])

    def encode(self, text: str, block: int = 1 << 20) -> bytes:
        """The ids of the whole text as little-endian bytes; very long texts go block by block, cut where chunks end."""
        if self.find_added is None or not (found := self.find_added.search(text)):
            return self._between(text, block)
        if not self.plain_added:
            return b"".join([self.packed[x] for x in self.tokenizer.encode(text, add_special_tokens=False).ids])
        out, at = [], 0
        while found:
            out += [self._between(text[at : found.start()], block), self.added[found[0]]]
            at = found.end()
            found = self.find_added.search(text, at)
        return b"".join([*out, self._between(text[at:], block)])

    def _between(self, text: str, block: int) -> bytes:
        out, at = [], 0
        while at < len(text):
            end = len(text)
            if end - at > 2 * block and (found := _BEFORE_SPACE.search(text, at + block)):
                end = found.start()
            out.append(self._piece(text[at:end]))
            at = end
        return b"".join(out)


_encoders: dict[tuple[str, bool], ByteBpeEncoder] = {}


def encoder(path: str, special_as_text: bool = False) -> ByteBpeEncoder:
    """One per Python worker and file."""
    key = (path, special_as_text)
    if key not in _encoders:
        _encoders[key] = ByteBpeEncoder(path, special_as_text=special_as_text)
    return _encoders[key]


class _ShardWriter:
    """Packs ids into sequences; holds at most one batch of them."""

    def __init__(self, folder: str, shard: int, id_type, dtype, length: int, rows: int, attempt: int) -> None:
        import pyarrow as pa

        self.length, self.rows, self.dtype = length, rows, dtype
        self.fs, base = file_system(f"{folder}/part-{shard:05d}")
        self.names = [f"{base}.arrow", f"{base}.index.arrow"]
        self.temporary = [f"{x}.{attempt}.tmp" for x in self.names]
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.uint8(), length // 8))])
        self.index_schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.fs.open_output_stream(x) for x in self.temporary]
        self.out = pa.ipc.new_stream(self.sinks[0], self.schema)
        self.index = pa.ipc.new_stream(self.sinks[1], self.index_schema)
        self.held, self.total, self.docs = bytearray(), 0, []

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.docs.append((doc_id, self.total, n))
        self.total += n
        self.held += ids
        full = self.length * self.rows * self.dtype.itemsize
        if len(self.held) >= full:
            cut = len(self.held) // full * full
            view = memoryview(bytes(self.held[:cut]))
            for at in range(0, cut, full):
                self._batch(view[at : at + full], self.length * self.rows)
            del self.held[:cut]
        if len(self.docs) >= 10_000:
            self._index()

    def _batch(self, raw, n: int) -> None:
        import numpy as np
        import pyarrow as pa

        rows = -(-n // self.length)
        ids, mask = np.zeros(rows * self.length, self.dtype), np.zeros(rows * self.length, np.uint8)
        ids[:n] = np.frombuffer(raw, self.dtype)
        mask[:n] = 1
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(pa.array(np.packbits(mask)), self.length // 8)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def _index(self) -> None:
        import pyarrow as pa

        columns = [pa.array([x[k] for x in self.docs], self.index_schema.types[k]) for k in range(3)]
        self.index.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.index_schema))
        self.docs = []

    def close(self) -> None:
        if self.held:
            self._batch(bytes(self.held), len(self.held) // self.dtype.itemsize)
        if self.docs:
            self._index()
        for x in (self.out, self.index, *self.sinks):
            x.close()
        for old, new in zip(self.temporary, self.names, strict=True):
            self.fs.move(old, new)  # a file appears whole or not at all, so attempts can be repeated


def write_token_files(df: DataFrame, tokenizer_path: str, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, length: int = 2048, rows_per_batch: int = 64, special_as_text: bool = False) -> DataFrame:
    """Encodes every text, appends end_id, and writes the shards. The strings of added tokens in a text become those tokens,
    as the library has it, unless special_as_text is set. One range shuffle puts documents in ascending id order;
    each task then streams its range into one file. Returns the manifest: shard, path, id_type, n_docs, n_tokens, start
    (ids in all shards before). The manifest has one row per task, so it may pass through the driver."""
    assert length % 8 == 0
    spark = df.sparkSession
    folder = folder or new_folder(spark, "tokens")
    if path := local_path(folder):
        import os

        os.makedirs(path, exist_ok=True)
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task, out = TaskContext.get(), None
        code = encoder(tokenizer_path, special_as_text)
        end = np.array([end_id], code.dtype).tobytes()
        n_docs = 0
        for batch in slices(batches, 500):
            if out is None:
                out = _ShardWriter(folder, task.partitionId(), batch.schema.field("doc_id").type, code.dtype, length, rows_per_batch, task.taskAttemptId())
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                out.add(doc_id, code.encode(text) + end)
                n_docs += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int64()), "path": [f"{folder}/part-{task.partitionId():05d}"], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([out.total], pa.int64())})

    shards = sorted(rows.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long").collect())
    starts = [0]
    for x in shards:
        starts.append(starts[-1] + x.n_tokens)
    return spark.createDataFrame([(x.shard, x.path, id_type, x.n_docs, x.n_tokens, at) for x, at in zip(shards, starts, strict=False)], "shard long, path string, id_type string, n_docs long, n_tokens long, start long")


#: Fixed by the Arrow stream format: the mark after the last batch.
_STREAM_END = b"\xff\xff\xff\xff\0\0\0\0"


def _open(uri: str):
    import pyarrow as pa

    path = local_path(uri)
    if path:
        return pa.memory_map(path)
    fs, path = file_system(uri)
    return fs.open_input_file(path)


class TokenFile:
    """Random access to the sequences of one shard. The place of any batch follows from the size of the first one and of the
    file, so only the batch that holds a sequence is touched; ids and packed masks are views of the memory map."""

    def __init__(self, path: str) -> None:
        import pyarrow as pa

        self.path, self.file = path, _open(f"{path}.arrow")
        self.schema = pa.ipc.open_stream(self.file).schema
        self.length = self.schema.field("ids").type.list_size
        self.begin, end = self.file.tell(), self.file.size() - len(_STREAM_END)
        self.held = (-1, None)
        if self.begin >= end:  # no batch
            self.rows = self.step = self.last = 0
            return
        self.last, self.step = 0, end - self.begin
        self.rows = self.batch(0).num_rows
        self.step = self.file.tell() - self.begin
        self.last = -(-(end - self.begin) // self.step) - 1  # all batches but the last take the same number of bytes

    def batch(self, k: int):
        import pyarrow as pa

        if self.held[0] != k:
            self.file.seek(self.begin + k * self.step)
            self.held = (k, pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema))
        return self.held[1]

    def __len__(self) -> int:
        return self.last * self.rows + self.batch(self.last).num_rows if self.rows else 0

    def _row(self, column: int, k: int):
        values = self.batch(k // self.rows).column(column)
        width = values.type.list_size
        return values.values.to_numpy(zero_copy_only=True)[(values.offset + k % self.rows) * width :][:width]

    def ids(self, k: int):
        return self._row(0, k)

    def mask(self, k: int):
        """A bit per id, packed."""
        return self._row(1, k)

    def between(self, start: int, n: int):
        """Parts of the shard's ids from a place on, n in all; each part is a view of one batch."""
        full = self.rows * self.length
        while n > 0:
            k, at = divmod(start, full)
            part = self.batch(k).column(0).flatten().to_numpy(zero_copy_only=True)[at : at + n]
            yield part
            start, n = start + len(part), n - len(part)

    def documents(self):
        """Batches of the index: doc_id, start, n_tokens."""
        import pyarrow as pa

        yield from pa.ipc.open_stream(_open(f"{self.path}.index.arrow"))


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document's ids, read back from the files: doc_id, shard, start (in the whole dataset), n_tokens, ids_crc32 (of
    the ids as little-endian unsigned 32-bit integers). A task streams through whole shards, batch by batch."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for shard, path, base in zip(*(batch.column(x).to_pylist() for x in ("shard", "path", "start")), strict=True):
                file = TokenFile(path)
                for docs in file.documents():
                    crcs = []
                    for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist(), strict=True):
                        crc = 0
                        for part in file.between(start, n):
                            crc = zlib.crc32(part.astype("<u4"), crc)
                        crcs.append(crc)
                    starts = pa.array(docs.column("start").to_numpy() + base)
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array([shard] * len(crcs), pa.int64()), starts, docs.column("n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "shard", "start", "n_tokens", "ids_crc32"])

    first = manifest.select("id_type").first()
    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(read, f"doc_id {first.id_type if first else 'long'}, shard long, start long, n_tokens long, ids_crc32 long")
