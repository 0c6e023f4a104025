"""The training-data operators against brute force, round trips and held-out accuracy, on small fixtures with the hard cases:
nulls, empty and long texts, ties, repeated rows, clashing column names, empty tables."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tuyere.llm import exact_dedup, html_text, lang_id, lm, mixing, pieces, queries, sharding, simhash, tiff, token_files
from tuyere.llm.labelled_pages import LABELLED

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "th er on an re he in ed nd ha at en".split(), "de": "sch ein ung ich keit ver zu ä ö ß".split()}


def _text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def rows():
    rng = random.Random(3)
    out = []
    for k in range(90):
        lang = ("en", "de")[k % 2]
        out.append([k, _text(rng, lang, rng.randint(5, 120)), lang, f"s{k % 4}", 0])
    for k in range(90, 110):  # copies, some with other white space
        out.append([k, out[k - 90][1].replace(" ", "  " if k % 2 else "\t"), "en", "s0", 0])
    for k in range(110, 130):  # near copies of long texts
        base = out[0][1] if k == 110 else out[110][1]
        out.append([k, (base * 20 if k == 110 else base) + f" tail{k}", "en", "s1", 0])
    out += [[130, None, None, None, 0], [131, "", "en", None, 0], [132, "  \n ", None, "s2", 0], [133, "12 34 !!", "en", "s9", 0], [134, None, "de", "s0", None]]
    out += [[135, "word", "en", "s0", 0], [135, "word", "en", "s0", 0], [136, "\x00 émoji 🙂 <|endoftext|> </s> 漢字\r\n\tx", "de", "s3", 0], [137, "THE the The end", "en", "s0", 0]]
    out += [[138, _text(rng, "en", 30000), "en", "s1", 0]]
    return [tuple(x) for x in out]


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names clash with what the operators add
    extra = ["size", "slot", "fp", "body", "key", "lot", "row", "held_out", "bucket", "rest"]
    return spark.createDataFrame(rows(), SCHEMA).select("*", *[F.lit("x").alias(c) for c in extra]).repartition(5)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    manifest = token_files.write_token_files(docs, path, f"file://{tmp_path}/tokens", length=64, rows_per_batch=4)
    got = sorted(token_files.read_token_files(spark, manifest).collect(), key=lambda r: r.start)
    plain = Tokenizer.from_file(path)
    start, everything = 0, []
    for r, (doc_id, text, *_) in zip(got, sorted(rows(), key=lambda x: (x[0], x[1] or "")), strict=True):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
        everything += ids
    read = []
    for shard in manifest.orderBy("shard").collect():
        file = token_files.TokenFile(shard.path)
        assert not file.ids(0).flags.owndata
        for k in range(len(file)):
            real = np.unpackbits(file.mask(k)).astype(bool)
            assert len(file.ids(k)) == 64 == len(real)
            read += file.ids(k)[real].tolist()
    assert read == everything
    assert token_files.read_token_files(spark, token_files.write_token_files(none, path)).count() == 0


def test_token_files_by_text_ids(spark, tmp_path):
    table = spark.createDataFrame([("b", "x y"), ("a", "<|endoftext|>"), (None, None)], "`my id` string, `a text` string")
    manifest = token_files.write_token_files(table, queries.tokenizer_file("byte_bpe_50k.json"), f"file://{tmp_path}/t", id_col="my id", text_col="a text", length=8, rows_per_batch=1)
    got = [(r.doc_id, r.start, r.n_tokens) for r in token_files.read_token_files(spark, manifest).orderBy("start").collect()]
    assert got == [(None, 0, 1), ("a", 1, 2), ("b", 3, 3)]


@pytest.mark.parametrize("as_text", [False, True])
def test_token_chunks_equal_whole_texts(as_text):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    plain, code = Tokenizer.from_file(path), token_files.ByteBpeEncoder(path, most_chunks=50, special_as_text=as_text)
    plain.encode_special_tokens = as_text
    rng = random.Random(1)
    parts = [*" a'stéß漢½²́_ \n\t\x1c\xa0 12.,", "<|endoftext|>", " the", "word,", "don't", "Ünï", " 3rd", "\u2003", "e\u0301", "×", "÷"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        for block in (1 << 20, 5):
            assert np.frombuffer(code.encode(text, block), code.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces(docs, none):
    import sentencepiece

    path = queries.tokenizer_file("piece_bpe_32k.model")
    plain = sentencepiece.SentencePieceProcessor(model_file=path)
    got = pieces.encode_pieces(docs, path).collect()
    assert len(got) == len(rows())
    for r in got:
        ids = plain.encode(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == plain.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert pieces.encode_pieces(none, path, with_ids=False).count() == 0
    model, rng = pieces.PieceModel(path, most_chunks=60), random.Random(2)
    for _ in range(1500):
        text = "".join(rng.choice("  ▁abthe\n\x00ß漢<s>/.,0'\"\t　🙂") for _ in range(rng.randint(0, 25))) + " " * rng.choice([0, 0, 3, 41])
        assert model.encode(text, block=rng.choice([1, 1 << 20])) == plain.encode(text), repr(text)
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(rng.randint(0, 8))]
        assert model.decode(ids) == plain.decode(ids), ids


def _normal(text):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("key_bits", [64, 3])
def test_exact_dedup(docs, none, key_bits):
    got = exact_dedup.exact_groups(docs, key_bits=key_bits, capacity=10, most_bits=6).collect()
    assert key_bits < 64 or len({r.bucket for r in got}) > 8
    groups = {}
    for doc_id, text, *_ in rows():
        groups.setdefault(_normal(text), []).append(doc_id)
    expected = Counter((d, min(g), len(g), d == min(g), hashlib.sha256(b.encode()).hexdigest()) for b, g in groups.items() for d in g)
    assert Counter(tuple(r)[:5] for r in got) == expected
    assert exact_dedup.exact_groups(none).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values())


def test_copies_with_repeated_ids(spark):
    """Rows that share an id are rows of their own unless their texts are equal too."""
    found = spark.createDataFrame([(5, "a b"), (5, "a  b"), (5, "c"), (3, "c"), (5, "d"), (None, "e"), (None, "d"), (5, None), (6, "")], "doc_id long, text string")
    kept = sorted(((r.doc_id, exact_dedup_text(r.text)) for r in exact_dedup.drop_copies(found).collect()), key=str)
    assert kept == sorted([(5, "a b"), (3, "c"), (5, "d"), (None, "e"), (5, "")], key=str)


def exact_dedup_text(text):
    return " ".join((text or "").split())


def test_directory_doubles():
    assert exact_dedup.split_directory({0: 100, 1: 1, 15: 3}, 50, 4) == [(4, 0), (4, 1), (3, 1)] + [(3, 1)] + [(2, 1)] * 4 + [(1, 1)] * 8
    assert exact_dedup.split_directory({}, 5, 3) == [(0, 0)]
    assert exact_dedup.split_directory({0: 1, 7: 1}, 1, 3) == [(1, 0), (1, 1)]


def test_directory_deals_and_finds(spark, docs):
    """Rows are found through the directory: where a slot points to another bucket, its rows find no entry."""
    source = docs.select("doc_id", exact_dedup.normalised(F.col("text")).alias("body")).withColumn("key", F.xxhash64("body"))
    keys = source.select("doc_id", "key")
    right = exact_dedup.build_directory(keys, 10, 6)
    index = exact_dedup.build_index(source, right)
    loads = [r.n for r in index.groupBy("bucket").agg(F.count_distinct("key").alias("n")).collect()]
    assert max(loads) <= 10 and len(loads) > 8
    assert exact_dedup.look_up(keys, index, right, source).count() == len(rows())
    wrong = [right[-1], *right[1:]]
    lost = keys.where(exact_dedup._cell(F.col("key"), len(right).bit_length() - 1) == 0).count()
    assert lost and exact_dedup.look_up(keys, index, wrong, source).count() == len(rows()) - lost


def test_frequent_texts_and_clashing_names(spark):
    table = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t "), F.col("id").cast("string"))).otherwise("same").alias("text"), F.lit(1).alias("sha"), F.lit(2).alias("__sha"), F.lit(3).alias("row"))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(table).collect()}
    assert got == {k: (k, 1) if k % 3 else (0, 1667) for k in range(5000)}
    kept = exact_dedup.drop_copies(table)
    assert kept.columns == table.columns and kept.count() == 3334


def _fingerprint(text, words=3):
    from xxhash import xxh64_intdigest

    w = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    if not w:
        return 0
    h = [xxh64_intdigest(b" ".join(w[k : k + words]), 42) for k in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _reach(fps, distance):
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


def test_simhash(docs, none):
    got = simhash.near_groups(docs).collect()
    data = sorted(rows(), key=lambda x: x[0])
    fps = [_fingerprint(x[1]) for x in data]
    roots = _reach(fps, 3)
    expected = Counter((x[0], f"{f:016x}", data[r][0]) for x, f, r in zip(data, fps, roots, strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == expected
    assert simhash.near_groups(none).count() == 0


def test_near_copies_with_repeated_ids(spark):
    one = " ".join(f"alpha{k}" for k in range(60))
    other = " ".join(f"beta{k}" for k in range(60))
    third = " ".join(f"gamma{k}" for k in range(60))
    table = spark.createDataFrame([(1, one, "x"), (1, other, "x"), (1, one, "y"), (2, one, "x"), (3, third, "x"), (None, third, "x"), (None, None, "x")], "doc_id long, text string, text_hash string")
    got = simhash.drop_near_copies(table, words=3)
    assert got.columns == table.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, one), (1, other), (3, third), (None, None)])


def test_mix_repeats_rows_of_equal_ids_by_source_and_size(spark):
    table = spark.createDataFrame([(1, "a b c d e f g h", "p"), (1, "a b", "q"), (1, "a b", None), (2, "", "q")], "doc_id long, text string, source string")
    plan = Counter({(r.doc_id, r.source, r.size): r.times for r in mixing.mix(table).collect()})
    got = Counter((r.doc_id, r.source, len(r.text.split())) for r in mixing.repeat_documents(table).collect())
    assert got == +plan


@pytest.mark.parametrize("thresholds", [None, (1, 1), (2, 0), (1, 0, 0), (-1, 2, 0), (0, 0, 0, 0), (1, 0, 0, -1)])
def test_simhash_links_in_dense_and_blocked_buckets(spark, monkeypatch, thresholds):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(150)}
    for centre in list(values)[:6]:
        for _ in range(40):
            x = centre
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.choice([0, 1, 5, 17, 33, 34, 50, 63])
            values.add(x)
    values = sorted(values)
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    if thresholds:
        real = simhash.plan_search

        def fixed(frame, distance):
            n, both = simhash._co_occurrence(frame)
            return simhash.group_bits(n, both, len(thresholds)), list(thresholds)

        assert real(fps)[1]
        monkeypatch.setattr(simhash, "plan_search", fixed)
    edges = simhash.links(fps, 3, block=16)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    parts = {}
    for v, s, r in zip(values, signed, _reach(values, 3), strict=True):
        parts.setdefault(r, set()).add(s)
    expected = {frozenset(p) for p in parts.values() if len(p) > 1}
    found = {}
    for node, root in got.items():
        found.setdefault(root, {root}).add(node)
    assert {frozenset(p) for p in found.values()} == expected


def test_threshold_allocation():
    from itertools import product

    costs = [{-1: 0, 0: 50, 1: 60}, {-1: 0, 0: 1, 1: 2, 2: 1000}, {-1: 0, 0: 1, 1: 90}]
    for total in (-3, 0, 1, 3):
        cost, chosen = simhash.allocate(costs, total)
        best = min(sum(c[t] for c, t in zip(costs, ts, strict=True)) for ts in product(*costs) if sum(ts) == total)
        assert sum(chosen) == total and cost == best == sum(c[t] for c, t in zip(costs, chosen, strict=True))
    groups = simhash.group_bits(10, np.diag(np.arange(64.0) % 10), 3)
    assert sorted(b for g in groups for b in g) == list(range(64))


@pytest.mark.parametrize("codec", [tiff.PLAIN, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE, None])
def test_tiff_round_trip(codec):
    rng = np.random.default_rng(1)
    for size in (64, 640, 64 * 65, 64 * 700):
        for payload in (rng.integers(0, 256, size, np.uint8).tobytes(), (b"aaaab" * size)[:size], b"\0" * size):
            stored = tiff.encode_pages(payload, codec=codec, rows_per_page=300, rows_per_strip=100)
            pages = list(tiff.decode_pages(stored))
            assert b"".join(p[4] for p in pages) == payload and len(pages) == -(-size // (64 * 300))


def test_tiff_foreign_files():
    assert tiff.lzw_decode(bytes.fromhex("8001E0408044080C068080")) == b"\7\7\7\x08\x08\7\7\6\6"
    assert tiff.packbits_decode(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    pixels = np.arange(2 * 3 * 3, dtype=">u2").reshape(2, 3, 3)  # big-endian, RGB, 16 bits, predictor
    coded = np.concatenate([pixels[:, :1], np.diff(pixels, axis=1)], axis=1).astype(">u2").tobytes()
    tags = [(256, 3, 3), (257, 3, 2), (258, 3, 16), (259, 3, 1), (273, 4, 8), (277, 3, 3), (278, 3, 2), (279, 4, len(coded)), (317, 3, 2)]
    entries = b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags)
    file = b"MM\0*" + struct.pack(">I", 8 + len(coded)) + coded + struct.pack(">H", len(tags)) + entries + struct.pack(">I", 0)
    ((width, height, samples, _, got),) = tiff.decode_pages(file)
    assert (width, height, samples) == (3, 2, 3) and got == pixels.astype("<u2").tobytes()


def _lzw_by_strings(data):
    """Codes read from a string of bits, for comparison."""
    bits, at, table, out, last = "".join(f"{x:08b}" for x in data), 0, [], b"", None
    width = 9
    while True:
        code, at = int(bits[at : at + width], 2), at + width
        if code == 257:
            return out
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [None, None], 9, None
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last is not None:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


def _packbits_by_steps(data):
    out, rest = b"", list(data)
    while rest:
        n = rest.pop(0)
        if n < 128:
            out, rest = out + bytes(rest[: n + 1]), rest[n + 1 :]
        elif n > 128:
            out, rest = out + bytes(rest[:1]) * (257 - n), rest[1:]
    return out


def test_codecs_against_plain_decoders():
    rng = random.Random(8)
    for n in (0, 1, 2, 250, 260, 800, 3000, 20_000):
        for letters in (1, 3, 256):
            data = bytes(rng.randrange(letters) for _ in range(n))
            assert _lzw_by_strings(tiff.lzw_encode(data)) == data == tiff.lzw_decode(tiff.lzw_encode(data))
            assert _packbits_by_steps(tiff.packbits_encode(data)) == data == tiff.packbits_decode(tiff.packbits_encode(data))
            assert tiff.lzw_decode(tiff.lzw_encode(data), 100)[:100] == data[:100]


def test_tiff_form_does_not_depend_on_length():
    rng = random.Random(9)
    for n in (64, 6400, 64 * 3000):
        codecs = {next(tiff.decode_pages(tiff.encode_pages(bytes(rng.randrange(256) for _ in range(64)) + b"a" * (n - 64))))[3] for _ in range(20)}
        assert codecs == {tiff.LZW, tiff.PACKBITS, tiff.DEFLATE}


def test_tiff_features():
    rng = random.Random(10)
    for n in (64, 128, 6400):
        data = bytes(rng.randrange(40) for _ in range(n))
        mean = sum(data) / n
        spread = (sum((x - mean) ** 2 for x in data) / n) ** 0.5
        entropy = -sum(c / n * np.log2(c / n) for c in Counter(data).values())
        edges = [int(k * n / 72) for k in range(73)]
        cells = [sum(data[a:b]) / (b - a) if b > a else data[min(a, n - 1)] for a, b in zip(edges, edges[1:])]
        bits = "".join("1" if cells[9 * r + c + 1] > cells[9 * r + c] else "0" for r in range(8) for c in range(8))
        assert tiff.features(data) == f"mean={mean:.4f};std={spread:.4f};entropy={entropy:.4f};dhash={int(bits, 2):016x}"


def _damaged(**changes):
    """A page of 4 x 2 with some tags changed or left out."""
    tags = {256: 4, 257: 2, 258: 8, 259: 1, 273: 8, 277: 1, 278: 2, 279: 8} | {int(k[1:]): v for k, v in changes.items()}
    tags = {k: v for k, v in tags.items() if v is not None}
    entries = b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in sorted(tags.items()))
    return b"II*\0" + struct.pack("<I", 16) + bytes(range(8)) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0)


def test_damaged_tiffs_give_an_error(spark):
    whole = tiff.encode_pages(bytes(range(64)) * 40, codec=tiff.LZW)
    files = [_damaged(), _damaged(t256=None), _damaged(t257=0), _damaged(t322=0, t323=0, t324=8, t325=8), _damaged(t256=2_000_000, t257=2_000_000), _damaged(t256=2_000_000, t257=2_000_000, t278=2_000_000)]
    files += [_damaged(t259=5), _damaged(t259=8), _damaged(t259=77), _damaged(t279=4), _damaged(t273=None), _damaged(t273=4_000_000_000), _damaged(t277=0), _damaged(t258=1), _damaged(t317=3), whole[:100], whole[:9], b"II*\0"]
    files += [whole[:k] + bytes([whole[k] ^ 0xFF]) + whole[k + 1 :] for k in range(0, len(whole), 7)]
    table = spark.createDataFrame([(f"f{k:03d}", bytearray(x)) for k, x in enumerate(files)], "doc_id string, media binary")
    got = {r.doc_id: r for r in tiff.read_pages(table).collect()}
    assert len(got) >= len(files) - 2 and got["f000"].pixels == bytes(range(8))
    assert all(got[f"f{k:03d}"].error and got[f"f{k:03d}"].pixels is None for k in range(1, 17))


def test_tiff_query_with_text_ids(spark):
    table = spark.createDataFrame([("a", "x" * 100), ("b", None), (None, "é")], "doc_id string, text string")
    table.write.parquet(f"{(folder := _folder(spark))}/documents.parquet")
    assert {(r.doc_id, r.n_bytes, r.payload_bytes) for r in queries.op5_tiff(spark, folder).collect()} == {("a", 100, 128), ("b", 0, 64), (None, 2, 64)}


def test_tiff_rows(spark, docs):
    frame = spark.createDataFrame([(1, bytearray(b"no image")), (2, None), (3, bytearray(tiff.encode_pages(b"z" * 64 * 5, rows_per_page=2)))], "doc_id long, media binary")
    got = tiff.read_pages(frame).orderBy("doc_id", "page").collect()
    assert [(r.doc_id, r.page, r.error is None) for r in got] == [(1, 0, False), (3, 0, True), (3, 1, True), (3, 2, True)]
    docs.write.parquet(path := f"{_folder(spark)}/documents.parquet")
    for r in queries.op5_tiff(spark, path.removesuffix("/documents.parquet")).collect():
        bodies = {(x[1] or "").encode() for x in rows() if x[0] == r.doc_id}
        body = next(b for b in bodies if len(b) == r.n_bytes)
        payload = body.ljust(max(64, -(-len(body) // 64) * 64), b"\0")
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = tiff.encode_pages(payload)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), tiff.features(payload))


def _folder(spark):
    from tuyere.llm.shared import new_folder

    return new_folder(spark, "test")


def test_sharding(spark, docs, none):
    shards = [f"n{k}" for k in range(7)]
    table = sharding.lookup_table(shards, 101)
    counts = Counter(table)
    assert sorted(counts) == list(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(shards[:-1], 101)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 101 * 0.25
    claimed, order = {}, {k: iter([(sharding._number(f"offset:n{k}") + j * (sharding._number(f"skip:n{k}") % 100 + 1)) % 101 for j in range(101)]) for k in range(7)}
    while len(claimed) < 101:  # turn by turn, as described
        for k in range(7):
            if len(claimed) < 101:
                claimed[next(s for s in order[k] if s not in claimed)] = k
    assert [claimed[s] for s in range(101)] == table
    got = sharding.place(docs, shards, size=101).collect()
    assert len(got) == len(rows())
    for r in got:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard) == (slot, shards[table[slot]])
    assert sharding.place(none, shards, size=101).count() == 0
    sharding.write_shards(docs, shards, path := f"{_folder(spark)}/shards")
    assert spark.read.parquet(path).count() == len(rows())


def test_mixing(spark, docs, none):
    got = mixing.mix(docs).collect()
    size = lambda t: len((t or "").encode().split())
    source_size = Counter()
    for x in rows():
        source_size[x[3]] += size(x[1])
    order = sorted(source_size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(source_size.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * source_size[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 3.0 * source_size[s] for s in over}
        left -= sum(3.0 * source_size[s] for s in over)
        free -= over
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((x[0], size(x[1])) for x in rows())
    taken = Counter()
    for r in got:
        assert r.source_size == source_size[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.taken % max(1, r["size"]) == 0 and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in order:
        longest = max(size(x[1]) for x in rows() if x[3] == s)
        assert abs(taken[s] - target[s]) <= longest
    assert sorted(map(str, mixing.mix(docs.repartition(3)).collect())) == sorted(map(str, got))
    repeated = Counter(r.doc_id for r in mixing.repeat_documents(docs).collect())
    assert all(repeated[r.doc_id] % r.times == 0 if r.times else not repeated[r.doc_id] for r in got if r.doc_id != 135)
    assert mixing.mix(none).count() == 0


def test_html_text(spark):
    weights = html_text.learn(html_text.__dict__.get("LABELLED") or __import__("tuyere.llm.labelled_pages", fromlist=["LABELLED"]).LABELLED)
    assert all(weights[k] > 0 for k in html_text.WORD_KINDS) and all(v <= 0 for k, v in weights.items() if k.startswith("<"))
    body = "<p>One &amp; two &lt;x&gt;<br>three <b>bo</b>ld,\n next</p><p><b>open<br><p>last caf&eacute;</p>"
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body class='has-sidebar'><header>Site head</header><nav><ul><li><a href='/a'>Menu a</a></li></ul></nav><!-- c -->"
        f"<div class='ad'>Buy now</div><div id=cookie-notice>We use cookies</div><article><h1>Title here</h1>{body}<aside>Side</aside><div class='share-buttons'>Share</div><form>Mail <input></form></article>"
        "<section id='comments'><p>First! A long comment by some reader, with many words in it, and more of them.</p></section><div class='sidebar'>Popular</div><footer>&copy; foot <p>x</footer>"
    )
    expected = "Title here One & two <x> three bold, next open last café"
    assert html_text.main_text(page, weights) == expected
    assert html_text.main_text(page + "</body></html>", weights) == expected
    assert html_text.main_text("<nav>a b c</nav><article><h1>S</h1><p>&am &quo x", weights) == "S &am &quo x"
    assert html_text.main_text("plain words only", weights) == "plain words only"
    assert html_text.main_text("<nav>only menu</nav>", weights) == "" == html_text.main_text(None, weights) == html_text.main_text("<a href='", weights)
    frame = spark.createDataFrame([(1, "u", page, 9), (2, None, None, 9), (2, None, None, 9)], "page_id long, url string, html string, text long")
    got = html_text.extract(frame).orderBy("page_id").collect()
    assert [(r.text, r.n_chars) for r in got] == [(expected, len(expected)), ("", 0), ("", 0)]
    assert html_text.extract(frame.where("false")).count() == 0


def test_best_region_is_the_maximum():
    rng = random.Random(4)
    for _ in range(300):
        x = [rng.choice([-3, -1, 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        a, b = html_text.best_region(x)
        assert sum(x[a:b]) == max([0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1))])


def _hand_made_pages():
    links = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul>"
    prose = "The council met on Monday to discuss the plan for the new harbour and its cost to the town over the years."
    return {
        'div body': (f"<body><nav>{links}</nav><article><h1>Title</h1><div>{prose}</div><div>{prose}</div></article><footer>x</footer></body>", f"Title {prose} {prose}"),
        'div only': (f"<body><div>{links}</div><div><h1>Title</h1><div>{prose}</div><div>{prose}</div></div><div>Copyright 2020</div></body>", f"Title {prose} {prose}"),
        'list end': (f"<body><nav>{links}</nav><article><h1>Title</h1><p>{prose}</p><ul><li>one</li><li>two</li><li>three</li></ul></article><footer>x</footer></body>", f"Title {prose} one two three"),
        'list start': (f"<body><nav>{links}</nav><article><ul><li>one</li><li>two</li></ul><p>{prose}</p></article><footer>x</footer></body>", f"one two {prose}"),
        'table': (f"<body><nav>{links}</nav><article><h1>T</h1><p>{prose}</p><table><tr><td>1</td><td>2</td></tr></table></article></body>", f"T {prose} 1 2"),
        'quote': (f"<body><article><h1>T</h1><p>{prose}</p><blockquote>{prose}</blockquote><div class='byline'>By Ann</div></article></body>", f"T {prose} {prose} By Ann"),
        'bare': (f"<article>{prose}<br>{prose}</article>", f"{prose} {prose}"),
        'short': ("<body><article><h1>Hi</h1></article></body>", "Hi"),
        'main link': (f"<body><main><p>See <a href=x>all the figures of the report here</a>.</p></main></body>", "See all the figures of the report here."),
        'comments': (f"<body><article><h1>T</h1><p>{prose}</p><section class='comments'><p>{prose}</p></section></article><div id='comments'><p>{prose}{prose}</p></div></body>", f"T {prose}"),
        'cookie': (f"<body><div class='cookie-notice'><p>{prose}</p></div><article><h1>T</h1><p>a&nbsp;b &amp; c&#233;</p></article><form><p>{prose}</p></form></body>", "T a b & cé"),
        'two art': (f"<body><article><h1>T</h1><p>{prose}</p></article><aside><p>{prose}</p></aside><article><p>{prose}</p></article></body>", f"T {prose} {prose}"),
        'art comment': (f"<body><article><h1>T</h1><p>{prose}</p></article><article class='comment'><p>{prose}</p></article><article><p>Z z</p></article></body>", f"T {prose} Z z"),
        'bodytext': (prose, prose),
    }


def test_html_text_on_hand_made_pages():
    weights = html_text.learn(LABELLED)
    for name, (html, want) in _hand_made_pages().items():
        assert html_text.main_text(html, weights) == want, name


# Names of parts around articles.
_PART_NAMES = (
    "ad ads adbox adslot aside alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification overlay pager pagination popup promo promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget"
).split()


@pytest.mark.parametrize("name", _PART_NAMES)
def test_html_names_cut_parts_but_not_articles(name):
    weights = html_text.learn(LABELLED)
    prose = "The council met on Monday to discuss the plan for the harbour and its cost."
    wrappers = (
        f'<body><div class="layout has-{name}"><article><p>{prose}</p></article></div></body>',
        f'<div id="page" class="hfeed site no-{name}"><article><p>{prose}</p></article></div>',
        f'<div class="{name}-area-off content"><main><article><p>{prose}</p></article></main></div>',
        f'<body class="{name}"><div class="{name}"><h1>{prose}</h1></div></body>',
    )
    for page in wrappers:
        assert html_text.main_text(page, weights) == prose
    assert html_text.main_text(f'<article><p>{prose}</p><p class="{name}-board">{prose}</p></article>', weights) == f"{prose} {prose}"
    part = f'<div class="{name}"><p>{prose}</p></div>'
    for page in (f"<article><h1>Plan</h1>{part * 4}<p>{prose}</p></article>", f"<article><h1>Plan</h1><p>{prose}</p></article>{part}", f'<div id="{name}">{prose}</div><article><h1>Plan</h1><p>{prose}</p></article>'):
        assert html_text.main_text(page, weights) == f"Plan {prose}"


def test_html_formulas_and_open_elements():
    weights = html_text.learn(LABELLED)
    prose = "The council met on Monday to discuss the plan for the harbour and its cost."
    assert html_text.main_text(f"<article><p>{prose}</p><p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> is <svg><text>drawn</text></svg></p></article>", weights) == f"{prose} where x=2 is drawn"
    assert html_text.main_text(f"<article><div class='ad'>Buy<p>now</article><article><p>{prose}", weights) == prose
    assert html_text.main_text(f"<article><ul><li>one<li class='x'>two<li>three</ul><p>{prose}<div>end</div></article>", weights) == f"one two three {prose} end"
    deep = "<div class='ad'>" * 3000 + f"<article><h1>T</h1><p>{prose}</p></article>"
    assert html_text.main_text(deep, weights) == f"T {prose}"


def test_html_text_on_generated_pages(spark):
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        expected = " ".join(unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", article))).split())
        assert got[r.page_id] == expected


def test_lang_id(docs, none):
    got = lang_id.identify(docs).collect()
    data = {x[0]: x for x in rows()}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in data[r.doc_id][1] or ""):
            assert r.lang_pred == "und"
    clear = [r for r in got if r.held_out and r.doc_id < 90]
    assert sum(r.lang_pred == data[r.doc_id][2] for r in clear) >= 0.95 * len(clear)
    assert lang_id.identify(none).count() == 0
    assert {r.lang_pred for r in lang_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_lang_profiles_and_distance(docs):
    known = lang_id.profiles(docs)
    for lang in ("en", "de"):
        counts = Counter()
        for x in rows():
            if x[2] == lang and (got := lang_id.ngrams(x[1])):
                counts.update(dict(zip(*(v.tolist() for v in got), strict=True)))
        assert known[lang] == sorted(counts, key=lambda g: (-counts[g], g))[: lang_id.PROFILE_LENGTH]
    compare = lang_id.Comparison(known, lang_id.PROFILE_LENGTH)
    text = rows()[0][1]
    grams, n = lang_id.ngrams(text)
    own = sorted(range(len(grams)), key=lambda k: (-n[k], grams[k]))[:300]
    best = {}
    for lang, profile in known.items():
        rank = {g: k for k, g in enumerate(profile)}
        best[lang] = sum(min(400, abs(rank[g] - k)) if (g := grams[i]) in rank else 400 for k, i in enumerate(own))
    lang = min(sorted(best), key=best.get)
    assert compare.predict(text) == (lang, pytest.approx(1 - best[lang] / (400 * len(own))))
    short, long = lang_id.ngrams("ab cd " * 50), lang_id.ngrams("ab cd " * 50, block=7)
    assert all((a == b).all() for a, b in zip(short, long, strict=True))


def test_lm_score(docs, none):
    got = lm.score(docs).collect()
    tokens = lambda t: [*lm.words_of(t), b" "]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for x in rows() if not held(x[0]) for w in tokens(x[1]))
    n, v = sum(counts.values()), len(counts)
    expected = sorted((x[0], held(x[0]), len(tokens(x[1])), sum(w in counts for w in tokens(x[1])), n, round(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(x[1])), 6)) for x in rows())
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    long = [r for r in got if r.held_out and 0 <= r.doc_id < 90]
    assert sum(r.score for r in long) > sum(r.base_score for r in long)
    assert lm.score(none).count() == 0


def test_trained_lm_is_normalised_and_scores_as_defined(spark, docs):
    """All known words and one unseen word a class add up to one after any context; scores are sums over tokens."""
    model = lm.learn(docs, most_head=300, most_items=60)  # so that some words are outside the head
    head = model.head.ready()
    logs, inner = lm.log_table(model.first), lm.item_table(model.second, head.item_class)
    counts = {r.word.encode(): r.c for r in model.counts.collect()}
    assert len(counts) > 300 and len(head.words) <= 300
    sums = Counter()
    for w, c in counts.items():
        if (item := head.of_word(w)[1]) >= 60:
            sums[item] += c + 1

    def log_p(word, far, near):
        kind, item = head.of_word(word)
        out = logs[far * (lm.CLASSES + 1) + near, kind]
        if item >= 0:
            out += inner[near, item]
        if item >= 60:
            out += np.log10((counts.get(word, 0) + 1) / (sums[item] + 1))
        return float(out)

    one_unseen = {lm.ending_class(f"{a}{b}".encode()): f"unseen{a}{b}".encode() for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"}
    assert len(one_unseen) == lm.ENDINGS and not set(one_unseen.values()) & set(counts)
    for far, near in ((lm.CLASSES, lm.CLASSES), (lm.CLASSES, 1), (3, 150), (191, 0)):
        assert sum(10 ** log_p(w, far, near) for w in [*counts, *one_unseen.values()]) == pytest.approx(1, abs=1e-3)
    got = lm.score_by(docs.select("doc_id", "text", F.lit(False).alias("held_out")), model).collect()
    expected = []
    for x in rows():
        far = near = lm.CLASSES
        total = 0.0
        for w in [*lm.words_of(x[1]), b" "]:
            total += log_p(w, far, near)
            far, near = near, head.of_word(w)[0]
        expected.append((x[0], total))
    for (i, a), (j, b) in zip(sorted((r.doc_id, r.score) for r in got), sorted(expected), strict=True):
        assert i == j and a == pytest.approx(b, rel=1e-4, abs=1e-4)


def test_pipeline(spark, docs):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "piece_encoding"]
    plain = spark.createDataFrame(rows(), SCHEMA)
    known = corpus_pipeline.keep_known_language(spark, plain, "")
    assert known.columns == plain.columns
    assert Counter(r.doc_id for r in known.collect()) == Counter(x[0] for x in rows() if any(c.isalpha() for c in x[1] or ""))
    unique = corpus_pipeline.drop_exact_copies(spark, known, "")
    first = {}
    for x in sorted(rows(), key=lambda x: x[0]):
        if any(c.isalpha() for c in x[1] or ""):
            first.setdefault(_normal(x[1]), x)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(x[0] for x in first.values())
    left = sorted(first.values(), key=lambda x: x[0])
    root = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if _shingle_similarity(left[i][1], left[j][1]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    near = corpus_pipeline.drop_near_copies(spark, unique, "")
    assert sorted(r.doc_id for r in near.collect()) == sorted({left[k][0] for k in root})
    mixed = corpus_pipeline.mix_sources(spark, near, "")
    assert mixed.columns == plain.columns
    plan = {r.doc_id: r.times for r in mixing.mix(near).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == +Counter(plan)
    coded = corpus_pipeline.encode(spark, mixed, "").collect()
    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    texts = {x[0]: x[1] for x in left}
    expected = Counter({(i, tuple(model.encode(texts[i]))): n for i, n in plan.items() if n})
    assert Counter((r.doc_id, tuple(r.ids)) for r in coded) == expected
    folder = _folder(spark)
    plain.write.parquet(f"{folder}/documents.parquet")
    assert Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder).collect()) == expected
    plain.where("false").write.parquet(f"{(nothing := _folder(spark))}/documents.parquet")
    assert corpus_pipeline.run(spark, nothing).count() == 0


def _shingle_similarity(a, b, words=5):
    bags = [Counter(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) for w in ((x or "").encode().lower().split() for x in (a, b))]
    both = sum((bags[0] & bags[1]).values())
    return both / (sum(bags[0].values()) + sum(bags[1].values()) - both)


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    names = ["score", "held_out", "lang_pred", "__id", "__sha", "__hash", "row", "i", "text_", "slot", "times", "source_size"]
    table = spark.createDataFrame(rows(), SCHEMA).select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, table, "")
        assert got.columns == table.columns
        assert all(r[c] == f"{c}{r.doc_id}" for r in got.collect() for c in names)
    for key in ("shard", "slot", "doc_id"):
        placed = sharding.place(table.withColumn("shard", F.lit("s")), ["a", "b"], key_col=key, size=101)
        assert set(placed.columns) == {*table.columns, "shard"} and placed.count() == table.count()


def test_components_of_stars_and_chains(spark):
    edges = [(0, k) for k in range(1, 3000)] + [(k, k + 1) for k in range(5000, 5060)] + [(9000, 9001), (9001, 9000), (7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 3000)} | {k: 5000 for k in range(5001, 5061)} | {9001: 9000}
