"""The pipeline's near-dedup stage against brute-force similarities, on scattered word changes around a similarity of 0.8."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from tuyere.llm import near_copies, simhash


def _similar(a, b, words=5):
    bags = [Counter(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) for w in (a.lower().split(), b.lower().split())]
    both = sum((bags[0] & bags[1]).values())
    return both / (sum(bags[0].values()) + sum(bags[1].values()) - both)


def _pairs(n, seed=5):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(200)]
        other = list(words)
        for at in rng.sample(range(200), k % 9):
            other[at] = f"x{rng.randrange(3000)}"
        out.append((" ".join(words), " ".join(other)))
    return out


def test_scattered_changes_are_near_copies(spark):
    pairs = _pairs(270)
    rows = [(2 * k + j, text) for k, pair in enumerate(pairs) for j, text in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    similar = [_similar(*pair) for pair in pairs]
    assert {2 * k for k in range(len(pairs))} <= kept
    assert 100 < sum(s >= 0.8 for s in similar) < 200
    assert [2 * k + 1 not in kept for k in range(len(pairs))] == [s >= 0.8 for s in similar]
    three_bits = sum((simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= 3 for (a, b), s in zip(pairs, similar, strict=True) if 0.8 <= s < 1)
    assert three_bits < sum(0.8 <= s < 1 for s in similar) / 2


def test_band_recall():
    pairs = [(near_copies.bag(a), near_copies.bag(b)) for a, b in _pairs(4500, 6)]
    close = [(a, b) for a, b in pairs if 0.8 <= near_copies.similarity(a, b) < 1]
    met = [bool(np.any(near_copies.bands(a) == near_copies.bands(b))) for a, b in close]
    assert len(close) > 1000 and sum(met) >= 0.999 * len(met)


def test_groups_by_brute_force_in_blocks(spark):
    rng = random.Random(7)
    base = [f"b{k}" for k in range(150)]
    texts = []
    for _ in range(60):  # a chain: each text changes a word of some earlier one
        w = list(rng.choice(texts)) if texts else base
        w = list(w)
        w[rng.randrange(150)] = f"y{rng.randrange(999)}"
        texts.append(w)
    texts = [" ".join(w) for w in texts] + ["a b c", "A  b C", "", None, "a b c " * 40, "a b c " * 20, "a b c"]
    rows = list(enumerate(texts))
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if _similar(texts[i] or "", texts[j] or "") >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.groups(docs).collect()} == dict(enumerate(root))
    sets = [near_copies.bag(x) for x in texts]
    assert len(texts) == len(near_copies.linked(sets, 0.8)) + len(set(root))
    nodes = near_copies._bags(docs, "doc_id", "text", 5).dropDuplicates(["fp"])
    edges = near_copies.links(docs, nodes, block=1000)  # about nine blocks
    least = {near_copies._signed([near_copies._name(x)])[0]: root[k] for k, x in reversed(list(enumerate(sets)))}
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert len({least[x] for x in found}) == len(set(found.values())) and all(least[x] == least[y] for x, y in found.items())
    assert len({found.get(x, x) for x in least}) == len(set(root))
    assert near_copies.groups(docs.limit(0)).count() == 0


def test_simhash_links_come_first(spark, monkeypatch):
    """Texts of a changed word are linked by their SimHash alone; what it misses comes by bands, compared across groups only."""
    rng = random.Random(3)
    texts = []
    for k in range(40):
        words = [f"v{rng.randrange(5000)}" for _ in range(600)]
        texts += [" ".join(words), " ".join([*words[:-1], "changed"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = near_copies._bags(docs, "doc_id", "text", 5)
    bags = {near_copies._signed([near_copies._name(b)])[0]: b for b in map(near_copies.bag, texts)}
    assert {r.fp: r.print for r in nodes.collect()} == {k: near_copies._signed([near_copies.print_of(b)])[0] for k, b in bags.items()}
    assert near_copies.print_of(near_copies.bag(texts[0])) == simhash.fingerprint(texts[0], words=5)
    close = near_copies.close_prints(nodes).collect()
    assert len(close) >= 35 and all(near_copies.similarity(bags[r.a], bags[r.b]) >= 0.8 for r in close)
    monkeypatch.setattr(near_copies, "bands", lambda found: np.array([int(found[0] >> np.uint64(1))] * 24, np.int64))  # no bands of use
    assert len({r.component_id for r in near_copies.groups(docs).collect()}) <= 45
    sets = [near_copies.bag(x) for x in texts[:4]]
    assert near_copies.linked(sets, 0.8, np.array([0, 0, 1, 1])) == []
    assert len(near_copies.linked([sets[0], sets[2], sets[1]], 0.8, np.array([0, 0, 1]))) == 1


def test_long_chunks_and_large_texts_are_not_kept():
    import pyarrow as pa

    from tuyere.llm import pieces, shared
    from tuyere.llm.queries import tokenizer_file

    model = pieces.PieceModel(tokenizer_file("piece_bpe_32k.model"))
    model.encode("x" * 5000 + " short words")
    assert model.memo and max(map(len, model.memo)) <= pieces.LONGEST_KEPT
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 30, None, "b" * 80, "", "c" * 200, "d"])], ["text"])
    cut = [b.column(0).to_pylist() for b in shared.light_slices([batch], 0, rows=3, size=100)]
    assert [len(c) for c in cut] == [2, 2, 1, 1] and sum(cut, []) == batch.column(0).to_pylist()
