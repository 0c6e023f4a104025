"""Filter audit, host rules and ranked search against plain Python versions, on fixtures with nulls, ties, copies, repeated and
very long rows, columns that clash, and empty tables; and the queries against their SQL."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from compare import difference
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tuyere.llm import filter_audit, host_rules, queries, ranked_search

SCHEMA = "doc_id long, text string, lang string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def rows():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)] + ["é", "漢字", "\x85x", "naïve", "A", "BC", "#", "a-b", "x_y", "1.5"]
    out = []
    for k in range(120):
        n = rng.choice((0, 3, 40, 60, 250, 400))
        out.append((k, " ".join(rng.choice(words[: rng.choice((5, 60, 410))]) for _ in range(n)), rng.choice(("en", "de", None, "")), f"s{k % 6}"))
    out += [(k, out[k % 7 + 20][1], "en", "s0") for k in range(120, 180)]  # a large group of copies
    out += [(180, None, None, None), (181, "", "en", None), (182, " \n\t\n x \n", "de", "s1"), (None, None, "en", "s2"), (None, out[20][1], "en", "s2"), (None, "lonely", "en", "s2"), (None, "lonely", "de", "s2")]
    out += [(183, "same same", "en", "s3"), (183, "same same", "en", "s3"), (183, "other", "de", "s3"), (184, "SAME Same\nSAME Same\n\nSAME same\r\nSAME Same", "en", "s3")]
    out += [(185, " ".join(rng.choice(words) for _ in range(60_000)), "en", "s4"), (186, "ab " * 50_000, "de", "s4"), (187, "\x1cw1\x1fw2 w3 w4 w5", "en", "s1")]
    out += [(200 + k, "spam & spam & spam " * 30 + str(k), "en", "junk") for k in range(40)] + [(260, " ".join(words), "en", "junk")]
    return out


LABELS = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 190, 2)] + [(4, 1, None), (5, None, 1), (5, 0, None), (None, 1, 1), (999, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    extra = ["mask", "Good", "digest", "host", "N_words", "Kept", "rank", "Score", "terms", "salt", "n", "part"]
    return spark.createDataFrame(rows(), SCHEMA).select("*", *[F.lit("x").alias(c) for c in extra]).repartition(5)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_first_failures():
    table, order = filter_audit.first_failures(5), filter_audit.orders(5)
    assert table.shape == (32, 120) and sorted(map(tuple, order)) == sorted(permutations(range(5)))
    for mask in range(32):
        for k, x in enumerate(order):
            steps = [s for s, f in enumerate(x) if mask >> f & 1]
            assert table[mask, k] == (steps[0] if steps else 5)


def audited():
    """The audit step by step, one order after the other."""
    seen: dict[str, list] = {}
    for i, text, _, _ in rows():
        seen.setdefault(text or "", []).append(math.inf if i is None else i)
    cases = []
    for i, text, lang, _ in rows():
        text = text or ""
        words = WORD.findall(text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if (math.inf if i is None else i) > min(seen[text]):
            fails.add("E")
        of = [x for x in LABELS if i is not None and x[0] == i]
        cases.append((lang or "", fails, any(x[1] == 1 for x in of), any(x[2] == 1 for x in of)))
    out, shares = {}, Counter()
    for part in {c[0] for c in cases}:
        for order in map("".join, permutations("ABCDE")):
            left = [c for c in cases if c[0] == part]
            whole = left
            for step, f in enumerate(order, 1):
                gone, left = [c for c in left if f in c[1]], [c for c in left if f not in c[1]]
                shares[part, f] += len(gone)
                failing = [c for c in whole if f in c[1]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(c[1] == {f} for c in whole), sum(c[2] for c in gone), sum(c[3] for c in gone)]
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(docs, labels):
    got = filter_audit.audit(docs, labels).collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[c] for c in filter_audit.COUNTS) for r in got}
    assert len(found) == len(got) == 3 * 120 * 5
    assert found == audited()


def test_audit_of_empty_tables(docs, labels):
    assert filter_audit.audit(docs.where("false"), labels).count() == 0
    got = filter_audit.audit(docs, labels.where("false"))
    assert got.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0 and got.count() == 1800


def test_interactions_of_few_filters_and_many_parts(spark):
    """Two filters, and more parts than a task holds."""
    rows = [(f"p{k}", k % 2 == 0, False, k % 4, k + 1) for k in range(600)]
    got = filter_audit.interactions(spark.createDataFrame(rows, "part string, good boolean, toxic boolean, mask int, n long").repartition(2), "XY").collect()
    assert len(got) == 600 * 2 * 2
    for r in got:
        k = int(r.part[1:])
        own, other = (1, 2) if r.filter_order[r.step - 1] == "X" else (2, 1)
        mask = k % 4
        removed = (k + 1) * bool(mask & own and not (r.step == 2 and mask & other))
        assert (r.removed, r.good_lost, r.unique_fails) == (removed, removed * (k % 2 == 0), (k + 1) * (mask == own))
        assert r.shapley == (k + 1) * {own: 2, 3: 1}.get(mask, 0)


def repeated_words(words):
    at = {}
    for k in range(len(words) - 2):
        at.setdefault(tuple(words[k : k + 3]), []).append(k)
    return len({k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(3)})


def of_text(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeated_words(words), len(lines)


@settings(max_examples=25, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(["a", "b", "c", "#", "&<", "é", "\n", " \n", "\t", "a\n", "\x0b", "\x1c"]), max_size=25).map(" ".join), min_size=1, max_size=20))
def test_text_counts(spark, texts):
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string").coalesce(1)
    got = host_rules.text_counts(df, "doc_id", "text", "source").collect()
    assert {r.doc_id: tuple(r)[2:] for r in got} == {k: of_text(t) for k, t in enumerate(texts)}


def test_host_rules(docs):
    got = host_rules.judge(docs).collect()
    of = {}
    for i, text, _, host in rows():
        n, chars, symbols, dup, rep, lines = of_text(text)
        fails = (n < 50, 100 * rep > 50 * n, 10 * symbols > n, 10 * dup > 3 * lines)
        of.setdefault(host, []).append((i, n, chars, symbols, dup, rep, fails))
    total, m = sum(map(len, of.values())), len(of)
    bad = set()
    for rule in range(4):
        f = {h: sum(x[6][rule] for x in xs) for h, xs in of.items()}
        mean = sum(f.values()) / total
        q = sum(f[h] ** 2 / len(of[h]) for h in of)
        between, within = (q - total * mean**2) / (m - 1), (sum(f.values()) - q) / (total - m)
        size = (total - sum(len(x) ** 2 for x in of.values()) / total) / (m - 1)
        alike = (between - within) / (between + (size - 1) * within) if between + (size - 1) * within else 0
        strength = min(1e4, max(10, 1 / alike - 1)) if alike > 0 else 1e4
        for h, xs in of.items():
            rate = (f[h] + mean * strength) / (len(xs) + strength)
            if rate - 2 * math.sqrt(rate * (1 - rate) / (len(xs) + strength + 1)) > 0.5:
                bad.add(h)
    expected = Counter((h, *x[:6], x[6][0] or x[6][1], not (x[6][0] or x[6][1] or h in bad)) for h, xs in of.items() for x in xs)
    assert Counter((r.host, r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == expected
    assert "junk" in bad and any(r.doc_id == 260 and not r.kept and not r.base_failed for r in got)
    assert "s5" not in bad and any(r.host == "s5" and r.kept for r in got)
    assert host_rules.judge(docs.where("false")).count() == 0


def test_few_rows_are_no_verdict(spark):
    """One failed document does not condemn its host; a host whose rows all fail goes once there are enough of them."""
    good, poor = " ".join(f"v{k}" for k in range(80)), "too short"
    rows = [(k, good, f"h{k % 20}") for k in range(400)] + [(500, poor, "new")] + [(600 + k, poor, "mill") for k in range(60)]
    got = host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("host").agg(F.max("host_failed").alias("bad"), F.max("rate_few_words").alias("rate")).collect()
    assert {r.host for r in got if r.bad} == {"mill"}
    assert 0.1 < next(r.rate for r in got if r.host == "new") < 1


ITEMS = [(1, "W1 w2, w3-w4 w1"), (2, "naïve 漢字 É é"), (3, None), (4, ""), (5, "?!"), (6, "unseen"), (7, "spam"), (7, "spam"), (None, "w5 x y 1 5"), (8, "ab"), (9, "a b c w1 w2 w7 w9 w11 w20")]


def ranked(most):
    fold = lambda t: TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, fold(t)) for i, t, _, _ in rows()]
    bags = [(i, Counter(x), len(x)) for i, x in bags if x]
    big_n, big_l = len(bags), sum(x[2] for x in bags)
    df = Counter(t for x in bags for t in x[1])
    out = []
    for item, text in ITEMS:
        scores = []
        for i, bag, n in bags:
            m = 75 + 25 * n * big_n // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m)) for t in fold(text) if t in bag)
            if s > 0:
                scores.append((-s, math.inf if i is None else i))
        out += [(item, k + 1, None if i == math.inf else i, -s) for k, (s, i) in enumerate(sorted(scores)[:most])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "terms", "most"), [(4096, 100_000, 20), (7, 100_000, 20), (16, 8, 3)])
def test_search(spark, docs, monkeypatch, window, terms, most):
    monkeypatch.setattr(ranked_search, "WINDOW", window)
    monkeypatch.setattr(ranked_search, "TERMS", terms)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("Rank", F.lit(1))
    got = ranked_search.search(docs, items, most=most)
    assert sorted(map(tuple, got.collect()), key=str) == ranked(most)


def test_search_of_empty_tables(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.search(docs.where("false"), items).count() == 0
    assert ranked_search.search(docs, items.where("false")).count() == 0
    assert ranked_search.search(docs.where("text is null"), items).count() == 0


def test_best_keeps_earlier_of_equal_scores():
    rng = np.random.default_rng(5)
    scores = rng.integers(0, 9, 3000)
    best = ranked_search.Best(20)
    for k in range(0, 3000, 100):
        best.put(scores[k : k + 100], np.arange(100), k)
    assert sorted((-s, -k) for s, k in best.heap) == sorted((-s, k) for k, s in enumerate(scores.tolist()) if s > 0)[:20]


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_host_rules", "op13_ranked_search"])
def test_query(spark, name):
    assert difference(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.001") == ""
