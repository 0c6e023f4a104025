"""The trace against all simple paths, on graphs with cycles, hubs and anomalous nodes that make detours pay."""

import random

import pytest

from tuyere.operators import graph


def best_paths(edges, root, anomalous, hops, least):
    steps = {}
    for a, b, t, w in edges:
        steps.setdefault(b, []).append((a, w * graph.TRACE.get(t, 0.3)))
        if t == "coupling":
            steps.setdefault(a, []).append((b, w * 0.8))
    found, front = {}, [((root,), 1.0)]
    for _ in range(hops):
        new = []
        for path, s in front:
            for to, w in steps.get(path[-1], []):
                score = (s + (0.2 if to in anomalous else 0)) * w * 0.9
                if to not in path and score >= least:
                    new.append(((*path, to), score))
                    found[to] = max(found.get(to, (0, "")), (score, " → ".join((*path, to))))
        front = new
    return found


@pytest.mark.parametrize("seed", range(4))
def test_trace(spark, seed, monkeypatch):
    rng = random.Random(seed)
    nodes = [f"n{k:02}" for k in range(14)]
    kinds = list(graph.TRACE) + ["other"]
    edges = {(a, b): (a, b, rng.choice(kinds[:2] if seed % 2 else kinds), rng.choice((0.7, 0.9, 1.0))) for a, b in (rng.sample(nodes, 2) for _ in range(60))}
    edges = list(edges.values())
    anomalous = set(rng.sample(nodes, 7))
    if seed == 3:
        real = graph.representative
        monkeypatch.setattr(graph, "representative", lambda front, left, many=0: real(front, left, 0))  # in lots
    got = graph.trace(
        spark.createDataFrame(edges, "src string, dst string, type string, weight double"),
        spark.createDataFrame([("n00",), ("n01",)], "id string"),
        spark.createDataFrame([(x,) for x in anomalous], "id string"), 5, 0.2, 100, many=0 if seed else 100_000,
    ).collect()
    for root in ("n00", "n01"):
        want = best_paths(edges, root, anomalous, 5, 0.2)
        mine = {r.node: (r.score, r.path) for r in got if r.root == root}
        assert mine.keys() == want.keys()
        for node, (score, _) in want.items():
            assert mine[node][0] == pytest.approx(score, abs=1e-6)
            assert mine[node][1].startswith(root) and mine[node][1].endswith(node)


def test_few_paths_go_on(spark):
    """Of 400 paths to one node, less than ten can begin a best one."""
    rows = [("r", "x", 1 - k / 1000, ["r", f"a{k % 20}", f"b{k // 20}", "x"], 3) for k in range(400)]
    front = spark.createDataFrame(rows, "root string, node string, score double, path array<string>, hop_count int")
    kept = graph.representative(front, 2).collect()
    assert len(kept) <= 7 and max(r.score for r in kept) == 1.0
