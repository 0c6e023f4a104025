"""Components: small plans, and nodes with many links."""

from tuyere.llm import simhash

EDGES = [(0, k) for k in range(1, 3000)] + [(k, k + 1) for k in range(5000, 5060)] + [(9000, 9001), (9001, 9000), (7, 7)]
ROOTS = {k: 0 for k in range(1, 3000)} | {k: 5000 for k in range(5001, 5061)} | {9001: 9000}


def found(spark):
    return {r.node: r.root for r in simhash.components(spark.createDataFrame(EDGES, "a long, b long")).collect()}


def test_no_step_of_components_has_a_large_plan(spark, monkeypatch):
    """The driver keeps metrics of every task of every operator, so a step that computes its inputs anew fills it."""
    joins, real = [], simhash.written

    def written(df, name):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return real(df, name)

    monkeypatch.setattr(simhash, "written", written)
    assert found(spark) == ROOTS
    assert max(joins) <= 3


def test_links_of_a_node_with_many_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MANY", 50)
    assert found(spark) == ROOTS
