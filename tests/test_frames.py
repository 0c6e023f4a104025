"""Series queries against their twins when every series is cut into many buckets."""

import pytest
from compare import difference

from tuyere.catalogue import ORACLE_SQL, QUERIES
from tuyere.functions import frames
from tuyere.operators import impute

SF = "/root/testdata/sf0.001"
CUT = ["align_linear_hourly", "align_cubic", "impute_linear", "impute_spline", "impute_kalman", "outlier_rolling_mad", "outlier_ensemble", "outlier_replace_interpolation", "rolling_stats"]


@pytest.mark.parametrize("name", CUT)
def test_cut_series(spark, monkeypatch, name):
    monkeypatch.setattr(frames, "ROWS", 40)
    assert difference(spark, QUERIES[name], ORACLE_SQL[name], SF) == ""


def test_chunks_of_a_cut_series(spark, monkeypatch):
    monkeypatch.setattr(frames, "ROWS", 7)
    table = spark.range(100).selectExpr("'s' as series", "id * id as t", "id")
    rows = frames.chunked(table, "series", "t", ["t", "id"], 2, 3, 10).collect()
    assert sorted(r._i for r in rows if r._home) == list(range(100)) and all(r._i == r.id for r in rows)
    for c in range(10):
        assert sorted(r._i for r in rows if r._c == c) == list(range(max(0, 10 * c - 2), min(100, 10 * c + 13)))


def test_bursts_are_cut(spark, monkeypatch):
    """A series whose rows lie at few times but one far off has buckets of about as many rows each."""
    monkeypatch.setattr(frames, "ROWS", 100)
    table = spark.range(1000).selectExpr("cast(null as string) as series", "if(id = 999, 1000000000000, id) as t", "id")
    rows, many = frames.bucketed(table, "series", "t")
    sizes = [r["count"] for r in rows.groupBy("_b").count().collect()]
    assert many and 8 <= len(sizes) <= 12 and max(sizes) <= 150


def test_cubic_fill_cuts_a_series_once(spark, monkeypatch):
    """Buckets without a known value, or with one, take what they need from others; the rows are put in order once."""
    values = [(s, k, k, float(k * k) if k % m == 3 else None) for s, n, m in (("a", 400, 37), ("b", 90, 4), (None, 60, 50), ("d", 30, 99)) for k in range(n)]
    table = spark.createDataFrame(values, "series string, t long, id long, v double").repartition(3)
    whole = {(r.series, r.id): r.filled for r in impute.fill_cubic(table).collect()}
    monkeypatch.setattr(frames, "ROWS", 8)
    cuts = []
    monkeypatch.setattr(impute, "bucketed", lambda *a: cuts.append(a) or frames.bucketed(*a))
    cut = {(r.series, r.id): r.filled for r in impute.fill_cubic(table).collect()}
    assert len(cuts) == 1 and len(cut) == len(values) and set(cut) == set(whole)
    assert all(cut[k] == pytest.approx(whole[k], abs=1e-6) for k in whole)
    assert all(cut["a", k] == pytest.approx(k * k, abs=1e-6) for k in range(3 + 37, 336)) and cut[None, 59] == 53.0**2 and cut["d", 5] == 9.0
