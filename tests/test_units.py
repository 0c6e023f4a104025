"""Small fixtures with values worked out by hand."""

import json

import zlib

import pytest
from pyspark.sql import functions as F

from tuyere.functions import frames, names, special
from tuyere.operators import align, impute, mapping, metrics, outliers, scale, stats
from tuyere.plans import preprocessing
from tuyere.sources import catalog
from tuyere.streaming import channels, streams

S = 1_000_000


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame([("a", k * S, k, v) for k, v in enumerate([None, 2.0, None, 4.0, None])], "series string, t long, id long, v double")


def filled(df, column="filled"):
    return [r[column] for r in df.orderBy("id").collect()]


def test_fills(five):
    assert filled(impute.fill_linear(five)) == [2, 2, 3, 4, 4]
    assert filled(impute.fill_forward(five)) == [None, 2, 2, 4, 4]
    assert filled(impute.fill_backward(five)) == [2, 2, 4, 4, None]
    assert filled(impute.fill_nearest(five)) == [None, 2, 2, 4, None]


def test_exact_grid(spark):
    df = spark.createDataFrame([("a", k * 5 * S, k, v) for k, v in enumerate([25.3, 25.5, 26.1, 26.8])], "series string, t long, id long, v double")
    got = align.align(df, step=5 * S).orderBy("t").collect()
    assert [(r.v, r.status) for r in got] == [(25.3, "EXACT_MATCH"), (25.5, "EXACT_MATCH"), (26.1, "EXACT_MATCH"), (26.8, "EXACT_MATCH")]
    assert align.align(df.where("false")).count() == 0


def test_buckets_and_chunks_change_nothing(spark, monkeypatch):
    df = spark.range(400).select(F.lit("a").alias("series"), (F.col("id") * 7 * S).alias("t"), "id", F.when(F.col("id") % 5 > 0, F.sin("id") * 10).alias("v"))
    for f in (lambda n: outliers.rolling_mad(df, chunk=n), lambda n: outliers.moving_average(df, factor=1.2, chunk=n), lambda n: outliers.exponential(df, factor=1.5, reach=40, chunk=n)):
        assert filled(f(50), "is_outlier") == filled(f(100_000), "is_outlier")
    assert True in filled(outliers.moving_average(df, factor=1.2), "is_outlier")
    whole = filled(impute.fill_linear(df))
    monkeypatch.setattr(frames, "ROWS", 43)
    assert filled(impute.fill_linear(df)) == whole


def test_times(spark):
    raw = ["2024-01-01T10:00:00Z", "1704108010", "1704108010000", "2024-01-01 10:00:20", "2024-01-01T12:00:00+02:00", "nonsense", None]
    got = align.parse_times(spark.createDataFrame([(x,) for x in raw], "raw string")).collect()
    base = 1_704_103_200 * S
    assert [r.t for r in got] == [base, 1_704_108_010 * S, 1_704_108_010 * S, base + 20 * S, base, None, None]


def test_scaling_inverts(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (9.0, 5.0)], "x double, y double")
    for m in ("zscore", "mad", "minmax", "robust"):
        p = scale.parameters(df, ["x", "y"], m)
        back = scale.apply(scale.apply(df, p, ["x", "y"]), p, ["x", "y"], inverse=True)
        assert sorted((round(r.x, 9), round(r.y, 9)) for r in back.collect()) == [(1, 5), (2, 5), (4, 5), (9, 5)]


def test_p_values(spark):
    assert special.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert special.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    df = spark.createDataFrame([(float(k), float(k * 2 + k % 3), 1.0) for k in range(20)], "a double, b double, c double")
    got = {(r.a, r.b): r for r in stats.p_values(stats.pearson(df, ["a", "b", "c"])).collect()}
    assert got["a", "b"].p < 1e-6 and got["a", "c"].r is None and got["a", "c"].p == 1.0


def test_names(spark):
    raw = ["Blast Furnace (No.1)", "9 lives", "select", "  ", "Über-Größe", "x" * 70, "", None, "values", "「a」【b】", "a" * 49 + "-b"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "s string").select(names.normalise_name(F.col("s"))).collect()]
    assert got == ["blast_furnace_no_1", "t_9_lives", "select_col", "", "über_größe", "x" * 50, "unnamed", "unnamed", "values", "a_b", "a" * 49]
    long = spark.range(1).select(names.table_name(*[F.lit(c * 30) for c in "abcd"])).first()[0]
    raw_name = "_".join(c * 30 for c in "abcd")
    assert long == "_".join(c * 13 for c in "abcd") + "_" + format(zlib.crc32(raw_name.encode()), "05x")[-5:]
    spaced = spark.range(1).select(names.table_name(*[F.lit("x" * 12 + " " + c * 20) for c in "abcd"])).first()[0]
    assert spaced.startswith("x" * 12 + "__" + "x" * 12 + "_")


def test_features_and_pools(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (5.0,)], "x double")
    got = [r.features[0] for r in mapping.assemble(df, ["x"]).collect()]
    assert sum(got) == pytest.approx(0, abs=1e-6) and sum(x * x for x in got) / 4 == pytest.approx(1, abs=1e-6)
    assert mapping.pool_of(["timestamp", "value"]) == "Continuous time-series data" and mapping.pool_of(["image_id", "capture_time"]) == "Image data"
    out, left = mapping.apply_rules(spark.createDataFrame([(1, 2)], "a long, b long"), {"a": ("param_a", 1.0)})
    assert out.columns == ["param_a"] and left == ["b"]


def test_survey_and_overlap(spark):
    df = spark.createDataFrame([("q1", "3", "4", "7"), ("q2", "3", "4", "8"), ("q3", "x", "1", "1")], "question string, yes string, no string, total string")
    assert sorted(map(tuple, metrics.survey_links(df).collect())) == [("q1", "No", 4), ("q1", "Yes", 3)]
    df = spark.createDataFrame([("1", "x"), ("3", "x"), ("1", "y"), ("2", "y"), ("3", "y"), ("2", None)], "s string, i string")
    assert sorted(map(tuple, metrics.overlap(df, "s", "i", ["1", "2", "3"]).collect())) == [("1&2&3", 1), ("1&3", 1)]


def test_pipeline(spark, five):
    config = preprocessing.Config(steps=("missing", "unheard", "outliers", "normalise"))
    got = preprocessing.run(five, config)
    assert config.warnings == ["unknown step unheard"] and [x is not None for x in filled(got, "v")] == [True] * 5
    batch = preprocessing.run_batch({"good": five, "bad": five.drop("v")})
    assert isinstance(batch["bad"], str) and not isinstance(batch["good"], str)


def test_dictionary_document(spark, tmp_path):
    doc = {"base_work_types": [{"work_type_en": "W", "work_type_zh": "w", "no": 1}], "categories": [], "pools": [{"pool_en": "P", "pool_zh": "p"}], "datasets": [], "attribute_templates": {"P": {"attribute_1": "Unit"}}}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    got = catalog.read_dictionary(spark, str(tmp_path / "d.json"))
    assert got["base_work_types"].first().work_type_en == "W" and got["attributes"].first().fields == {"attribute_1": "Unit"}
    assert catalog.validate_dictionary(json.dumps(doc)) == []
    assert catalog.validate_dictionary('{"pools": {}}') == ["base_work_types is missing", "categories is missing", "pools is no list", "datasets is missing", "attribute_templates is missing"]


def test_streams(spark, tmp_path):
    spark.createDataFrame([(k, "a", float(k % 3) + (100 if k == 29 else 0)) for k in range(30)], "s long, key string, v double").select(F.timestamp_seconds(F.col("s") * 600).alias("ts"), "key", "v").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("ts timestamp, key string, v double").parquet(str(tmp_path / "in"))
    q = streams.tumbling(stream(), "ts", "key", "v").writeStream.format("memory").queryName("tumbled").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tumbled").agg(F.sum("n")).first()[0] == 30 and spark.table("tumbled").count() == 5
    q = channels.running_anomalies(stream(), "key", "v").writeStream.format("memory").queryName("odd").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r.value for r in spark.table("odd").where("is_anomaly").orderBy("value").collect()] == [2.0, 102.0]  # the third of 0, 1, 2 is far from the first two
    loop = streams.ClosedLoop(collect=lambda df: df.where("v > 0"), analyse=lambda df: 1 / 0, act=lambda df: df.limit(3))
    assert loop(spark.read.parquet(str(tmp_path / "in"))).count() == 3
    assert [(p, s) for _, p, s, _ in loop.history] == [("collect", "done"), ("analyse", "failed"), ("act", "done")]


def test_pending_tables_and_incremental_import(spark, tmp_path):
    from tuyere.operators import imports

    schema = "work_type string, category string, pool string, dataset string, ordinal int"
    d = spark.createDataFrame([("w", "c", "p1", "a", 1), ("w", "c", "p2", "b", 2)], schema)
    tables = spark.createDataFrame([("p1", "pending"), ("p2", "created"), ("p9", "pending")], "pool string, status string")
    path = f"file://{tmp_path}/tables"
    built = imports.build_pending(tables, d, path)
    assert {tuple(r) for r in built.select("pool", "status").collect()} == {("p1", "created"), ("p2", "created"), ("p9", "failed")}
    assert {r.dataset for r in spark.read.parquet(path).collect()} == {"a"}
    new, after = imports.incremental_import(d, spark.createDataFrame([("w", "c", "p2", "n", 3), ("w", "c", "p1", "a", 4)], schema), built, path)
    assert {r.dataset for r in new.collect()} == {"a", "b", "n"}
    assert {tuple(r) for r in after.select("pool", "status").collect()} == {("p1", "created"), ("p2", "created"), ("p9", "failed")}
    assert {r.dataset for r in spark.read.parquet(path).collect()} == {"a", "b", "n"}
    sheet = spark.createDataFrame([(1, "w", "c", None, "t1"), (2, "w", "c", "named", "t2")], "ordinal int, work_type string, category string, dataset string, id string")
    assert [r.dataset for r in imports.fixed_pool_sheet(sheet, "Text data", "id").orderBy("ordinal").collect()] == ["t1", "named"]


def test_time_column(spark):
    df = spark.createDataFrame([("x", "2024-01-01", 1.0), ("2024-01-02", None, 2.0)], "bad_time string, start_date string, v double")
    assert stats.time_column(df) == "start_date"
    assert stats.time_column(df.select("v", "bad_time")) is None
    assert stats.time_column(df.select("v", F.current_timestamp().alias("at"))) == "at"
