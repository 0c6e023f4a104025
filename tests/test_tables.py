"""Routing by column kind, scalers by name and method, registers, templates, documents, logs and settings, on small fixtures."""

import json
import math
import uuid

import pytest
from pyspark.sql import functions as F

from tuyere.operators import align, imports, mapping, plots, registry, scalers
from tuyere.plans import preprocessing
from tuyere.sources import catalog


def messy(spark):
    rows = [(k, f"2024-01-{1 + k // 24:02} {k % 24:02}:00:00", None if k % 9 == 4 else float(k), None if k % 7 == 2 else 2.0 * k + 1, None if k % 10 == 3 else "ab"[k % 3 == 0], None if k % 11 == 5 else k % 4, f"t{k}") for k in range(200)]
    return spark.createDataFrame(rows, "id long, s string, a double, b double, kind string, few int, note string").withColumn("sample_time", F.to_timestamp("s")).drop("s")


def test_fill_table_by_time(spark):
    df = messy(spark)
    out, report = preprocessing.fill_table(df, "id")
    assert out.columns == df.columns and out.dtypes == df.dtypes
    rows = {r.id: r for r in out.collect()}
    assert all(r.a == pytest.approx(r.id) and r.b == pytest.approx(2 * r.id + 1) for r in rows.values())
    assert all(rows[k].kind == "a" for k in range(3, 200, 10)) and all(r.few is not None for r in rows.values())
    assert {r.column_name: (r.kind, r.remaining, r.rate) for r in report.collect()} == {"a": ("numeric", 0, 1.0), "b": ("numeric", 0, 1.0), "kind": ("categorical", 0, 1.0), "few": ("categorical_numeric", 0, 1.0)}


def test_fill_table_without_time(spark):
    """Then other columns tell: by equations or by nearest rows."""
    df = messy(spark).select("id", "a", "b")
    for config in (preprocessing.Config(), preprocessing.Config(use_equations=False)):
        rows = preprocessing.fill_table(df, "id", config)[0].collect()
        known = [r for r in rows if r.id % 9 == 4 and r.id % 7 != 2]
        assert all(abs(r.a - r.id) < (2 if config.use_equations else 6) for r in known)
        assert all(r.a is not None and r.b is not None for r in rows)


def test_run_tables(spark):
    p = f"mill{uuid.uuid4().hex[:8]}_"
    messy(spark).write.saveAsTable(f"{p}one")
    spark.createDataFrame([("x",)], "word string").write.saveAsTable(f"{p}two")  # no id
    config = preprocessing.Config(steps=("missing", "outliers", "normalise", "polish"))
    got = preprocessing.run_tables(spark, p, "id", config, log=f"{p}log")
    assert got[f"{p}one"] == "done", got
    assert "id" in got[f"{p}two"] and config.warnings[0] == "unknown step polish"
    clean = spark.table(f"{p}one_clean")
    assert clean.count() == 200 and abs(clean.agg(F.avg("a")).first()[0]) < 1e-9
    assert {r.table_name: r.status for r in spark.table(f"{p}log").collect()} == {f"{p}one": "done", f"{p}two": "failed"}
    info = catalog.table_info(spark, f"{p}one").collect()
    assert {(r.table_name, r.n_rows) for r in info} == {(f"{p}one", 200), (f"{p}one_clean", 200)}
    assert catalog.clear_table(spark, f"{p}one") == 200 and spark.table(f"{p}one").count() == 0 and "a" in catalog.list_columns(spark, f"{p}one")
    assert sorted(catalog.drop_tables(spark, p)) == [f"{p}{t}" for t in ("log", "one", "one_clean", "two")]
    with pytest.raises(ValueError):
        catalog.drop_tables(spark, "")


def test_config():
    c = preprocessing.Config.from_json('{"steps": ["missing"], "neighbours": 3, "colour": 1}')
    assert c.steps == ("missing",) and c.neighbours == 3 and c.warnings == ["unknown setting colour"]
    assert preprocessing.Config.from_json(c.to_json()).steps == ("missing",)
    e = preprocessing.Config.from_environment(environment={"TUYERE_STEPS": "missing, normalise", "TUYERE_BY_SERIES": "false", "OTHER": "1"})
    assert e.steps == ("missing", "normalise") and e.by_series is False and e.warnings == []


@pytest.mark.parametrize("method", scalers.METHODS)
def test_scalers(spark, tmp_path, method):
    values = [3.0, -1.0, 0.0, 7.5, 7.5, 12.0, 100.0, None, math.nan]
    df = spark.createDataFrame([(k, v, 2.0) for k, v in enumerate(values)], "id long, x double, x2 double")
    scaled, p, figures = scalers.normalise(df, ["x", "x2"], method)
    scalers.save(p, f"{tmp_path}/p")
    p = scalers.load(spark, f"{tmp_path}/p")
    back = {r.id: r.x for r in scalers.transform(scaled, p, ["x"], method, inverse=True).collect()}
    for k, v in enumerate(values):
        assert back[k] is None if v is None or v != v else back[k] == pytest.approx(v, rel=1e-6, abs=1e-6)
    other = next(m for m in scalers.METHODS if m != method)
    assert scalers.transform(scaled, p, ["x"], other, inverse=True).exceptAll(scaled).count() == 0  # no parameters of that method
    assert scalers.transform(scaled, p.where("name = 'x2'"), ["x"], method).exceptAll(scaled).count() == 0  # nor of that name
    by = {(r.stage, r.name): r for r in figures.collect()}
    assert by["before", "x"].median == 7.5 and by["before", "x"].largest == 100
    if method == "zscore":
        assert abs(by["after", "x"]["mean"]) < 1e-12
    if method in ("minmax", "quantile"):
        assert (by["after", "x"].least, by["after", "x"].largest) == (0, 1)
    if method == "log":
        assert by["after", "x"].least == 0


def test_registers(spark):
    r = spark.createDataFrame([("a", 1, "u"), ("b", 2, "u")], "name string, no int, kind string")
    new = spark.createDataFrame([("a", 9, "u"), ("c", 3, "w"), ("c", 4, "u"), ("", 5, "u"), ("d", 2, "u")], "name string, no int, kind string")
    out, told = registry.add(r, new, ["name"])
    assert sorted(x.name for x in out.collect()) == ["a", "b", "c", "d"]
    assert sorted((x.name, x.no, x.reason) for x in told.where("not ok").collect()) == [("", 5, "empty key"), ("a", 9, "exists already"), ("c", 4, "repeated")]
    out, _ = registry.add(r, new, ["name"], overwrite=True)
    assert {x.name: x.no for x in out.collect()} == {"a": 9, "b": 2, "c": 3, "d": 2}
    out, told = registry.add_under(r, new, ["name"], spark.createDataFrame([("u",)], "kind string"), "kind", unique="no")
    assert {x.name for x in out.collect()} == {"a", "b"}
    assert {(x.name, x.no): x.reason for x in told.collect()} == {("a", 9): "exists already", ("c", 3): "unknown kind", ("c", 4): "repeated", ("", 5): "empty key", ("d", 2): "no is taken"}
    out, told = registry.update(r, spark.createDataFrame([("a", "z", 7), ("b", None, 8), ("x", None, 1)], "name string, new_name string, new_no int"), ["name"])
    assert {x.name: x.no for x in out.collect()} == {"a": 1, "b": 8}
    assert {x.name: x.reason for x in told.collect()} == {"a": "the key must not change", "b": None, "x": "not found"}
    out, told = registry.delete(r, spark.createDataFrame([("a",), ("q",)], "name string"), ["name"])
    assert [x.name for x in out.collect()] == ["b"] and {x.name: x.ok for x in told.collect()} == {"a": True, "q": False}
    keys = spark.createDataFrame([(" Pool  A ", None, "x")], "p string, q string, r string").select(registry.joined_key("p", "q", "r").alias("k")).first().k
    assert keys == "Pool A | x"


def test_compare_templates(spark):
    old = spark.createDataFrame([("a", {"x": "1", "y": "2"}), ("b", {"x": "1"}), ("c", {})], "pool string, fields map<string,string>")
    new = spark.createDataFrame([("a", {"y": "2", "x": "1"}), ("b", {"x": "3"}), ("d", {"x": "1"})], "pool string, fields map<string,string>")
    assert {r.pool: r.change for r in registry.compare_templates(old, new).collect()} == {"a": "same", "b": "changed", "c": "removed", "d": "added"}


def test_documents(spark, tmp_path):
    levels = {
        "base_work_types": spark.createDataFrame([(1, "smelt", "冶", 2), (0, "roll", "轧", 1)], "ordinal int, work_type_en string, work_type_zh string, no int"),
        "categories": spark.createDataFrame([(0, "smelt", "heat", "热")], "ordinal int, work_type_en string, category_en string, category_zh string"),
        "pools": spark.createDataFrame([(0, "text", "文")], "ordinal int, pool_en string, pool_zh string"),
        "datasets": spark.createDataFrame([(0, "smelt", "heat", "text", "log", "日志", None)], "ordinal int, work_type_en string, category_en string, pool_en string, dataset_en string, dataset_zh string, dataset_zh_short string"),
    }
    catalog.write_dictionary(levels, spark.createDataFrame([("text", {"author": "string"})], "pool_en string, fields map<string,string>"), f"{tmp_path}/d")
    back = catalog.read_dictionary(spark, f"{tmp_path}/d")
    assert [r.work_type_en for r in back["base_work_types"].orderBy("ordinal").collect()] == ["roll", "smelt"]
    assert back["datasets"].first().dataset_zh == "日志" and back["attributes"].first().fields == {"author": "string"}
    text = spark.read.text(f"{tmp_path}/d").first().value
    assert catalog.validate_dictionary(text) == []
    with pytest.raises(ValueError):
        catalog.write_dictionary(levels, back["attributes"], f"{tmp_path}/e", most=2)
    catalog.save_scenario(spark.createDataFrame([("n1", 0, 1.0, False), ("n1", 1, 5.0, True)], "id string, timestep int, value double, is_anomaly boolean"), f"{tmp_path}/s", kind="abnormal", seed=3)
    assert spark.read.json(f"{tmp_path}/s/statistics").first().anomalies == 1
    assert {r.key: r.value for r in spark.read.json(f"{tmp_path}/s/metadata").collect()} == {"kind": "abnormal", "seed": "3"}
    doc = json.loads(catalog.results_json(spark.createDataFrame([("b", 0.123456), ("a", 0.9)], "name string, s double"), "q").first().document)
    assert doc == {"query": "q", "n": 2, "results": [{"rank": 1, "name": "a", "score": 0.9}, {"rank": 2, "name": "b", "score": 0.1235}]}


def test_dictionary_of_several_documents(spark, tmp_path):
    name = lambda c: F.concat(F.lit(c), F.col("id").cast("string"))
    none = F.lit(None).cast("string")
    levels = {
        "base_work_types": spark.range(2).select((F.col("id") * 5).alias("ordinal"), name("w").alias("work_type_en"), none.alias("work_type_zh"), F.lit(1).alias("no")),
        "categories": spark.range(0).select(F.col("id").alias("ordinal"), none.alias("work_type_en"), none.alias("category_en"), none.alias("category_zh")),
        "pools": spark.range(12).select((-F.col("id")).alias("ordinal"), name("p").alias("pool_en"), none.alias("pool_zh")),
        "datasets": spark.range(25).select((F.col("id") * 2).alias("ordinal"), *[none.alias(c) for c in ("work_type_en", "category_en", "pool_en")], name("d").alias("dataset_en"), none.alias("dataset_zh"), none.alias("dataset_zh_short")),
    }
    attributes = spark.range(12).select(name("p").alias("pool_en"), F.create_map(F.lit("k"), name("v")).alias("fields"))
    catalog.write_dictionary(levels, attributes, f"{tmp_path}/d", entries=10)
    back = catalog.read_dictionary(spark, f"{tmp_path}/d")
    assert [(r.ordinal, r.dataset_en) for r in back["datasets"].orderBy("ordinal").collect()] == [(k, f"d{k}") for k in range(25)]
    assert [(r.ordinal, r.pool_en) for r in back["pools"].orderBy("ordinal").collect()] == [(k, f"p{11 - k}") for k in range(12)]
    assert back["categories"].count() == 0 and back["base_work_types"].count() == 2
    assert {r.pool_en: r.fields for r in back["attributes"].collect()} == {f"p{k}": {"k": f"v{k}"} for k in range(12)}
    assert all(catalog.validate_dictionary(r.value) == [] for r in spark.read.text(f"{tmp_path}/d").collect())


def test_ddl_of_clashing_names():
    got = catalog.ddl_columns([("value", "double"), ("id", "string"), ("ID_attr", "int"), ("id", "int")])
    assert [c for c, _ in got] == ["id", "created_at", "value", "id_attr", "ID_attr_attr", "id_attr2"]


def test_logs(spark):
    aligned = align.align(spark.createDataFrame([("a", 0, 1, 1.0), ("a", 2 * align.HOUR, 2, 3.0)], "series string, t long, id long, v double"))
    name = f"align{uuid.uuid4().hex[:8]}"
    catalog.append_rows(catalog.alignment_log(aligned, "t", "b1", "linear"), name)
    catalog.append_rows(catalog.alignment_log(aligned, "t", "b2", "linear"), name)
    rows = spark.table(name).where("batch_id = 'b2'").orderBy("aligned_t").collect()
    assert [(r.source_t, r.is_interpolated) for r in rows] == [(0, False), (None, True), (2 * align.HOUR, False)]
    spark.sql(f"DROP TABLE {name}")
    one = catalog.batch_summary(aligned, "t", "b1", 2, gap=6).first()
    assert (one.n_source, one.n_aligned, one.n_interpolated, one.n_missing, json.loads(one.config)) == (2, 3, 1, 0, {"gap": 6})


def test_sources_that_do_not_go_together(spark):
    rows = [("a", k * 1000, k, 1.0) for k in range(40)] + [("b", (k**4) * 1000, k, 1.0) for k in range(40)] + [("c", k * 1000 + 5, k, 1.0) for k in range(12)]
    got = {r.series: r.warning for r in align.synchronise(spark.createDataFrame(rows, "series string, t long, id long, v double")).collect()}
    assert got["a"] is None and got["c"] is None and got["b"].startswith("weak match: r2 0.")


def test_map_table(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, "x")], "raw int, top_temperature double, other double, note string")
    names = spark.createDataFrame([("Top temperature", 1), ("nothing", 2)], "target string, ordinal int")
    out, told = mapping.map_table(df, {"raw": ("r", 10.0)}, names, required=["raw", "lost"])
    assert out.columns == ["r", "Top temperature"] and tuple(out.first()) == (10.0, 2.0)
    assert told == {"success": True, "mapped": ["raw", "top_temperature"], "unmapped": ["other", "note"], "found": {"top_temperature": "Top temperature"}, "warnings": ["required column lost is missing"]}
    assert mapping.map_table(df.select("other"), {})[1]["success"] is False


def test_plots(spark):
    df = spark.createDataFrame([(k, float(k), 5.0) for k in range(60)], "id long, a double, b double")
    assert [(r.param, r.place) for r in plots.by_variation(df, ["a", "b"]).orderBy("place").collect()] == [("b", 0), ("a", 1)]
    heat = plots.heat(df, ["a", "b"], ["id"])
    assert heat.count() == 100 and heat.where("param = 'b' and z is not null").count() == 0
    assert {r.side for r in plots.shapes(df, ["a"]).collect()} == {"middle"}


def test_import_folder(spark, tmp_path):
    levels = {"pools": ({"pool": ["name", "pool_en"], "zh": []}, ["pool"]), "work_types": ({"work_type": ["type"]}, ["work_type"])}
    (tmp_path / "a_pools.csv").write_text("Name,ZH\n text ,w\nimage,t\n,x\n")
    (tmp_path / "b_pools.csv").write_text("pool_en,zh\ntext,new\nbinary,b\n")
    (tmp_path / "notes.txt").write_text("no sheet")
    known = {"pools": spark.createDataFrame([("image", "old")], "pool string, zh string")}
    fallback = {"work_types": spark.createDataFrame([("smelt",)], "work_type string")}
    rows = lambda t: {r.pool: r.zh for r in t["pools"].collect()}
    fresh, counts = imports.import_folder(spark, str(tmp_path), levels, fallback=fallback)
    assert rows(fresh) == {"text": "w", "image": "t", "binary": "b"} and [r.work_type for r in fresh["work_types"].collect()] == ["smelt"]
    assert {tuple(r) for r in counts.collect()} == {("pools", "sheets", 4, 3), ("work_types", "fallback", 0, 1)}
    assert rows(imports.import_folder(spark, str(tmp_path), levels, known)[0]) == {"text": "w", "image": "old", "binary": "b"}
    assert rows(imports.import_folder(spark, str(tmp_path), levels, known, overwrite=True)[0]) == {"text": "new", "image": "t", "binary": "b"}
    kept, counts = imports.import_folder(spark, f"{tmp_path}/none", levels, known)
    assert rows(kept) == {"image": "old"} and [tuple(r) for r in counts.collect()] == [("pools", "known", 0, 1)]
