"""The preprocessing pipeline: ordered steps as DataFrame transforms, over series, a table or many tables (C-15, C-41, C-42)."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuyere.functions.storage import stored
from tuyere.operators import impute, impute_columns, outliers, scale, scalers, stats
from tuyere.sources import catalog


@dataclass
class Config:
    steps: tuple[str, ...] = ("missing", "outliers", "normalise")
    fill: tuple[str, ...] = ("linear", "time", "ffill", "bfill")
    outlier_methods: tuple[str, ...] = ("zscore", "iqr", "rolling_mad", "moving_average")
    replace_by: str = "median"
    scale_by: str = "zscore"
    by_series: bool = True
    use_equations: bool = True
    use_nearest: bool = True
    neighbours: int = 5
    rounds: int = 10
    group_columns: tuple[str, ...] = ()
    warnings: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, values: Mapping) -> Config:
        """Settings by name; unknown ones are noted as warnings."""
        known = {f.name for f in fields(cls)} - {"warnings"}
        kept = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known}
        return cls(**kept, warnings=[f"unknown setting {k}" for k in values if k not in known])

    @classmethod
    def from_json(cls, text: str) -> Config:
        return cls.of(json.loads(text))

    @classmethod
    def from_environment(cls, prefix: str = "TUYERE_", environment: Mapping[str, str] | None = None) -> Config:
        """Settings from variables such as TUYERE_STEPS; values are JSON, or texts where they are none, lists may be written
        with commas."""
        environment, found = os.environ if environment is None else environment, {}
        lists = {f.name for f in fields(cls) if isinstance(f.default, tuple)}
        for name, text in environment.items():
            if name.startswith(prefix):
                key = name.removeprefix(prefix).lower()
                try:
                    found[key] = json.loads(text)
                except ValueError:
                    found[key] = text
                if key in lists and isinstance(found[key], str):
                    found[key] = [x.strip() for x in found[key].split(",") if x.strip()]
        return cls.of(found)

    def to_json(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if k != "warnings"}, sort_keys=True)


def run(df: DataFrame, config: Config | None = None) -> DataFrame:
    """Series rows (series, t, id, v) with v filled, cleaned and scaled; raw keeps what came in. Unknown steps are noted."""
    config = config or Config()
    df = df.withColumn("raw", F.col("v"))
    for step in config.steps:
        if step == "missing":
            filled, _ = impute.fill_by_priority(df, config.fill)
            df = filled.withColumn("v", F.col("filled")).drop("filled")
        elif step == "outliers":
            df = outliers.replace(outliers.ensemble(df, config.outlier_methods), config.replace_by)
            df = df.withColumn("v", F.col("fixed")).drop("fixed", "votes", "is_outlier")
        elif step == "normalise":
            groups = ["series"] if config.by_series else list(config.group_columns)
            df = scale.within_groups(df, groups, "v").withColumn("v", F.col("scaled")).drop("scaled")
        else:
            config.warnings.append(f"unknown step {step}")
    return df


def run_batch(tables: dict[str, DataFrame], config: Config | None = None) -> dict[str, DataFrame | str]:
    """Each table's result, or why it failed."""
    out: dict[str, DataFrame | str] = {}
    for name, df in tables.items():
        try:
            out[name] = run(df, config)
        except Exception as e:  # noqa: BLE001 - one table's failure must not stop the others
            out[name] = str(e)
    return out


def _as_series(df: DataFrame, id_col: str, t: F.Column, columns: list[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("series"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns]
    return df.select(F.col(f"`{id_col}`").alias("id"), t.alias("t"), F.explode(F.array(*cells)).alias("c")).select("c.series", "t", "id", "c.v")


def _beside(df: DataFrame, id_col: str, filled: DataFrame, columns: list[str]) -> DataFrame:
    """df with the columns taken from filled (series, id, filled)."""
    wide = filled.groupBy(F.col("id").alias("_id")).pivot("series", columns).agg(F.first("filled"))
    wide = wide.withColumnsRenamed({c: f"_new_{k}" for k, c in enumerate(columns)})
    return df.join(wide, F.col(f"`{id_col}`").eqNullSafe(F.col("_id"))).drop("_id")


def fill_table(df: DataFrame, id_col: str, config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """The table with its gaps filled by the kind of each column, and (column_name, kind, missing, filled, remaining, rate).

    Numeric columns become series in the order of the time column, if there is one with less than a tenth missing, and are
    filled by the methods of config.fill; what is left, and all where there is no such time, by chained equations and then by
    nearest rows over all numeric columns. Categories, texts and numbers of few values get their most frequent value. Times
    are filled like numbers, the time column by row order of the id. Columns of other kinds stay. Ids must be unique."""
    config = config or Config()
    kinds = {r.column_name: r.kind for r in stats.column_types(df.drop(id_col)).collect()}
    missing = {r.column_name: r.n_missing for r in impute.missing_rates(df, list(kinds)).collect()}
    n, clock = df.count(), stats.time_column(df.drop(id_col))
    gaps = [c for c in kinds if missing[c]]
    stamped = clock is not None and missing[clock] * 10 < n
    moment = lambda c: F.unix_micros(F.col(f"`{c}`").cast("timestamp"))
    t = moment(clock) if stamped else F.col(f"`{id_col}`").cast("long")
    out, types = stored(df, "table"), dict(df.dtypes)
    numbers = [c for c in kinds if types[c] != "string" and c != clock and kinds[c] in ("numeric", "categorical_numeric")]
    by_series = [c for c in gaps if kinds[c] == "numeric" and c in numbers] if stamped else []
    if by_series:
        filled, _ = impute.fill_by_priority(_as_series(out, id_col, t, by_series), config.fill)
        out = _beside(out, id_col, filled, by_series)
        out = stored(out.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.col(f"_new_{k}").cast(types[c])) for k, c in enumerate(by_series)}).select(*df.columns), "table")
    times = [c for c in gaps if kinds[c] == "datetime"]
    if times:
        rows = out.select(id_col, *[moment(c).alias(c) for c in times])
        filled = impute.fill_linear(_as_series(rows, id_col, F.col(f"`{id_col}`").cast("long"), times))
        out = _beside(out, id_col, filled, times)
        out = stored(out.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.timestamp_micros(F.col(f"_new_{k}").cast("long")).cast(types[c])) for k, c in enumerate(times)}).select(*df.columns), "table")
    for c in (c for c in gaps if kinds[c] in ("categorical", "text", "categorical_numeric")):
        most = out.agg(F.mode(f"`{c}`", True).alias("_mode"))  # one row
        out = out.crossJoin(F.broadcast(most)).withColumn(c, F.coalesce(F.col(f"`{c}`"), F.col("_mode"))).drop("_mode")
    left = {r.column_name: r.n_missing for r in impute.missing_rates(out, numbers).collect()} if numbers else {}
    if any(left.values()) and len(numbers) > 1:
        if config.use_equations:
            out = _typed(impute_columns.fill_by_equations(out, id_col, numbers, config.rounds, estimator="linear")[0], df)
        elif config.use_nearest:
            out = _typed(impute_columns.fill_from_nearest(out, id_col, numbers, config.neighbours), df)
    elif any(left.values()):
        out = _typed(out.crossJoin(F.broadcast(out.agg(F.median(numbers[0]).alias("_m")))).withColumn(numbers[0], F.coalesce(numbers[0], "_m")), df)
    out = stored(out, "table")
    after = {r.column_name: r.n_missing for r in impute.missing_rates(out, list(kinds)).collect()}
    rows = [(c, kinds[c], missing[c], missing[c] - after[c], after[c], (missing[c] - after[c]) / missing[c]) for c in gaps]
    return out, df.sparkSession.createDataFrame(rows, "column_name string, kind string, missing long, filled long, remaining long, rate double")


def _typed(out: DataFrame, df: DataFrame) -> DataFrame:
    return out.select(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in df.dtypes])


def run_table(df: DataFrame, id_col: str, config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """A whole table through the steps: gaps filled by kind, numeric columns cleaned of outliers as series in the order of the
    time column (of the id without one), and scaled; and the report of the fills."""
    config = config or Config()
    if id_col not in df.columns:
        raise ValueError(f"the table has no column {id_col}")
    report = df.sparkSession.createDataFrame([], "column_name string, kind string, missing long, filled long, remaining long, rate double")
    kinds = {r.column_name: r.kind for r in stats.column_types(df.drop(id_col)).collect()}
    types, clock = dict(df.dtypes), stats.time_column(df.drop(id_col))
    numbers = [c for c in kinds if kinds[c] == "numeric" and types[c] != "string" and c != clock]
    for step in config.steps:
        if step == "missing":
            df, report = fill_table(df, id_col, config)
        elif step == "outliers" and numbers:
            t = F.unix_micros(F.col(f"`{clock}`").cast("timestamp")) if clock else F.col(f"`{id_col}`").cast("long")
            rows = outliers.replace(outliers.ensemble(_as_series(df, id_col, t, numbers), config.outlier_methods), config.replace_by)
            wide = _beside(df, id_col, rows.select("series", "id", F.col("fixed").alias("filled")), numbers)
            df = stored(wide.withColumns({c: F.col(f"_new_{k}") for k, c in enumerate(numbers)}).select(*df.columns), "table")
        elif step == "normalise" and numbers:
            df, _, _ = scalers.normalise(df, numbers, config.scale_by)
        elif step not in ("outliers", "normalise"):
            config.warnings.append(f"unknown step {step}")
    return df, report


def run_tables(spark: SparkSession, part: str, id_col: str, config: Config | None = None, suffix: str = "_clean", log: str | None = None) -> dict[str, str]:
    """All tables whose name holds the text, each written under its name with the suffix; "done", or why it failed. With a log
    table every run leaves a row there."""
    out = {}
    for name in catalog.list_tables(spark, part):
        if name.endswith(suffix) or name == log:
            continue
        started = time.time()
        try:
            df, _ = run_table(spark.table(name), id_col, config)
            catalog.write_table(df, name + suffix, "replace")
            out[name], rows = "done", df.count()
        except Exception as e:  # noqa: BLE001 - one table's failure must not stop the others
            out[name], rows = str(e), 0
        if log:
            catalog.log_run(spark, name, log, "done" if out[name] == "done" else "failed", rows, seconds=round(time.time() - started, 3), error="" if out[name] == "done" else out[name][:200])
    return out
