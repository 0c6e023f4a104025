"""Names: normalisation, table names, types inferred from names (B-01, B-02, B-04), as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that cannot be column names, and the keyword rules of types in their order.
RESERVED = (
    "all analyse analyze and any array as asc asymmetric authorization between binary both case cast check collate collation column concurrently constraint create cross "
    "current_catalog current_date current_role current_schema current_time current_timestamp current_user default deferrable desc distinct do else end except false fetch for "
    "foreign from full grant group having ilike in initially inner intersect into is isnull join lateral leading left like limit localtime localtimestamp natural not notnull null "
    "offset on only or order outer overlaps placing primary references returning right select session_user similar some symmetric table tablesample then to trailing true union "
    "unique user using variadic verbose when where window with"
).split()
TYPE_RULES = [
    ("timestamp", "time timestamp 时间 日期".split()),
    ("decimal(18,4)", "value mean average threshold limit range frequency interval duration period cycle deviation quantile latency delay ratio rate score upper lower min max 标准 阈值 周期".split()),
    ("boolean", "status state flag enabled valid available mapped triggered aligned async is_ has_ can_ 状态 有效 触发".split()),
    ("json", "label keyword tag mapping set 规则".split()),
    ("int", "count number priority level threshold index 优先级 序号 计数".split()),
]
SEPARATORS, BRACKETS = r"(?U)[\s&%#\-./\\]+", r"[()（）\[\]「」『』〈〉《》【】{}]"
LONGEST_NAME, LONGEST_TABLE, DIGEST = 50, 63, 5


def _once(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), where x is computed once however often then uses it: a name of its own, as a lambda's argument."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def normalise_name(c: Column) -> Column:
    """Lower case; separators and brackets to one underscore, none at the ends; no digit first; no reserved word; 50
    characters. Null and empty names are unnamed; a name of separators only becomes empty."""
    x = F.regexp_replace(F.regexp_replace(F.lower(c), SEPARATORS, "_"), BRACKETS, "_")
    x = F.regexp_replace(F.regexp_replace(x, "_+", "_"), "^_|_$", "")
    x = _once(x, lambda x: F.when(x.rlike(r"(?U)^\d"), F.concat(F.lit("t_"), x)).otherwise(x))
    x = _once(x, lambda x: F.when(x.isin(RESERVED), F.concat(x, F.lit("_col"))).otherwise(x))
    x = _once(x, lambda x: F.when(F.length(x) > LONGEST_NAME, F.regexp_replace(F.substring(x, 1, LONGEST_NAME), "_+$", "")).otherwise(x))
    return F.when(F.coalesce(c, F.lit("")) == "", "unnamed").otherwise(x)


def table_name(*parts: Column) -> Column:
    """The normalised parts joined; where that is too long, each is cut so that the parts, their joints and five digits of the
    raw names' CRC-32 fit."""
    digest = F.right(F.concat(F.lit("0" * DIGEST), F.lower(F.hex(F.crc32(F.concat_ws("_", *parts).cast("binary"))))), F.lit(DIGEST))
    each = (LONGEST_TABLE - (len(parts) - 1) - DIGEST) // len(parts)

    def joined(names: Column) -> Column:
        whole, cut = F.concat_ws("_", names), F.transform(names, lambda n: F.substring(n, 1, each))
        return F.when(F.length(whole) > LONGEST_TABLE, F.concat_ws("_", cut, digest)).otherwise(whole)

    return _once(F.array(*[normalise_name(p) for p in parts]), joined)


def inferred_type(c: Column) -> Column:
    """The type of the first rule with a keyword inside the name; string without any."""
    x, out = F.lower(c), None
    for kind, words in TYPE_RULES:
        hit = F.lit(False)
        for w in words:
            hit = hit | x.contains(w)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("string")
