"""Aggregates with this engine's result types and null rules, as columns for ``groupBy().agg()``. All combine map-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_exact(x: Column) -> Column:
    """SUM of bigints that cannot overflow."""
    return F.sum(x.cast("decimal(38,0)"))


def avg_int(x: Column) -> Column:
    """AVG of integers: an integer, cut towards zero."""
    return F.call_function("div", F.sum(x.cast("long")), F.count(x))


def avg_decimal(x: Column, scale: int) -> Column:
    """AVG of decimals in the argument's scale, cut towards zero."""
    total, n = F.sum(x), F.count(x)
    unit = F.lit(10**scale).cast("decimal(18,0)")
    cents = (F.abs(total) * unit).cast("decimal(38,0)")
    back = (F.call_function("div", cents, n).cast("decimal(28,0)") / unit).cast(f"decimal(38,{scale})")
    return F.when(total < 0, -back).otherwise(back)


def avg_timestamp(x: Column) -> Column:
    """AVG of datetimes, to the microsecond."""
    micros = F.unix_micros(x.cast("timestamp"))
    return F.timestamp_micros(F.call_function("div", F.sum(micros.cast("decimal(38,0)")), F.count(x)).cast("long"))


def stddev(x: Column) -> Column:
    """Sample deviation; 0 (not null) for a single row."""
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x))


def variance(x: Column) -> Column:
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.var_samp(x))


def median(x: Column, kind: str) -> Column:
    """MEDIAN in the argument's type; the mean of the two middle values is cut to it."""
    return F.median(x).cast(kind)


def any_value(x: Column) -> Column:
    return F.any_value(x, ignoreNulls=F.lit(True))


def array_agg(x: Column, *order: Column) -> Column:
    """ARRAY_AGG: keeps nulls; ordered by ``order`` and then the value, nulls first."""
    keys = [k.alias(f"k{i}") for i, k in enumerate(order)]
    rows = F.sort_array(F.collect_list(F.struct(*keys, x.alias("x"))))
    return F.transform(rows, lambda r: r["x"])


def listagg(x: Column, separator: str, *order: Column, distinct: bool = False, fetch: int | None = None, overflow: int | None = None, filler: str = "...", with_count: bool = False) -> Column:
    """GROUP_CONCAT, STRING_AGG and LISTAGG: non-null values in order, joined.

    ``fetch`` keeps the first values alone. ``overflow`` is a most length: values that do not fit give way to ``filler``
    and, ``with_count``, their number in brackets.
    """
    rows = F.filter(array_agg(x.cast("string"), *order), lambda v: v.isNotNull())
    if distinct:
        rows = F.array_distinct(rows)
    if fetch is not None:
        rows = F.slice(rows, 1, fetch)
    whole = F.array_join(rows, separator)
    if overflow is None:
        return whole
    state = F.aggregate(
        rows,
        F.struct(F.lit(0).alias("size"), F.lit(0).alias("n")),
        lambda s, v: F.struct(
            (s["size"] + F.char_length(v) + len(separator)).alias("size"),
            (s["n"] + (s["size"] + F.char_length(v) <= overflow).cast("int")).alias("n"),
        ),
        lambda s: s["n"],
    )
    cut = F.concat(F.array_join(F.slice(rows, 1, state), separator), F.when(state > 0, F.lit(separator)).otherwise(F.lit("")), F.lit(filler))
    if with_count:
        cut = F.concat(cut, F.lit("("), (F.size(rows) - state).cast("string"), F.lit(")"))
    return F.when(F.char_length(whole) <= overflow, whole).otherwise(cut)


def json_arrayagg(x: Column, *order: Column, absent_on_null: bool = True) -> Column:
    """JSON_ARRAYAGG; nulls are left out unless asked for."""
    rows = array_agg(x, *order)
    return F.to_json(F.filter(rows, lambda v: v.isNotNull()) if absent_on_null else rows)


def json_objectagg(key: Column, value: Column) -> Column:
    """JSON_OBJECTAGG, keys in order; null values stay; a key that comes twice raises (Spark's map policy)."""
    return F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key.alias("key"), value.alias("value"))))))


def count_distinct_rows(*columns: Column) -> Column:
    """COUNT(DISTINCT a, b): rows with a null in any column do not count."""
    return F.count_distinct(*columns)


def grouping_bits(*columns: Column) -> Column:
    """GROUPING(a, b, ..): a bit for each column, the last one lowest; 1 where it is aggregated away."""
    out = F.lit(0).cast("long")
    for c in columns:
        out = out * 2 + F.grouping(c).cast("long")
    return out
