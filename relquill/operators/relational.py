"""Relational operators that Spark's grammar lacks or treats differently, as DataFrame compositions.

None of them collects rows; the joins they make are semi, anti or equality joins wherever the semantics allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OPS = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


# --- predicates


def between_symmetric(x: Column, a: Column, b: Column) -> Column:
    return x.between(a, b) | x.between(b, a)


def row_equal(left: list[Column], right: list[Column]) -> Column:
    """(a, b) = (c, d), null where a comparison that decides is null."""
    out = F.lit(True)
    for x, y in zip(left, right, strict=True):
        out = out & (x == y)
    return out


def row_less(left: list[Column], right: list[Column]) -> Column:
    """(a, b) < (c, d), by columns in turn."""
    out = left[-1] < right[-1]
    for x, y in reversed(list(zip(left[:-1], right[:-1], strict=True))):
        out = (x < y) | ((x == y) & out)
    return out


def quantified(df: DataFrame, x: Column, op: str, kind: str, rows: DataFrame, value: str) -> DataFrame:
    """``df`` where ``x op ANY`` or ``x op ALL`` of the column ``value`` of ``rows``.

    Only its least and greatest value, its number and that of its nulls are needed for the order comparisons, so a
    row of four numbers is joined instead of the subquery; = ANY is a semi join and <> ALL a null-aware anti join.
    """
    kind = kind.upper().replace("SOME", "ANY")
    v = F.col(value)
    if (op, kind) == ("=", "ANY"):
        keyed = df.withColumn("__x", x)
        return keyed.join(rows.select(v.alias("__v")).where("__v IS NOT NULL"), F.col("__x") == F.col("__v"), "left_semi").drop("__x")
    if (op, kind) == ("<>", "ALL"):
        facts = rows.agg(F.count(F.lit(1)).alias("__n"), F.count(v).alias("__k"))
        keyed = df.withColumn("__x", x).join(rows.select(v.alias("__v")).where("__v IS NOT NULL"), F.expr("__x = __v"), "left_anti")
        return keyed.join(F.broadcast(facts)).where("__n = 0 OR (__n = __k AND __x IS NOT NULL)").drop("__x", "__n", "__k")
    facts = rows.agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"), F.count(F.lit(1)).alias("__n"), F.count(v).alias("__k"))
    low, high, n, k = (F.col(c) for c in ("__lo", "__hi", "__n", "__k"))
    if kind == "ALL":
        bound = {"<": low, "<=": low, ">": high, ">=": high}
        holds = (low == high) & (x == low) if op == "=" else _OPS[op](x, bound[op])
        keep = (n == 0) | ((n == k) & holds)
    else:
        bound = {"<": high, "<=": high, ">": low, ">=": low}
        keep = (x != low) | (x != high) if op == "<>" else _OPS[op](x, bound[op])
    return df.join(F.broadcast(facts)).where(keep).drop("__lo", "__hi", "__n", "__k")


def unique_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """UNIQUE (subquery) as one row with the column ``is_unique``: no two rows without nulls are equal."""
    full = rows.dropna(subset=columns)
    twice = full.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return twice.agg((F.count(F.lit(1)) == 0).alias("is_unique"))


def match_rows(df: DataFrame, left: list[str], rows: DataFrame, right: list[str], mode: str = "SIMPLE", unique: bool = False) -> DataFrame:
    """``df`` where the row of ``left`` columns MATCHes the subquery ``rows`` (SIMPLE, PARTIAL or FULL; UNIQUE: exactly once).

    SIMPLE: true with any null, FULL: all null, or none and a match; PARTIAL: the columns that are not null match.
    The subquery is counted by key first; PARTIAL has one equality join for each pattern of nulls.
    """
    mode = mode.upper()
    nulls = sum((F.col(c).isNull().cast("int") for c in left), F.lit(0))
    many = F.col("__n") == 1 if unique else F.col("__n") >= 1

    def matched(part: DataFrame, places: list[int]) -> DataFrame:
        keys = [F.col(right[i]).alias(f"__k{i}") for i in places]
        counted = rows.select(*keys).dropna().groupBy(*[f"__k{i}" for i in places]).agg(F.count(F.lit(1)).alias("__n")).where(many)
        return part.join(counted, [F.col(left[i]) == F.col(f"__k{i}") for i in places], "left_semi")

    every = list(range(len(left)))
    whole = matched(df.where(nulls == 0), every)
    if mode == "SIMPLE":
        return whole.unionByName(df.where(nulls > 0))
    out = whole.unionByName(df.where(nulls == len(left)))
    if mode == "FULL":
        return out
    for mask in range(1, 2 ** len(left) - 1):
        places = [i for i in every if mask >> i & 1]
        pattern = F.lit(True)
        for i in every:
            pattern = pattern & (F.col(left[i]).isNotNull() if i in places else F.col(left[i]).isNull())
        out = out.unionByName(matched(df.where(pattern), places))
    return out


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """OVERLAPS of two half-open spans, each with its ends in either order."""
    s, e = F.when(a0 <= a1, a0).otherwise(a1), F.when(a0 <= a1, a1).otherwise(a0)
    t, f = F.when(b0 <= b1, b0).otherwise(b1), F.when(b0 <= b1, b1).otherwise(b0)
    return F.when(s > t, f > s).otherwise(e > t)


#: Period predicates of (start, end) with (start, end): half-open spans.
PERIOD = {
    "CONTAINS": lambda s, e, s2, e2: (s <= s2) & (e >= e2),
    "EQUALS": lambda s, e, s2, e2: (s == s2) & (e == e2),
    "OVERLAPS": lambda s, e, s2, e2: (s < e2) & (e > s2),
    "PRECEDES": lambda s, e, s2, e2: e <= s2,
    "IMMEDIATELY PRECEDES": lambda s, e, s2, e2: e == s2,
    "SUCCEEDS": lambda s, e, s2, e2: s >= e2,
    "IMMEDIATELY SUCCEEDS": lambda s, e, s2, e2: s == e2,
}


def period_contains_point(s: Column, e: Column, x: Column) -> Column:
    return (s <= x) & (e > x)


def checked_period(df: DataFrame, start: str, end: str) -> DataFrame:
    """``df``; a row whose period does not start before it ends raises."""
    wrong = F.raise_error(F.lit("22020 data exception: invalid period value"))
    return df.withColumn(end, F.when(F.col(start) < F.col(end), F.col(end)).otherwise(F.when(F.col(start).isNull() | F.col(end).isNull(), F.col(end)).otherwise(wrong.cast(df.schema[end].dataType))))


# --- joins

#: Rows of each side that meet at once in a hot cell of a range join.
_BLOCK = 2048


def union_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """UNION JOIN: the rows of both sides, each padded with nulls; no comparison is made."""
    kinds = dict(right.dtypes)
    a = left.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in right.columns])
    kinds = dict(left.dtypes)
    return a.unionByName(right.select(*[F.lit(None).cast(kinds[c]).alias(c) for c in left.columns], "*"))


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """On all columns that both have, which come once and first."""
    return left.join(right, [c for c in left.columns if c in right.columns], how)


def unnest(df: DataFrame, arrays: dict[str, str], ordinality: str | None = None) -> DataFrame:
    """UNNEST(a, b, ..) [WITH ORDINALITY]: arrays side by side, the shorter padded with nulls; {array column: name of its element}."""
    zipped = F.arrays_zip(*[F.col(a).alias(n) for a, n in arrays.items()])
    out = df.select("*", F.posexplode(zipped).alias("__pos", "__row"))
    fields = out.schema["__row"].dataType.fieldNames()
    cols = [F.col("__row")[f].alias(n) for f, n in zip(fields, arrays.values(), strict=True)]
    return out.select(*df.columns, *cols, *([(F.col("__pos") + 1).alias(ordinality)] if ordinality else []))


def _cell(df: DataFrame, c: str, width: float) -> Column:
    """The cell of ``width`` (seconds for timestamps) that a number or timestamp lies in; no less for a greater value."""
    x, kind = F.col(c), df.schema[c].dataType.typeName()
    if kind == "timestamp_ntz":  # by its fields, to whole seconds: in the session's zone some hours come twice
        x = F.unix_date(x.cast("date")) * F.lit(86400).cast("bigint") + F.hour(x) * 3600 + F.minute(x) * 60 + F.second(x)
    elif kind == "timestamp":
        x = F.unix_micros(x) / 1e6
    cell = F.floor(x / width)
    return F.when(F.isnan(x), F.lit(2**63 - 1)).otherwise(cell) if kind in ("double", "float") else cell  # NaN is the greatest


def range_join(left: DataFrame, right: DataFrame, point: str, start: str, end: str, width: float) -> DataFrame:
    """Rows of ``left`` whose ``point`` lies in [start, end) of a row of ``right``, numbers or timestamps.

    Spans are dealt to cells of ``width`` (seconds for timestamps), so that the join is by equality on the cell and not a
    comparison of all with all; a point lies in one cell, so no pair comes twice. In a cell with many rows each side is dealt to
    blocks of about 2,048 rows and meets the other's blocks one by one, so that a hot cell is many small groups. The pairs
    themselves may be as many as rows times rows: where only their number is asked, ``range_join_counts`` makes none of them.
    Blocks are dealt by a hash of the row, so equal rows share one; the numbers of blocks of hot cells are written to the shared folder.
    """
    from relquill.sources.storage import stage

    cells = F.sequence(_cell(right, start, width), _cell(right, end, width))
    spans = right.where(F.col(start) < F.col(end)).withColumn("__cell", F.explode(cells))
    points = left.withColumn("__cell", _cell(left, point, width))
    sizes = [d.groupBy("__cell").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).alias(n)) for d, n in ((points, "__p"), (spans, "__s"))]
    hot = stage(sizes[0].join(sizes[1], "__cell").where("__p > 1 OR __s > 1"), "cells")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        hashed = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind and df.columns.count(c) == 1]
        df = df.join(hot, "__cell", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("__p", "__s")})
        df = df.withColumn(own, F.pmod(F.xxhash64(*hashed), own))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)))

    met = dealt(points, "__p", "__s").join(dealt(spans, "__s", "__p"), ["__cell", "__p", "__s"])
    return met.where((F.col(start) <= F.col(point)) & (F.col(point) < F.col(end))).drop("__cell", "__p", "__s")


def range_join_counts(left: DataFrame, right: DataFrame, point: str, start: str, end: str, width: float, name: str = "n") -> DataFrame:
    """Each row of ``right`` with the number of rows that ``range_join`` pairs it with, where there are any; no pair is made.

    The number is that of the points before ``end`` less that before ``start``. Points before a value are counted by running
    sums over distinct values in their cell of ``width``, over cells in their block of 65,536, and over blocks. So work grows
    with the rows of both sides, equal values are one row, and a task holds the distinct values of a cell or the cells of a block.
    """
    bounds = right.where(F.col(start) < F.col(end))
    marks = left.select(F.col(point).alias("__x"), F.lit(1).cast("bigint").alias("__w"), F.lit(False).alias("__bound"))
    marks = marks.unionByName(bounds.select(F.explode(F.array(start, end)).alias("__x"), F.lit(0).cast("bigint").alias("__w"), F.lit(True).alias("__bound")))
    marks = marks.where("__x IS NOT NULL")
    cell = _cell(marks, "__x", width)

    def before(*keys: str) -> Column:
        """The sum of the rows before, by the last of ``keys`` within the others."""
        w = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("__w").over(w), F.lit(0))

    total = F.sum("__w").alias("__w")
    blocks = marks.groupBy(F.shiftright(cell, 16).alias("__block")).agg(total).select("__block", before("__block").alias("__b"))
    cells = marks.groupBy(cell.alias("__cell")).agg(total).withColumn("__block", F.shiftright("__cell", 16))
    cells = cells.withColumn("__c", before("__block", "__cell")).join(blocks, "__block").select("__cell", (F.col("__b") + F.col("__c")).alias("__c"))
    values = marks.groupBy("__x").agg(total, F.max("__bound").alias("__bound")).withColumn("__cell", cell)
    ranks = values.withColumn("__v", before("__cell", "__x")).where("__bound").join(cells, "__cell").select("__x", (F.col("__c") + F.col("__v")).alias("__r"))
    out = bounds.join(ranks.select(F.col("__x").alias("__s"), F.col("__r").alias("__lo")), F.col(start) == F.col("__s"))
    out = out.join(ranks.select(F.col("__x").alias("__f"), F.col("__r").alias("__hi")), F.col(end) == F.col("__f")).where("__hi > __lo")
    return out.select(*right.columns, (F.col("__hi") - F.col("__lo")).alias(name))


# --- sorting, limits, numbering


def order_by(df: DataFrame, *keys: tuple[str, bool] | str) -> DataFrame:
    """ORDER BY with this engine's default: nulls first, ascending or descending. Keys are names or (name, descending)."""
    cols = []
    for k in keys:
        name, down = (k, False) if isinstance(k, str) else k
        cols.append(F.col(name).desc_nulls_first() if down else F.col(name).asc_nulls_first())
    return df.orderBy(*cols)


def limited(df: DataFrame, limit: int | None = None, offset: int = 0, fetch: bool = False) -> DataFrame:
    """LIMIT and OFFSET: a limit of 0 is none; FETCH of 0 rows raises."""
    if fetch and limit is not None and limit < 1:
        raise ValueError("2201W data exception: invalid row count in fetch first clause")
    out = df.offset(offset) if offset else df
    return out.limit(limit) if limit else out


def row_numbers(df: DataFrame, name: str = "rownum") -> DataFrame:
    """ROWNUM(): 1, 2, .. over the rows as they come.

    Numbered by partition: counts of rows a partition (one small row each) give the partitions' bases, so no task takes all
    rows. The input is read twice and should be a stored table, whose partitions come out alike.
    """
    marked = df.withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    counts = marked.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    base = counts.select("__p", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    out = marked.withColumn("__p", part).join(F.broadcast(base), "__p")
    return out.withColumn(name, F.col("__base") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__p", "__id", "__base")


# --- set operations


def corresponding(left: DataFrame, right: DataFrame, how: str, by: list[str] | None = None) -> DataFrame:
    """A set operation CORRESPONDING [BY (columns)]: on the columns both sides have, by name."""
    names = by or [c for c in left.columns if c in right.columns]
    a, b = left.select(*names), right.select(*names)
    return {
        "UNION": lambda: a.union(b).distinct(), "UNION ALL": lambda: a.union(b), "INTERSECT": lambda: a.intersect(b),
        "INTERSECT ALL": lambda: a.intersectAll(b), "EXCEPT": lambda: a.subtract(b), "EXCEPT ALL": lambda: a.exceptAll(b),
    }[how.upper()]()


def recursive_union(seed: DataFrame, step, distinct: bool = True, limit: int = 256) -> DataFrame:
    """WITH RECURSIVE .. UNION: ``step`` (DataFrame -> DataFrame) runs on the rows that the last step added, until it adds none.

    Each step's new rows are written to the shared folder, so plans stay short and lost executors cost one step. With
    ``distinct`` rows that are there already are taken out by an anti join on all columns. More than ``limit`` steps raise.
    """
    from relquill.sources.storage import stage

    fresh = stage(seed.distinct() if distinct else seed, "recursion")
    parts = [fresh]
    for _ in range(limit):
        new = step(fresh).select(*seed.columns)
        if distinct:
            known = parts[0]
            for p in parts[1:]:
                known = known.unionAll(p)
            new = new.subtract(known)
        fresh = stage(new, "recursion")
        if fresh.isEmpty():
            break
        parts.append(fresh)
    else:
        raise RuntimeError("22522 recursive query has taken too many steps")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def grouping_sets(df: DataFrame, sets: list[list[str]], aggregates: list[Column], distinct: bool = False) -> DataFrame:
    """GROUP BY GROUPING SETS as given (duplicates kept, or taken out for GROUP BY DISTINCT)."""
    if distinct:
        sets = [list(s) for s in dict.fromkeys(tuple(sorted(s)) for s in sets)]
    every = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in every]).agg(*aggregates)
