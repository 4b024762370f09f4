"""Changes to tables as DataFrame rewrites: the new contents from the old, with constraints and system versions.

A table here is a DataFrame; every operator returns the table after the change (and, where asked, the rows it
changed), to be written as a new version. Keys meet by equality joins, so a change costs one shuffle by key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: End of a system period that is still current.
FOREVER = "9999-12-31 23:59:59.999999"


def insert(table: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None, generated: dict[str, Column] | None = None) -> DataFrame:
    """INSERT: columns that ``rows`` lacks take their default or null; generated columns are worked out from the row."""
    kinds, defaults = dict(table.dtypes), defaults or {}
    new = rows
    for c in table.columns:
        if c not in rows.columns and c not in (generated or {}):
            new = new.withColumn(c, defaults.get(c, F.lit(None)).cast(kinds[c]))
    for c, value in (generated or {}).items():
        new = new.withColumn(c, value.cast(kinds[c]))
    return table.unionByName(new.select(*[F.col(c).cast(kinds[c]).alias(c) for c in table.columns]))


def update(table: DataFrame, changes: dict[str, Column], where: Column | None = None) -> DataFrame:
    """UPDATE .. SET; all new values are worked out from the old row. Rows for which ``where`` is not true stay."""
    kinds = dict(table.dtypes)
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    return table.select(*[F.when(hit, changes[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in table.columns])


def update_from(table: DataFrame, source: DataFrame, on: list[str], changes: dict[str, str]) -> DataFrame:
    """UPDATE with values of the row of ``source`` that has the same key: {column: source column}. The key is unique in ``source``."""
    s = source.select(*[F.col(c).alias(f"__k_{c}") for c in on], *[F.col(v).alias(f"__v_{c}") for c, v in changes.items()], F.lit(True).alias("__hit"))
    joined = table.join(s, [F.col(c) == F.col(f"__k_{c}") for c in on], "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__v_{c}")).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in table.columns])


def delete(table: DataFrame, where: Column | None = None) -> DataFrame:
    """DELETE: rows for which ``where`` is true go; unknown is not true. Without ``where``: TRUNCATE."""
    return table.limit(0) if where is None else table.where(~F.coalesce(where, F.lit(False)))


def replace_rows(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """REPLACE, INSERT .. ON DUPLICATE KEY UPDATE with all columns: a row of the same key gives way."""
    return table.join(rows.select(*key), key, "left_anti").select(*table.columns).unionByName(rows)


def insert_ignore(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """INSERT IGNORE: a row whose key is there already is left out."""
    return table.unionByName(rows.join(table.select(*key), key, "left_anti").select(*table.columns))


@dataclass
class When:
    """A branch of MERGE: ``matched``, an extra condition, and ``action`` ("UPDATE", "DELETE" or "INSERT") with its values."""

    matched: bool
    action: str
    values: dict[str, Column] = field(default_factory=dict)
    condition: Column | None = None


def merge(table: DataFrame, source: DataFrame, on: list[str], branches: list[When], prefix: str = "s_") -> DataFrame:
    """MERGE: the first branch that holds decides. In branches, columns of ``source`` carry ``prefix``.

    A full outer join on the key; each key of ``source`` must match a table row once at most (else the rewrite would
    double rows), which is checked as the join runs.
    """
    kinds = dict(table.dtypes)
    doubled = F.raise_error(F.lit("21000 cardinality violation: merge source")).cast("boolean")
    once = source.groupBy(*on).agg(*[F.first(c).alias(c) for c in source.columns if c not in on], F.count(F.lit(1)).alias("__c"))
    once = once.withColumn("__in_s", F.when(F.col("__c") == 1, F.lit(True)).otherwise(doubled))
    s = once.select(*[F.col(c).alias(prefix + c) for c in source.columns], "__in_s")
    both = table.withColumn("__in_t", F.lit(True)).join(s, [F.col(c) == F.col(prefix + c) for c in on], "full")
    in_t, in_s = F.col("__in_t").isNotNull(), F.col("__in_s").isNotNull()
    pick = F.lit(-1)
    for i, b in reversed(list(enumerate(branches))):
        hit = (in_t & in_s if b.matched else ~in_t & in_s) & (F.coalesce(b.condition, F.lit(False)) if b.condition is not None else F.lit(True))
        pick = F.when(hit, F.lit(i)).otherwise(pick)
    both = both.withColumn("__b", pick)
    gone = [i for i, b in enumerate(branches) if b.action.upper() == "DELETE"]
    kept = both.where((in_t | (F.col("__b") >= 0)) & ~F.col("__b").isin(gone)) if gone else both.where(in_t | (F.col("__b") >= 0))
    cols = []
    for c in table.columns:
        value = F.col(c)
        for i, b in enumerate(branches):
            if b.action.upper() != "DELETE" and (c in b.values or b.action.upper() == "INSERT"):
                value = F.when(F.col("__b") == i, b.values.get(c, F.lit(None)).cast(kinds[c])).otherwise(value)
        cols.append(value.alias(c))
    return kept.select(*cols)


# --- constraints


def violations(table: DataFrame, *, not_null: list[str] = (), check: dict[str, Column] | None = None, unique: list[list[str]] = (), foreign: list[tuple[list[str], DataFrame, list[str]]] = ()) -> DataFrame:
    """(constraint, n): how many rows break each; none is broken where all are 0.

    CHECK fails where it is false (unknown passes); UNIQUE does not compare keys with a null; FOREIGN KEY asks only keys without one.
    """
    parts = []
    counted = [F.count_if(F.col(c).isNull()).alias(f"not null {c}") for c in not_null]
    counted += [F.count_if(~test).alias(f"check {name}") for name, test in (check or {}).items()]
    if counted:
        one = table.agg(*counted)
        names = one.columns
        parts.append(one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("constraint"), F.col(f"`{n}`").alias("n")) for n in names])).alias("x")).select("x.*"))
    for key in unique:
        twice = table.dropna(subset=list(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        parts.append(twice.agg(F.lit("unique " + ", ".join(key)).alias("constraint"), F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n")))
    for key, parent, target in foreign:
        p = parent.select(*[F.col(t).alias(f"__p{i}") for i, t in enumerate(target)]).distinct()
        lost = table.dropna(subset=list(key)).join(p, [F.col(k) == F.col(f"__p{i}") for i, k in enumerate(key)], "left_anti")
        parts.append(lost.agg(F.lit("foreign key " + ", ".join(key)).alias("constraint"), F.count(F.lit(1)).alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def on_parent_delete(child: DataFrame, key: list[str], gone: DataFrame, target: list[str], action: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """The child table after its parents' rows ``gone`` were deleted: CASCADE, SET NULL, SET DEFAULT, or RESTRICT / NO ACTION (raises)."""
    g = gone.select(*[F.col(t).alias(f"__g{i}") for i, t in enumerate(target)]).distinct()
    same = [F.col(k) == F.col(f"__g{i}") for i, k in enumerate(key)]
    action = action.upper()
    if action == "CASCADE":
        return child.join(g, same, "left_anti")
    if action in ("RESTRICT", "NO ACTION"):
        if not child.join(g, same, "left_semi").isEmpty():
            raise ValueError("23504 integrity constraint violation: foreign key")
        return child
    kinds = dict(child.dtypes)
    hit = child.join(g.withColumn("__hit", F.lit(True)), same, "left")
    value = {k: (F.lit(None) if action == "SET NULL" else (defaults or {}).get(k, F.lit(None))).cast(kinds[k]) for k in key}
    return hit.select(*[F.when(F.col("__hit"), value[c]).otherwise(F.col(c)).alias(c) if c in key else F.col(c) for c in child.columns])


# --- system versions


def versioned(rows: DataFrame, at: str, start: str = "row_start", end: str = "row_end") -> DataFrame:
    """``rows`` as the current versions of a system-versioned table from the time ``at``."""
    return rows.withColumns({start: F.lit(at).cast("timestamp"), end: F.lit(FOREVER).cast("timestamp")})


def update_versioned(table: DataFrame, changes: dict[str, Column], where: Column, at: str, start: str = "row_start", end: str = "row_end") -> DataFrame:
    """UPDATE of a system-versioned table: old versions end at ``at``, and new ones begin. One pass, no join."""
    now, current = F.lit(at).cast("timestamp"), F.col(end) == F.lit(FOREVER).cast("timestamp")
    kinds, hit = dict(table.dtypes), F.coalesce(where, F.lit(False)) & current
    old = F.struct(*[F.when(hit, now).otherwise(F.col(end)).alias(c) if c == end else F.col(c).alias(c) for c in table.columns])
    new = F.struct(*[now.alias(c) if c == start else F.col(c).alias(c) if c not in changes else changes[c].cast(kinds[c]).alias(c) for c in table.columns])
    return table.select(F.explode(F.when(hit, F.array(old, new)).otherwise(F.array(old))).alias("r")).select("r.*")


def delete_versioned(table: DataFrame, where: Column, at: str, end: str = "row_end") -> DataFrame:
    """DELETE of a system-versioned table: the versions end at ``at``."""
    hit = F.coalesce(where, F.lit(False)) & (F.col(end) == F.lit(FOREVER).cast("timestamp"))
    return table.withColumn(end, F.when(hit, F.lit(at).cast("timestamp")).otherwise(F.col(end)))


def as_of(table: DataFrame, at: str, start: str = "row_start", end: str = "row_end") -> DataFrame:
    """FOR SYSTEM_TIME AS OF."""
    t = F.lit(at).cast("timestamp")
    return table.where((F.col(start) <= t) & (F.col(end) > t))


def system_time_between(table: DataFrame, a: str, b: str, inclusive: bool, start: str = "row_start", end: str = "row_end") -> DataFrame:
    """FOR SYSTEM_TIME BETWEEN a AND b (``inclusive``) or FROM a TO b."""
    t, u = F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp")
    return table.where((F.col(end) > t) & ((F.col(start) <= u) if inclusive else (F.col(start) < u)))


def current_rows(table: DataFrame, end: str = "row_end") -> DataFrame:
    """A versioned table without FOR SYSTEM_TIME: the versions that have not ended."""
    return table.where(F.col(end) == F.lit(FOREVER).cast("timestamp"))


# --- sequences


@dataclass
class Sequence:
    """CREATE SEQUENCE: a counter on the driver; ``numbered`` takes a block of values for the rows of a DataFrame."""

    start: int = 1
    increment: int = 1
    next_value: int | None = None
    last: int | None = None

    def next(self) -> int:
        self.last = self.start if self.next_value is None else self.next_value
        self.next_value = self.last + self.increment
        return self.last

    def numbered(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with the next values of the sequence, a different one in each row."""
        from relquill.operators.relational import row_numbers

        first, n = self.next(), df.count()
        self.last = first + (n - 1) * self.increment if n else first
        self.next_value = self.last + self.increment if n else first
        return row_numbers(df, "__n").withColumn(name, F.lit(first) + (F.col("__n") - 1) * F.lit(self.increment)).drop("__n")


def information_schema(spark: SparkSession, name: str) -> DataFrame:
    """INFORMATION_SCHEMA views from the session's catalog: TABLES, COLUMNS, VIEWS, SCHEMATA, ROUTINES. Names alone, no data."""
    catalog = spark.catalog
    name = name.upper()
    if name == "SCHEMATA":
        rows = [(d.catalog, d.name, d.description) for d in catalog.listDatabases()]
        return spark.createDataFrame(rows, "catalog_name string, schema_name string, description string")
    if name == "ROUTINES":
        rows = [(f.catalog, f.name, f.className) for f in catalog.listFunctions()]
        return spark.createDataFrame(rows, "routine_catalog string, routine_name string, routine_body string")
    tables = catalog.listTables()
    if name == "COLUMNS":
        rows = [(t.catalog, t.name, c.name, i + 1, c.nullable, c.dataType) for t in tables for i, c in enumerate(catalog.listColumns(t.name))]
        return spark.createDataFrame(rows, "table_catalog string, table_name string, column_name string, ordinal_position int, is_nullable boolean, data_type string")
    kinds = [(t.catalog, (t.namespace or [None])[-1], t.name, "VIEW" if t.tableType in ("TEMPORARY", "VIEW") else "BASE TABLE") for t in tables]
    if name == "VIEWS":
        kinds = [r for r in kinds if r[3] == "VIEW"]
    elif name != "TABLES":
        raise ValueError(f"no such view: {name}")
    return spark.createDataFrame(kinds, "table_catalog string, table_schema string, table_name string, table_type string")
