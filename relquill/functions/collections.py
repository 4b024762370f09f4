"""Arrays, JSON construction, conditionals and session values with this engine's rules, as column builders."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from relquill.functions.strings import _same, col


def element(a, i) -> Column:
    """The i-th element, from 1; a place outside the array raises (under ANSI mode, Spark's default)."""
    return F.element_at(col(a), col(i))


def cardinality(a) -> Column:
    return F.when(col(a).isNotNull(), F.size(col(a)).cast("long"))


def position_array(x, a, start: int = 1) -> Column:
    """First place of ``x`` at or after ``start``; 0 if there is none."""
    a = col(a)
    if start == 1:
        return F.array_position(a, col(x)).cast("long")
    found = F.array_position(F.slice(a, start, F.greatest(F.size(a) - start + 1, F.lit(0))), col(x))
    return F.when(found > 0, found + start - 1).otherwise(found).cast("long")


def sequence_array(lo, hi, step) -> Column:
    return F.sequence(col(lo), col(hi), col(step))


def sort_array(a, ascending: bool = True, nulls_first: bool = True) -> Column:
    """Sorted; nulls come first in either direction unless asked otherwise."""
    a = col(a)
    whole = F.array_sort(F.array_compact(a))
    if not ascending:
        whole = F.reverse(whole)
    nulls = F.filter(a, lambda x: x.isNull())
    return F.concat(nulls, whole) if nulls_first else F.concat(whole, nulls)


def trim_array(a, n) -> Column:
    """Without its last ``n`` elements; n outside 0 to the size raises."""
    a, n = col(a), col(n)
    bad = (n < 0) | (n > F.size(a))
    return F.when(bad, F.raise_error(F.lit("2202E data exception: array element error"))).otherwise(F.slice(a, 1, F.size(a) - n))


def json_value(x: Column, kind: str) -> Column:
    """A value as JSON text: strings and datetimes quoted, the rest plain; null as null."""
    if kind in ("string", "date", "timestamp", "timestamp_ntz") or kind.startswith(("char", "varchar", "interval", "binary")):
        text = x.cast("string")
        quoted = F.concat(F.lit('"'), F.regexp_replace(text, r'([\\"])', r"\\$1"), F.lit('"'))
        return F.coalesce(quoted, F.lit("null"))
    if kind.startswith(("array", "struct", "map")):
        return F.coalesce(F.to_json(x), F.lit("null"))
    return F.coalesce(x.cast("string"), F.lit("null"))


def json_array(values: list[tuple[Column, str]], absent_on_null: bool = False) -> Column:
    """JSON_ARRAY of (column, Spark type) pairs of any types; nulls stay unless ``absent_on_null``."""
    parts = [F.when(x.isNotNull(), json_value(x, kind)) if absent_on_null else json_value(x, kind) for x, kind in values]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def json_object(pairs: list[tuple[str, Column, str]], absent_on_null: bool = False, unique_keys: bool = False) -> Column:
    """JSON_OBJECT of (key, column, Spark type); ``unique_keys`` refuses a key given twice."""
    keys = [k for k, _, _ in pairs]
    if unique_keys and len(set(keys)) < len(keys):
        raise ValueError("23505 integrity constraint violation: unique keys")
    parts = []
    for key, x, kind in pairs:
        part = F.concat(json_value(F.lit(key), "string"), F.lit(":"), json_value(x, kind))
        parts.append(F.when(x.isNotNull(), part) if absent_on_null else part)
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def greatest(*values) -> Column:
    """Left fold of CASE WHEN a > b THEN a ELSE b: a null on the left yields the right value, one on the right yields null."""
    out = col(values[0])
    for v in values[1:]:
        out = F.when(out > col(v), out).otherwise(col(v))
    return out


def least(*values) -> Column:
    out = col(values[0])
    for v in values[1:]:
        out = F.when(out < col(v), out).otherwise(col(v))
    return out


def decode(x, *pairs) -> Column:
    """DECODE(x, search, result, ..., default): nulls match nulls."""
    x, out = col(x), None
    for i in range(0, len(pairs) - 1, 2):
        hit = x.eqNullSafe(col(pairs[i]))
        out = F.when(hit, col(pairs[i + 1])) if out is None else out.when(hit, col(pairs[i + 1]))
    return out.otherwise(col(pairs[-1])) if len(pairs) % 2 else out


def nvl2(x, there, absent) -> Column:
    return F.when(col(x).isNotNull(), col(there)).otherwise(col(absent))


def casewhen(condition, yes, no) -> Column:
    return F.when(col(condition), col(yes)).otherwise(col(no))


def session_values(spark: SparkSession) -> dict[str, object]:
    """Values of the session functions that are no column of a table."""
    user = spark.sparkContext.sparkUser()
    catalog, schema = spark.catalog.currentCatalog(), spark.catalog.currentDatabase()
    return {
        "CURRENT_CATALOG": catalog, "DATABASE": catalog, "DATABASE_NAME": catalog, "CURRENT_SCHEMA": schema, "CURRENT_USER": user, "USER": user,
        "SESSION_USER": user, "SYSTEM_USER": user, "CURRENT_ROLE": None, "DATABASE_VERSION": spark.version, "SESSION_ID": spark.sparkContext.applicationId,
        "DATABASE_ISOLATION_LEVEL": "READ COMMITTED", "SESSION_ISOLATION_LEVEL": "READ COMMITTED", "ISOLATION_LEVEL": "READ COMMITTED",
        "IS_AUTOCOMMIT": True, "IS_READONLY_DATABASE": False, "IS_READONLY_DATABASE_FILES": False, "IS_READONLY_SESSION": False, "TRANSACTION_CONTROL": "LOCKS",
    }


#: SQL name -> column builder.
FUNCTIONS = {
    "ARRAY_SORT": sort_array, "SORT_ARRAY": sort_array, "CARDINALITY": cardinality, "POSITION_ARRAY": position_array, "SEQUENCE_ARRAY": sequence_array,
    "TRIM_ARRAY": trim_array, "MAX_CARDINALITY": lambda bound: F.lit(bound), "ARRAY_MAX_CARDINALITY": lambda bound: F.lit(bound),
    "COALESCE": _same("coalesce"), "NULLIF": _same("nullif"), "IFNULL": _same("coalesce"), "ISNULL": _same("coalesce"), "NVL": _same("coalesce"),
    "NVL2": nvl2, "DECODE": decode, "GREATEST": greatest, "LEAST": least, "CASEWHEN": casewhen, "IF": casewhen, "JSON_ARRAY": json_array, "JSON_OBJECT": json_object,
}
