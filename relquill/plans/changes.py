"""Queries of changes to tables: the contents after INSERT, UPDATE, DELETE, MERGE, with constraints, versions, sequences, text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.operators import dml
from relquill.plans.registry import query, table
from relquill.sources import text
from relquill.sources.storage import shared_dir


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000, 'Copy of ' || s_name, 0, s_acctbal FROM supplier WHERE s_nationkey = 1")
def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT .. SELECT with a default for one column and a generated other."""
    s = _suppliers(spark, sf_dir)
    new = s.where("s_nationkey = 1").select((F.col("s_suppkey") + 1000000).alias("s_suppkey"), "s_acctbal", F.col("s_name").alias("old"))
    return dml.insert(s, new, defaults={"s_nationkey": F.lit(0)}, generated={"s_name": F.concat(F.lit("Copy of "), F.col("old"))})


@query("SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_nationkey END AS s_nationkey, CASE WHEN s_acctbal < 0 THEN s_acctbal + s_nationkey ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All new values come from the old row."""
    return dml.update(_suppliers(spark, sf_dir), {"s_nationkey": F.lit(None), "s_acctbal": F.col("s_acctbal") + F.col("s_nationkey")}, F.col("s_acctbal") < 0)


@query("SELECT s_suppkey, s_name, s_nationkey, coalesce(x.top, s_acctbal) AS s_acctbal FROM supplier LEFT JOIN (SELECT l_suppkey, max(l_extendedprice) AS top FROM lineitem WHERE l_quantity > 45 GROUP BY l_suppkey) x ON l_suppkey = s_suppkey")
def update_from_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_extendedprice").alias("top"))
    return dml.update_from(_suppliers(spark, sf_dir), top, ["s_suppkey"], {"s_acctbal": "top"})


@query("SELECT * FROM supplier WHERE NULLIF(s_nationkey, 5) < 10 IS NOT TRUE")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for which the condition is unknown stay."""
    return dml.delete(_suppliers(spark, sf_dir), F.expr("NULLIF(s_nationkey, 5) < 10"))


@query("SELECT count(*) AS n FROM supplier WHERE false")
def truncate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.delete(_suppliers(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"))


_SOURCE = "(SELECT s_suppkey * 2 AS k, s_acctbal AS bal, s_nationkey AS nat FROM supplier)"


@query(f"""SELECT s_suppkey, CASE WHEN k IS NOT NULL AND NOT bal < 0 AND bal > 5000 THEN 'rich' ELSE s_name END AS s_name, s_nationkey, CASE WHEN k IS NOT NULL AND NOT bal < 0 AND bal > 5000 THEN s_acctbal + bal ELSE s_acctbal END AS s_acctbal
          FROM supplier LEFT JOIN {_SOURCE} ON k = s_suppkey WHERE NOT coalesce(bal < 0, false)
          UNION ALL SELECT k, 'new', nat, bal FROM {_SOURCE} WHERE k NOT IN (SELECT s_suppkey FROM supplier) AND bal > 100""")
def merge_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MERGE with DELETE, UPDATE and INSERT branches; the first that holds decides."""
    s = _suppliers(spark, sf_dir)
    source = s.select((F.col("s_suppkey") * 2).alias("s_suppkey"), F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("nat"))
    bal = F.col("new_bal")
    return dml.merge(s, source, ["s_suppkey"], [
        dml.When(True, "DELETE", condition=bal < 0),
        dml.When(True, "UPDATE", {"s_name": F.lit("rich"), "s_acctbal": F.col("s_acctbal") + bal}, bal > 5000),
        dml.When(False, "INSERT", {"s_suppkey": F.col("new_s_suppkey"), "s_name": F.lit("new"), "s_nationkey": F.col("new_nat"), "s_acctbal": bal}, bal > 100),
    ], prefix="new_")


@query("""SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT s_suppkey, 'replaced', 9, 0 FROM supplier WHERE s_suppkey % 4 = 0""")
def replace_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _suppliers(spark, sf_dir)
    new = s.where("s_suppkey % 4 = 0").select("s_suppkey", F.lit("replaced").alias("s_name"), F.lit(9).alias("s_nationkey"), F.lit(0.0).alias("s_acctbal"))
    return dml.replace_rows(s, new, ["s_suppkey"])


@query("SELECT * FROM supplier UNION ALL SELECT s_suppkey * 3 + 1000000, s_name, s_nationkey, s_acctbal FROM supplier")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _suppliers(spark, sf_dir)
    return dml.insert_ignore(s, s.unionByName(s.withColumn("s_suppkey", F.col("s_suppkey") * 3 + 1000000)), ["s_suppkey"])


@query("""SELECT 'not null o_custkey' AS "constraint", count(*) FILTER (WHERE o_custkey IS NULL) AS n FROM orders UNION ALL SELECT 'check price', count(*) FILTER (WHERE NOT o_totalprice < 400000) FROM orders
          UNION ALL SELECT 'unique o_custkey', coalesce(sum(c), 0)::BIGINT FROM (SELECT count(*) AS c FROM orders GROUP BY o_custkey HAVING count(*) > 1)
          UNION ALL SELECT 'foreign key o_custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)""")
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "customer").where("c_nationkey < 20")
    return dml.violations(table(spark, sf_dir, "orders"), not_null=["o_custkey"], check={"price": F.col("o_totalprice") < 400000}, unique=[["o_custkey"]], foreign=[(["o_custkey"], parents, ["c_custkey"])])


@query("""SELECT 'CASCADE' AS action, count(*) AS n, count(c_nationkey) AS k FROM customer WHERE c_nationkey >= 5 UNION ALL SELECT 'SET NULL', count(*), count(*) FILTER (WHERE c_nationkey >= 5) FROM customer
          UNION ALL SELECT 'SET DEFAULT', count(*), count(*) FROM customer""")
def foreign_key_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, gone = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").where("n_nationkey < 5")
    out = None
    for action in ("CASCADE", "SET NULL", "SET DEFAULT"):
        after = dml.on_parent_delete(c, ["c_nationkey"], gone, ["n_nationkey"], action, {"c_nationkey": F.lit(10)})
        one = after.agg(F.lit(action).alias("action"), F.count(F.lit(1)).alias("n"), F.count("c_nationkey").alias("k"))
        out = one if out is None else out.unionAll(one)
    return out


@query("""SELECT 'as of start' AS at, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier UNION ALL SELECT 'now', count(*), round(sum(CASE WHEN s_nationkey < 5 THEN 0 ELSE s_acctbal END), 2) FROM supplier WHERE s_nationkey <> 7
          UNION ALL SELECT 'all', count(*) + count(*) FILTER (WHERE s_nationkey < 5), round(sum(s_acctbal), 2) FROM supplier UNION ALL SELECT 'between', count(*) + count(*) FILTER (WHERE s_nationkey < 5), round(sum(s_acctbal), 2) FROM supplier""")
def system_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = dml.versioned(_suppliers(spark, sf_dir), "2020-01-01 00:00:00")
    v = dml.update_versioned(v, {"s_acctbal": F.lit(0.0)}, F.col("s_nationkey") < 5, "2021-01-01 00:00:00")
    v = dml.delete_versioned(v, F.col("s_nationkey") == 7, "2022-01-01 00:00:00")
    views = {
        "as of start": dml.as_of(v, "2020-06-01 00:00:00"), "now": dml.current_rows(v), "all": v,
        "between": dml.system_time_between(v, "2020-06-01 00:00:00", "2021-01-01 00:00:00", True),
    }
    out = None
    for name, rows in views.items():
        one = rows.agg(F.lit(name).alias("at"), F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("s_acctbal").cast("decimal(14,2)")).cast("double"), 2).alias("total"))
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT count(*) AS n, 100::BIGINT AS lo, 100 + (count(*) - 1) * 5 AS hi, count(*) AS different FROM supplier")
def sequence_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dml.Sequence(start=100, increment=5).numbered(_suppliers(spark, sf_dir), "id")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.count_distinct("id").alias("different"))


@query("SELECT s_suppkey, s_name, NULLIF(s_nationkey, 3) AS s_nationkey, s_acctbal FROM supplier")
def text_table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXPORT DATA to a delimited text table in the shared folder, and that table read again."""
    import uuid

    s = _suppliers(spark, sf_dir).withColumn("s_nationkey", F.expr("NULLIF(s_nationkey, 3)"))
    settings = text.TextSettings.parse(f"{shared_dir(spark)}/relquill/text-{uuid.uuid4().hex};fs=|;ignore_first=true;quoted=true")
    text.write_text_table(s, settings)
    return text.read_text_table(spark, s.schema, settings)


@query("SELECT 'rq_nations' AS table_name, 'VIEW' AS table_type, 3::BIGINT AS n_columns")
def information_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "nation").createOrReplaceTempView("rq_nations")
    t = dml.information_schema(spark, "TABLES").where("table_name = 'rq_nations'").select("table_name", "table_type")
    n = dml.information_schema(spark, "COLUMNS").where("table_name = 'rq_nations'").groupBy("table_name").agg(F.count(F.lit(1)).alias("n_columns"))
    return t.join(n, "table_name")
