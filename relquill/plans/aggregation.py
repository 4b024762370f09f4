"""Queries of the aggregation operators. The SQL beside each states this engine's semantics in the checking engine's terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.operators import aggregates as A
from relquill.operators import relational as R
from relquill.plans.registry import query, sql, table


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority")
def group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS total, max(l_partkey) AS top FROM lineitem WHERE l_quantity < 0")
def global_aggregate_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_quantity < 0").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("total"), F.max("l_partkey").alias("top"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("total"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand, p_type), (p_size), (p_size), ())""")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.grouping_sets(table(spark, sf_dir, "part"), [["p_brand", "p_type"], ["p_size"], ["p_size"], []], [F.count(F.lit(1)).alias("n")]).select("p_brand", "p_type", "p_size", "n")


@query("""SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand, p_type), (p_brand), ())""")
def group_by_distinct_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GROUP BY DISTINCT: sets that come twice count once."""
    sets = [["p_brand", "p_type"], ["p_brand"], ["p_type", "p_brand"], ["p_brand"], []]
    return R.grouping_sets(table(spark, sf_dir, "part"), sets, [F.count(F.lit(1)).alias("n")], distinct=True).select("p_brand", "p_type", "n")


@query("""SELECT c_mktsegment, c_nationkey, grouping(c_mktsegment, c_nationkey)::BIGINT AS bits, grouping(c_nationkey)::BIGINT AS by_nation, count(*) AS n
          FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)""")
def grouping_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").cube("c_mktsegment", "c_nationkey").agg(
        A.grouping_bits(F.col("c_mktsegment"), F.col("c_nationkey")).alias("bits"), A.grouping_bits(F.col("c_nationkey")).alias("by_nation"), F.count(F.lit(1)).alias("n")
    )


@query("""SELECT year(o_orderdate)::INTEGER AS y, CASE WHEN o_totalprice > 250000 THEN 'high' ELSE 'low' END AS band, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 3""")
def group_by_expression_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, "SELECT year(o_orderdate) AS y, CASE WHEN o_totalprice > 250000 THEN 'high' ELSE 'low' END AS band, count(*) AS n FROM {orders} GROUP BY y, 2 HAVING count(*) > 3", "orders")


@query("SELECT count(*) AS n FROM orders HAVING count(*) > 10")
def having_without_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n")).where("n > 10")


@query("""SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, sum(l_linenumber) FILTER (WHERE l_quantity > 25)::BIGINT AS big,
          count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'N') AS n_suppliers FROM lineitem GROUP BY l_linestatus""")
def filtered_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, """SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, sum(l_linenumber) FILTER (WHERE l_quantity > 25) AS big,
        count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'N') AS n_suppliers FROM {lineitem} GROUP BY l_linestatus""", "lineitem")  # fmt: skip


@query("SELECT o_orderstatus, count(*) AS n FROM (SELECT DISTINCT o_orderstatus, o_custkey, o_orderpriority FROM orders) GROUP BY o_orderstatus")
def count_distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(A.count_distinct_rows(F.col("o_custkey"), F.col("o_orderpriority")).alias("n"))


@query("""SELECT l_suppkey, trunc(sum(l_linenumber) / count(*))::BIGINT AS avg_line, sum(l_orderkey)::DECIMAL(38,0)::VARCHAR AS total_key,
          (trunc(sum((l_quantity - 25)::DECIMAL(12,2)) * 100 / count(*)) / 100)::DECIMAL(12,2)::DOUBLE AS avg_off FROM lineitem GROUP BY l_suppkey""")
def typed_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AVG and SUM in the argument's terms: integers cut, decimals cut to their scale, sums that cannot overflow."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        A.avg_int(F.col("l_linenumber")).alias("avg_line"),
        A.sum_exact(F.col("l_orderkey")).cast("string").alias("total_key"),
        A.avg_decimal((F.col("l_quantity") - 25).cast("decimal(12,2)"), 2).cast("double").alias("avg_off"),
    )


@query("""SELECT event_type, make_timestamp((sum(epoch_us(ts)) // count(*))::BIGINT) AS mid FROM events GROUP BY event_type""")
def average_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(A.avg_timestamp(F.col("ts")).cast("timestamp_ntz").alias("mid"))


@query("""SELECT n_regionkey, round(CASE WHEN count(x) = 1 THEN 0 ELSE stddev_samp(x) END, 6) AS dev, round(CASE WHEN count(x) = 1 THEN 0 ELSE var_samp(x) END, 4) AS var,
          round(stddev_pop(x), 6) AS dev_pop, round(var_pop(x), 4) AS var_pop, round(stddev_samp(x), 6) AS dev_samp
          FROM (SELECT n_regionkey, n_nationkey::DOUBLE AS x FROM nation WHERE n_regionkey > 0 OR n_nationkey = 0) GROUP BY n_regionkey""")
def deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STDDEV and VARIANCE of one row are 0; the _SAMP forms are null."""
    x = F.col("n_nationkey").cast("double")
    return table(spark, sf_dir, "nation").where("n_regionkey > 0 OR n_nationkey = 0").groupBy("n_regionkey").agg(
        F.round(A.stddev(x), 6).alias("dev"), F.round(A.variance(x), 4).alias("var"), F.round(F.stddev_pop(x), 6).alias("dev_pop"),
        F.round(F.var_pop(x), 4).alias("var_pop"), F.round(F.stddev_samp(x), 6).alias("dev_samp"),
    )


@query("""SELECT o_orderpriority, trunc(median(o_custkey))::BIGINT AS mid_customer, median(o_totalprice) AS mid_price FROM orders GROUP BY o_orderpriority""")
def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(A.median(F.col("o_custkey"), "bigint").alias("mid_customer"), A.median(F.col("o_totalprice"), "double").alias("mid_price"))


@query("""SELECT l_returnflag, bool_and(l_quantity > 0) AS every_pos, bool_or(l_discount > 0.09) AS some_high, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day FROM lineitem GROUP BY l_returnflag""")
def every_some_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.every(F.col("l_quantity") > 0).alias("every_pos"), F.some(F.col("l_discount") > F.lit(0.09)).alias("some_high"),
        F.min("l_shipdate").cast("timestamp_ntz").alias("first_day"), F.max("l_shipdate").cast("timestamp_ntz").alias("last_day"),
    )


@query("""SELECT s_nationkey, any_value(s_nationkey) AS any_nation, array_to_string(list(coalesce(x::VARCHAR, '-') ORDER BY x NULLS FIRST), ',') AS keys
          FROM (SELECT s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END AS x FROM supplier) GROUP BY s_nationkey""")
def array_agg_keeps_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").withColumn("x", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey")))
    out = rows.groupBy("s_nationkey").agg(A.any_value(F.col("s_nationkey")).alias("any_nation"), A.array_agg(F.col("x")).alias("a"))
    return out.select("s_nationkey", "any_nation", F.array_join(F.transform("a", lambda v: F.coalesce(v.cast("string"), F.lit("-"))), ",").alias("keys"))


@query("""WITH g AS (SELECT n_regionkey, list(n_name ORDER BY n_nationkey DESC) AS a, list(DISTINCT n_name ORDER BY n_name) AS d FROM nation GROUP BY n_regionkey)
          SELECT n_regionkey, array_to_string(a, '; ') AS names, array_to_string(d, '|') AS distinct_names, array_to_string(a[1:2], ',') AS first_two,
          CASE WHEN length(array_to_string(a, ',')) <= 20 THEN array_to_string(a, ',') ELSE array_to_string(a[1:2], ',') || ',..(' || (len(a) - 2)::VARCHAR || ')' END AS cut FROM g""")
def listagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GROUP_CONCAT, STRING_AGG, LISTAGG with DISTINCT, FETCH and ON OVERFLOW TRUNCATE .. WITH COUNT."""
    name, down = F.col("n_name"), -F.col("n_nationkey")
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(
        A.listagg(name, "; ", down).alias("names"), A.listagg(name, "|", distinct=True).alias("distinct_names"),
        A.listagg(name, ",", down, fetch=2).alias("first_two"), A.listagg(name, ",", down, overflow=20, filler="..", with_count=True).alias("cut"),
    )


@query("""SELECT n_regionkey, '[' || string_agg('"' || n_name || '"', ',' ORDER BY n_nationkey) || ']' AS names,
          '{' || string_agg('"' || n_name || '":' || n_nationkey::VARCHAR, ',' ORDER BY n_name) || '}' AS by_name FROM nation GROUP BY n_regionkey""")
def json_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(A.json_arrayagg(F.col("n_name"), F.col("n_nationkey")).alias("names"), A.json_objectagg(F.col("n_name"), F.col("n_nationkey")).alias("by_name"))


@query("""SELECT c_mktsegment, round(exp(avg(ln(c_acctbal + 2000))), 4) AS geo FROM customer WHERE c_acctbal > -1999 GROUP BY c_mktsegment""")
def user_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user-defined aggregate (CREATE AGGREGATE FUNCTION) composed of built-in ones, so that it combines map-side."""
    geo = lambda x: F.exp(F.avg(F.ln(x)))
    return table(spark, sf_dir, "customer").where("c_acctbal > -1999").groupBy("c_mktsegment").agg(F.round(geo(F.col("c_acctbal") + 2000), 4).alias("geo"))
