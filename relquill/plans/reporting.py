"""Reporting queries: scans with pushed filters, star joins, aggregates and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.operators import aggregates as A
from relquill.operators import relational as R
from relquill.plans.registry import query, table

_CENTS = "decimal(12,2)"


def _money(name: str):
    return F.col(name).cast(_CENTS)


def _revenue():
    return F.sum(_money("l_extendedprice") * (F.lit(1).cast("decimal(3,2)") - F.col("l_discount").cast("decimal(3,2)"))).cast("double")


@query(
    """SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(12,2))::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(12,2))::DOUBLE AS sum_base,
       sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(3,2)))::DOUBLE AS sum_disc, count(*) AS count_order
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'")
    out = rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(_money("l_quantity")).cast("double").alias("sum_qty"),
        F.sum(_money("l_extendedprice")).cast("double").alias("sum_base"),
        _revenue().alias("sum_disc"),
        F.count(F.lit(1)).alias("count_order"),
    )
    return R.order_by(out, "l_returnflag", "l_linestatus")


@query(
    """SELECT l_orderkey, sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(3,2)))::DOUBLE AS revenue, o_orderdate
       FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
       AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
       GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10"""
)
def shipping_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, sf_dir, "orders").where("o_orderdate < TIMESTAMP '1998-03-15 00:00:00'").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").where("l_shipdate > TIMESTAMP '1998-03-15 00:00:00'")
    rows = li.join(o.join(c, o.o_custkey == c.c_custkey, "left_semi"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = rows.groupBy("l_orderkey", "o_orderdate").agg(_revenue().alias("revenue"))
    return R.order_by(out, ("revenue", True), "o_orderdate", "l_orderkey").limit(10).select("l_orderkey", "revenue", "o_orderdate")


@query(
    """SELECT n_name, sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(3,2)))::DOUBLE AS revenue
       FROM customer, orders, lineitem, supplier, nation, region
       WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
       AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name"""
)
def local_supplier_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    places = t("nation").join(t("region").where("r_name = 'ASIA'"), F.expr("n_regionkey = r_regionkey"), "left_semi")
    s = t("supplier").join(places, F.expr("s_nationkey = n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    rows = t("lineitem").join(s, F.expr("l_suppkey = s_suppkey")).join(t("orders"), F.expr("l_orderkey = o_orderkey"))
    rows = rows.join(t("customer").select("c_custkey", "c_nationkey"), F.expr("c_custkey = o_custkey AND c_nationkey = s_nationkey"))
    return rows.groupBy("n_name").agg(_revenue().alias("revenue"))


@query(
    """SELECT sum(l_extendedprice::DECIMAL(12,2) * l_discount::DECIMAL(3,2))::DOUBLE AS revenue FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24"""
)
def revenue_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(
        "l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' AND l_discount BETWEEN 0.03D AND 0.07D AND l_quantity < 24"
    )
    return rows.agg(F.sum(_money("l_extendedprice") * F.col("l_discount").cast("decimal(3,2)")).cast("double").alias("revenue"))


@query(
    """SELECT c_custkey, c_name, sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(3,2)))::DOUBLE AS revenue, n_name
       FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey
       GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20"""
)
def returned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").where("l_returnflag = 'R'").join(t("orders").select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey"))
    # aggregated by customer before the customer's own columns join
    top = R.order_by(rows.groupBy("o_custkey").agg(_revenue().alias("revenue")).join(t("customer"), F.expr("c_custkey = o_custkey")), ("revenue", True), "c_custkey")
    out = top.limit(20).join(t("nation"), F.expr("c_nationkey = n_nationkey"))
    return out.select("c_custkey", "c_name", "revenue", "n_name")


@query(
    """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, q.qty AS sum_qty FROM orders JOIN
       (SELECT l_orderkey, sum(l_quantity::DECIMAL(12,2))::DOUBLE AS qty FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity::DECIMAL(12,2)) > 150) q ON o_orderkey = q.l_orderkey"""
)
def large_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(_money("l_quantity")).cast("double").alias("sum_qty")).where("sum_qty > 150")
    return table(spark, sf_dir, "orders").join(big, F.expr("o_orderkey = l_orderkey")).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "sum_qty")


@query(
    """SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, count(DISTINCT user_id) AS users, sum(value::DECIMAL(12,2))::DOUBLE AS total
       FROM events GROUP BY event_type, date_trunc('hour', ts)"""
)
def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return rows.groupBy("event_type", "hour").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.sum(_money("value")).cast("double").alias("total"))


@query(
    """SELECT o_orderpriority, count(*) AS order_count, count(*) // 3 AS third, sum(o_totalprice::DECIMAL(12,2))::DOUBLE AS total FROM orders
       WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40) GROUP BY o_orderpriority"""
)
def order_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    busy = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select("l_orderkey")
    rows = table(spark, sf_dir, "orders").join(busy, F.expr("o_orderkey = l_orderkey"), "left_semi")
    out = rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("order_count"), F.sum(_money("o_totalprice")).cast("double").alias("total"))
    return out.withColumn("third", F.expr("order_count div 3"))


@query("""SELECT p_brand, p_type, count(DISTINCT l_suppkey) AS supplier_cnt, (sum(p_size) // count(*))::BIGINT AS avg_size
          FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size IN (1, 5, 9, 14, 21, 36, 45) GROUP BY p_brand, p_type""")
def supplier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_size IN (1, 5, 9, 14, 21, 36, 45)").select("p_partkey", "p_brand", "p_type", "p_size")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(p, F.expr("l_partkey = p_partkey"))
    return rows.groupBy("p_brand", "p_type").agg(F.count_distinct("l_suppkey").alias("supplier_cnt"), A.avg_int(F.col("p_size")).alias("avg_size"))
