"""Queries of predicates, joins, sorting, limits, set operations and recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.operators import relational as R
from relquill.plans.registry import query, sql, table


def _same(text: str, *names: str):
    """A query whose Spark SQL and checking SQL are one text: tables in braces."""
    plain = text
    for n in names:
        plain = plain.replace("{" + n + "}", n)

    def add(name: str) -> None:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return sql(spark, sf_dir, text, *names)

        run.__name__ = name
        query(plain)(run)

    return add


# --- scans, projections, predicates

_same("SELECT * FROM {region}", "region")("select_star")
_same("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS doubled FROM {lineitem} WHERE l_shipdate >= TIMESTAMP '2000-01-01 00:00:00' AND l_quantity < 10", "lineitem")("scan_filter_project")
_same("SELECT v.a, v.b FROM (VALUES (1, 'x'), (2, 'y'), (CAST(NULL AS INTEGER), 'z')) AS v(a, b)")("values_table")
_same("SELECT count(*) AS n, min(l_shipdate) AS lo, max(l_orderkey) AS hi FROM {lineitem}", "lineitem")("count_min_max_metadata")
_same("SELECT c_custkey FROM {customer} WHERE c_acctbal BETWEEN 0 AND 500 OR c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT c_nationkey IN (1, 2, 3)", "customer")("in_between")
_same("SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE 's%g' AND p_name NOT LIKE '%!%%' ESCAPE '!' OR p_type LIKE '_CON%'", "part")("like_escape")
_same("SELECT c_custkey, (c_acctbal > 0) IS TRUE AS pos, (NULLIF(c_nationkey, 3) > 10) IS NULL AS unknown, NULLIF(c_nationkey, 3) IS DISTINCT FROM 4 AS differs FROM {customer}", "customer")("three_valued_tests")
_same("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END AS band,
    COALESCE(NULLIF(o_orderstatus, 'P'), '-') AS st FROM {orders}""", "orders")("case_coalesce_nullif")  # fmt: skip
_same("SELECT o_orderkey FROM {orders} WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' AND EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')", "orders", "lineitem")("exists_subquery")
_same("SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)", "customer", "orders")("not_exists_subquery")
_same("SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 300000)", "customer", "orders")("not_in_subquery")
_same("SELECT p_partkey, (SELECT max(l_extendedprice) FROM {lineitem} WHERE l_partkey = p_partkey) AS top FROM {part} WHERE p_size > 40", "part", "lineitem")("scalar_subquery")
_same("WITH busy AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey), top AS (SELECT * FROM busy WHERE n > 15) SELECT c_name, n FROM top JOIN {customer} ON c_custkey = o_custkey", "orders", "customer")("with_clause")


@query("SELECT c_custkey FROM customer WHERE c_nationkey BETWEEN 5 AND 9 OR c_nationkey BETWEEN 20 AND c_nationkey")
def between_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").where(R.between_symmetric(k, F.lit(9), F.lit(5)) | ((k >= 20) & (k <= k))).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_linenumber = 2 AND l_suppkey = 3) OR (l_linenumber < 1 OR (l_linenumber = 1 AND l_suppkey < 5))")
def row_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = [F.col("l_linenumber"), F.col("l_suppkey")]
    rows = table(spark, sf_dir, "lineitem").where(R.row_equal(row, [F.lit(2), F.lit(3)]) | R.row_less(row, [F.lit(1), F.lit(5)]))
    return rows.select("l_orderkey", "l_linenumber")


@query("""SELECT '> ALL' AS op, c_custkey FROM customer WHERE c_acctbal > ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey = 3)
          UNION ALL SELECT '< ANY', c_custkey FROM customer WHERE c_acctbal < ANY (SELECT s_acctbal FROM supplier WHERE s_nationkey = 3)
          UNION ALL SELECT '= ANY', c_custkey FROM customer WHERE c_nationkey = ANY (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)
          UNION ALL SELECT '<> ALL', c_custkey FROM customer WHERE c_nationkey <> ALL (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)
          UNION ALL SELECT '> ALL empty', c_custkey FROM customer WHERE c_acctbal > ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey = 99)""")
def quantified_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    three, rich, none = s.where("s_nationkey = 3"), s.where("s_acctbal > 9000"), s.where("s_nationkey = 99")
    parts = [
        ("> ALL", R.quantified(c, F.col("c_acctbal"), ">", "ALL", three, "s_acctbal")),
        ("< ANY", R.quantified(c, F.col("c_acctbal"), "<", "ANY", three, "s_acctbal")),
        ("= ANY", R.quantified(c, F.col("c_nationkey"), "=", "ANY", rich, "s_nationkey")),
        ("<> ALL", R.quantified(c, F.col("c_nationkey"), "<>", "ALL", rich, "s_nationkey")),
        ("> ALL empty", R.quantified(c, F.col("c_acctbal"), ">", "ALL", none, "s_acctbal")),
    ]
    out = None
    for name, rows in parts:
        one = rows.select(F.lit(name).alias("op"), "c_custkey")
        out = one if out is None else out.unionAll(one)
    return out


@query("""SELECT 'key' AS what, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING count(*) > 1)) = 0 AS is_unique
          UNION ALL SELECT 'customer', (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1)) = 0""")
def unique_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    one = R.unique_rows(o, ["o_orderkey"]).select(F.lit("key").alias("what"), "is_unique")
    return one.unionAll(R.unique_rows(o, ["o_custkey"]).select(F.lit("customer").alias("what"), "is_unique"))


_MATCH = "(SELECT c_custkey, NULLIF(c_nationkey, 7) AS a, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 40 END AS b FROM customer)"


@query(f"""WITH l AS {_MATCH}, r AS (SELECT s_nationkey AS x, s_suppkey % 40 AS y FROM supplier)
          SELECT 'simple' AS mode, c_custkey FROM l WHERE a IS NULL OR b IS NULL OR EXISTS (SELECT 1 FROM r WHERE x = a AND y = b)
          UNION ALL SELECT 'full', c_custkey FROM l WHERE (a IS NULL AND b IS NULL) OR EXISTS (SELECT 1 FROM r WHERE x = a AND y = b)
          UNION ALL SELECT 'partial', c_custkey FROM l WHERE (a IS NULL AND b IS NULL) OR EXISTS (SELECT 1 FROM r WHERE coalesce(x = a, true) AND coalesce(y = b, true))
          UNION ALL SELECT 'unique', c_custkey FROM l WHERE a IS NULL OR b IS NULL OR (SELECT count(*) FROM r WHERE x = a AND y = b) = 1""")
def match_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select("c_custkey", F.expr("NULLIF(c_nationkey, 7)").alias("a"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 40 END").alias("b"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("x"), (F.col("s_suppkey") % 40).alias("y"))
    out = None
    for name, mode, once in (("simple", "SIMPLE", False), ("full", "FULL", False), ("partial", "PARTIAL", False), ("unique", "SIMPLE", True)):
        one = R.match_rows(left, ["a", "b"], right, ["x", "y"], mode, once).select(F.lit(name).alias("mode"), "c_custkey")
        out = one if out is None else out.unionAll(one)
    return out


@query("""SELECT o_orderkey, (s < TIMESTAMP '1998-07-01' AND e > TIMESTAMP '1998-01-01') AS overlaps, (s <= TIMESTAMP '1998-01-01' AND e >= TIMESTAMP '1998-02-01') AS contains,
          (s <= TIMESTAMP '1998-03-03' AND e > TIMESTAMP '1998-03-03') AS contains_point, e <= TIMESTAMP '1998-01-01' AS precedes, e = TIMESTAMP '1998-01-01' AS meets,
          s >= TIMESTAMP '1998-02-01' AS succeeds, s = TIMESTAMP '1998-02-01' AS met, (s = TIMESTAMP '1998-01-01' AND e = TIMESTAMP '1998-02-01') AS same,
          (s < TIMESTAMP '1998-07-01' AND e > TIMESTAMP '1998-01-01') AS either_way
          FROM (SELECT o_orderkey, o_orderdate AS s, o_orderdate + INTERVAL 31 DAY AS e FROM orders)""")
def period_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("s"), F.expr("CAST(o_orderdate AS TIMESTAMP_NTZ) + INTERVAL 31 DAY").alias("e"))
    rows = R.checked_period(rows, "s", "e")
    s, e, jan, feb, jul = F.col("s"), F.col("e"), day("1998-01-01"), day("1998-02-01"), day("1998-07-01")
    p = R.PERIOD
    return rows.select(
        "o_orderkey", p["OVERLAPS"](s, e, jan, jul).alias("overlaps"), p["CONTAINS"](s, e, jan, feb).alias("contains"), R.period_contains_point(s, e, day("1998-03-03")).alias("contains_point"),
        p["PRECEDES"](s, e, jan, feb).alias("precedes"), p["IMMEDIATELY PRECEDES"](s, e, jan, feb).alias("meets"), p["SUCCEEDS"](s, e, jan, feb).alias("succeeds"),
        p["IMMEDIATELY SUCCEEDS"](s, e, jan, feb).alias("met"), p["EQUALS"](s, e, jan, feb).alias("same"), R.overlaps(s, e, jul, jan).alias("either_way"),
    )


# --- joins

_same("SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_totalprice > 200000", "orders", "customer")("inner_join")
_same("SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey AND o_orderstatus = 'P'", "customer", "orders")("left_join")
_same("SELECT s_suppkey, n_name FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey AND s_acctbal > 5000", "supplier", "nation")("right_join")
_same("SELECT c_custkey, s_suppkey FROM {customer} FULL JOIN {supplier} ON c_custkey = s_suppkey * 7", "customer", "supplier")("full_join")
_same("SELECT n_name, r_name FROM {nation} CROSS JOIN {region}", "nation", "region")("cross_join")
_same("SELECT a.n_name AS x, b.n_name AS y FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey", "nation")("theta_join")
_same("SELECT c_name, r_name FROM {customer} LEFT JOIN ({nation} JOIN {region} ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey", "customer", "nation", "region")("parenthesised_join")
_same("SELECT n_name, r_name, count(*) AS n FROM {customer}, {nation}, {region} WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY n_name, r_name", "customer", "nation", "region")("comma_join")
_same("SELECT r_name, t.n_name FROM {region}, LATERAL (SELECT n_name FROM {nation} WHERE n_regionkey = r_regionkey ORDER BY n_nationkey DESC LIMIT 2) t", "region", "nation")("lateral_subquery")


@query("SELECT n_nationkey, n_name, NULL::INTEGER AS r_regionkey, NULL::VARCHAR AS r_name FROM nation UNION ALL SELECT NULL, NULL, r_regionkey, r_name FROM region")
def union_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.union_join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "region"))


@query("SELECT regionkey, n_name, r_name FROM (SELECT n_regionkey AS regionkey, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS regionkey, r_name FROM region)")
def natural_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.natural_join(table(spark, sf_dir, "nation").selectExpr("n_regionkey AS regionkey", "n_name"), table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "regionkey"))


@query("SELECT nationkey, c_custkey, s_suppkey FROM (SELECT c_nationkey AS nationkey, c_custkey FROM customer WHERE c_acctbal > 9000) FULL JOIN (SELECT s_nationkey AS nationkey, s_suppkey FROM supplier WHERE s_acctbal > 9000) USING (nationkey)")
def join_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").selectExpr("c_nationkey AS nationkey", "c_custkey")
    return c.join(table(spark, sf_dir, "supplier").where("s_acctbal > 9000").selectExpr("s_nationkey AS nationkey", "s_suppkey"), ["nationkey"], "full")


@query("""SELECT r_regionkey, i::INTEGER AS ord, a[i] AS x, b[i] AS y FROM (SELECT r_regionkey, list_value(1, 2, 3) AS a, string_split(r_name, 'A') AS b FROM region),
          LATERAL (SELECT unnest(range(1, greatest(len(a), len(b)) + 1)) AS i)""")
def unnest_with_ordinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region").select("r_regionkey", F.array(F.lit(1), F.lit(2), F.lit(3)).alias("a"), F.split("r_name", "A").alias("b"))
    return R.unnest(rows, {"a": "x", "b": "y"}, "ord").select("r_regionkey", "ord", "x", "y")


@query("""SELECT w.user_id, count(*) AS n FROM events e JOIN (SELECT user_id, min(ts) AS s, min(ts) + INTERVAL 1 HOUR AS f FROM events GROUP BY user_id) w
          ON e.ts >= w.s AND e.ts < w.f GROUP BY w.user_id""")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the first hour of each user: only their number is asked, so it is a difference of running sums and no pair is made."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id")
    spans = e.groupBy("user_id").agg(F.min("ts").alias("s")).withColumn("f", F.expr("s + INTERVAL 1 HOUR"))
    return R.range_join_counts(e.select("ts"), spans, "ts", "s", "f", 1).select("user_id", "n")


# --- sorting and limits

_same("SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "orders")("top_k")


@query("SELECT x, c_custkey FROM (SELECT NULLIF(c_nationkey, 4) AS x, c_custkey FROM customer) ORDER BY x DESC NULLS FIRST, c_custkey NULLS FIRST LIMIT 30 OFFSET 5")
def order_nulls_first_limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.expr("NULLIF(c_nationkey, 4)").alias("x"), "c_custkey")
    return R.limited(R.order_by(rows, ("x", True), "c_custkey"), 30, 5)


@query("SELECT n_name FROM nation")
def limit_zero_is_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.limited(table(spark, sf_dir, "nation").select("n_name"), 0)


@query("SELECT count(*) AS n, 1::BIGINT AS lo, count(*) AS hi, count(*) AS different FROM lineitem WHERE l_quantity > 10")
def rownum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROWNUM() over the rows that pass WHERE: which row gets which number is open, so the numbers are summed up."""
    rows = R.row_numbers(table(spark, sf_dir, "lineitem").where("l_quantity > 10"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("rownum").alias("lo"), F.max("rownum").alias("hi"), F.count_distinct("rownum").alias("different"))


# --- set operations and recursion

_A, _B = "SELECT c_nationkey AS k FROM {customer}", "SELECT s_nationkey AS k FROM {supplier} WHERE s_acctbal > 0"
for _name, _op in {"union_distinct": "UNION", "union_all": "UNION ALL", "intersect_distinct": "INTERSECT", "intersect_all": "INTERSECT ALL", "except_distinct": "EXCEPT", "except_all": "EXCEPT ALL"}.items():
    _same(f"{_A} {_op} {_B}", "customer", "supplier")(_name)
_same("SELECT DISTINCT c_mktsegment, c_nationkey FROM {customer}", "customer")("select_distinct")
_same("SELECT k FROM (SELECT 1 AS k) UNION ALL SELECT c_nationkey FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier} ", "customer", "supplier")("set_precedence")


@query("SELECT nationkey FROM (SELECT c_nationkey AS nationkey FROM customer) EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000")
def corresponding(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr("c_name", "c_nationkey AS nationkey")
    return R.corresponding(c, table(spark, sf_dir, "supplier").where("s_acctbal > 3000").selectExpr("s_nationkey AS nationkey", "s_suppkey"), "EXCEPT")


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation UNION SELECT n_nationkey, (n_nationkey + n_regionkey) % 25 FROM nation),
          t AS (SELECT 2 AS node UNION SELECT b FROM t JOIN e ON a = node) SELECT node FROM t""")
def recursive_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    edges = n.selectExpr("n_nationkey AS a", "(n_nationkey * 3 + 1) % 25 AS b").union(n.selectExpr("n_nationkey AS a", "(n_nationkey + n_regionkey) % 25 AS b"))
    return R.recursive_union(spark.sql("SELECT 2 AS node"), lambda t: t.join(edges, F.col("a") == F.col("node")).select(F.col("b").alias("node")))


@query("WITH RECURSIVE t AS (SELECT 1::BIGINT AS n, 1::BIGINT AS f UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
def recursive_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("WITH RECURSIVE t(n, f) AS (SELECT 1L, 1L UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
