"""Queries of scalar functions and operators over whole columns; and literals through them, a row a function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.functions import collections as C
from relquill.functions import datetimes as D
from relquill.functions import numeric as N
from relquill.functions import strings as S
from relquill.plans.registry import query, sql, table


@query("""SELECT p_partkey, ascii(p_name)::INTEGER AS ascii, length(p_name)::BIGINT AS len, 2 * length(p_name)::BIGINT AS octets, 16 * length(p_name)::BIGINT AS bits,
    upper(p_name) AS up, lower(p_type) AS low, left(p_name, 3) AS l3, right(p_name, 4) AS r4, reverse(p_name) AS rev, replace(p_name, 'e', 'EE') AS rep,
    repeat(p_brand, 2) AS rpt, translate(p_name, 'aeiou', 'AEIOU') AS tr, instr(p_name, 'e')::BIGINT AS pos, p_name || '-' || p_brand AS cat,
    concat_ws('/', p_brand, NULLIF(p_size, 7)::VARCHAR, p_type) AS ws, lpad(trim('  ' || p_brand || ' '), 10, '*') AS lp, rpad(trim(' ' || p_brand), 10, '.') AS rp,
    trim(p_name, 'sg') AS tboth, ltrim(p_name, 'sr') AS tlead, rtrim(p_name, 'gt') AS ttrail FROM part""")
def string_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, b, t = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    f = S.FUNCTIONS
    return table(spark, sf_dir, "part").select(
        "p_partkey", f["ASCII"](n).alias("ascii"), f["CHAR_LENGTH"](n).alias("len"), f["OCTET_LENGTH"](n).alias("octets"), f["BIT_LENGTH"](n).alias("bits"),
        f["UPPER"](n).alias("up"), f["LCASE"](t).alias("low"), f["LEFT"](n, 3).alias("l3"), f["RIGHT"](n, 4).alias("r4"), f["REVERSE"](n).alias("rev"), f["REPLACE"](n, "e", "EE").alias("rep"),
        f["REPEAT"](b, 2).alias("rpt"), f["TRANSLATE"](n, "aeiou", "AEIOU").alias("tr"), f["LOCATE"](F.lit("e"), n).alias("pos"), f["CONCAT"](n, "-", b).alias("cat"),
        f["CONCAT_WS"]("/", b, F.expr("NULLIF(p_size, 7)"), t).alias("ws"), f["LPAD"](F.concat(F.lit("  "), b, F.lit(" ")), 10, "*").alias("lp"), f["RPAD"](F.concat(F.lit(" "), b), 10, ".").alias("rp"),
        f["TRIM"](n, "sg").alias("tboth"), S.trim(n, "sr", "leading").alias("tlead"), S.trim(n, "gt", "trailing").alias("ttrail"),
    )


@query("""SELECT p_partkey, CASE WHEN p_size % 9 - 4 < 1 THEN substring(p_name, 1, greatest(0, 5 + p_size % 9 - 4 - 1)) ELSE substring(p_name, p_size % 9 - 4, 5) END AS clipped,
    substring(p_name, greatest(1, p_size % 9 - 4)) AS tail, substring(p_name, 1, 2) || 'XY' || substring(p_name, 6) AS ins, substring(p_name, 1, 1) || 'zz' || substring(p_name, 4) AS ov,
    p_name = 'red widget' AS padded_eq FROM part""")
def substring_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, at = F.col("p_name"), F.expr("p_size % 9 - 4")
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.substring(n, at, 5).alias("clipped"), S.substring(n, at).alias("tail"), S.insert(n, 3, 3, "XY").alias("ins"), S.overlay(n, "zz", 2).alias("ov"),
        S.blank_padded_equal(F.concat(n, F.lit("  ")), "red widget ").alias("padded_eq"),
    )


@query(r"""SELECT p_partkey, regexp_full_match(p_name, '[a-r]+ .*') AS whole, len(regexp_extract_all(p_name, '[aeiou]'))::INTEGER AS vowels, regexp_replace(p_name, '([aeiou])', '<\1>', 'g') AS marked,
    regexp_replace(p_name, '[aeiou]', '_') AS first_only, NULLIF(regexp_extract(p_name, 'e[a-z]'), '') AS piece, array_to_string(regexp_extract_all(p_name, '[a-z]+'), '+') AS pieces FROM part""")
def regular_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.regexp_like(n, "[a-r]+ .*").alias("whole"), S.FUNCTIONS["REGEXP_COUNT"](n, "[aeiou]").alias("vowels"), S.regexp_replace(n, "([aeiou])", "<$1>").alias("marked"),
        S.regexp_replace(n, "[aeiou]", "_", first_only=True).alias("first_only"), S.FUNCTIONS["REGEXP_SUBSTR"](n, "e[a-z]").alias("piece"),
        F.array_join(S.FUNCTIONS["REGEXP_SUBSTRING_ARRAY"](n, "[a-z]+"), "+").alias("pieces"),
    )


@query("""SELECT p_partkey, lower(hex(p_partkey)) AS hexed, lower(hex(encode(p_name))) AS raw, to_base64(encode(p_name)) AS b64, p_name AS back, p_name AS unhexed, chr(256 + p_size) AS ch FROM part""")
def encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    raw = S.rawtohex(n.cast("binary"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.hex_number(F.col("p_partkey")).alias("hexed"), raw.alias("raw"), F.base64(n.cast("binary")).alias("b64"), F.unbase64(F.base64(n.cast("binary"))).cast("string").alias("back"),
        F.unhex(raw).cast("string").alias("unhexed"), S.char(F.col("p_size") + 256).alias("ch"),
    )


@query("""SELECT * FROM (VALUES ('asciistr', 'caf\\00e9 a'), ('unistr', 'café a'), ('soundex', 'R163'), ('soundex none', '0000'), ('difference', '4'), ('difference far', '3'),
          ('position from', '5'), ('chr', 'é'), ('uuid', '00112233-4455-6677-8899-aabbccddeeff')) AS t(name, value)""".replace("\\\\", "\\"))
def string_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = {
        "asciistr": S.asciistr("café a"), "unistr": S.unistr("caf\\00e9 a"), "soundex": S.soundex("Robert"), "soundex none": S.soundex("12"),
        "difference": S.difference("Robert", "Rupert"), "difference far": S.difference("Aa", "Zz"), "position from": S.position("b", "abcab", 3),
        "chr": S.char(233), "uuid": S.uuid_text(S.uuid_bytes("00112233-4455-6677-8899-aabbccddeeff")),
    }
    return _rows(spark, {k: F.lower(v) if k == "asciistr" else v for k, v in rows.items()})


def _rows(spark: SparkSession, values: dict) -> DataFrame:
    """(name, value as text), a row each."""
    items = F.array(*[F.struct(F.lit(k).alias("name"), v.cast("string").alias("value")) for k, v in values.items()])
    return spark.range(1).select(F.explode(items).alias("x")).select("x.*")


@query("""SELECT l_orderkey, l_linenumber, l_partkey // 7 AS q, -l_linenumber // 2 AS neg_half, mod(l_partkey, 13)::BIGINT AS m, l_linenumber::BIGINT + 2000000000 + 2000000000 AS wide, abs(l_quantity - 25) AS dist,
    ceil(l_discount * 10) AS up, floor(l_tax * 100 + 0.5) AS down, round(l_extendedprice::DECIMAL(12,2), 1)::DOUBLE AS r1, (trunc(l_extendedprice::DECIMAL(12,2) * 10) / 10)::DOUBLE AS t1,
    sign(l_quantity - 25)::INTEGER AS sg, (trunc(l_extendedprice::DECIMAL(12,2) * 100 / l_linenumber) / 100)::DECIMAL(14,2)::DOUBLE AS share,
    (l_suppkey & 5)::BIGINT AS ba, (l_suppkey | 5)::BIGINT AS bo, xor(l_suppkey, 5)::BIGINT AS bx, (l_suppkey & ~5)::BIGINT AS bn, (~l_suppkey)::BIGINT AS bnot FROM lineitem""")
def arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer division truncates, sums promote, decimals divide to their scale; rounding and bits."""
    money, k = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_suppkey")
    f = N.FUNCTIONS
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", N.int_divide(F.col("l_partkey"), 7).alias("q"), N.int_divide(-F.col("l_linenumber"), 2).cast("int").alias("neg_half"), f["MOD"](F.col("l_partkey"), 13).alias("m"),
        N.add(N.add(F.col("l_linenumber"), F.lit(2000000000)), F.lit(2000000000)).alias("wide"), f["ABS"](F.col("l_quantity") - 25).alias("dist"), f["CEIL"](F.col("l_discount") * 10).alias("up"),
        f["FLOOR"](F.col("l_tax") * 100 + 0.5).alias("down"), N.round_number(money, 1).cast("double").alias("r1"), N.truncate(money, 1).cast("double").alias("t1"), N.sign(F.col("l_quantity") - 25).alias("sg"),
        N.decimal_divide(money, F.col("l_linenumber"), 2).cast("double").alias("share"), f["BITAND"](k, F.lit(5)).cast("long").alias("ba"), f["BITOR"](k, F.lit(5)).cast("long").alias("bo"),
        f["BITXOR"](k, F.lit(5)).cast("long").alias("bx"), f["BITANDNOT"](k, F.lit(5)).cast("long").alias("bn"), f["BITNOT"](k).alias("bnot"),
    )


@query("""SELECT c_custkey, round(ln(x), 9) AS ln, round(log10(x), 9) AS log10, round(exp(x / 100000), 9) AS exp, round(sqrt(x), 9) AS sqrt, round(power(x, 0.5), 9) AS power, round(sin(x), 6) AS sin, round(cos(x), 6) AS cos,
    round(tan(y), 6) AS tan, round(cot(y), 6) AS cot, round(asin(y), 6) AS asin, round(acos(y), 6) AS acos, round(atan(x), 9) AS atan, round(atan2(y, x), 9) AS atan2, round(sinh(y), 9) AS sinh, round(cosh(y), 9) AS cosh,
    round(tanh(y), 9) AS tanh, round(degrees(y), 6) AS degrees, round(radians(x), 6) AS radians, round(pi(), 9) AS pi,
    CASE WHEN x < 2000 THEN 0 WHEN x >= 12000 THEN 6 ELSE 1 + floor((x - 2000) / 2000)::INTEGER END::BIGINT AS bucket
    FROM (SELECT c_custkey, c_acctbal + 2001 AS x, (c_custkey % 100 + 1) / 101 AS y FROM customer)""")
def transcendental(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") + 2001).alias("x"), ((F.col("c_custkey") % 100 + 1) / 101).alias("y"))
    x, y, f = F.col("x"), F.col("y"), N.FUNCTIONS
    one = {
        "ln": (f["LN"](x), 9), "log10": (f["LOG10"](x), 9), "exp": (f["EXP"](x / 100000), 9), "sqrt": (f["SQRT"](x), 9), "power": (f["POWER"](x, F.lit(0.5)), 9), "sin": (f["SIN"](x), 6), "cos": (f["COS"](x), 6),
        "tan": (f["TAN"](y), 6), "cot": (f["COT"](y), 6), "asin": (f["ASIN"](y), 6), "acos": (f["ACOS"](y), 6), "atan": (f["ATAN"](x), 9), "atan2": (f["ATAN2"](y, x), 9), "sinh": (f["SINH"](y), 9),
        "cosh": (f["COSH"](y), 9), "tanh": (f["TANH"](y), 9), "degrees": (f["DEGREES"](y), 6), "radians": (f["RADIANS"](x), 6), "pi": (f["PI"](), 9),
    }
    return rows.select("c_custkey", *[F.round(v, n).alias(k) for k, (v, n) in one.items()], f["WIDTH_BUCKET"](x, F.lit(2000.0), F.lit(12000.0), F.lit(5)).alias("bucket"))


@query("""SELECT o_orderkey, year(d)::INTEGER AS y, quarter(d)::INTEGER AS q, month(d)::INTEGER AS m, day(d)::INTEGER AS dd, dayofyear(d)::INTEGER AS doy, (dayofweek(d) + 1)::INTEGER AS dow, weekofyear(d)::INTEGER AS wk,
    isoyear(d)::INTEGER AS iso, dayname(d) AS dname, monthname(d) AS mname, last_day(d) AS eom, date_diff('day', DATE '0001-01-01', d::DATE) + 1 AS days,
    CASE WHEN d::DATE = last_day(d) THEN last_day(d + INTERVAL 1 MONTH) ELSE (d + INTERVAL 1 MONTH)::DATE END AS next_m, d + INTERVAL 5 DAY AS d5, d - INTERVAL 2 MONTH AS m2,
    strftime(d, '%d-%b-%Y %H:%M') AS txt, date_trunc('month', d)::TIMESTAMP AS tm, date_trunc('year', d)::TIMESTAMP AS ty,
    CASE WHEN day(d) >= 16 THEN date_trunc('month', d) + INTERVAL 1 MONTH ELSE date_trunc('month', d) END::TIMESTAMP AS rm FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)""")
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, f = F.col("d"), D.FUNCTIONS
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("d"))
    ntz = "timestamp_ntz"
    return rows.select(
        "o_orderkey", f["YEAR"](d).alias("y"), f["QUARTER"](d).alias("q"), D.date_part("mm", d).alias("m"), f["DAYOFMONTH"](d).alias("dd"), D.date_part("dy", d).alias("doy"), D.date_part("dw", d).alias("dow"),
        f["WEEK"](d).alias("wk"), D.iso_year(d).alias("iso"), f["DAYNAME"](d).alias("dname"), f["MONTHNAME"](d).alias("mname"), f["LAST_DAY"](d).alias("eom"), f["DAYS"](d).alias("days"),
        f["ADD_MONTHS"](d, 1).alias("next_m"), D.date_add("dd", 5, d).cast(ntz).alias("d5"), D.date_add("month", -2, d).cast(ntz).alias("m2"), D.to_char(d, "DD-MON-YYYY HH24:MI").alias("txt"),
        D.trunc(d, "MM").cast(ntz).alias("tm"), D.trunc(d, "YYYY").cast(ntz).alias("ty"), D.round_datetime(d, "MM").cast(ntz).alias("rm"),
    )


@query("""SELECT event_id, hour(ts)::INTEGER AS h, minute(ts)::INTEGER AS mi, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::BIGINT AS sm, (epoch_us(ts) // 1000)::BIGINT AS ums, (epoch_us(ts) // 1000000)::BIGINT AS ut, (epoch_us(ts) % 1000000)::BIGINT AS micros,
    date_trunc('hour', ts) AS th, CASE WHEN minute(ts) >= 30 THEN date_trunc('hour', ts) + INTERVAL 1 HOUR ELSE date_trunc('hour', ts) END AS rh,
    ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 60000000)::BIGINT AS diff_min, ((datediff('day', DATE '2024-01-01', ts::DATE) + 6) // 7)::BIGINT AS diff_wk,
    (datediff('month', DATE '2023-11-15', ts::DATE))::BIGINT AS diff_mo, ts + INTERVAL 90 SECOND AS plus FROM events""")
def time_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, f, start = F.col("ts"), D.FUNCTIONS, F.lit("2024-01-01").cast("timestamp_ntz")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    ntz = "timestamp_ntz"
    return rows.select(
        "event_id", f["HOUR"](ts).alias("h"), f["MINUTE"](ts).alias("mi"), f["SECONDS_MIDNIGHT"](ts).alias("sm"), f["UNIX_MILLIS"](ts).alias("ums"), f["UNIX_TIMESTAMP"](ts).alias("ut"),
        D.date_part("mcs", ts).alias("micros"), D.trunc(ts, "HH24").cast(ntz).alias("th"), D.round_datetime(ts, "HH24").cast(ntz).alias("rh"), D.date_diff("mi", start, ts).alias("diff_min"),
        D.date_diff("wk", start, ts).alias("diff_wk"), D.date_diff("mm", F.lit("2023-11-15").cast(ntz), ts).alias("diff_mo"), D.date_add("ss", 90, ts).cast(ntz).alias("plus"),
    )


@query("""SELECT * FROM (VALUES ('to_date', '1998-10-03 14:05:09'), ('to_timestamp ff', '1998-10-03 14:05:09.123'), ('months_between', '2.00000000'), ('next_day', '2024-01-08'), ('add_months end', '2024-03-31'),
    ('quarter diff', '1'), ('year diff', '1'), ('datediff 2', '30'), ('week diff back', '-2'), ('trunc week', '2024-01-01 00:00:00'), ('round year', '2025-01-01 00:00:00'), ('ds', '1 12:00:00'), ('ym', '18')) AS t(name, value)""")
def date_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    day = lambda s: F.lit(s).cast("date")
    rows = {
        "to_date": D.to_date("03/10/1998 14:05:09", "DD/MM/YYYY HH24:MI:SS"), "to_timestamp ff": D.to_timestamp("03/10/1998 14:05:09.123", "DD/MM/YYYY HH24:MI:SS.FF3"),
        "months_between": D.months_between(t("2024-03-15 10:00:00"), t("2024-01-15 22:00:00")).cast("decimal(10,8)"), "next_day": D.FUNCTIONS["NEXT_DAY"](day("2024-01-01"), F.lit("Mon")),
        "add_months end": D.add_months(day("2024-02-29"), 1), "quarter diff": D.date_diff("quarter", t("2024-03-31"), t("2024-04-01")), "year diff": D.date_diff("year", t("2023-05-01"), t("2024-06-01")),
        "datediff 2": D.days_between(day("2024-01-31"), day("2024-01-01")), "week diff back": D.date_diff("week", t("2024-01-09"), t("2024-01-01")), "trunc week": D.trunc(t("2024-01-04 10:00:00"), "IW"),
        "round year": D.round_datetime(t("2024-08-01"), "YYYY"), "ds": F.regexp_replace(D.num_to_ds_interval(1.5, "DAY").cast("string"), "^INTERVAL '([^']*)'.*$", "$1"),
        "ym": (F.date_part(F.lit("YEAR"), D.num_to_ym_interval(18, "MONTH")) * 12 + F.date_part(F.lit("MONTH"), D.num_to_ym_interval(18, "MONTH"))),
    }
    return _rows(spark, rows)


@query("""SELECT p_partkey, a[2] AS second, len(a)::BIGINT AS card, array_to_string(a || ['new'], ',') AS more, coalesce(list_position(a, p_brand), 0)::BIGINT AS at, array_to_string(list_sort(a), ',') AS sorted,
    array_to_string(a[1:2], ',') AS trimmed, list_contains(a, 'ECONOMY') AS has, array_to_string(range(1, p_size, 7), ',') AS seq FROM (SELECT p_partkey, p_brand, p_size, [p_name, p_brand, p_type] AS a FROM part)""")
def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.array("p_name", "p_brand", "p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey", C.element(a, 2).alias("second"), C.cardinality(a).alias("card"), F.array_join(F.concat(a, F.array(F.lit("new"))), ",").alias("more"), C.position_array(F.col("p_brand"), a).alias("at"),
        F.array_join(C.sort_array(a), ",").alias("sorted"), F.array_join(C.trim_array(a, 1), ",").alias("trimmed"), F.array_contains(a, "ECONOMY").alias("has"),
        F.array_join(F.when(F.col("p_size") > 1, C.sequence_array(F.lit(1), F.col("p_size") - 1, F.lit(7))).otherwise(F.array().cast("array<int>")), ",").alias("seq"),
    )


@query("""SELECT c_custkey, CASE WHEN x > c_nationkey THEN x ELSE c_nationkey END AS g, CASE WHEN c_nationkey < x THEN c_nationkey ELSE x END AS l, coalesce(x, -1) AS nvl, CASE WHEN x IS NOT NULL THEN 'there' ELSE 'absent' END AS nvl2,
    CASE WHEN x IS NULL THEN 'none' WHEN x = 3 THEN 'three' ELSE 'other' END AS dec, CASE WHEN c_acctbal > 0 THEN 'credit' ELSE 'debit' END AS cw FROM (SELECT *, NULLIF(c_nationkey % 6, 5) AS x FROM customer)""")
def conditionals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GREATEST and LEAST with their lopsided nulls, NVL, NVL2, DECODE, CASEWHEN."""
    rows, x, k = table(spark, sf_dir, "customer").withColumn("x", F.expr("NULLIF(c_nationkey % 6, 5)")), F.col("x"), F.col("c_nationkey")
    return rows.select(
        "c_custkey", C.greatest(x, k).alias("g"), C.least(k, x).alias("l"), C.FUNCTIONS["NVL"](x, F.lit(-1)).alias("nvl"), C.nvl2(x, "there", "absent").alias("nvl2"),
        C.decode(x, F.lit(None), "none", 3, "three", "other").alias("dec"), C.casewhen(F.col("c_acctbal") > 0, "credit", "debit").alias("cw"),
    )


@query("""SELECT c_custkey, '[' || c_custkey || ',"' || c_mktsegment || '",' || coalesce(x::VARCHAR, 'null') || ']' AS arr, '[' || c_custkey || CASE WHEN x IS NULL THEN '' ELSE ',' || x::VARCHAR END || ']' AS absent,
    '{"id":' || c_custkey || ',"seg":"' || c_mktsegment || '","x":' || coalesce(x::VARCHAR, 'null') || '}' AS obj FROM (SELECT *, NULLIF(c_nationkey, 3) AS x FROM customer)""")
def json_constructors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("x", F.expr("NULLIF(c_nationkey, 3)"))
    k, seg, x = (F.col("c_custkey"), "bigint"), (F.col("c_mktsegment"), "string"), (F.col("x"), "int")
    return rows.select("c_custkey", C.json_array([k, seg, x]).alias("arr"), C.json_array([k, x], absent_on_null=True).alias("absent"), C.json_object([("id", *k), ("seg", *seg), ("x", *x)]).alias("obj"))


@query("SELECT count(*) AS n, true AS user_there, true AS catalog_there, true AS day_there FROM nation")
def session_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = C.session_values(spark)
    return table(spark, sf_dir, "nation").agg(F.count(F.lit(1)).alias("n")).select(
        "n", (F.lit(v["CURRENT_USER"]) == F.expr("current_user()")).alias("user_there"), (F.lit(v["CURRENT_CATALOG"]) == F.expr("current_catalog()")).alias("catalog_there"),
        (F.current_date() > F.lit("2024-01-01").cast("date")).alias("day_there"),
    )


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 1000 AND c_mktsegment = 'BUILDING'")
def query_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named parameters, as a prepared statement takes them."""
    return spark.sql("SELECT c_custkey, c_acctbal FROM {c} WHERE c_acctbal > :least AND c_mktsegment = :segment", args={"least": 1000, "segment": "BUILDING"}, c=table(spark, sf_dir, "customer"))


@query("SELECT o_orderkey, o_totalprice * 1.1::DOUBLE AS gross, CASE WHEN o_totalprice > 200000 THEN 'A' ELSE 'B' END AS grade FROM orders")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE FUNCTION .. RETURN: SQL functions of the session, expanded into the plan."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION rq_gross(x DOUBLE) RETURNS DOUBLE RETURN x * 1.1D")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION rq_grade(x DOUBLE) RETURNS STRING RETURN CASE WHEN x > 200000 THEN 'A' ELSE 'B' END")
    return sql(spark, sf_dir, "SELECT o_orderkey, rq_gross(o_totalprice) AS gross, rq_grade(o_totalprice) AS grade FROM {orders}", "orders")


@query("SELECT r_regionkey, i::BIGINT AS i, r_regionkey * i AS product FROM (SELECT r_regionkey, unnest(range(1, 4)) AS i FROM region)")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function (RETURNS TABLE) applied to each row."""
    return sql(spark, sf_dir, "SELECT r_regionkey, t.id AS i, r_regionkey * t.id AS product FROM {region}, LATERAL range(1, 4) t", "region")
