"""Queries given as SQL text to a session: the functions as text, definitions, changes, triggers, transactions, blocks, scripts.

The sample tables are views named ``rq_<table>``; each query has a session of its own, and its tables have names of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from relquill.plans.registry import query, table
from relquill.session import Engine
from relquill.sources.storage import shared_dir


def _engine(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(f"rq_{n}")
    return Engine(spark)


@query("""SELECT p_partkey, length(p_name)::BIGINT AS len, length(p_name)::BIGINT AS clen, 2 * length(p_name)::BIGINT AS octets, 16 * length(p_name)::BIGINT AS bits, instr(p_name, 'a')::BIGINT AS at, ltrim(' x' || p_name) AS lt,
    rtrim(p_name || '  ') AS rt, upper(p_name) AS uc, lower(p_type) AS lc, '[' || repeat(' ', p_size % 5) || ']' AS sp, regexp_extract(p_type, '[A-Z]+ED', 0) AS sub, 36::BIGINT AS guid, 36::BIGINT AS newid, 16::BIGINT AS sys,
    substr(p_name, 2, 3) AS mid, left(p_name, 3) AS l3, right(p_name, 3) AS r3, replace(p_name, 'a', '*') AS rep, lower(hex(p_brand)) AS hx, p_name || '/' || p_brand AS cat, reverse(p_brand) AS rev, ascii(p_name) AS asc,
    strpos(p_type, 'ED')::BIGINT AS pos FROM part""")
def text_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir, "part").sql("""
        SELECT p_partkey, LENGTH(p_name) AS len, CHARACTER_LENGTH(p_name) AS clen, OCTETLENGTH(p_name) AS octets, BITLENGTH(p_name) AS bits, CAST(INSTR(p_name, 'a') AS BIGINT) AS at, LTRIM(' x' || p_name) AS lt,
        RTRIM(p_name || '  ') AS rt, UCASE(p_name) AS uc, LCASE(p_type) AS lc, '[' || SPACE(MOD(p_size, 5)) || ']' AS sp, COALESCE(REGEXP_SUBSTRING(p_type, '[A-Z]+ED'), '') AS sub, LENGTH(UUID()) AS guid,
        LENGTH(NEWID()) AS newid, CAST(OCTET_LENGTH(HEX(SYS_GUID())) / 4 AS BIGINT) AS sys, SUBSTRING(p_name FROM 2 FOR 3) AS mid, LEFT(p_name, 3) AS l3, RIGHT(p_name, 3) AS r3, REPLACE(p_name, 'a', '*') AS rep,
        HEX(p_brand) AS hx, CONCAT_WS('/', p_name, p_brand) AS cat, REVERSE(p_brand) AS rev, ASCII(p_name) AS asc, CAST(POSITION('ED' IN p_type) AS BIGINT) AS pos FROM rq_part""")


@query("""SELECT c_custkey, ceil(c_acctbal)::DOUBLE AS up, floor(c_acctbal)::DOUBLE AS down, round(ln(c_acctbal + 2001), 9) AS lg, c_acctbal AS nv, true AS rnd, c_acctbal::DECIMAL(38,10)::DOUBLE AS num, c_custkey // 7 AS quotient,
    c_custkey % 7 AS rest, c_nationkey & 5 AS ba, c_nationkey | 8 AS bo, sign(c_acctbal)::INTEGER AS sg, abs(c_acctbal) AS ab, 0.29::DOUBLE AS tr FROM customer""")
def text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir, "customer").sql("""
        SELECT c_custkey, CAST(CEILING(c_acctbal) AS DOUBLE) AS up, CAST(FLOOR(c_acctbal) AS DOUBLE) AS down, ROUND(LOG(c_acctbal + 2001), 9) AS lg, NANVL(c_acctbal, 0) AS nv, RAND() < 1 AS rnd,
        CAST(TO_NUMBER(CAST(c_acctbal AS VARCHAR(40))) AS DOUBLE) AS num, c_custkey / 7 AS quotient, MOD(c_custkey, 7) AS rest, BITAND(c_nationkey, 5) AS ba, BITOR(c_nationkey, 8) AS bo, SIGN(c_acctbal) AS sg,
        ABS(c_acctbal) AS ab, TRUNC(0.29E0, 2) AS tr FROM rq_customer""")


@query("""SELECT o_orderkey, month(d)::INTEGER AS m, day(d)::INTEGER AS d, (dayofweek(d) + 1)::INTEGER AS dow, dayofyear(d)::INTEGER AS doy, last_day(d) AS eom, monthname(d) AS mn, month(d)::VARCHAR AS dn, d + INTERVAL 3 DAY AS plus,
    d - INTERVAL 2 MONTH AS minus, true AS today, true AS cur, date_diff('day', DATE '1990-01-01', d::DATE) AS n, d AS ts, quarter(d)::INTEGER AS q, strftime(d, '%Y-%m') AS txt FROM (SELECT o_orderkey, o_orderdate::TIMESTAMP AS d FROM orders)""")
def text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir, "orders").sql("""
        SELECT o_orderkey, MONTH(d) AS m, DAY(d) AS d, DAYOFWEEK(d) AS dow, DAYOFYEAR(d) AS doy, EOMONTH(d) AS eom, MONTHNAME(d) AS mn, DATENAME('mm', d) AS dn, DATE_ADD(d, INTERVAL '3' DAY) AS plus,
        DATE_SUB(d, INTERVAL '2' MONTH) AS minus, TODAY() = CURDATE() AS today, CURRENT_DATE > DATE '2024-01-01' AS cur, DATEDIFF('dd', DATE '1990-01-01', d) AS n, CAST(TIMESTAMP(d) AS TIMESTAMP_NTZ) AS ts,
        QUARTER(d) AS q, TO_CHAR(d, 'YYYY-MM') AS txt FROM (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP_NTZ) AS d FROM rq_orders)""")


@query("""SELECT event_id, second(ts)::BIGINT AS s, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::BIGINT AS sm, (epoch_us(ts) // 1000)::BIGINT AS ms, (epoch_us(ts) // 1000000)::BIGINT AS ut, ts - INTERVAL 2 HOUR AS tz, ts - INTERVAL 2 HOUR AS utc,
    ts + INTERVAL 36 HOUR AS ds, ts + INTERVAL 14 MONTH AS ym, true AS clock FROM events""")
def text_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zone without summer time: the second engine has no zone files here."""
    return _engine(spark, sf_dir, "events").sql("""
        SELECT event_id, CAST(FLOOR(SECOND(t)) AS BIGINT) AS s, CAST(FLOOR(SECONDS_MIDNIGHT(t)) AS BIGINT) AS sm, UNIX_MILLIS(t) AS ms, UNIX_TIMESTAMP(t) AS ut, CAST(FROM_TZ(t, '+02:00') AS TIMESTAMP_NTZ) AS tz,
        CAST(SYS_EXTRACT_UTC(t, '+02:00') AS TIMESTAMP_NTZ) AS utc, t + TO_DSINTERVAL('1 12:00:00') AS ds, t + TO_YMINTERVAL('1-02') AS ym,
        LOCALTIMESTAMP >= NOW() AND CURRENT_TIMESTAMP >= SYSTIMESTAMP AND SYSDATE >= NOW() AND CURTIME() >= LOCALTIME AS clock FROM (SELECT event_id, CAST(ts AS TIMESTAMP_NTZ) AS t FROM rq_events)""")


@query("""SELECT * FROM (VALUES ('plus', TIMESTAMP '2024-01-02 13:00:00'), ('minus', TIMESTAMP '2024-01-01 11:00:00'), ('times', TIMESTAMP '2024-01-02 12:00:00'), ('half', TIMESTAMP '2024-01-01 06:00:00'), ('months', TIMESTAMP '2025-03-01 00:00:00'), ('literal', TIMESTAMP '2024-01-01 00:01:30')) AS t(name, moment)""")
def text_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, differences, multiples and parts of intervals."""
    t = "TIMESTAMP '2024-01-01 00:00:00'"
    cells = {
        "plus": "(INTERVAL '1' DAY + INTERVAL '13' HOUR)", "minus": "(INTERVAL '12' HOUR - INTERVAL '1' HOUR)", "times": "(INTERVAL '12' HOUR * 3)", "half": "(INTERVAL '12' HOUR / 2)",
        "months": "(INTERVAL '1' YEAR + INTERVAL '2' MONTH)", "literal": "INTERVAL '01:30' MINUTE TO SECOND",
    }
    return _engine(spark, sf_dir).sql(" UNION ALL ".join(f"SELECT '{k}' AS name, CAST({t} + {v} AS TIMESTAMP_NTZ) AS moment" for k, v in cells.items()))


@query("""SELECT p_partkey, 3::BIGINT AS n, array_to_string(list_sort([p_name, p_brand, p_type]), ',') AS sorted, 2::BIGINT AS at, p_brand AS second, array_to_string([p_name, p_brand], ',') AS cut, 3::BIGINT AS most, '2,4,6' AS seq,
    p_size IN (1, 5, 9) AS there FROM part""")
def text_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir, "part").sql("""
        SELECT p_partkey, CAST(CARDINALITY(a) AS BIGINT) AS n, ARRAY_JOIN(SORT_ARRAY(a), ',') AS sorted, CAST(POSITION_ARRAY('#', ARRAY['x', '#']) AS BIGINT) AS at, a[2] AS second, ARRAY_JOIN(TRIM_ARRAY(a, 1), ',') AS cut,
        CAST(MAX_CARDINALITY(a) AS BIGINT) AS most, ARRAY_JOIN(SEQUENCE_ARRAY(2, 6, 2), ',') AS seq, p_size IN (UNNEST(ARRAY[1, 5, 9])) AS there FROM (SELECT *, ARRAY[p_name, p_brand, p_type] AS a FROM rq_part)""")


@query("""SELECT 'READ COMMITTED' AS iso, 'READ COMMITTED' AS db_iso, 'READ COMMITTED' AS s_iso, true AS auto, false AS ro, false AS rof, false AS ros, 'LOCKS' AS control, true AS users, true AS names, true AS zones, true AS version, true AS session FROM range(1)""")
def text_session_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).sql("""
        SELECT ISOLATION_LEVEL() AS iso, DATABASE_ISOLATION_LEVEL() AS db_iso, SESSION_ISOLATION_LEVEL() AS s_iso, IS_AUTOCOMMIT() AS auto, IS_READONLY_DATABASE() AS ro, IS_READONLY_DATABASE_FILES() AS rof,
        IS_READONLY_SESSION() AS ros, TRANSACTION_CONTROL() AS control, USER() = CURRENT_USER AND SESSION_USER = SYSTEM_USER AND CURRENT_ROLE IS NULL AS users, DATABASE() = DATABASE_NAME() AND CURRENT_CATALOG = DATABASE()
        AND CURRENT_SCHEMA IS NOT NULL AS names, TIMEZONE() = SESSIONTIMEZONE() AND DATABASE_TIMEZONE() = DBTIMEZONE() AND SESSION_TIMEZONE() = CURRENT_TIMEZONE AS zones, DATABASE_VERSION() IS NOT NULL AS version,
        SESSION_ID() IS NOT NULL AS session""")


@query("SELECT s_suppkey AS id, s_name AS name, s_nationkey * 2 AS twice, 'new' AS note FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT -1, 'last', 0, 'own'")
def text_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE AS and LIKE, generated columns, ALTER TABLE, DROP IF EXISTS, a view."""
    e = _engine(spark, sf_dir, "supplier")
    e.script("""
        DROP TABLE rq_def_a IF EXISTS;
        CREATE TABLE rq_def_a AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey AS k FROM rq_supplier WHERE s_acctbal > 0) WITH DATA;
        CREATE TABLE rq_def_b (id BIGINT PRIMARY KEY, name VARCHAR(60) NOT NULL, k INTEGER, twice INTEGER GENERATED ALWAYS AS (k * 2), gone INTEGER);
        INSERT INTO rq_def_b (id, name, k) SELECT id, name, k FROM rq_def_a;
        ALTER TABLE rq_def_b ADD COLUMN remark VARCHAR(10) DEFAULT 'new';
        ALTER TABLE rq_def_b DROP COLUMN gone;
        ALTER TABLE rq_def_b ALTER COLUMN remark RENAME TO note;
        CREATE TABLE rq_def_c (LIKE rq_def_a);
        INSERT INTO rq_def_b (id, name, k, note) VALUES (-1, 'last', 0, 'own');
        CREATE VIEW rq_def_v (id, name, twice, note) AS SELECT id, name, twice, note FROM rq_def_b""")
    return e.sql("SELECT * FROM rq_def_v WHERE id NOT IN (SELECT id FROM rq_def_c)")


@query("""SELECT 'INSERT' AS event, count(*) AS n, sum(n_nationkey)::BIGINT AS total FROM nation UNION ALL SELECT 'UPDATE', count(*), sum(n_nationkey + 100)::BIGINT FROM nation WHERE n_regionkey = 1
          UNION ALL SELECT 'DELETE', count(*), sum(n_nationkey)::BIGINT FROM nation WHERE n_regionkey = 2""")
def text_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row and statement triggers with transition tables write a log of the changes."""
    e = _engine(spark, sf_dir, "nation")
    e.script("""
        CREATE TABLE rq_trg (k INTEGER PRIMARY KEY, r INTEGER);
        CREATE TABLE rq_log (event VARCHAR(10), k INTEGER);
        CREATE TRIGGER rq_t1 AFTER INSERT ON rq_trg REFERENCING NEW TABLE AS fresh FOR EACH STATEMENT INSERT INTO rq_log SELECT 'INSERT', k FROM fresh;
        CREATE TRIGGER rq_t2 AFTER UPDATE ON rq_trg REFERENCING NEW ROW AS nw OLD ROW AS od FOR EACH ROW INSERT INTO rq_log VALUES ('UPDATE', nw.k);
        CREATE TRIGGER rq_t3 AFTER DELETE ON rq_trg REFERENCING OLD ROW AS od FOR EACH ROW INSERT INTO rq_log VALUES ('DELETE', od.k);
        INSERT INTO rq_trg SELECT n_nationkey, n_regionkey FROM rq_nation;
        DELETE FROM rq_trg WHERE r = 2;
        UPDATE rq_trg SET k = k + 100 WHERE r = 1""")
    return e.sql("SELECT event, COUNT(*) AS n, CAST(SUM(k) AS BIGINT) AS total FROM rq_log GROUP BY event")


@query("SELECT n_nationkey AS k, CASE WHEN n_regionkey = 1 THEN 'kept' ELSE n_name END AS name FROM nation WHERE n_regionkey <> 4")
def text_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows a savepoint is undone by ROLLBACK TO it, the rest stays after COMMIT."""
    e = _engine(spark, sf_dir, "nation")
    e.script("""
        CREATE TABLE rq_tx AS (SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM rq_nation) WITH DATA;
        START TRANSACTION; UPDATE rq_tx SET name = 'lost'; ROLLBACK;
        START TRANSACTION; UPDATE rq_tx SET name = 'kept' WHERE r = 1; SAVEPOINT a; DELETE FROM rq_tx; ROLLBACK TO SAVEPOINT a; DELETE FROM rq_tx WHERE r = 4; COMMIT""")
    return e.sql("SELECT k, name FROM rq_tx")


@query("SELECT n_nationkey AS k, n_name AS name, NULLIF(n_regionkey, 3) AS r FROM nation")
def text_export_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PERFORM EXPORT DATA to a file of the shared folder, PERFORM IMPORT DATA into a table."""
    e, at = _engine(spark, sf_dir, "nation"), f"{shared_dir(spark)}/relquill/text-{uuid.uuid4().hex};fs=|"
    e.script("CREATE TABLE rq_out (k INTEGER, name VARCHAR(40), r INTEGER); INSERT INTO rq_out SELECT n_nationkey, n_name, NULLIF(n_regionkey, 3) FROM rq_nation; CREATE TABLE rq_in (k INTEGER, name VARCHAR(40), r INTEGER)")
    e.sql(f"PERFORM EXPORT DATA FROM TABLE rq_out TO '{at}'")
    e.sql(f"PERFORM IMPORT DATA INTO TABLE rq_in FROM '{at}' STOP ON ERROR")
    return e.sql("SELECT k, name, r FROM rq_in")


@query("SELECT r_regionkey AS k, r_name AS name FROM region")
def text_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCRIPT writes the statements that make the tables; another session runs them."""
    e = _engine(spark, sf_dir, "region")
    e.script("CREATE TABLE rq_dumped (k INTEGER PRIMARY KEY, name VARCHAR(30)); INSERT INTO rq_dumped SELECT r_regionkey, r_name FROM rq_region")
    lines = [r[0] for r in e.sql("SCRIPT").collect()]  # a few lines: the sample has five regions
    other = Engine(spark)
    other.script(";".join(line.rstrip(";") for line in lines))
    return other.sql("TABLE rq_dumped")


@query("SELECT 5::BIGINT AS loops, 15::BIGINT AS total, 'many' AS word")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DECLARE, SET, WHILE, IF in a block."""
    return _engine(spark, sf_dir).sql("""
        BEGIN
          DECLARE i BIGINT DEFAULT 0; DECLARE total BIGINT DEFAULT 0; DECLARE word STRING DEFAULT 'none';
          WHILE i < 5 DO SET i = i + 1; SET total = total + i; END WHILE;
          IF total > 10 THEN SET word = 'many'; ELSE SET word = 'few'; END IF;
          SELECT i AS loops, total, word;
        END""")


@query("SELECT name, x::DOUBLE AS x FROM (VALUES ('dual', 1.0), ('top', 5), ('limit', 4), ('unified', 2.5), ('unified', 1), ('period', 25)) AS t(name, x)")
def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SELECT without a table, TOP and LIMIT after SELECT, types of branches, a period's own check."""
    e = _engine(spark, sf_dir, "nation")
    e.script("CREATE TABLE rq_span (k INTEGER, a TIMESTAMP, b TIMESTAMP, CHECK (a < b)); INSERT INTO rq_span SELECT n_nationkey, TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-02-01 00:00:00' FROM rq_nation")
    return e.sql("""SELECT name, CAST(x AS DOUBLE) AS x FROM (
        SELECT 'dual' AS name, CAST(1 AS DECIMAL(12,2)) AS x UNION ALL SELECT 'top', COUNT(*) FROM (SELECT TOP 5 n_nationkey FROM rq_nation ORDER BY n_nationkey) t
        UNION ALL SELECT 'limit', COUNT(*) FROM (SELECT LIMIT 2 4 n_nationkey FROM rq_nation ORDER BY n_nationkey) t UNION ALL SELECT 'unified', x FROM (SELECT 1 AS x UNION SELECT CAST(2.5 AS DECIMAL(4,1))) u
        UNION ALL SELECT 'period', COUNT(*) FROM rq_span WHERE (a, b) OVERLAPS (TIMESTAMP '2024-01-15 00:00:00', TIMESTAMP '2024-03-01 00:00:00')) r""")


@query("""SELECT o_custkey AS k, sum(o_totalprice::DECIMAL(12,2))::DOUBLE AS total, (trunc(sum(o_totalprice::DECIMAL(12,2)) * 100 / 7)::BIGINT / 100)::DOUBLE AS seventh, sum(o_orderkey)::BIGINT AS keys, (sum(o_orderkey) // count(*))::BIGINT AS middle FROM orders GROUP BY o_custkey""")
def text_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUM of bigints as decimal, decimal division cut to its scale, AVG of integers, in text."""
    return _engine(spark, sf_dir, "orders").sql("""
        SELECT k, CAST(total AS DOUBLE) AS total, CAST(total / 7 AS DOUBLE) AS seventh, CAST(keys AS BIGINT) AS keys, middle FROM (SELECT o_custkey AS k, SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS total, SUM(CAST(o_orderkey AS BIGINT)) AS keys,
        AVG(o_orderkey) AS middle FROM rq_orders GROUP BY o_custkey) t""")


@query("SELECT k, name FROM (SELECT n_nationkey AS k, CASE WHEN n_regionkey = 0 THEN upper(n_name) || '!' ELSE n_name END AS name, n_regionkey AS r FROM nation) WHERE r <> 3 UNION ALL SELECT n_nationkey + 500, 'merged' FROM nation WHERE n_regionkey = 3")
def text_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT, UPDATE, MERGE and DELETE as text."""
    e = _engine(spark, sf_dir, "nation")
    e.script("""
        CREATE TABLE rq_chg (k INTEGER PRIMARY KEY, name VARCHAR(40), r INTEGER);
        INSERT INTO rq_chg SELECT n_nationkey, n_name, n_regionkey FROM rq_nation;
        UPDATE rq_chg SET name = UPPER(name) || '!' WHERE r = 0;
        MERGE INTO rq_chg AS t USING (SELECT n_nationkey + 500 AS k FROM rq_nation WHERE n_regionkey = 3) AS s ON t.k = s.k WHEN NOT MATCHED THEN INSERT (k, name, r) VALUES (s.k, 'merged', 9);
        DELETE FROM rq_chg WHERE r = 3""")
    return e.sql("SELECT k, name FROM rq_chg")


@query("SELECT count(*) AS n, max(n_nationkey)::BIGINT AS most, 'added' AS word, true AS single, false AS twice FROM nation WHERE n_regionkey = 1")
def text_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Procedures with IN, OUT and INOUT parameters, told apart by their number, one of them with a variable; UNIQUE (subquery)."""
    e = _engine(spark, sf_dir, "nation")
    e.sql("CREATE TABLE rq_proc (k INTEGER PRIMARY KEY, r INTEGER)")
    e.sql("""CREATE PROCEDURE rq_fill(IN region INTEGER, OUT n BIGINT, INOUT most BIGINT) MODIFIES SQL DATA BEGIN ATOMIC
             INSERT INTO rq_proc SELECT n_nationkey, n_regionkey FROM rq_nation WHERE n_regionkey = region;
             SELECT COUNT(*), MAX(k) + most INTO n, most FROM rq_proc; END""")
    e.sql("CREATE PROCEDURE rq_fill(IN a INTEGER, OUT word VARCHAR(10)) BEGIN DECLARE i INT DEFAULT 0; SET i = a; IF i > 2 THEN SET word = 'added'; ELSE SET word = 'none'; END IF; END")
    e.sql("CALL rq_fill(1, NULL, 0)").createOrReplaceTempView("rq_call_a")
    e.sql("CALL rq_fill(3, NULL)").createOrReplaceTempView("rq_call_b")
    return e.sql("SELECT n, most, word, UNIQUE (SELECT k FROM rq_proc) AS single, UNIQUE (SELECT r FROM rq_proc) AS twice FROM rq_call_a CROSS JOIN rq_call_b")
