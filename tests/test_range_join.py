"""Range joins and their counts, against comparisons of all with all."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from relquill.operators import relational as R
from relquill.plans import catalog

INF, NAN = float("inf"), float("nan")


def rows_made(df):
    """The most rows that an operator of the executed plan has put out."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.nodeName()
        if "QueryStage" in kind:
            todo.append(node.plan())
        if "AdaptiveSparkPlan" in kind:
            todo.append(node.executedPlan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value()) if metric.isDefined() else most
    return most


def inside(x, s, e):
    if None in (x, s, e):
        return False
    return key(s) <= key(x) < key(e)


def key(x):
    return (1, 0) if x != x else (0, x)


def check(spark, points, spans, kind, width):
    """Both operators over ``points`` and (start, end) pairs, given twice each."""
    left = spark.createDataFrame([(x,) for x in points * 2], f"x {kind}")
    right = spark.createDataFrame([(i % 7, s, e) for i, (s, e) in enumerate(spans * 2)], f"id int, s {kind}, e {kind}")
    want = [(i % 7, sum(inside(x, s, e) for x in points) * 2) for i, (s, e) in enumerate(spans * 2)]
    counted = R.range_join_counts(left, right, "x", "s", "e", width)
    assert counted.columns == ["id", "s", "e", "n"]
    assert Counter((r.id, r.n) for r in counted.collect()) == Counter(w for w in want if w[1])
    return left, right, want


def test_hot_hour_makes_no_pairs(spark, tmp_path):
    """All events of all users in one hour: 2,000 users x 4,000 events would be 8,000,000 pairs."""
    start = datetime(2024, 1, 1)
    events = [(start + timedelta(milliseconds=i % 2000), i % 2000) for i in range(4000)]
    spark.createDataFrame(events, "ts timestamp_ntz, user_id bigint").write.parquet(f"{tmp_path}/events.parquet")
    df = catalog.queries()["range_join"](spark, str(tmp_path))
    assert {r.user_id: r.n for r in df.collect()} == {u: 4000 - 2 * u for u in range(2000)}
    assert rows_made(df) <= 4 * len(events)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_timestamps(spark, kind, zone):
    """Around an hour that New York's clocks leave out, and one that they show twice."""
    rnd = random.Random(3)
    times = [datetime(2024, 3, 10), datetime(2024, 11, 3), datetime(1969, 12, 31, 22)]
    some = lambda: rnd.choice(times) + timedelta(microseconds=rnd.randrange(6 * 3600 * 10**6))
    points = [some() for _ in range(150)] + [times[0], None]
    spans = [(s, s + timedelta(minutes=rnd.randrange(-20, 200))) for s in points[:60]] + [(times[2], times[1]), (None, times[1]), (times[0], None)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        if kind == "timestamp":  # instants, as Python's clock has them
            points, spans = [x and x.astimezone() for x in points], [tuple(x and x.astimezone() for x in p) for p in spans]
        left, right, want = check(spark, points, spans, kind, 600)
        joined = R.range_join(left, right, "x", "s", "e", 6000).groupBy("id").count()
        by_id = Counter()
        for i, n in want:
            by_id[i] += n
        assert {r.id: r["count"] for r in joined.collect()} == {i: n for i, n in by_id.items() if n}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_numbers(spark):
    """Over many blocks of cells, ties, spans that are empty or turned round, values without an order among numbers."""
    rnd = random.Random(4)
    points = [rnd.choice([rnd.uniform(-1e6, 1e6), float(rnd.randrange(5)), rnd.random() / 1e9]) for _ in range(200)]
    spans = [(a, a + rnd.choice([0, -1, 0.5, 3, 1e5])) for a in points[:60]]
    check(spark, points + [INF, -INF, NAN, None, -0.0], spans + [(-INF, INF), (0.0, NAN), (-INF, -INF), (NAN, INF), (INF, NAN), (-0.0, 1.0)], "double", 0.25)
    whole = [int(x) for x in points]
    left, right, want = check(spark, whole + [None], [(a, a + rnd.randrange(-2, 900)) for a in whole[:60]], "bigint", 10)
    joined = R.range_join(left, right, "x", "s", "e", 10)
    assert joined.count() == sum(n for _, n in want)


def test_hot_cell_is_dealt_to_blocks(spark, monkeypatch):
    """Points and spans of one cell in blocks of 16: the pairs are the same, and no task has most of them."""
    monkeypatch.setattr(R, "_BLOCK", 16)
    left = spark.createDataFrame([(i % 400 / 100, {"k": i}) for i in range(800)] + [(50.0, {}), (None, {})], "x double, m map<string, int>")
    right = spark.createDataFrame([(i, i / 100, i / 100 + 1) for i in range(300)] + [(300, 49.0, 51.0), (301, 2.0, 2.0), (302, None, 2.0)], "id int, s double, e double")
    joined = R.range_join(left, right, "x", "s", "e", 10)
    assert joined.columns == ["x", "m", "id", "s", "e"]
    want = Counter({i: 2 * sum(i / 100 <= x / 100 < i / 100 + 1 for x in range(400)) for i in range(300)} | {300: 1})
    assert Counter(r.id for r in joined.collect()) == want
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        share = [r["count"] for r in R.range_join(left, right, "x", "s", "e", 10).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(share) < sum(share) / 2  # all were in one task
