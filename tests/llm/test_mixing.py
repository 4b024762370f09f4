from collections import Counter

import pytest
from helpers import ODD, WORD, documents

from relquill.llm import mixing
from relquill.llm._shared import read_table


def targets(total):
    """{source: target} by refilling until no target is over three times its source."""
    names = sorted(s for s in total if s is not None) + ([None] if None in total else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = sum(total.values()) - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * total[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * total[s] for s in over}


def check(rows, got, slack):
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    want, taken = targets(size), Counter()
    by_id = {}
    for i, t, s in rows:
        by_id.setdefault(i, []).append((len(WORD.findall(t or "")), s))
    assert len(got) == len(rows)
    for r in got:
        own = [s for n, s in by_id[r["doc_id"]] if n == r["size"] and size[s] == r["source_size"]]
        assert own and 0 <= r["taken"] <= 3 * r["size"]
        assert any(r["target"] == pytest.approx(want[s]) for s in own)
        taken[own[0]] += r["taken"]
    for s in size:
        assert abs(taken[s] - want[s]) <= slack, (s, taken[s], want[s])


def test_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    first, again = mixing.op1_mixing(spark, sf_dir).collect(), mixing.op1_mixing(spark, sf_dir).collect()
    check(rows, first, 4)
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, again), key=str)


def test_capped_sources_and_edges(spark):
    rows = [(i, "w " * (1 + i % 7), "big") for i in range(400)] + [(1000 + i, "a b c", "tiny") for i in range(3)] + [(2000, "x y", None)]
    got = mixing.mix(documents(spark, rows)).collect()
    check(rows, got, 4)
    odd = [r for r in ODD if r[0] is not None and r[0] != 4]
    check(odd, mixing.mix(documents(spark, odd)).collect(), 4)
    assert mixing.mix(documents(spark, ODD)).count() == len(ODD)
    assert mixing.mix(documents(spark, [])).count() == 0
    assert all(r["taken"] == 0 for r in mixing.mix(documents(spark, [(1, None, "a"), (2, "", None)])).collect())


def test_schedule_is_even_in_every_run_of_slots(spark):
    sizes = spark.createDataFrame([(k, 10, 10_000) for k in ("0a", "0b", "0c")], "key string, docs long, source_size long")
    slots = [r["key"] for r in mixing.schedule(spark, mixing.source_targets(sizes), 10).orderBy("slot").collect()]
    assert len(slots) == 1024
    for lo in range(0, 1024, 128):
        part = Counter(slots[lo : lo + 128])
        assert all(abs(part[k] - 128 * w / 6) <= 4 for k, w in zip(("0a", "0b", "0c"), (1, 2, 3), strict=True))


def test_slots_grow_with_the_mix():
    assert [mixing.slot_exponent(n) for n in (0, 1, 5, 10**6, 10**9, 10**12, 10**14)] == [0, 0, 2, 18, 20, 30, 37]


def test_many_sources(spark):
    n = 300_000
    sizes = spark.range(n).selectExpr("concat('0', lpad(id, 6, '0')) AS key", "1L AS docs", "1 + id % 5 AS source_size")
    want = mixing.source_targets(sizes)
    assert want.where("target <= 0").isEmpty()
    assert mixing.schedule(spark, want).select("key").distinct().count() == n


def test_stage_is_in_slot_order(spark, sf_dir):
    rows = [(i, "w " * 50, "abc"[i % 3]) for i in range(300)]
    out = [r["source"] for r in mixing.mix_stage(spark, documents(spark, rows), sf_dir).collect()]
    for lo in range(0, len(out) - 60, 60):  # any run of the mix is near the weights 1, 2, 3
        part = Counter(out[lo : lo + 60])
        assert all(abs(part[k] - 60 * w / 6) <= 6 for k, w in zip("abc", (1, 2, 3), strict=True)), part


def test_stage_repeats_and_cuts(spark, sf_dir):
    rows = [(i, "w " * (1 + i % 7), "big") for i in range(60)] + [(100, "a b  c", "tiny")]
    docs = documents(spark, rows)
    out = mixing.mix_stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    words = Counter()
    for r in out.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert words == Counter({k: v for k, v in taken.items() if v})


def test_sources_smaller_than_a_slot_get_their_targets(spark):
    rows = [(i, "w " * 500, "big") for i in range(400)] + [(1000 + i, "a b c", f"tiny{i:02d}") for i in range(40)] + [(2000, "x y", None)]
    docs = documents(spark, rows)
    got = mixing.mix(docs, slot_bits=6).collect()  # slots of about 3,000 words
    check(rows, got, 1)
    assert all((r["first_slot"] is not None) == (r["taken"] > 0) for r in got)
    assert all(0 <= r["first_slot"] < 64 for r in got if r["taken"])
    assert len({r["first_slot"] for r in got if r["doc_id"] < 1000}) > 32


def test_slots_do_not_pass_through_the_driver(spark, sf_dir):
    rows = [(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(60)]
    plan = mixing.mix_stage(spark, documents(spark, rows), sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join " in x and "sk#" in x]
    assert len(joins) == 1 and "strategy=broadcast" not in joins[0]
