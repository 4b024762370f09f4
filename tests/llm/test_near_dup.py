import random

import numpy as np
from helpers import ODD, components, documents, shingles

from relquill.llm import near_dup


def found(df, size):
    rows = near_dup.near_duplicates(df, size=size).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] is not None}, rows


def corpus(seed=3):
    """Copies, near copies on both sides of the threshold, chains, and unlike texts that share a long passage."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(800)]
    rows, common = [], [rng.choice(words) for _ in range(25)]
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.choice((3, 12, 60, 200)))]
        rows.append(base)
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(copy)
            if rng.random() < 0.3:
                base = copy
        if g % 3 == 0:
            rows.append(common + [rng.choice(words) for _ in range(40)])
    rng.shuffle(rows)
    return [(i + 1, " ".join(r)) for i, r in enumerate(rows)]


def test_brute_force(spark):
    for size in (2, 5):
        rows = corpus(size)
        got, _ = found(documents(spark, [(i, t, "a") for i, t in rows]), size)
        assert got == {i: (n, c, c == i) for i, (n, c) in components(rows, size).items()}


def test_large_group_of_different_near_copies(spark):
    rng = random.Random(1)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(700):
        copy = list(base)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(120)] = f"z{rng.randrange(10_000)}"
        rows.append((i + 1, " ".join(copy)))
    got, _ = found(documents(spark, [(i, t, "a") for i, t in rows]), 2)
    assert got == {i: (n, c, c == i) for i, (n, c) in components(rows, 2).items()}


def test_edges(spark):
    got, rows = found(documents(spark, ODD), 5)
    assert len(rows) == len(ODD)
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True)
    assert got[4] == (1, 4, True)
    assert got[5] == (5, 5, True) and got[6] == (5, 5, False) and got[7] == (5, 5, False)
    assert sorted((r["n_shingles"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None) == [(0, None, True), (1, None, True)]
    assert near_dup.near_duplicates(documents(spark, [])).count() == 0


def test_stage_keeps_one_of_each_group(spark, sf_dir):
    out = near_dup.dedup_stage(spark, documents(spark, ODD), sf_dir)
    assert set(out.columns) == set(documents(spark, ODD).columns)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 8, 9, 10, 11] and ids.count(None) == 2


def test_signature_estimates_likeness():
    rng = np.random.default_rng(0)
    a, b = [f"t{i}" for i in range(400)], [f"t{i}" for i in range(40, 440)]
    del rng
    texts = [" ".join(a).encode(), " ".join(b).encode()]
    h, who = near_dup.shingle_hashes(texts, 1)
    _, at = near_dup.superminhash(h, who, 2)
    real = len(shingles(" ".join(a), 1) & shingles(" ".join(b), 1)) / len(shingles(" ".join(a), 1) | shingles(" ".join(b), 1))
    assert abs((at[0] == at[1]).mean() - real) < 0.12


def test_few_links_are_grouped_by_few_jobs(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1200)] + [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(400)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(8)
    context = spark.sparkContext
    context.setJobGroup("few links", "")
    got = {tuple(r) for r in near_dup.connected_components(df).collect()}
    jobs = len(context.statusTracker().getJobIdsForGroup("few links"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 6
    by_steps = {tuple(r) for r in near_dup.connected_components(df, at_once=0).collect()}
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for x, y in edges:
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    assert got == by_steps == {(x, find(x)) for e in edges for x in e if x != find(x)}
