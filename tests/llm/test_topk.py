import numpy as np

from relquill.llm import exact_topk as K


def brute(rows, queries, k):
    good = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q in sorted({i for i, _ in good if i in queries}):
        w = next(v for i, v in good if i == q)
        scored = sorted((-sum(a * b for a, b in zip(w, v, strict=False)), i) for i, v in good if i != q)[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


def run(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS w", "3 AS r", "4 AS score")
    return {tuple(r) for r in K.exact_topk(df, df.where("vec_id % 20 = 0"), k).collect()}


def test_brute_force_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 1)]) for i in range(300)]
    rows += [(400, None), (420, []), (440, [1.0, None] + [0.0] * 6), (460, [float("nan")] * 8), (480, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(500 + i, [0.5] * 8) for i in range(40)]
    assert run(spark, rows) == brute(rows, set(range(0, 1000, 20)), 5)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 16)
    monkeypatch.setattr(K, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (rng.random(6) < 0.4)]) for i in range(260)]
    assert run(spark, rows, 7) == brute(rows, set(range(0, 1000, 20)), 7)


def test_few_and_none(spark):
    rows = [(0, [1.0]), (3, [2.0])]
    assert run(spark, rows) == {(0, 1, 3, 64 * 128)}
    assert run(spark, []) == set()
