"""Exact top-k inner products by exhaustive term-at-a-time accumulation over blocks.

Vectors become integer weights floor(scale * x); a component is a term, its non-zero weights over a
candidate block are the term's postings. A block of queries accumulates one term at a time: the queries
that hold the term scatter query weight x posting weight into a dense array of scores. Each query then
selects its k best of the block by partitioning, and the blocks' lists are merged.

Queries x candidates is the stated work, done in blocks: pairs of blocks are grouped by key, so a task holds
one query block, one candidate block and one array of scores, whatever the tables' size; nothing is broadcast.
Blocks are dealt round by a counted row number's remainder, so they are even.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part; so do null
ids. Vectors of other lengths than the query's score over the components both have. Rows that share a
query's id are the query's own and are not its candidates, and one of them asks; other repeated rows each count. Ties go to
the smaller id. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relquill.llm._shared import prepare, read_table, stage

QUERY_BLOCK, BLOCK = 512, 2048
#: Postings that at least this share of a block holds are worked as a whole row of the array.
DENSE = 0.5


def accumulate(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Scores (queries x block rows) of integer weight matrices, one term at a time."""
    terms = min(queries.shape[1], block.shape[1])
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(block).max(initial=0)) * max(1, terms)
    kind = np.int32 if most < 2**31 else np.int64
    queries, block = queries.astype(kind), block.astype(kind)
    scores = np.zeros((len(queries), len(block)), kind)
    part = np.empty_like(scores)
    for t in range(terms):
        holds = np.flatnonzero(queries[:, t])
        ids = np.flatnonzero(block[:, t])
        if not len(holds) or not len(ids):
            continue
        if len(holds) >= DENSE * len(queries) and len(ids) >= DENSE * len(block):
            np.multiply(queries[:, t][:, None], block[:, t][None, :], out=part)
            scores += part
        else:
            scores[np.ix_(holds, ids)] += queries[holds, t][:, None] * block[ids, t][None, :]
    return scores


def select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of one query: by score down, then id up; ``own`` is left out."""
    keep = ids != own
    s, i = scores[keep], ids[keep]
    if len(s) > k:
        floor = np.partition(s, len(s) - k)[len(s) - k]
        top = s >= floor  # with all that tie at the floor, for the ids to decide
        s, i = s[top], i[top]
    order = np.lexsort((i, -s.astype(np.int64)))[:k]
    return s[order], i[order]


def exact_topk(
    rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0
) -> DataFrame:
    """Per query its k best rows: query_id, rank (from 1), vec_id, score."""
    prepare(rows.sparkSession, 2048)

    def weights(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        good = df.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0))
        good = good.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))))
        out = good.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(scale))).alias("w"))
        return stage(out.withColumn("r", F.monotonically_increasing_id()), "weights")

    def dealt(df: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
        blocks = max(1, -(-df.count() // size))
        # rows of a file partition are numbered in turn: their remainders are even
        return df.withColumn(name, F.pmod(F.col("r"), F.lit(blocks)).cast("int")), blocks

    c, n_c = dealt(weights(rows), BLOCK, "cb")
    q, n_q = dealt(weights(queries.dropDuplicates([id_col])), QUERY_BLOCK, "qb")
    c = c.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).select("qb", "cb", "id", "w", F.lit(False).alias("is_query"))
    q = q.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1)))).select("qb", "cb", "id", "w", F.lit(True).alias("is_query"))

    def matrix(column: pd.Series) -> np.ndarray:
        width = max(map(len, column), default=0)
        out = np.zeros((len(column), width), np.int64)
        for i, w in enumerate(column):
            out[i, : len(w)] = w
        return out

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        mine = frame["is_query"].to_numpy(bool)
        qs, cs = frame[mine], frame[~mine]
        scores = accumulate(matrix(qs["w"]), matrix(cs["w"]))
        ids, out = cs["id"].to_numpy(np.int64), []
        for i, own in enumerate(qs["id"].to_numpy(np.int64)):
            s, v = select(scores[i], ids, int(own), k)
            out.append(pd.DataFrame({"query_id": int(own), "vec_id": v, "score": s.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    lists = q.unionByName(c).groupBy("qb", "cb").applyInPandas(best, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best partners of every 20th vector among all ``embeddings``."""
    rows = read_table(spark, sf_dir, "embeddings")
    return exact_topk(rows, rows.where("vec_id % 20 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS (SELECT vec_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.w * c.w)::BIGINT AS score
      FROM t q JOIN t c ON q.i = c.i WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id GROUP BY q.vec_id, c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s) WHERE rank <= 20
"""
