"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled ones (of which a share, the class prior, is toxic too) train a
numpy classifier. Its risk is prior * R(positives as 1) + max(0, R(unlabelled as 0) - prior * R(positives
as 0)): the bracket estimates the risk on negatives, and where it falls under zero, which a real risk cannot,
the step goes against it. The negatives' labels are used for the prior alone.

Inputs of a score are runs of letters and their beginnings in the whole text, lower-cased and hashed, each at one, two
and four occurrences. The features whose document frequencies differ most between the samples are kept.

Training is bounded: ``PER_CLASS`` positives and ``UNLABELLED`` other documents, chosen by a hash, so it
costs the same at any size; scoring is one pass without shuffle. Edge cases: null and empty texts score by the
bias alone; without any positive label every score is 0; rows keep their order and number; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.llm import _bytes
from relquill.llm._shared import crc_mod, prepare, read_table, sampled_ids, sampled_rows

BITS = 20
STEMS = (4, 6, 8)
LEVELS = (1, 2, 4)
PER_CLASS, UNLABELLED, KEPT = 2000, 6000, 2048


#: ASCII letters in lower case, other ASCII as blanks; bytes of other letters stay.
_LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256)).lower()


def hashed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed feature, text) of every run of letters and its beginnings, in no particular order."""
    buf, start, end, owner = _bytes.words([p.translate(_LETTERS) for p in parts])
    keys, who = [_bytes.span_hashes(buf, start, end)], [owner]
    for n in STEMS:
        long = end - start > n
        keys.append(_bytes.span_hashes(buf, start[long], start[long] + n) ^ np.uint64(0x5851F42D4C957F2D))
        who.append(owner[long])
    return (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(who)


@dataclass
class Model:
    """slot[feature] is the feature's row of ``weight`` (levels as columns), or -1."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, texts: list) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, parts in _bytes.runs([t and t.lower() for t in texts]):
            key, who = hashed(parts)
            slot = self.slot[key]
            kept = slot >= 0
            pair = who[kept] * len(self.weight) + slot[kept]
            pair, count = np.unique(pair, return_counts=True)
            level = np.searchsorted(LEVELS, count, "right") - 1
            total = np.bincount(pair // len(self.weight), self.weight[pair % len(self.weight), level], len(parts))
            out[first : first + len(parts)] = total + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 1500, batch: int = 256, rate: float = 0.02, decay: float = 2e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative risk, with Adam on the sigmoid loss."""
    rng = np.random.default_rng(11)
    w = np.zeros(pos.shape[1] + 1, np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        p = pos[rng.integers(0, len(pos), batch)].astype(np.float32)
        u = unl[rng.integers(0, len(unl), batch * 2)].astype(np.float32)
        sp = 1 / (1 + np.exp(-(p @ w[:-1] + w[-1])))
        su = 1 / (1 + np.exp(-(u @ w[:-1] + w[-1])))
        # loss as 1 is 1 - s, as 0 is s; their slopes are -s(1-s) and s(1-s)
        negative = su.mean() - prior * sp.mean()
        gp, gu = sp * (1 - sp) / len(p), su * (1 - su) / len(u)
        if negative >= 0:
            cp, cu = -2 * prior * gp, gu
        else:
            cp, cu = prior * gp, -gu
        grad = np.append(cp @ p + cu @ u, cp.sum() + cu.sum()) * 10
        grad[:-1] += decay * w[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _features(docs: DataFrame, id_col: str, text_col: str, sample: list[tuple]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, features, counts) of the sampled documents, made on the executors."""

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        out = []
        for _, parts in _bytes.runs([t and t.lower() for t in texts]):
            key, who = hashed(parts)
            pair, count = np.unique((who << BITS) + key, return_counts=True)
            cut = np.searchsorted(pair >> BITS, np.arange(len(parts) + 1))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                out.append(((pair[a:b] & ((1 << BITS) - 1)) | (np.minimum(count[a:b], 7) << BITS)).astype("<u4").tobytes())
        return pd.Series(out)

    rows = sampled_rows(docs.select(id_col, F.col(text_col).cast("string").alias("__t")), sample, id_col)
    out = []
    for label, id_, data in rows.select("__label", id_col, packed("__t")).collect():
        x = np.frombuffer(data, "<u4")
        out.append((label, id_, (x & ((1 << BITS) - 1)).astype(np.int32), (x >> BITS).astype(np.int8)))
    out.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))  # the order rows arrive in must not matter
    return [(label, key, count) for label, _, key, count in out]


def _nothing() -> Model:
    """What is learned from no positives: every score is 0."""
    return Model(np.full(1 << BITS, -1, np.int16), np.zeros((1, len(LEVELS))), -30.0)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], prior: float) -> Model:
    """The classifier of (1 for positives, 0 for unlabelled; features; their counts)."""
    y = np.array([r[0] for r in rows])
    if not (y == 1).any() or not (y == 0).any():
        return _nothing()
    df = np.zeros((2, 1 << BITS))
    for label, key, _ in rows:
        df[label, key] += 1
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    mean = (df[0] + df[1]) / (n0 + n1)
    z = (df[1] / n1 - df[0] / n0) / np.sqrt(np.maximum(mean * (1 - mean), 1e-9) * (1 / n0 + 1 / n1))
    z[df.sum(axis=0) < 4] = 0
    chosen = np.argsort(-np.abs(z), kind="stable")[:KEPT]
    chosen = np.sort(chosen[np.abs(z[chosen]) > 3])
    slot = np.full(1 << BITS, -1, np.int16)
    slot[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen) * len(LEVELS)), np.int8)
    for i, (_, key, count) in enumerate(rows):
        at = slot[key]
        has = at >= 0
        for j, level in enumerate(LEVELS):
            x[i, at[has & (count >= level)] * len(LEVELS) + j] = 1
    w, bias = nnpu(x[y == 1], x[y == 0], prior)
    return Model(slot, np.cumsum(w.reshape(len(chosen), len(LEVELS)), axis=1, dtype=np.float64), bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits the classifier on rows of ``docs`` and ``labels`` that the caller may learn from."""
    known = labels.select(id_col, F.col(label_col).cast("int").alias("__l")).where("__l IS NOT NULL").where(F.col(id_col).isNotNull())
    prior = known.agg(F.avg("__l")).first()[0]
    positive = sampled_ids(known.where("__l = 1"), id_col, "__l", PER_CLASS)
    if not positive:
        return _nothing()
    other = sampled_ids(docs.select(id_col, F.lit(0).alias("__u")), id_col, "__u", UNLABELLED)
    return fit(_features(docs, id_col, text_col, positive) + _features(docs, id_col, text_col, other), float(prior))


def score_column(spark: SparkSession, model: Model):
    """A column function: text -> score. The model's size is fixed: 2**BITS slots and KEPT rows."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores(texts.tolist()))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, score, predicted. Rows for which ``held_out`` (a column of the id) is true teach nothing."""
    spark = docs.sparkSession
    prepare(spark)
    model = train(docs.where(~held_out), labels.where(~held_out), id_col, text_col)
    out = docs.select(F.col(id_col), held_out.alias("held_out"), score_column(spark, model)(F.col(text_col).cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; a fifth of the ids, by crc32, is held out."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity(docs, labels, crc_mod(F.col("doc_id"), 5) == 0)
