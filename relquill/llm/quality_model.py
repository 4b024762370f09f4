"""Document quality by a convolutional network over bytes, in numpy.

Every byte of the text is seen: a learned embedding of the byte, and beside it a plane that says how often its
word has just been repeated (equality at a varying distance is out of reach of any fixed filter), are
read by learned filters over chunks of ``WIDTH`` bytes that start every ``STRIDE`` bytes and so overlap. The
filters' responses are max-pooled over the whole text and a dense layer combines them into one probability.

Training is bounded: ``PER_LABEL`` labelled documents of each label, chosen by a hash, whole texts of any length, up to
``SAMPLE_BYTES`` in all. Scoring is one pass without shuffle, in
runs of bounded size; no chunk reaches into another text, so a score depends on its text alone. Edge cases: null and empty texts pool to zeros and score by the dense layer's bias;
with one label only, that label's probability is the score; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.llm import _bytes
from relquill.llm._shared import crc_mod, prepare, read_table, sampled_ids, sampled_texts

DIMS, WIDTH, STRIDE, FILTERS = 5, 12, 4, 24
PER_LABEL, EPOCHS = 1200, 10
#: Bytes whose windows are held at once.
RUN = 1 << 17


def repeats(parts: list[bytes]) -> np.ndarray:
    """For each byte of the joined run: how often its word has been repeated in direct succession, 0 to 1 for 0 to 8 times."""
    buf, start, end, owner = _bytes.words(parts)
    out = np.zeros(len(buf), np.float32)
    if len(start) < 2:
        return out
    h = _bytes.span_hashes(buf, start, end)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    i = np.arange(len(h))
    since = i - np.maximum.accumulate(np.where(same, 0, i))
    level = np.minimum(since, 8).astype(np.float32) / 8
    at = np.flatnonzero(level)
    if len(at):
        width = end[at] - start[at]
        first = np.repeat(start[at] - np.concatenate([[0], np.cumsum(width)[:-1]]), width)
        out[first + np.arange(width.sum())] = np.repeat(level[at], width)
    return out


@dataclass
class Network:
    embed: np.ndarray  # 256 x DIMS
    filters: np.ndarray  # WIDTH * (DIMS + 1) x FILTERS
    shift: np.ndarray
    dense: np.ndarray
    bias: float

    def planes(self, buf: np.ndarray, rep: np.ndarray, kind=np.float32) -> np.ndarray:
        x = np.empty((len(buf), DIMS + 1), kind)
        x[:, :DIMS] = self.embed[buf]
        x[:, DIMS] = rep
        return x

    def windows(self, x: np.ndarray) -> np.ndarray:
        """The chunks of one run as rows; x is padded so that every byte is in a chunk."""
        n = max(0, (len(x) - WIDTH) // STRIDE + 1)
        step = x.strides[0]
        view = np.lib.stride_tricks.as_strided(x, (n, WIDTH * (DIMS + 1)), (STRIDE * step, x.strides[1]))
        return np.ascontiguousarray(view)

    def pooled(self, parts: list[bytes]) -> np.ndarray:
        """Max-pooled responses, a row for each text."""
        out = np.zeros((len(parts), FILTERS))
        filters = self.filters.astype(np.float64)  # sums in single precision would depend on the batch
        # texts start on the filters' grid, apart by a chunk's width, so that no chunk sees two of them
        parts = [p + b" " * (WIDTH + -(len(p) + 1) % STRIDE) for p in parts]
        starts = np.cumsum([0] + [len(p) + 1 for p in parts])
        rep = repeats(parts)
        buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        rep = np.append(rep, np.float32(0))
        for lo in range(0, len(buf), RUN):
            hi = min(len(buf), lo + RUN + WIDTH - STRIDE)
            y = self.windows(self.planes(buf[lo:hi], rep[lo:hi], np.float64)) @ filters
            at = lo + STRIDE * np.arange(len(y))
            who = np.searchsorted(starts, at, "right") - 1
            y[at + WIDTH > starts[who + 1]] = -np.inf  # begins in the padding and would reach into the next text
            cut = np.flatnonzero(np.diff(who, prepend=-1))
            if len(cut):
                best = np.maximum.reduceat(y, cut) + self.shift
                out[who[cut]] = np.maximum(out[who[cut]], best)
        return out

    def scores(self, texts: list) -> np.ndarray:
        out = np.empty(len(texts))
        for first, parts in _bytes.runs(texts, RUN):
            z = self.pooled(parts) @ self.dense + self.bias
            out[first : first + len(parts)] = np.where([len(p) == 0 for p in parts], self.bias, z)
        # the last bits may still differ with the batch; rounding takes them off
        return np.round(1 / (1 + np.exp(-np.clip(out, -30, 30))), 6)


def fit(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Trains on whole texts: Adam, batches of 32, gradients through each filter's winning chunk."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.5, (256, DIMS)).astype(np.float32),
        rng.normal(0, 0.15, (WIDTH * (DIMS + 1), FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.3, FILTERS).astype(np.float32),
        0.0,
    )
    weight = np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum())))
    values = [net.embed, net.filters, net.shift, net.dense, np.zeros(1, np.float32)]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    rep = [repeats([t]) for t in texts]
    step, total = 0, epochs * -(-len(texts) // 32)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), 32):
            grads = [np.zeros_like(v) for v in values]
            for i in order[lo : lo + 32]:
                pad = WIDTH + -(len(texts[i]) + 1) % STRIDE
                buf = np.frombuffer(texts[i] + b" " * pad + b"\n", np.uint8)
                w = net.windows(net.planes(buf, np.pad(rep[i], (0, pad + 1))))
                z = w @ net.filters
                win = z.argmax(axis=0)
                top = np.maximum(z[win, np.arange(FILTERS)] + net.shift, 0)
                p = 1 / (1 + np.exp(-(top @ net.dense + values[4][0])))
                d = np.float32((p - y[i]) * weight[i] / 32)
                grads[3] += d * top
                grads[4] += d
                dz = d * net.dense * (top > 0)
                chunk = w[win]  # FILTERS x inputs
                grads[1] += chunk.T * dz
                grads[2] += dz
                dx = (net.filters.T * dz[:, None]).reshape(FILTERS, WIDTH, DIMS + 1)[:, :, :DIMS]
                np.add.at(grads[0], buf[(win * STRIDE)[:, None] + np.arange(WIDTH)], dx)
            step += 1
            rate = 0.01 * (1 - step / (total + 1))
            for v, g, (m, s) in zip(values, grads, moments, strict=True):
                m *= 0.9
                m += 0.1 * g
                s *= 0.999
                s += 0.001 * g * g
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)
    net.bias = float(values[4][0])
    # classes weighed alike while training; the prior goes back into the bias
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    net.bias += 0.25 * float(np.log(max(1, n1) / max(1, n0)))
    return net


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """Fits the network on rows of ``docs`` and ``labels`` that the caller may learn from."""
    known = labels.select(id_col, F.col(label_col).cast("int").alias("__l")).where("__l IN (0, 1)")
    sample = sampled_ids(known, id_col, "__l", PER_LABEL)
    rows = []
    if sample:
        rows = [(label, i, t.encode()) for label, i, t in sampled_texts(docs, sample, id_col, text_col)]
    y = np.array([r[0] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        flat = Network(np.zeros((256, DIMS), np.float32), np.zeros((WIDTH * (DIMS + 1), FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), 0.0)
        flat.bias = 5.0 if not len(y) or y[0] == 1 else -5.0
        return flat
    return fit([r[2] for r in rows], y)


def score_column(spark: SparkSession, net: Network):
    """A column function: text -> probability of label 1. The network has a few thousand numbers."""
    sent = spark.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores(texts.tolist()))

    return score


def quality(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, score, predicted. Rows for which ``held_out`` (a column of the id) is true teach nothing."""
    spark = docs.sparkSession
    prepare(spark)
    net = train(docs.where(~held_out), labels.where(~held_out), id_col, text_col)
    out = docs.select(F.col(id_col), held_out.alias("held_out"), score_column(spark, net)(F.col(text_col).cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _held_out():
    return crc_mod(F.col("doc_id"), 3) == 1


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; a third of the ids, by crc32, is held out."""
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), _held_out())


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    prepare(spark)
    labels = read_table(spark, sf_dir, "labels")
    net = train(docs.where(~_held_out()), labels.where(~_held_out()))
    return docs.where(score_column(spark, net)(F.col("text").cast("string")) >= 0.5)
