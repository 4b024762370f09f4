"""Byte-level BPE: overlapping chunks are pre-tokenised apart, stitched where they resynchronise, then encoded.

A regular-expression pre-tokeniser without look-behind has this property: if a piece starts at position p
both in the split of the whole text and in the split of a chunk, the two agree from p on, up to the
look-ahead of the chunk's end. So chunks that overlap can be split independently (here on a few threads,
the regular expression engine lets go of the interpreter lock) and joined at the first start they share. Where two
chunks share none, as inside a run of letters longer than the overlap, the split goes on from the last
sure start over a window that doubles until the piece ends: exact in every case.

Edge cases: null texts count as empty and give no ids; texts of any length are handled whole.
"""

from __future__ import annotations

import base64
import hashlib
from concurrent.futures import ThreadPoolExecutor
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.llm._shared import prepare, read_table

CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Characters after a piece that can change how it is split: an apostrophe and two letters.
AHEAD = 3
#: Distinct pieces whose ids a worker holds before it starts afresh.
CACHED = 400_000


def split_pieces(text: str, pattern, chunk: int = CHUNK, overlap: int = OVERLAP, threads: int = 2) -> list[str]:
    """``pattern``'s matches over the whole of ``text``, made from overlapping chunks."""
    n = len(text)
    if n <= chunk + overlap:
        return pattern.findall(text, concurrent=True)
    ends = [(lo, min(n, lo + chunk + overlap)) for lo in range(0, n, chunk)]

    def starts(span: tuple[int, int]) -> np.ndarray:
        return np.fromiter((m.start() for m in pattern.finditer(text, span[0], span[1], concurrent=True)), np.int64)

    with ThreadPoolExecutor(threads) as pool:
        found = list(pool.map(starts, ends))
    sure: list[int] = [0]  # starts of the split of the whole text
    for i, (lo, hi) in enumerate(ends):
        if sure[-1] >= hi:
            continue
        own = found[i]
        at = np.searchsorted(own, sure[-1])
        known = np.asarray(sure[np.searchsorted(sure, lo) :] if len(sure) > 1 else sure, np.int64)
        meet = np.intersect1d(known, own)
        if len(meet):
            at = np.searchsorted(own, meet[0])
            own = own[at:]
            while sure and sure[-1] >= own[0]:
                sure.pop()
        else:  # no start in common: go on from the last sure one
            own = _onward(text, pattern, sure.pop(), hi, chunk)
        last = n if hi == n else hi - AHEAD
        # a start is sure if the piece before it ended with its look-ahead in view
        sure += own[(own < last)].tolist() if hi < n else own.tolist()
    return [text[a:b] for a, b in zip(sure, [*sure[1:], n], strict=True)]


def _onward(text: str, pattern, start: int, upto: int, chunk: int) -> np.ndarray:
    """Starts of the split from the sure start ``start``, at least as far as ``upto`` or the text's end."""
    n, width = len(text), chunk
    while True:
        hi = min(n, max(upto, start + width))
        own = np.fromiter((m.start() for m in pattern.finditer(text, start, hi, concurrent=True)), np.int64)
        if hi == n or len(own) > 1 and own[-1] > start and own[own < hi - AHEAD][-1] > start:
            return own
        width *= 2


class _Ids(dict):
    """Piece -> its ids as little-endian 32-bit bytes; filled as pieces come."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        out = np.asarray(self.encode(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = out
        return out


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        merges = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.ids = _Ids(merges._core_bpe.encode_single_piece)
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.ids.__getitem__, split_pieces(text, self.pattern)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def encode_column(ranks_path: str, pattern: str):
    """A column function: text -> array of ids."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        c = codec(ranks_path, pattern)
        return pd.Series([np.frombuffer(c.encode(t or ""), "<i4") for t in texts])

    return ids


def decode_column(ranks_path: str, pattern: str):
    """A column function: array of ids -> bytes."""

    @F.pandas_udf("binary")
    def text(ids: pd.Series) -> pd.Series:
        c = codec(ranks_path, pattern)
        return pd.Series([c.decode(np.asarray([] if i is None else i, "<u4").tobytes()) for i in ids])

    return text


def token_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, and digests of its ids and of the bytes they decode to. One pass, no shuffle."""
    prepare(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        c, rows = codec(ranks_path, pattern), []
        for t in texts:
            ids = c.encode(t or "")
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.select(F.col(id_col).alias("id"), digest(F.col(text_col).cast("string")).alias("d"))
    return out.select(F.col("id").alias(id_col), "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def _ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text of ``documents``."""
    return token_digests(read_table(spark, sf_dir, "documents"), *_ranks())


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what the pipeline kept."""
    return token_digests(docs, *_ranks())
