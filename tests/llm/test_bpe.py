import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from helpers import ODD, documents

from relquill.llm import byte_bpe
from relquill.llm._shared import read_table

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(library, text):
    ids = np.asarray(library.encode_ordinary(text), "<u4").tobytes()
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_chunks_stitch_to_the_whole_split():
    rng = random.Random(5)
    pattern = regex.compile(PATTERN)
    pieces = ["word", " word", "  ", "\n\n", "'re", "'ll", " 123456", "ñandú", "漢字", "!?", "\U0001f600", "x" * 30, " " * 40, "\t", "'", "I'"]
    for _ in range(300):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 90)))
        for chunk, overlap in ((16, 4), (24, 16), (7, 1)):
            assert byte_bpe.split_pieces(text, pattern, chunk, overlap) == pattern.findall(text)


def test_documents_like_the_library(spark, sf_dir, library):
    docs = read_table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    for r in byte_bpe.op3_byte_bpe(spark, sf_dir).collect():
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected(library, texts[r["doc_id"]])


def test_edges_and_round_trip(spark, library):
    df = documents(spark, ODD + [(12, "a long run " + "é" * 150_000 + " of letters", "c")])
    got = sorted(tuple(r)[1:] for r in byte_bpe.token_digests(df, PATH, PATTERN).collect())
    assert got == sorted(expected(library, r["text"] or "") for r in df.select("text").collect())
    back = df.select("text", byte_bpe.decode_column(PATH, PATTERN)(byte_bpe.encode_column(PATH, PATTERN)("text")).cast("string").alias("b"))
    assert all((r["text"] or "") == r["b"] for r in back.collect())
    assert byte_bpe.token_digests(documents(spark, []), PATH, PATTERN).count() == 0
