"""The pipeline, stage by stage, against brute force on what the stage before kept."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
from helpers import WORD, components

from relquill.llm import byte_bpe, quality_model
from relquill.llm._shared import read_table, stage
from relquill.llm.secret_scan import redacted


def test_stages(spark, sf_dir):
    steps = dict(corpus_pipeline.STAGES)
    assert len(steps) == 5
    quality, dedup, secrets, mixing, bpe = corpus_pipeline.STAGES
    docs = read_table(spark, sf_dir, "documents")
    score = {r["doc_id"]: r["predicted"] for r in quality_model.op9_quality_model(spark, sf_dir).collect()}

    first = stage(quality[1](spark, docs, sf_dir), "t1")
    assert first.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in first.collect()}
    assert set(kept) == {i for i, p in score.items() if p}

    second = stage(dedup[1](spark, first, sf_dir), "t2")
    assert second.columns == docs.columns
    left = {r["doc_id"]: r["text"] for r in second.collect()}
    assert left == {i: kept[i] for i, (_, c) in components(list(kept.items()), 5).items() if c == i}

    third = stage(secrets[1](spark, second, sf_dir), "t3")
    assert third.columns == docs.columns
    clean = {r["doc_id"]: (r["text"], r["n_chars"]) for r in third.collect()}
    assert clean == {i: (redacted(t), None if t is None else len(redacted(t))) for i, t in left.items()}

    fourth = stage(mixing[1](spark, third, sf_dir), "t4")
    assert fourth.columns == docs.columns
    words = Counter()
    for r in fourth.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert all(n <= 3 * len(WORD.findall(clean[i][0])) for i, n in words.items())
    assert abs(sum(words.values()) - sum(len(WORD.findall(t or "")) for t, _ in clean.values())) <= 100

    codec = byte_bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    last = Counter((r["doc_id"], r["n_tokens"]) for r in bpe[1](spark, fourth, sf_dir).collect())
    assert last == Counter((r["doc_id"], len(codec.encode(r["text"] or "")) // 4) for r in fourth.collect())
