"""A corpus pipeline of five operators: each stage works on all that the one before it kept.

Documents that the quality classifier rejects go; of each group of near duplicates (five-word shingles, 0.8) one document
stays; secrets are replaced by a mark; sources are mixed to their target weights; the mix is
encoded and decoded. The last stage returns a row per document of the mix: doc_id, n_tokens, ids_sha256,
decoded_sha256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relquill.llm._shared import read_table, stage
from relquill.llm.byte_bpe import bpe_stage
from relquill.llm.mixing import mix_stage
from relquill.llm.near_dup import dedup_stage
from relquill.llm.quality_model import quality_stage
from relquill.llm.secret_scan import secrets_stage

STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mix_stage),
    ("byte-level BPE", bpe_stage),
]

#: The first stage is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = stage(step(spark, docs, sf_dir), f"pipeline{i}")
    return docs
