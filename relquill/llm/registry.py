"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from relquill.llm import exact_topk, quality_rules
from relquill.llm.byte_bpe import op3_byte_bpe
from relquill.llm.exact_topk import op4_exact_topk
from relquill.llm.html_text import op10_html_text
from relquill.llm.language_id import op8_language_id
from relquill.llm.mixing import op1_mixing
from relquill.llm.near_dup import op6_near_dup
from relquill.llm.quality_model import op9_quality_model
from relquill.llm.quality_rules import op7_quality_rules
from relquill.llm.secret_scan import op5_secret_scan
from relquill.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_exact_topk": op4_exact_topk,
    "op5_secret_scan": op5_secret_scan,
    "op6_near_dup": op6_near_dup,
    "op7_quality_rules": op7_quality_rules,
    "op8_language_id": op8_language_id,
    "op9_quality_model": op9_quality_model,
    "op10_html_text": op10_html_text,
}

ORACLES: dict[str, str] = {
    "op4_exact_topk": exact_topk.ORACLE,
    "op7_quality_rules": quality_rules.ORACLE,
}
