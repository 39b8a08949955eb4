"""The operators' queries and their SQL."""

from __future__ import annotations

from tarnfall.llm.decontaminate import op9_decontaminate
from tarnfall.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from tarnfall.llm.language_id import op10_language_id
from tarnfall.llm.license_scan import op7_license_scan
from tarnfall.llm.lm_scoring import op2_lm_scoring
from tarnfall.llm.minhash_dedup import op1_minhash_dedup
from tarnfall.llm.mixing import OP8_SQL, op8_mixing
from tarnfall.llm.toxicity import op6_toxicity
from tarnfall.llm.url_filter import OP4_SQL, op4_url_filter
from tarnfall.llm.warc import OP3_SQL, op3_warc

OPERATORS = (
    op1_minhash_dedup,
    op2_lm_scoring,
    op3_warc,
    op4_url_filter,
    op5_exact_dedup,
    op6_toxicity,
    op7_license_scan,
    op8_mixing,
    op9_decontaminate,
    op10_language_id,
)


def queries():
    return {f.__name__: f for f in OPERATORS}


def oracle_sql():
    return {"op3_warc": OP3_SQL, "op4_url_filter": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op8_mixing": OP8_SQL}
