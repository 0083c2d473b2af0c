"""Queries of this subpackage and the SQL that each must match."""

from __future__ import annotations

from waymark.llm.decontaminate import op4_decontaminate
from waymark.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from waymark.llm.language_id import op7_language_id
from waymark.llm.line_dedup import OP2_SQL, op2_line_dedup
from waymark.llm.lm_score import OP5_SQL, op5_lm_score
from waymark.llm.packing import op3_packing
from waymark.llm.sharding import OP10_SQL, op10_sharding
from waymark.llm.simhash import op1_simhash
from waymark.llm.toxicity import op6_toxicity
from waymark.llm.url_filter import op9_url_filter

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_packing": op3_packing,
    "op4_decontaminate": op4_decontaminate,
    "op5_lm_score": op5_lm_score,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_sharding": op10_sharding,
}

ORACLE_SQL = {
    "op2_line_dedup": OP2_SQL,
    "op5_lm_score": OP5_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op10_sharding": OP10_SQL,
}
