"""The corpus operators' queries; ORACLE_SQL has those that SQL expresses at the cost of the tables at hand."""

from __future__ import annotations

from loomwright.llm.bpe import op4_byte_bpe
from loomwright.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from loomwright.llm.fill_in_middle import OP11_SQL, op11_fill_in_middle
from loomwright.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from loomwright.llm.language_id import op13_language_id
from loomwright.llm.line_dedup import OP8_SQL, op8_line_dedup
from loomwright.llm.near_dedup import op3_near_dedup
from loomwright.llm.packing import op9_packing
from loomwright.llm.quality_model import op1_quality_model
from loomwright.llm.quality_rules import OP10_SQL, op10_quality_rules
from loomwright.llm.substring_dedup import op2_substring_dedup
from loomwright.llm.suffix_dedup import op5_suffix_dedup
from loomwright.llm.toxicity import op6_toxicity

QUERIES = {
    "op1_quality_model": op1_quality_model,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_packing": op9_packing,
    "op10_quality_rules": op10_quality_rules,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_language_id": op13_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op7_exact_dedup": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op10_quality_rules": OP10_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
