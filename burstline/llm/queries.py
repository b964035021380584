"""The queries of this folder and their SQL twins, for `__spark_entry__.py`."""

from __future__ import annotations

from burstline.llm import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13

QUERIES = {
    "op1_packing": op1.op1_packing,
    "op2_line_dedup": op2.op2_line_dedup,
    "op3_main_text": op3.op3_main_text,
    "op4_url_filter": op4.op4_url_filter,
    "op5_fingerprints": op5.op5_fingerprints,
    "op6_exact_dedup": op6.op6_exact_dedup,
    "op7_ngram_join": op7.op7_ngram_join,
    "op8_suffix_dedup": op8.op8_suffix_dedup,
    "op9_mixing": op9.op9_mixing,
    "op10_quality": op10.op10_quality,
    "op11_decontamination": op11.op11_decontamination,
    "op12_hard_negatives": op12.op12_hard_negatives,
    "op13_token_alignment": op13.op13_token_alignment,
}
ORACLE = {
    "op2_line_dedup": op2.ORACLE,
    "op6_exact_dedup": op6.ORACLE,
    "op7_ngram_join": op7.ORACLE,
    "op9_mixing": op9.ORACLE,
    "op11_decontamination": op11.ORACLE,
    "op12_hard_negatives": op12.ORACLE,
}
