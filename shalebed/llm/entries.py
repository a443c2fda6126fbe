"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import (
    decontamination,
    fill_in_middle,
    hard_negatives,
    html_extraction,
    license_scan,
    line_dedup,
    lm_scoring,
    ngram_join,
    packing,
    quality_rules,
    substring_dedup,
    token_counts,
    word_bpe,
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_html_extraction": html_extraction.op4_html_extraction,
    "op5_benchmark_decontamination": decontamination.op5_benchmark_decontamination,
    "op6_lm_scoring": lm_scoring.op6_lm_scoring,
    "op7_ngram_jaccard_join": ngram_join.op7_ngram_jaccard_join,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_packing": packing.op10_packing,
    "op11_bpe_round_trip": word_bpe.op11_bpe_round_trip,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

SQL = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op8_substring_dedup": substring_dedup.OP8_SQL,
    "op12_fill_in_middle": fill_in_middle.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
