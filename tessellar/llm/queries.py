"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontaminate, html_extract, langid, oracles, packing, quality_fm, quality_rules, secret_scan, simhash, span_dedup, token_files

QUERIES = {
    "op1_line_block_extraction": html_extract.query,
    "op4_language_id": langid.query,
    "op5_quality_machine": quality_fm.query,
    "op7_distribution_rules": quality_rules.query,
    "op9_secret_ownership": secret_scan.query,
    "op10_sentence_spans": span_dedup.query,
    "op2_prefix_decontamination": decontaminate.query,
    "op3_simhash_anchors": simhash.query,
    "op6_best_fit_packing": packing.query,
    "op8_token_files": token_files.query,
}
ORACLE_SQL: dict[str, str] = {
    "op2_prefix_decontamination": oracles.PREFIX_DECONTAMINATION,
    "op7_distribution_rules": oracles.DISTRIBUTION_RULES,
}
