"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from signal_lake.llm import decontaminate, filter_audit, html_text, license_scan, packing, periodic_runs, pii, quality, simhash, substring_dedup, suffix_dedup, token_counts, topk_search

QUERIES = {
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_topk_search": topk_search.op11_topk_search,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_pii": pii.op2_pii,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_html_text": html_text.op5_html_text,
    "op6_packing": packing.op6_packing,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_simhash": simhash.op9_simhash,
}
ORACLE_SQL = {"op11_topk_search": topk_search.OP11_SQL, "op12_filter_audit": filter_audit.OP12_SQL, "op4_quality_rules": quality.OP4_SQL, "op10_license_scan": license_scan.OP10_SQL}
