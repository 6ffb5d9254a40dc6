"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, line_dedup, lm_score, packing, pii, quality_rules, secret_scan, simhash, substring_dedup, url_filter

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op8_pii": pii.op8_pii,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op9_lm_scoring": lm_score.op9_lm_scoring,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op10_url_filters": url_filter.op10_url_filters,
}


def oracles() -> dict[str, str]:
    return {"op7_quality_rules": quality_rules.ORACLE, "op10_url_filters": url_filter.oracle()}
