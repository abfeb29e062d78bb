"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import exact_dedup, host_rules, language_id, license_scan, lm_scoring, mixing, near_dedup, packing, substring_dedup, token_counts

QUERIES = {
    "op1_lm_scoring": lm_scoring.query,
    "op2_license_scan": license_scan.query,
    "op3_packing": packing.query,
    "op4_token_counts": token_counts.query,
    "op5_host_rules": host_rules.query,
    "op6_mixing": mixing.query,
    "op7_near_dedup": near_dedup.query,
    "op8_language_id": language_id.query,
    "op9_substring_dedup": substring_dedup.query,
    "op10_exact_dedup": exact_dedup.query,
}
ORACLES = {"op5_host_rules": host_rules.ORACLE, "op9_substring_dedup": substring_dedup.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE}
