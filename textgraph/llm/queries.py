"""The queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, decontamination, fingerprints, html_extraction, line_dedup, near_dedup, quality, sharding, suffix_dedup, toxicity

QUERIES = {
    "op1_quality": quality.query,
    "op10_byte_bpe": byte_bpe.query,
    "op2_fingerprints": fingerprints.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_decontamination": decontamination.query,
    "op5_near_dedup": near_dedup.query,
    "op6_sharding": sharding.query,
    "op7_line_dedup": line_dedup.query,
    "op8_html_extraction": html_extraction.query,
    "op9_toxicity": toxicity.query,
}
ORACLES = {
    "op4_decontamination": decontamination.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
}
