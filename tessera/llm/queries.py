"""The operators' queries, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, jaccard_join, license_rules, packing, pu_quality, quality_rules, suffix_repeats, token_frames, tree_bpe, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_harmonic_packing": packing.op1_packing,
    "op2_pu_quality": pu_quality.op2_pu_quality,
    "op3_token_frames": token_frames.op3_token_frames,
    "op4_suffix_repeats": suffix_repeats.op4_suffix_repeats,
    "op5_url_rules": url_rules.op5_url_rules,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_license_rules": license_rules.op7_license_rules,
    "op8_robust_quality": quality_rules.op8_robust_quality,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_tree_bpe": tree_bpe.op10_tree_bpe,
}
ORACLES: dict[str, str] = {
    "op5_url_rules": url_rules.ORACLE,
    "op7_license_rules": license_rules.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
}
