"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, line_dedup, near_dedup, packing, pii, quality_classifier, quality_rules, secrets, sharding, suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": quality_classifier.op1_quality_classifier,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_packing": packing.op3_packing,
        "op4_suffix_array_dedup": suffix_dedup.op4_suffix_array_dedup,
        "op5_pii": pii.op5_pii,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_balanced_sharding": sharding.op9_balanced_sharding,
        "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_suffix_array_dedup": suffix_dedup.ORACLE_SQL,
        "op6_line_dedup": line_dedup.ORACLE_SQL,
        "op7_benchmark_decontamination": decontaminate.ORACLE_SQL,
        "op8_quality_rules": quality_rules.ORACLE_SQL,
        "op10_minhash_near_dedup": near_dedup.ORACLE_SQL,
    }
