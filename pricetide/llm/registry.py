"""Queries of this folder and their SQL, added to the others by the driver's entry file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from pricetide.llm import (
    block_whitening,
    crf_quality,
    curve_packing,
    entropy_mix,
    kneser_ney,
    license_templates,
    line_neighbours,
    period_runs,
    ring_shards,
    rule_ledger,
    secret_owners,
    seed_decontam,
    simhash_blocks,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_spaced_seeds": seed_decontam.query,
        "op2_rule_ledger": rule_ledger.query,
        "op3_crf_quality": crf_quality.query,
        "op4_entropy_mix": entropy_mix.query,
        "op5_secret_owners": secret_owners.query,
        "op6_license_templates": license_templates.query,
        "op7_simhash_blocks": simhash_blocks.query,
        "op8_line_neighbours": line_neighbours.query,
        "op9_ring_shards": ring_shards.query,
        "op10_kneser_ney": kneser_ney.query,
        "op11_block_whitening": block_whitening.query,
        "op12_curve_packing": curve_packing.query,
        "op13_period_runs": period_runs.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_spaced_seeds": seed_decontam.ORACLE,
        "op2_rule_ledger": rule_ledger.ORACLE,
        "op4_entropy_mix": entropy_mix.ORACLE,
        "op5_secret_owners": secret_owners.ORACLE,
        "op6_license_templates": license_templates.ORACLE,
        "op8_line_neighbours": line_neighbours.ORACLE,
    }
