"""Registered queries of the training-data operators and of the pipeline, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import alignment, centroids, chat_tools, decontaminate, license_scan, line_dedup, minhash_dedup, packing, quality_rules, secret_scan, token_files, toxicity, warc_bundles


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_warc": warc_bundles.op3_warc,
        "op4_tool_calls": chat_tools.op4_tool_calls,
        "op5_licenses": license_scan.op5_licenses,
        "op6_secrets": secret_scan.op6_secrets,
        "op7_minhash": minhash_dedup.op7_minhash,
        "op8_packing": packing.op8_packing,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_alignment": alignment.op11_alignment,
        "op12_centroids": centroids.op12_centroids,
        "op13_token_files": token_files.op13_token_files,
        "pipeline": corpus_pipeline.run,
    }


def oracles() -> dict[str, str]:
    """Trained models, MinHash groups, packings and tokenizers are not SQL; tests hold them to brute force."""
    return {
        "op3_warc": warc_bundles.OP3_SQL,
        "op4_tool_calls": chat_tools.OP4_SQL,
        "op5_licenses": license_scan.OP5_SQL,
        "op9_line_dedup": line_dedup.OP9_SQL,
        "op10_decontaminate": decontaminate.OP10_SQL,
        "op12_centroids": centroids.OP12_SQL,
    }
