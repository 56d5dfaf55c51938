"""Queries of the training-data operators and, where DuckDB can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobloom.llm import decontamination, linededup, lshforest, packing, resampling, pii, secrets, simhash, tokens, toxicity, warc, whitening, winnowing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_winnowing": winnowing.query,
        "op2_simhash_near_dedup": simhash.query,
        "op3_secret_scan": secrets.query,
        "op4_personal_data": pii.query,
        "op5_toxicity": toxicity.query,
        "op6_curve_packing": packing.query,
        "op7_line_dedup": linededup.query,
        "op8_length_histogram": tokens.histogram_query,
        "op9_decontamination": decontamination.query,
        "op10_warc": warc.query,
        "op11_lsh_forest": lshforest.query,
        "op12_whitening": whitening.query,
        "op13_importance_resampling": resampling.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_line_dedup": linededup.ORACLE,
        "op9_decontamination": decontamination.ORACLE,
        "op10_warc": warc.ORACLE,
        "op11_lsh_forest": lshforest.ORACLE,
        "op13_importance_resampling": resampling.ORACLE,
    }
