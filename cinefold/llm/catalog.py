"""The operators of this package as queries on the sample tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cinefold.llm import (
    fill_in_middle,
    hard_negatives,
    html_text,
    katz,
    license_scan,
    minhash_forest,
    mixing,
    neighbours,
    packing,
    pieces,
    quality,
    substring_dedup,
    url_filter,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": substring_dedup.query,
        "op2_url_filter": url_filter.query,
        "op3_mixing": mixing.query,
        "op4_license_scan": license_scan.query,
        "op5_katz": katz.query,
        "op6_sentencepiece": pieces.query,
        "op7_quality_rules": quality.query,
        "op10_minhash_forest": minhash_forest.query,
        "op8_html_text": html_text.query,
        "op9_neighbours": neighbours.query,
        "op11_fill_in_middle": fill_in_middle.query,
        "op12_packing": packing.query,
        "op13_hard_negatives": hard_negatives.query,
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can say it on whole tables; the others are tested against plain versions."""
    return {
        "op1_substring_dedup": substring_dedup.ORACLE_SQL,
        "op2_url_filter": url_filter.ORACLE_SQL,
        "op4_license_scan": license_scan.ORACLE_SQL,
        "op7_quality_rules": quality.ORACLE_SQL,
        "op11_fill_in_middle": fill_in_middle.ORACLE_SQL,
        "op13_hard_negatives": hard_negatives.ORACLE_SQL,
    }
