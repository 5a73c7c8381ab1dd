"""The queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylens.llm import credentials, encode, language, licenses, packing, pairs, parse_check, provenance, truncation


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": language.found,
        "p1_shares": language.shares,
        "p3_found": provenance.found,
        "p3_hand_written": provenance.hand_written,
        "p4_found": licenses.found,
        "p4_evidence": licenses.evidence,
        "p5_found": pairs.found,
        "p5_pairs": pairs.pairs,
        "p6_found": credentials.found,
        "p6_redacted": credentials.redacted,
        "p7_found": parse_check.found,
        "p7_failures": parse_check.failures,
        "p7_rates": parse_check.rates,
        "p8_ids": encode.ids,
        "p9_containers": packing.containers,
        "p9_mixture": packing.mixture,
        "p10_found": truncation.found,
        "p10_rates": truncation.rates,
    }


def oracle_sql() -> dict[str, str]:
    return {}
