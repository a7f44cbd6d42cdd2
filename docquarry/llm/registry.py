"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import alignment, decontam, exact_dedup, html_extract, licenses, mixing, near_dedup, prefix_trie, quality, sharding, suffix_dedup, token_codes, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_near_dedup": near_dedup.op2_near_dedup,
        "op3_mixing": mixing.op3_mixing,
        "op4_license_scan": licenses.op4_license_scan,
        "op5_token_codes": token_codes.op5_token_codes,
        "op6_decontamination": decontam.op6_decontamination,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_quality": quality.op9_quality,
        "op10_html_extraction": html_extract.op10_html_extraction,
        "op11_token_alignment": alignment.op11_token_alignment,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return near_dedup.SQL | licenses.SQL | decontam.SQL | exact_dedup.SQL | prefix_trie.SQL
