"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name and the module whose ``query(spark, sf_dir)`` runs it.
MODULES = {
    "op1_substring_dedup": "substring_dedup",
    "op3_secret_scan": "secrets_scan",
    "op8_pii_scan": "pii",
    "op4_repetition_rules": "quality",
    "op5_toxicity": "toxicity",
    "op7_ngram_jaccard_join": "ngram_join",
    "op9_license_scan": "licenses",
    "op2_best_fit_packing": "packing",
    "op6_exact_dedup": "exact_dedup",
    "op10_source_mixing": "mixing",
    "op11_sentence_pieces": "sentence_pieces",
    "op12_phrase_mining": "phrases",
    "op13_filter_audit": "filter_audit",
}

#: Those whose module states the whole result as SQL, ``ORACLE``.
WITH_SQL = ["op1_substring_dedup", "op6_exact_dedup", "op7_ngram_jaccard_join", "op12_phrase_mining", "op13_filter_audit"]


def _run(module: str) -> Callable[[SparkSession, str], DataFrame]:
    return import_module(f"sealane.llm.{module}").query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(module) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: import_module(f"sealane.llm.{MODULES[name]}").ORACLE for name in WITH_SQL}
