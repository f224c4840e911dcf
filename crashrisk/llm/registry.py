"""Queries of the text operators, and their DuckDB text where SQL can say the same."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_MODULES = ["decontamination", "jaccard_join", "sentencepiece_scan", "token_files", "toxicity", "suffix_dedup", "quality_rules",
            "html_paths", "license_digests", "quotation_links", "fill_in_middle", "filter_audit", "pitman_yor"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def load() -> None:
    for module in _MODULES:
        importlib.import_module(f"crashrisk.llm.{module}")
