"""Names of the queries, each with its DataFrame form and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbmark.plans import audit_queries, corpus_queries, run_queries, spatial_queries

MODULES = [audit_queries, corpus_queries, run_queries, spatial_queries]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
