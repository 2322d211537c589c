"""The queries of the training-data operators, by number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbmark.llm import chat_format, feistel_pii, hash_tree, jaccard_join, katz_lm, merge_replay, nn_descent, rule_quality, text_cnn, window_decontam

MODULES = [rule_quality, merge_replay, text_cnn, nn_descent, window_decontam, hash_tree, chat_format, jaccard_join, katz_lm, feistel_pii]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
