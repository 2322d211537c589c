"""A training corpus from documents: toxic ones out, one of each group of near copies, no benchmark passages, personal data
under pseudonyms, and the texts that are left as tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbmark.llm import feistel_pii, jaccard_join, merge_replay, scratch, text_cnn, window_decontam
from plumbmark.session import table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, trained on all labels, lets pass. Languages without a threshold of their own take the common one.

    A null or empty text scores as one without words; equal rows share a fate; without labels every text gets one score below the threshold.
    """
    return text_cnn.reject(docs, text_cnn.train(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of documents of five-word shingles of similarity 0.75: that of the smallest doc_id.

    Null doc_ids come last, ties go by the hash of doc_id and text; rows that repeat both leave one; texts without words all stay.
    """
    return jaccard_join.one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text no ten-word window of the benchmark stands. Null and empty texts stay, and so does all if the benchmark is empty."""
    return window_decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in the text under pseudonyms by the session's key. Null texts stay null, repeated rows get equal texts."""
    return feistel_pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the ids of their texts; a null text has none."""
    return merge_replay.encode(docs)


STAGES = [("toxicity", toxicity), ("near copies", near_copies), ("decontamination", decontamination), ("pseudonyms", pseudonyms), ("tokens", tokens)]

#: The classifier and the tokenizer can't be said in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result written in the shared folder and read again, until the next one is written.

    Columns besides those of documents go through as they are, whatever their names; an empty table gives an empty one.
    """
    path, docs = scratch.folder(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), path, f"stage-{k}")
        scratch.drop(spark, path, f"stage-{k - 1}")
    return docs
