"""Labelled rows for the classifiers, and the folds that the queries keep apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, of: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: tuple[int, int]) -> DataFrame:
    """Rows of docs with `label` (0 or 1), at most per_class[label] of each label: those whose hashed doc_id is least.

    train says, by doc_id, which labels may be used. A doc_id labelled twice counts as 1 if any label is 1.
    The ids, a bounded number, are broadcast; so the documents are read once and not shuffled.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("_label"))
    order = F.xxhash64(F.lit("sample"), "doc_id")
    picked = None
    for value, most in enumerate(per_class):
        some = own.where(F.col("_label") == value).orderBy(order, "doc_id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    return docs.join(F.broadcast(picked.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id")).drop("_id").withColumnRenamed("_label", "label")
