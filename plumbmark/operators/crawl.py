"""A crawl from its candidates and their saved responses to samples, provenance and a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbmark.functions.text import stem
from plumbmark.operators import corpus
from plumbmark.params import DEFAULT, Params
from plumbmark.session import settle, shared_folder
from plumbmark.sources.drawings import write_provenance, write_summary


def pool(candidates: DataFrame, categories: list[str], target: int) -> DataFrame:
    """The candidates (category, pos) to fetch, with pos anew from 1: of each category the first, max(target, 10) of them, and 3 x target in all.

    Both limits are the crawl's own. Candidates of several categories count in each; their hashes tell them apart later.
    """
    first = Window.partitionBy("category").orderBy("pos")
    nth = F.array_position(F.lit(categories), F.col("category"))
    few = candidates.where(F.col("category").isin(categories)).withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= max(target, 10))
    capped = few.orderBy(nth, "_nth").limit(3 * target)
    return capped.withColumn("pos", F.row_number().over(Window.orderBy(nth, "_nth"))).drop("_nth")  # 3 x target rows


def reason(p: Params = DEFAULT) -> Column:
    """Why a gated row (stage, license_raw, status, n_bytes) is refused; null if it passed."""
    raw = F.coalesce(F.concat(F.lit("'"), F.col("license_raw"), F.lit("'")), F.lit("None"))
    s = F.col("stage")
    return (
        F.when(s == "license_check", F.concat(F.lit("license could not be mapped (raw: "), raw, F.lit(")")))
        .when(s == "url_check", "candidate has no URL")
        .when(s == "download", F.concat(F.lit("HTTP "), F.coalesce("status", F.lit(0)).cast("string")))
        .when(s == "size_check", F.concat(F.lit("image too small ("), F.col("n_bytes").cast("string"), F.lit(f" bytes < {p.least_bytes})")))
        .when(s == "dedup", "duplicate sha256 (already in corpus)")
    )


def fetched(candidates: DataFrame, responses: DataFrame) -> DataFrame:
    """candidates with status, content_type, body, n_bytes and sha256 of the response (url, status, content_type, body) to their URL; 0 without one."""
    one = responses.groupBy("url").agg(F.min(F.struct("status", "content_type", "body")).alias("_r"))
    rows = candidates.join(one, "url", "left").select("*", F.coalesce("_r.status", F.lit(0)).alias("status"), "_r.content_type", "_r.body").drop("_r")
    return rows.withColumn("n_bytes", F.coalesce(F.octet_length("body"), F.lit(0)).cast("long")).withColumn("sha256", F.sha2("body", 256))


def judge(candidates: DataFrame, responses: DataFrame, history: DataFrame | None = None, p: Params = DEFAULT) -> DataFrame:
    """All candidates (pos, filename, url, license_raw) with their stage and reason; those that pass have neither."""
    return corpus.first_of_hash(corpus.gate(fetched(candidates, responses), p), history).withColumn("reason", reason(p))


def records(judged: DataFrame, source: str, fetched_at: Column, taken: DataFrame | None = None) -> DataFrame:
    """The provenance of what passed, under names that neither each other nor `taken` (name) have, with the file's name and bytes."""
    named = corpus.unique_names(judged.where("stage IS NULL"), taken=taken)
    return named.select(
        stem(F.col("name")).alias("drawing_id"), F.lit(source).alias("source"), F.col("license_mapped").alias("license"), "sha256", fetched_at.alias("fetched_at"),
        F.coalesce("source_page_url", "url").alias("original_uri"), F.lit("demo-only").alias("usage"), F.lit("global").alias("domain"), "name", "body",
    )


def crawl(candidates: DataFrame, responses: DataFrame, samples: str, provenance: str, summary: str, history: DataFrame | None = None, taken: DataFrame | None = None, source: str = "wikimedia_commons", p: Params = DEFAULT) -> DataFrame:
    """Writes samples (name, body) as a table, provenance as JSON by source and the summary, which replaces the last one. Returns the refusals."""
    folder = shared_folder(candidates.sparkSession)
    judged = settle(judge(candidates, responses, history, p), folder, "judged")
    passed = settle(records(judged, source, F.current_timestamp(), taken), folder, "passed")
    passed.select("name", "body").write.mode("append").parquet(samples)
    write_provenance(passed.drop("name", "body"), provenance)
    write_summary(corpus.summary(judged.withColumn("source", F.lit(source))), summary)
    return judged.where("stage IS NOT NULL").select("filename", "stage", "reason")
