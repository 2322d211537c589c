"""Queries of the corpus ledger, over documents, labels, pages and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbmark.functions import text as X
from plumbmark.operators import corpus
from plumbmark.session import table

#: A document's licence line names one of these; spaces become dashes in the code derived from it.
LICENSE_LINE = r"(CC BY(?:-[A-Z]{2})* [0-9.]+|MIT|Apache|GNU|GPL|All rights reserved|[Pp]ublic domain)"


def _raw_license():
    return F.lower(F.replace(F.nullif(F.regexp_extract("text", LICENSE_LINE, 1), F.lit("")), F.lit(" "), F.lit("-")))


def text_classify(spark, sf_dir):
    words = table(spark, sf_dir, "pages").select(F.explode(F.split("url", r"[/:.?=&\-]+")).alias("w"))
    docs = table(spark, sf_dir, "documents")
    words = words.unionByName(docs.select(F.explode(F.array("lang", "source")).alias("w"))).unionByName(docs.select(F.explode(F.split("text", " ")).alias("w")))
    return words.groupBy(X.classify_text(F.col("w")).alias("kind")).agg(F.count("*").alias("cnt"))


def license_map(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(_raw_license().alias("license_raw")).withColumn("license_mapped", X.map_license(F.col("license_raw"))).groupBy("license_raw", "license_mapped").agg(F.count("*").alias("cnt"))


def _gated(spark, sf_dir):
    """Documents as candidates: open where they name no licence, the URL missing for every 17th, not found for every 13th."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("pos"), "source", F.coalesce(_raw_license(), F.lit("cc0")).alias("license_raw"), F.when(F.col("doc_id") % 17 != 0, "u").alias("url"), F.when(F.col("doc_id") % 13 == 0, 404).otherwise(200).alias("status"), F.octet_length("text").alias("n_bytes"), F.sha2("text", 256).alias("sha256"))
    from dataclasses import replace

    from plumbmark.params import DEFAULT

    return corpus.first_of_hash(corpus.gate(rows, replace(DEFAULT, least_bytes=600)))


def gate_cascade(spark, sf_dir):
    return _gated(spark, sf_dir).groupBy(F.coalesce("stage", F.lit("accept")).alias("stage")).agg(F.count("*").alias("cnt"))


def gate_counters(spark, sf_dir):
    return corpus.counters(_gated(spark, sf_dir))


def provenance_by_source(spark, sf_dir):
    return _gated(spark, sf_dir).where("stage IS NULL").groupBy("source").agg(F.count("*").alias("cnt"))


def sha_dedup_first(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.sha2("text", 256).alias("sha256"), F.lit(None).cast("string").alias("stage"))
    return corpus.first_of_hash(rows).where("stage IS NULL").select("pos", "sha256")


def duplicate_hashes(spark, sf_dir):
    return corpus.repeated(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256")), "sha256")


def missing_provenance(spark, sf_dir):
    return corpus.without_provenance(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


def dry_run(spark, sf_dir):
    return corpus.dry_run(table(spark, sf_dir, "documents").select(_raw_license().alias("license_raw")))


def safe_stem(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.with_prefix(X.safe_stem(F.concat(F.lit("File:"), F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(").png")))).alias("name"))


def infer_extension(spark, sf_dir):
    kind = F.when(F.col("page_id") % 5 == 0, "image/PNG").when(F.col("page_id") % 5 == 1, "image/jpeg; q=1").when(F.col("page_id") % 5 == 2, "application/pdf")
    url = F.when(F.col("page_id") % 7 == 0, F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/plan.JPEG?x=1.pdf"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", X.infer_extension(url, kind).alias("ext"))


def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


def unique_names(spark, sf_dir):
    """Parts' names as files: those that repeat are numbered past names already taken."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.concat("p_brand", F.when(F.col("p_partkey") % 3 == 0, "_2").otherwise(""), F.lit(".png")).alias("filename"), F.lit("u.png").alias("url"), F.lit(None).cast("string").alias("content_type"))
    return corpus.unique_names(rows).select("pos", "name")


def ranked_samples(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select(F.concat(F.when(F.col("doc_id") % 3 == 0, "wm_").when(F.col("doc_id") % 3 == 1, "synth_").otherwise(""), "source", F.lit("_"), F.col("doc_id").cast("string")).alias("name"))
    return corpus.ranked_samples(names, "name")


def set_checks(spark, sf_dir):
    """Ids in documents and labels: in both, and in one only."""
    a, b = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    count = lambda df, name: df.agg(F.count("*").alias("cnt")).select(F.lit(name).alias("what"), "cnt")
    return count(a.intersect(b), "both").unionByName(count(a.exceptAll(b), "unlabelled")).unionByName(count(b.exceptAll(a), "orphan"))


_RAW = r"lower(replace(nullif(regexp_extract(text, '(CC BY(?:-[A-Z]{2})* [0-9.]+|MIT|Apache|GNU|GPL|All rights reserved|[Pp]ublic domain)', 1), ''), ' ', '-'))"
_MAP = """CASE WHEN k = 'cc-zero' THEN 'public' WHEN k = 'cc0' THEN 'public' WHEN k = 'public-domain' THEN 'public' WHEN k = 'publicdomain' THEN 'public' WHEN starts_with(k, 'pd-') THEN 'public' WHEN k = 'pd' THEN 'public'
WHEN starts_with(k, 'cc-by-nc-sa-') OR k = 'cc-by-nc-sa' OR starts_with(k, 'cc-by-nc-') OR k = 'cc-by-nc' THEN 'CC-BY-NC' WHEN starts_with(k, 'cc-by-sa-') OR k = 'cc-by-sa' THEN 'CC-BY-SA' WHEN starts_with(k, 'cc-by-') OR k = 'cc-by' THEN 'CC-BY' END"""
_GATED = f"""WITH c AS (SELECT doc_id AS pos, source, coalesce({_RAW}, 'cc0') AS k, doc_id % 17 <> 0 AS has_url, doc_id % 13 = 0 AS lost, strlen(text) AS n, sha256(text) AS sha FROM documents),
g AS (SELECT *, CASE WHEN {_MAP} IS NULL THEN 'license_check' WHEN NOT has_url THEN 'url_check' WHEN lost OR n = 0 THEN 'download' WHEN n < 600 THEN 'size_check' END AS s FROM c),
d AS (SELECT *, CASE WHEN s IS NULL AND pos > min(pos) FILTER (s IS NULL) OVER (PARTITION BY sha) THEN 'dedup' ELSE s END AS stage FROM g)
"""

QUERIES = {
    "text_classify": text_classify, "license_map": license_map, "gate_cascade": gate_cascade, "gate_counters": gate_counters, "provenance_by_source": provenance_by_source, "sha_dedup_first": sha_dedup_first,
    "duplicate_hashes": duplicate_hashes, "missing_provenance": missing_provenance, "crawl_dry_run": dry_run, "safe_stem": safe_stem, "infer_extension": infer_extension, "strip_html": strip_html, "ranked_samples": ranked_samples, "unique_names": unique_names, "set_checks": set_checks,
}
ORACLES = {
    "text_classify": r"""WITH w AS (SELECT unnest(regexp_split_to_array(url, '[/:.?=&\-]+')) AS w FROM pages UNION ALL SELECT lang FROM documents UNION ALL SELECT source FROM documents UNION ALL SELECT unnest(string_split(text, ' ')) FROM documents),
t AS (SELECT regexp_replace(coalesce(w, ''), '^[\s\v\p{Z}\x{85}]+|[\s\v\p{Z}\x{85}]+$', '', 'g') AS w FROM w)
SELECT CASE WHEN regexp_matches(w, '^\p{Nd}{2,5}([.]\p{Nd}+)?$') THEN 'dimension_text' WHEN regexp_matches(w, '^[A-Za-zㄱ-힝][\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}ㄱ-힝\s\v\p{Z}\x{85}]*$') THEN 'room_label' ELSE 'other' END AS kind, count(*) AS cnt FROM t GROUP BY 1""",
    "license_map": f"SELECT k AS license_raw, {_MAP} AS license_mapped, count(*) AS cnt FROM (SELECT {_RAW} AS k FROM documents) GROUP BY 1, 2",
    "gate_cascade": _GATED + "SELECT coalesce(stage, 'accept') AS stage, count(*) AS cnt FROM d GROUP BY 1",
    "gate_counters": _GATED + "SELECT count(*) FILTER (stage IS NULL) AS downloaded, count(*) FILTER (stage = 'license_check') AS refused_by_license, count(*) FILTER (stage = 'url_check') AS refused_by_url, count(*) FILTER (stage = 'download') AS refused_by_404, count(*) FILTER (stage = 'size_check') AS refused_by_too_small, count(*) FILTER (stage = 'dedup') AS refused_by_dedup FROM d",
    "provenance_by_source": _GATED + "SELECT source, count(*) AS cnt FROM d WHERE stage IS NULL GROUP BY 1",
    "sha_dedup_first": "SELECT min(doc_id) AS pos, sha256(text) AS sha256 FROM documents GROUP BY 2",
    "duplicate_hashes": "SELECT sha256(text) AS sha256, count(*) AS cnt FROM documents GROUP BY 1 HAVING count(*) > 1",
    "missing_provenance": "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)",
    "crawl_dry_run": f"SELECT coalesce({_MAP}, 'refused') AS license_mapped, count(*) AS cnt FROM (SELECT {_RAW} AS k FROM documents) GROUP BY 1",
    "safe_stem": r"SELECT p_partkey, 'wm_' || left(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9_\-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 80) AS name FROM part",
    "infer_extension": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.pdf' ELSE CASE WHEN page_id % 7 = 0 THEN '.jpg' ELSE '.png' END END AS ext FROM pages",
    "strip_html": r"SELECT page_id, nullif(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g'), '') AS text FROM pages",
    "ranked_samples": "SELECT name FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'wm_' WHEN 1 THEN 'synth_' ELSE '' END || source || '_' || doc_id AS name FROM documents) ORDER BY CASE WHEN starts_with(name, 'wm_') THEN 0 WHEN starts_with(name, 'synth_') THEN 1 ELSE 2 END, name",
    "set_checks": "SELECT 'both' AS what, count(*) AS cnt FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'unlabelled', count(*) FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels) UNION ALL SELECT 'orphan', count(*) FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)",
}
