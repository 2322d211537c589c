"""Queries of audited runs, crawls and reports. Audited drawings are the generator's, as many as there are nations; every second one loses its texts, so it has no scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbmark.functions import text as X
from plumbmark.operators import audit, audited, crawl, reports
from plumbmark.plans import audit_queries, corpus_queries
from plumbmark.session import shared_folder, table
from plumbmark.sources import vector_gen


#: Warehouses that this process has filled, by session and input.
_FILLED: dict[tuple[str, str], tuple] = {}


def _audited(spark, sf_dir):
    """The warehouse after one audited call, and its runs. The queries over it share the call."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FILLED:
        _FILLED[key] = _fill(spark, sf_dir)
    return _FILLED[key]


def _fill(spark, sf_dir):
    made = vector_gen.generate(spark, table(spark, sf_dir, "nation").count())
    made["texts"] = made["texts"].where(F.right("drawing_id", F.lit(5)).cast("int") % 2 == 1)
    w = audit.Warehouse(spark, f"{shared_folder(spark)}/audit")
    return w, audited.run(w, made)["runs"].select("run_id", "drawing_id")


def run_audit_events(spark, sf_dir):
    w, runs = _audited(spark, sf_dir)
    walls = F.get_json_object("payload_json", "$.walls").cast("int")
    return w.read("stage_events").join(runs, "run_id").select("drawing_id", "event_seq", "stage", "level", "message", F.coalesce(walls, F.lit(0)).alias("walls"))


def run_policy_fires(spark, sf_dir):
    w, runs = _audited(spark, sf_dir)
    refused = F.get_json_object("detail_json", "$.mm_fields_refused").cast("int")
    return w.read("policy_fires").join(runs, "run_id").select("drawing_id", "policy_name", refused.alias("mm_fields_refused"))


def run_refusals_logged(spark, sf_dir):
    w, runs = _audited(spark, sf_dir)
    return w.read("refusals_log").join(runs, "run_id").select("drawing_id", "attempted_type", F.size(F.from_json("region_json", "array<array<double>>")).alias("points"))


def run_states(spark, sf_dir):
    w, _ = _audited(spark, sf_dir)
    marks = w.counts().groupBy("run_id", "stage").agg(F.count_if(F.col("field") == "type_epistemic").alias("type_tags"))
    return w.runs().join(marks, "run_id").select("drawing_id", "exit_state", "stage", (F.col("type_tags") > 0).alias("counted"), (F.col("duration_ms") >= 0).alias("timed"))


def text_histogram(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("w"))
    return reports.class_histogram(words.select("doc_id", X.classify_text(F.col("w")).alias("classification")), "doc_id")


def object_grid(spark, sf_dir):
    """Events as objects; a value above 50 is a measure."""
    ev = audit_queries.events(spark, sf_dir)
    tag = F.struct("tag")
    rows = ev.select("drawing_id", F.col("event_seq").alias("object_id"), F.col("stage").alias("type"), tag.alias("type_epistemic"), tag.alias("geometry_epistemic"), F.struct(F.when(F.col("value") > 50, "⊨").otherwise("⊥").alias("tag")).alias("measurement_epistemic"), F.when(F.col("value") > 50, F.floor("value")).alias("measurement_mm"), F.lit("needs_human").alias("review_status"))
    return reports.object_grid(rows)


def run_labels(spark, sf_dir):
    runs = audit_queries.runs(audit_queries.events(spark, sf_dir))
    return runs.select("run_id", reports.run_label(F.col("drawing_id"), F.col("started_at"), F.col("exit_state"), F.col("run_id")).alias("label"))


def past_runs(spark, sf_dir):
    ev = audit_queries.events(spark, sf_dir)
    return reports.overview(audit_queries.runs(ev), ev.where(F.col("stage").isin("error", "view")), ev.where("stage = 'error'"))


def default_sample(spark, sf_dir):
    """Each run's stages as a list to pick from, a purchase by default."""
    stages = audit_queries.events(spark, sf_dir).groupBy("run_id").agg(F.array_sort(F.collect_set("stage")).alias("options"))
    return stages.select("run_id", reports.default_index(F.col("options"), "purchase").alias("at"))


def diagnostics(spark, sf_dir):
    """Runs without clicks, purchases or both."""
    none = lambda s: ~F.bool_or(F.col("stage") == s)
    found = audit_queries.events(spark, sf_dir).groupBy("run_id").agg(reports.diagnostic(no_click=none("click"), no_purchase=none("purchase")).alias("diagnostic"))
    return found.groupBy("diagnostic").agg(F.count("*").alias("cnt"))


def crawl_pool(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("category"), F.col("doc_id").alias("pos"), F.col("doc_id"))
    return crawl.pool(docs, ["en", "de", "fr"], 12).select("pos", "category", "doc_id")


def crawl_reasons(spark, sf_dir):
    from dataclasses import replace

    from plumbmark.params import DEFAULT

    return corpus_queries._gated(spark, sf_dir).groupBy(crawl.reason(replace(DEFAULT, least_bytes=600)).alias("reason")).agg(F.count("*").alias("cnt"))


def crawl_records(spark, sf_dir):
    """Pages as responses to candidates of their URLs, every fifth lost; hashes of the labelled pages are already in the corpus."""
    pages = table(spark, sf_dir, "pages").withColumn("url", F.concat("url", F.lit("#"), F.col("page_id").cast("string")))
    pick = pages.select(F.col("page_id").alias("pos"), F.concat(F.lit("File:page "), F.col("page_id").cast("string"), F.lit(".png")).alias("filename"), "url", F.when(F.col("page_id") % 7 == 0, "gfdl").otherwise("cc0").alias("license_raw"), F.lit(None).cast("string").alias("source_page_url"))
    answers = pages.where("page_id % 5 <> 0").select("url", F.lit(200).alias("status"), F.lit("image/png").alias("content_type"), F.encode(F.repeat("html", F.lit(9)), "UTF-8").alias("body"))
    old = pages.where("page_id % 11 = 0").select(F.sha2(F.repeat("html", F.lit(9)), 256).alias("sha256"))
    return crawl.records(crawl.judge(pick, answers, old), "saved", F.lit(None).cast("timestamp")).select("drawing_id", "license", "sha256", "original_uri", "usage")


_EV, _RAW, _GATED = audit_queries._EV, corpus_queries._RAW, corpus_queries._GATED
_RUNS = """WITH d AS (SELECT i, printf('synth_%05d', 1001 + i) AS drawing_id, i % 2 = 0 AS scaled, CASE i % 4 WHEN 1 THEN 2 ELSE 1 END AS inner_walls FROM range((SELECT count(*) FROM nation)) t(i))
"""
_CLASS = r"""CASE WHEN regexp_matches(w, '^\p{Nd}{2,5}([.]\p{Nd}+)?$') THEN 'dimension_text' WHEN regexp_matches(w, '^[A-Za-zㄱ-힝][\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}ㄱ-힝\s\v\p{Z}\x{85}]*$') THEN 'room_label' ELSE 'other' END"""
_BADGE = "CASE {} WHEN '⊢' THEN '🟢 ⊢ grounded' WHEN '⊨' THEN '🔵 ⊨ inferred' WHEN '⊬' THEN '🟡 ⊬ extrapolated' WHEN '⊥' THEN '🔴 ⊥ unknown' END"

QUERIES = {
    "run_audit_events": run_audit_events, "run_policy_fires": run_policy_fires, "run_refusals_logged": run_refusals_logged, "run_states": run_states, "text_histogram": text_histogram, "object_grid": object_grid,
    "run_labels": run_labels, "past_runs": past_runs, "default_sample": default_sample, "diagnostics": diagnostics, "crawl_pool": crawl_pool, "crawl_reasons": crawl_reasons, "crawl_records": crawl_records,
}
ORACLES = {
    "run_audit_events": _RUNS + """SELECT drawing_id, event_seq, stage, 'INFO' AS level, CASE WHEN message = 'anchor' THEN 'scale_anchor: ' || scaled ELSE message END AS message, CASE WHEN event_seq = 3 THEN 4 + inner_walls ELSE 0 END AS walls
FROM d, (VALUES (0, 'ingest', 'starting'), (1, 'ingest', 'complete'), (2, 'geometry', 'starting'), (3, 'geometry', 'complete'), (4, 'ocr', 'starting'), (5, 'ocr', 'complete'), (6, 'symbols', 'starting'), (7, 'symbols', 'complete'), (8, 'compose', 'starting'), (9, 'compose', 'anchor'), (10, 'compose', 'complete')) e(event_seq, stage, message)""",
    "run_policy_fires": _RUNS + "SELECT drawing_id, 'Measurement_Policy' AS policy_name, 4 + inner_walls + inner_walls + 2 + inner_walls + 1 AS mm_fields_refused FROM d WHERE NOT scaled",
    "run_refusals_logged": _RUNS + "SELECT drawing_id, 'door' AS attempted_type, 2 AS points FROM d",
    "run_states": _RUNS + "SELECT drawing_id, 'SUCCESS' AS exit_state, 'compose' AS stage, true AS counted, true AS timed FROM d",
    "text_histogram": rf"""WITH w AS (SELECT doc_id, regexp_replace(unnest(string_split(coalesce(text, ''), ' ')), '^[\s\v\p{{Z}}\x{{85}}]+|[\s\v\p{{Z}}\x{{85}}]+$', '', 'g') AS w FROM documents), k AS (SELECT doc_id, {_CLASS} AS kind FROM w)
SELECT doc_id, count(*) FILTER (kind = 'dimension_text') AS dimension_text, count(*) FILTER (kind = 'room_label') AS room_label, count(*) FILTER (kind = 'other') AS other FROM k GROUP BY 1""",
    "object_grid": _EV + f"SELECT drawing_id, event_seq AS id, stage AS type, {_BADGE.format('tag')} AS type_tag, {_BADGE.format('tag')} AS geometry_tag, {_BADGE.format("CASE WHEN value > 50 THEN '⊨' ELSE '⊥' END")} AS measurement_tag, CASE WHEN value > 50 THEN floor(value)::BIGINT::VARCHAR ELSE '—' END AS measurement_mm, 'needs_human' AS review FROM ev",
    "run_labels": _EV + "SELECT run_id, drawing_id || '  |  ' || strftime(started_at, '%Y-%m-%dT%H:%M:%SZ') || '  |  ' || exit_state || '  (' || run_id[1:8] || ')' AS label FROM runs",
    "past_runs": _EV + "SELECT (SELECT count(*) FROM runs) AS total, (SELECT count(*) FROM runs WHERE exit_state = 'SUCCESS') AS success, (SELECT count(*) FROM runs WHERE exit_state = 'FAILURE') AS failure, (SELECT count(*) FROM ev WHERE stage IN ('error', 'view')) AS refusals, (SELECT count(*) FROM ev WHERE stage = 'error') AS policy_fires",
    "default_sample": _EV + ", o AS (SELECT run_id, list_sort(list(DISTINCT stage)) AS s FROM ev GROUP BY 1) SELECT run_id, CASE WHEN list_contains(s, 'purchase') THEN list_position(s, 'purchase') - 1 WHEN len(s) > 1 THEN 1 ELSE 0 END::BIGINT AS at FROM o",
    "diagnostics": _EV + ", o AS (SELECT run_id, concat_ws(' | ', CASE WHEN NOT bool_or(stage = 'click') THEN 'no click' END, CASE WHEN NOT bool_or(stage = 'purchase') THEN 'no purchase' END) AS diagnostic FROM ev GROUP BY 1) SELECT diagnostic, count(*) AS cnt FROM o GROUP BY 1",
    "crawl_pool": "WITH c AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n, list_position(['en', 'de', 'fr'], lang) AS k FROM documents WHERE lang IN ('en', 'de', 'fr')) SELECT row_number() OVER (ORDER BY k, n) AS pos, lang AS category, doc_id FROM c WHERE n <= 12 ORDER BY k, n LIMIT 36",
    "crawl_reasons": _GATED + """SELECT CASE stage WHEN 'license_check' THEN 'license could not be mapped (raw: ' || chr(39) || k || chr(39) || ')' WHEN 'url_check' THEN 'candidate has no URL' WHEN 'download' THEN 'HTTP ' || CASE WHEN lost THEN 404 ELSE 200 END
  WHEN 'size_check' THEN 'image too small (' || n || ' bytes < 600)' WHEN 'dedup' THEN 'duplicate sha256 (already in corpus)' END AS reason, count(*) AS cnt FROM d GROUP BY 1""",
    "crawl_records": """WITH p AS (SELECT page_id, url || '#' || page_id AS url, repeat(html, 9) AS body FROM pages), ok AS (SELECT *, sha256(body) AS sha FROM p WHERE page_id % 7 <> 0 AND page_id % 5 <> 0 AND strlen(body) >= 8192)
SELECT 'wm_page_' || page_id AS drawing_id, 'public' AS license, sha AS sha256, url AS original_uri, 'demo-only' AS usage FROM ok
WHERE sha NOT IN (SELECT sha256(body) FROM p WHERE page_id % 11 = 0) QUALIFY row_number() OVER (PARTITION BY sha ORDER BY page_id) = 1""",
}
