"""Queries over the audit warehouse, derived here from the events table.

A run is one user's day, a stage an event type, a drawing the user; an error is a policy fire, and an error or a view
is a refusal. Marks: a purchase is grounded, clicks and sign-ups are inferred, a view is extrapolated, an error unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbmark.functions.text import preview
from plumbmark.operators import audit, trust
from plumbmark.params import TAGS
from plumbmark.session import table

#: Which event type carries which mark.
TAG_OF = {"purchase": TAGS[0], "click": TAGS[1], "signup": TAGS[1], "view": TAGS[2], "error": TAGS[3]}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("run_id", F.concat_ws("_", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")))
    tag = F.element_at(F.create_map(*[F.lit(x) for kv in TAG_OF.items() for x in kv]), F.col("event_type"))
    return ev.select("run_id", F.col("event_id").alias("event_seq"), F.col("user_id").alias("drawing_id"), F.col("event_type").alias("stage"), tag.alias("tag"), "value", F.col("props").alias("payload_json"), F.col("ts").alias("timestamp"))


def runs(ev: DataFrame) -> DataFrame:
    """A run ends in failure if an error is among its events; a run of one event has no duration."""
    took = F.timestamp_diff("MILLISECOND", F.min("timestamp"), F.max("timestamp"))
    return ev.groupBy("run_id").agg(F.min("drawing_id").alias("drawing_id"), F.min("timestamp").alias("started_at"), F.when(F.count("*") > 1, took).alias("duration_ms"), F.when(F.bool_or(F.col("stage") == "error"), "FAILURE").otherwise("SUCCESS").alias("exit_state"))


def refusals(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("stage").isin("error", "view")).select("run_id", F.col("stage").alias("attempted_type"), "drawing_id")


def refusals_by_type_drawing(spark, sf_dir):
    ev = events(spark, sf_dir)
    return audit.refusals_by_type(refusals(ev).drop("drawing_id"), runs(ev))


def list_runs(spark, sf_dir):
    return audit.list_runs(runs(events(spark, sf_dir))).select("run_id", "drawing_id", "started_at", "exit_state")


def show_run_events(spark, sf_dir):
    """The events of the run that began first."""
    ev = events(spark, sf_dir)
    first = runs(ev).orderBy("started_at", "run_id").limit(1).select("run_id")
    return ev.join(F.broadcast(first), "run_id", "left_semi").select("run_id", "event_seq", "stage", preview(F.col("payload_json"), 200).alias("payload")).orderBy("event_seq")


def stats_counts(spark, sf_dir):
    return audit.run_counts(runs(events(spark, sf_dir)))


def success_rate(spark, sf_dir):
    return audit.success_rate(runs(events(spark, sf_dir)))


def affected(spark, sf_dir):
    return audit.affected(events(spark, sf_dir), TAGS[3])


def top_types(spark, sf_dir):
    return audit.top_types(events(spark, sf_dir).select(F.col("stage").alias("attempted_type")))


def slowest_runs(spark, sf_dir):
    return audit.slowest(runs(events(spark, sf_dir))).select("run_id", "duration_ms")


def policy_by_drawing(spark, sf_dir):
    ev = events(spark, sf_dir)
    return audit.fires_by_drawing(ev.where("stage = 'error'").select("run_id"), runs(ev))


def three_marks(ev: DataFrame) -> DataFrame:
    """Type, geometry and measurement marks of each event: its own, always inferred, and unknown unless the value is above 50."""
    own = lambda tag: F.struct(tag.alias("tag"))
    return ev.select("drawing_id", own(F.col("tag")).alias("type_epistemic"), own(F.lit(TAGS[1])).alias("geometry_epistemic"), own(F.when(F.col("value") > 50, TAGS[1]).otherwise(TAGS[3])).alias("measurement_epistemic"))


def epistemic_rollup(spark, sf_dir):
    counts = trust.rollup_tags(three_marks(events(spark, sf_dir)))
    return audit.tag_sums(counts)


def rollup_totals(spark, sf_dir):
    counts = trust.rollup_tags(three_marks(events(spark, sf_dir)))
    return counts.rollup("field", "tag").agg(F.sum("count").alias("total"))


def epistemic_upsert(spark, sf_dir):
    ev = events(spark, sf_dir).select("run_id", "stage", "tag", F.col("value").cast("long").alias("count"), "event_seq")
    return audit.latest(ev, ["run_id", "stage", "tag"], F.col("event_seq")).drop("event_seq")


def run_lifecycle(spark, sf_dir):
    """Begin and end rows as a log, then the latest state of each run."""
    state = runs(events(spark, sf_dir)).where("duration_ms IS NOT NULL")
    begin = runs(events(spark, sf_dir)).select("run_id", F.lit(0).alias("seq"), "drawing_id", F.lit("in_progress").alias("exit_state"), F.lit(None).cast("long").alias("duration_ms"))
    found = audit.run_state(begin.unionByName(state.select("run_id", F.lit(1).alias("seq"), "drawing_id", "exit_state", "duration_ms")))
    return found.select("run_id", "drawing_id", "exit_state", F.coalesce("duration_ms", F.lit(-1)).alias("duration_ms"))


def payload_json(spark, sf_dir):
    k = F.get_json_object("payload_json", "$.k").cast("long")
    return events(spark, sf_dir).groupBy("stage").agg(F.sum(k).alias("k_sum"), F.max(k).alias("k_max"), F.count(k).alias("k_count"))


def distinct_stages(spark, sf_dir):
    return events(spark, sf_dir).select("stage").distinct()


def stage_latency(spark, sf_dir):
    found = audit.stage_latency(events(spark, sf_dir))
    return found.groupBy("stage").agg(F.count("took_ms").alias("n"), F.sum("took_ms").alias("total_ms"), F.max("took_ms").alias("longest_ms"))


def taint_counts(spark, sf_dir):
    """By day of the week and event type, empty groups too."""
    ev = events(spark, sf_dir).withColumn("type", F.col("stage")).withColumn("drawing_id", F.pmod(F.col("drawing_id"), F.lit(200)))
    drawings = ev.select("drawing_id").distinct()
    groups = drawings.select("drawing_id", F.explode(F.array(*[F.lit(t) for t in [*TAG_OF, "door"]])).alias("type"))
    return trust.count_taint(ev.select("drawing_id", "type", "tag"), ["drawing_id", "type"], groups)


def taint_sum_gated(spark, sf_dir):
    """Drawings of even number have an anchor; purchases and clicks are what is measured."""
    ev = events(spark, sf_dir)
    anchor = ev.select("drawing_id").distinct().withColumn("detected", F.col("drawing_id") % 2 == 0)
    rows = ev.where(F.col("stage").isin("purchase", "click", "error") & ((F.col("stage") != "error") | (F.col("drawing_id") % 4 == 0))).select("drawing_id", F.col("value").alias("mm"), "tag")
    found = trust.sum_taint(rows, anchor)
    return found.select("drawing_id", F.round("value", 4).alias("value"), "tag", F.col("warning").isNotNull().alias("warned"))


def policy_violations(spark, sf_dir):
    """Faults: every third event lacks what its mark needs, and a drawing has an anchor if its number is divisible by 3, or, wrongly, a scale."""
    ev = events(spark, sf_dir)
    whole = F.col("event_seq") % 3 != 0
    mark = F.struct(F.col("tag").alias("tag"), F.when(whole, "basis").alias("basis"), F.when(whole, "gap").alias("gap"))
    detected = F.col("drawing_id") % 3 == 0
    tests = F.array_compact(F.array(
        F.concat(F.lit("mark "), trust.mark_violations(mark)),
        trust.measurement_violation(detected, F.when(F.col("value") > 90, F.col("value")), F.col("tag")),
        trust.anchor_violation(detected, F.when(F.col("drawing_id") % 2 == 0, F.lit(1.0))),
    ))
    return ev.select(F.explode(tests).alias("rule")).groupBy("rule").agg(F.count("*").alias("cnt"))


def review_route(spark, sf_dir):
    """Events with two signals or more are detections, others refusals."""
    evidence = F.array_compact(F.array(F.lit("seen"), F.when(F.col("value") > 50, "large"), F.when(F.col("stage") != "view", "acted")))
    return events(spark, sf_dir).select(F.when(F.size(evidence) >= 2, "detection").otherwise("refusal").alias("route"), "stage").groupBy("route", "stage").agg(F.count("*").alias("cnt"))


def hourly_levels(spark, sf_dir):
    """What the stream counts, in batch."""
    hour = F.date_trunc("HOUR", F.col("timestamp")).cast("timestamp_ntz")
    return events(spark, sf_dir).groupBy(F.date_format(hour, "yyyy-MM-dd HH").alias("hour"), "stage").agg(F.count("*").alias("cnt"))


_EV = """WITH ev AS (SELECT user_id::VARCHAR || '_' || strftime(ts, '%Y%m%d') AS run_id, event_id AS event_seq, user_id AS drawing_id, event_type AS stage,
  CASE event_type WHEN 'purchase' THEN '⊢' WHEN 'click' THEN '⊨' WHEN 'signup' THEN '⊨' WHEN 'view' THEN '⊬' WHEN 'error' THEN '⊥' END AS tag, value, props AS payload_json, ts AS timestamp FROM events),
runs AS (SELECT run_id, min(drawing_id) AS drawing_id, min(timestamp) AS started_at,
  CASE WHEN count(*) > 1 THEN (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) // 1000 END AS duration_ms,
  CASE WHEN bool_or(stage = 'error') THEN 'FAILURE' ELSE 'SUCCESS' END AS exit_state FROM ev GROUP BY 1),
marks AS (SELECT 'type' AS field, tag FROM ev UNION ALL SELECT 'geometry', '⊨' FROM ev UNION ALL SELECT 'measurement', CASE WHEN value > 50 THEN '⊨' ELSE '⊥' END FROM ev)
"""

QUERIES = {
    "audit_refusals_by_type_drawing": refusals_by_type_drawing, "audit_list_runs": list_runs, "audit_show_run_events": show_run_events, "audit_stats_counts": stats_counts, "audit_success_rate": success_rate, "audit_affected_counts": affected, "audit_top_types": top_types,
    "audit_slowest_runs": slowest_runs, "audit_policy_by_drawing": policy_by_drawing, "audit_epistemic_rollup": epistemic_rollup, "audit_rollup_totals": rollup_totals, "audit_epistemic_upsert": epistemic_upsert,
    "audit_run_lifecycle": run_lifecycle, "audit_payload_json": payload_json, "audit_distinct_stages": distinct_stages, "audit_stage_latency": stage_latency, "audit_hourly_levels": hourly_levels,
    "taint_counts": taint_counts, "taint_sum_gated": taint_sum_gated, "policy_violations": policy_violations, "review_route": review_route,
}
ORACLES = {
    "audit_refusals_by_type_drawing": _EV + "SELECT e.stage AS attempted_type, r.drawing_id, count(*) AS cnt FROM ev e JOIN runs r USING (run_id) WHERE e.stage IN ('error', 'view') GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2",
    "audit_list_runs": _EV + "SELECT run_id, drawing_id, started_at, exit_state FROM runs ORDER BY started_at DESC, run_id LIMIT 20",
    "audit_show_run_events": _EV + "SELECT run_id, event_seq, stage, CASE WHEN length(payload_json) > 200 THEN payload_json[1:200] || '...' ELSE coalesce(payload_json, '') END AS payload FROM ev WHERE run_id = (SELECT run_id FROM runs ORDER BY started_at, run_id LIMIT 1) ORDER BY event_seq",
    "audit_stats_counts": _EV + "SELECT count(*) AS total, count(*) FILTER (exit_state = 'SUCCESS') AS success, count(*) FILTER (exit_state = 'FAILURE') AS failure FROM runs",
    "audit_success_rate": _EV + "SELECT count(*) AS total, count(*) FILTER (exit_state = 'SUCCESS') AS ok, count(*) FILTER (exit_state = 'SUCCESS')::DOUBLE / count(*) AS rate, coalesce(count(*) FILTER (exit_state = 'SUCCESS')::DOUBLE / count(*) >= 0.8, false) AS enough FROM runs",
    "audit_affected_counts": _EV + "SELECT run_id, count(*) AS affected FROM ev WHERE stage = 'error' GROUP BY 1",
    "audit_top_types": _EV + "SELECT stage AS attempted_type, count(*) AS cnt FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "audit_slowest_runs": _EV + "SELECT run_id, duration_ms FROM runs ORDER BY duration_ms DESC NULLS LAST, run_id LIMIT 10",
    "audit_policy_by_drawing": _EV + "SELECT r.drawing_id, count(*) AS fires FROM ev e JOIN runs r USING (run_id) WHERE e.stage = 'error' GROUP BY 1",
    "audit_epistemic_rollup": _EV + "SELECT field, tag, count(*) AS total FROM marks GROUP BY 1, 2 ORDER BY 1, 2",
    "audit_rollup_totals": _EV + "SELECT field, tag, count(*) AS total FROM marks GROUP BY ROLLUP (field, tag)",
    "audit_epistemic_upsert": _EV + "SELECT run_id, stage, tag, arg_max(trunc(value)::BIGINT, event_seq) AS count FROM ev GROUP BY 1, 2, 3",
    "audit_run_lifecycle": _EV + "SELECT run_id, drawing_id, CASE WHEN duration_ms IS NULL THEN 'in_progress' ELSE exit_state END AS exit_state, coalesce(duration_ms, -1) AS duration_ms FROM runs",
    "audit_payload_json": _EV + "SELECT stage, sum(k)::BIGINT AS k_sum, max(k) AS k_max, count(k) AS k_count FROM (SELECT stage, json_extract_string(payload_json, '$.k')::BIGINT AS k FROM ev) GROUP BY 1",
    "audit_distinct_stages": _EV + "SELECT DISTINCT stage FROM ev",
    "audit_stage_latency": _EV + "SELECT stage, count(d) AS n, sum(d)::BIGINT AS total_ms, max(d) AS longest_ms FROM (SELECT stage, trunc((epoch_us(lead(timestamp) OVER (PARTITION BY run_id ORDER BY event_seq)) - epoch_us(timestamp)) / 1000)::BIGINT AS d FROM ev) GROUP BY 1",
    "audit_hourly_levels": _EV + "SELECT strftime(timestamp, '%Y-%m-%d %H') AS hour, stage, count(*) AS cnt FROM ev GROUP BY 1, 2",
    "taint_counts": _EV + """, own AS (SELECT drawing_id % 200 AS drawing_id, stage AS type, tag FROM ev),
groups AS (SELECT * FROM (SELECT DISTINCT drawing_id FROM own), (VALUES ('purchase'), ('click'), ('signup'), ('view'), ('error'), ('door')) t(type)),
c AS (SELECT g.drawing_id, g.type, count(o.tag) AS value, count(*) FILTER (o.tag IN ('⊬', '⊥')) AS tainted FROM groups g LEFT JOIN own o USING (drawing_id, type) GROUP BY 1, 2)
SELECT *, CASE WHEN value = 0 THEN '⊢' WHEN tainted > 0 THEN '⊬' ELSE '⊨' END AS tag, CASE WHEN tainted > 0 THEN tainted || ' of ' || value || ' contributors tainted' END AS warning FROM c""",
    "taint_sum_gated": _EV + """, a AS (SELECT DISTINCT drawing_id, drawing_id % 2 = 0 AS detected FROM ev),
s AS (SELECT drawing_id, sum(value) AS total, count(*) AS n, count(*) FILTER (tag IN ('⊬', '⊥')) AS bad FROM ev WHERE stage IN ('purchase', 'click') OR (stage = 'error' AND drawing_id % 4 = 0) GROUP BY 1)
SELECT drawing_id, CASE WHEN detected THEN round(coalesce(total, 0.0), 4) END AS value, CASE WHEN NOT detected THEN '⊥' WHEN n IS NULL THEN '⊢' WHEN bad > 0 THEN '⊬' ELSE '⊨' END AS tag, (NOT detected OR coalesce(bad, 0) > 0) AS warned FROM a LEFT JOIN s USING (drawing_id)""",
    "policy_violations": _EV + """, r AS (SELECT CASE WHEN tag = '⊬' AND event_seq % 3 = 0 THEN 'mark basis' WHEN tag = '⊥' AND event_seq % 3 = 0 THEN 'mark gap' END AS rule FROM ev
UNION ALL SELECT CASE WHEN drawing_id % 3 <> 0 AND value > 90 THEN 'value without anchor' WHEN drawing_id % 3 <> 0 AND tag <> '⊥' THEN 'mark without anchor' END FROM ev
UNION ALL SELECT CASE WHEN (drawing_id % 3 = 0) <> (drawing_id % 2 = 0) THEN 'anchor' END FROM ev)
SELECT rule, count(*) AS cnt FROM r WHERE rule IS NOT NULL GROUP BY 1""",
    "review_route": _EV + "SELECT CASE WHEN value > 50 OR stage <> 'view' THEN 'detection' ELSE 'refusal' END AS route, stage, count(*) AS cnt FROM ev GROUP BY 1, 2",
}
