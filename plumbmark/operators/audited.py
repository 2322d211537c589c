"""The engine under audit: every drawing is a run with its stage events, refusals, policy fires and counts of marks in the warehouse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbmark.operators import trust
from plumbmark.operators.audit import Warehouse
from plumbmark.params import DEFAULT, UNKNOWN, Params
from plumbmark.session import settle, shared_folder

#: Fixed names of the stages in their order, and of the policy.
STAGES = ("ingest", "geometry", "ocr", "symbols", "compose")
POLICY = "Measurement_Policy"


def run_key(drawing: Column, started: Column) -> Column:
    """A run's id: 32 hex digits that depend on the drawing and the start only, so that a lost task makes the same ones again."""
    return F.md5(F.concat_ws("|", drawing.cast("string"), F.unix_micros(started).cast("string")))


def _tally(drawings: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """drawings with a count of the rows of each part, 0 where it has none."""
    counted = [df.groupBy("drawing_id").agg(F.count("*").alias(name)) for name, df in parts.items()]
    return reduce(lambda all_, one: all_.join(one, "drawing_id", "left"), counted, drawings).na.fill(0, list(parts))


def stage_events(runs: DataFrame, tally: DataFrame, anchor: DataFrame) -> DataFrame:
    """Two events a stage, starting and complete with its counts, and the anchor's between those of compose; numbered in a run."""
    names = lambda *cs: F.to_json(F.struct(*cs))
    n = F.col
    complete = {
        "ingest": names("width", "height"),
        "geometry": names("lines", "contours", "walls"),
        "ocr": names("dimension_text", "room_label", "other", "skipped_empty"),
        "symbols": names("doors", "windows", "spaces", "refusals"),
        "compose": names("objects", "refusals", "detected"),
    }
    none = F.lit(None).cast("string")
    log = []
    for stage in STAGES:
        log.append((stage, F.lit("starting"), none))
        if stage == "compose":
            log.append((stage, F.concat(F.lit("scale_anchor: "), n("detected").cast("string")), names("detected", "px_per_mm", "signal")))
        log.append((stage, F.lit("complete"), complete[stage]))
    rows = F.array(*[F.struct(F.lit(stage).alias("stage"), F.lit("INFO").alias("level"), message.alias("message"), payload.alias("payload_json")) for stage, message, payload in log])
    whole = runs.join(tally, "drawing_id").join(anchor.select("drawing_id", "detected", "px_per_mm", "signal"), "drawing_id")
    return whole.select("run_id", F.col("started_at").alias("timestamp"), F.posexplode(rows).alias("event_seq", "e")).select("run_id", "event_seq", "e.*", "timestamp")


def policy_fires(runs: DataFrame, objects: DataFrame, anchor: DataFrame) -> DataFrame:
    """One a drawing without a scale, with the number of objects whose measure is refused for it, 0 included."""
    refused = objects.where(F.col("measurement_epistemic.tag") == UNKNOWN).groupBy("drawing_id").agg(F.count("*").alias("mm_fields_refused"))
    rows = runs.join(anchor.where("NOT detected").select("drawing_id"), "drawing_id").join(refused, "drawing_id", "left").na.fill(0, ["mm_fields_refused"])
    detail = F.struct(F.lit("scale_anchor.detected = False").alias("reason"), "mm_fields_refused", "drawing_id")
    return rows.select("run_id", F.lit(POLICY).alias("policy_name"), detail.alias("detail"), F.col("started_at").alias("timestamp"))


def run(w: Warehouse, primitives: dict[str, DataFrame], p: Params = DEFAULT) -> dict[str, DataFrame]:
    """trust.analyse of the primitives, recorded: each drawing's run begins, is filled and ends, or ends as a failure of its error.

    Returns what analyse does, and `runs` (drawing_id, run_id, started_at). All drawings of a call fail together, as one plan computes them.
    """
    spark = w.spark
    w.init()
    started = spark.sql("SELECT current_timestamp() AS t").first()[0]
    runs = primitives["drawings"].select("drawing_id").distinct().withColumn("started_at", F.lit(started)).withColumn("run_id", run_key(F.col("drawing_id"), F.col("started_at")))
    runs = settle(runs.withColumn("drawing_id", F.col("drawing_id").cast("string")), shared_folder(spark), "runs")
    own = {name: df.withColumn("drawing_id", F.col("drawing_id").cast("string")) for name, df in primitives.items()}
    w.begin(runs)
    try:
        found = trust.analyse(**own, p=p)
        kind = lambda k: found["texts"].where(F.col("classification") == k)
        parts = {name: own[name] for name in ("lines", "contours")} | {name: found[name] for name in ("walls", "doors", "windows", "spaces", "objects", "refusals")}
        parts |= {k: kind(k) for k in ("dimension_text", "room_label", "other")} | {"_texts": own["texts"]}
        tally = _tally(own["drawings"], parts)
        tally = tally.withColumn("skipped_empty", F.col("_texts") - F.col("dimension_text") - F.col("room_label") - F.col("other")).drop("_texts")
        w.append("stage_events", stage_events(runs, tally, found["anchor"]))
        w.fire(policy_fires(runs, found["objects"], found["anchor"]))
        w.refuse(found["refusals"].join(runs, "drawing_id").select("run_id", "region", "attempted_type", "why", F.col("started_at").alias("recorded_at")))
        marks = trust.rollup_tags(found["objects"]).join(runs, "drawing_id")
        w.append("epistemic_counts", marks.select("run_id", F.lit("compose").alias("stage"), "tag", F.concat("field", F.lit("_epistemic")).alias("field"), "count", F.unix_micros("started_at").alias("seq")))
    except Exception as error:
        text = f"{type(error).__name__}: {error}"
        w.emit_errors(runs.select("run_id", F.lit("compose").alias("stage"), F.lit(text).alias("message"), F.current_timestamp().alias("timestamp")))
        w.end(runs.select("*", F.current_timestamp().alias("completed_at"), F.lit(text).alias("error_msg")))
        raise
    w.end(runs.select("*", F.current_timestamp().alias("completed_at"), F.lit(None).cast("string").alias("error_msg")))
    return found | {"runs": runs}
