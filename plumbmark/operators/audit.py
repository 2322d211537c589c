"""Audit warehouse: six append-only tables, the run lifecycle, upserts by the latest row, and the command queries.

Runs are event-sourced: a begin row and, later, an end row; the state of a run is the latest of them. So no table is
updated in place, and a lost writer leaves a run `in_progress`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

VERSION = 1
TABLES = {
    "runs": "run_id string, drawing_id string, seq long, started_at timestamp, completed_at timestamp, duration_ms long, exit_state string, error_msg string",
    "stage_events": "event_seq long, run_id string, stage string, level string, message string, payload_json string, timestamp timestamp",
    "epistemic_counts": "run_id string, stage string, tag string, field string, count long, seq long",
    "refusals_log": "run_id string, region_json string, attempted_type string, why string, recorded_at timestamp",
    "policy_fires": "run_id string, policy_name string, detail_json string, timestamp timestamp",
    "schema_meta": "key string, value string",
}


class Warehouse:
    """The tables as Parquet folders below a path that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def init(self) -> int:
        """Creates what is missing; an equal version is left alone, any other is an error. Returns the version."""
        found = self.version()
        if found is None:
            for name, schema in TABLES.items():
                self.spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{name}")
            self.append("schema_meta", self.spark.createDataFrame([("version", str(VERSION))], TABLES["schema_meta"]))
        elif found != VERSION:
            raise ValueError(f"the warehouse has version {found}; this code knows {VERSION} and does not {'downgrade' if found > VERSION else 'migrate'}")
        return VERSION

    def version(self) -> int | None:
        try:
            row = self.read("schema_meta").where("key = 'version'").agg(F.max(F.expr("try_cast(value AS int)"))).first()
        except AnalysisException:
            return None
        return row[0]

    def tables(self) -> list[str]:
        return sorted(TABLES)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}") if self._exists(name) else self._missing(name)

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _missing(self, name: str) -> DataFrame:
        raise AnalysisException(f"no table {name} in {self.path}")

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows with the table's columns, in any order; missing ones are null."""
        schema = self.spark.createDataFrame([], TABLES[name]).schema
        rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.mode("append").parquet(f"{self.path}/{name}")

    def _append_json(self, name: str, rows: DataFrame, column: str, json: str) -> None:
        """rows with `column`, a struct, map or array, as the JSON text that the table keeps; null stays null."""
        self.append(name, rows.withColumn(json, F.to_json(column)) if column in rows.columns else rows)

    def emit(self, events: DataFrame) -> None:
        """events: run_id, stage, level, message, timestamp, and payload, if any."""
        self._append_json("stage_events", events, "payload", "payload_json")

    def emit_errors(self, errors: DataFrame) -> None:
        """errors: run_id, stage, message, timestamp. An event only: the run's state is set by its end."""
        self.emit(errors.withColumn("level", F.lit("ERROR")))

    def fire(self, fires: DataFrame) -> None:
        """fires: run_id, policy_name, timestamp, and detail, if any."""
        self._append_json("policy_fires", fires, "detail", "detail_json")

    def refuse(self, refusals: DataFrame) -> None:
        """refusals: run_id, region (an array of points, each an array of two numbers), attempted_type, why, recorded_at."""
        self._append_json("refusals_log", refusals, "region", "region_json")

    def begin(self, runs: DataFrame) -> None:
        """runs: run_id, drawing_id, started_at."""
        self.append("runs", runs.select("run_id", "drawing_id", "started_at", F.lit(0).alias("seq"), F.lit("in_progress").alias("exit_state")))

    def end(self, runs: DataFrame) -> None:
        """runs: run_id, drawing_id, started_at, completed_at, error_msg (null: success)."""
        took = F.timestamp_diff("MILLISECOND", F.col("started_at"), F.col("completed_at"))
        self.append("runs", runs.withColumns({"seq": F.lit(1), "duration_ms": took, "exit_state": F.when(F.col("error_msg").isNull(), "SUCCESS").otherwise("FAILURE")}))

    def runs(self) -> DataFrame:
        return run_state(self.read("runs"))

    def counts(self) -> DataFrame:
        return latest(self.read("epistemic_counts"), ["run_id", "stage", "tag", "field"], F.col("seq")).drop("seq")


def run_id() -> Column:
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def run_state(log: DataFrame) -> DataFrame:
    """One row a run: its latest log row, an end before a begin."""
    cols = [c for c in log.columns if c not in ("run_id", "seq")]
    return log.groupBy("run_id").agg(F.max_by(F.struct(*cols), "seq").alias("s")).select("run_id", "s.*")


def latest(rows: DataFrame, keys: list[str], seq: Column) -> DataFrame:
    """The row of largest seq of each key: an upsert of an append-only table. Ties must not occur."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_latest")).select(*keys, "_latest.*").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of equal keys; the new values replace, nothing is added up."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def list_runs(runs: DataFrame, limit: int = 20, drawing_id=None) -> DataFrame:
    own = runs if drawing_id is None else runs.where(F.col("drawing_id") == F.lit(drawing_id))
    return own.orderBy(F.desc("started_at"), "run_id").limit(limit)


def refusals_by_type(refusals: DataFrame, runs: DataFrame, drawing_id=None, attempted_type: str | None = None) -> DataFrame:
    own = refusals.join(runs.select("run_id", "drawing_id"), "run_id")
    if drawing_id is not None:
        own = own.where(F.col("drawing_id") == F.lit(drawing_id))
    if attempted_type is not None:
        own = own.where(F.col("attempted_type") == attempted_type)
    return own.groupBy("attempted_type", "drawing_id").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "attempted_type", "drawing_id")


def run_counts(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count("*").alias("total"), F.count_if(F.col("exit_state") == "SUCCESS").alias("success"), F.count_if(F.col("exit_state") == "FAILURE").alias("failure"))


def top_types(refusals: DataFrame, limit: int = 10) -> DataFrame:
    return refusals.groupBy("attempted_type").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "attempted_type").limit(limit)


def slowest(runs: DataFrame, limit: int = 10) -> DataFrame:
    return runs.orderBy(F.desc_nulls_last("duration_ms"), "run_id").limit(limit)


def fires_by_drawing(fires: DataFrame, runs: DataFrame) -> DataFrame:
    return fires.join(runs.select("run_id", "drawing_id"), "run_id").groupBy("drawing_id").agg(F.count("*").alias("fires"))


def tag_sums(counts: DataFrame) -> DataFrame:
    return counts.groupBy("field", "tag").agg(F.sum("count").alias("total")).orderBy("field", "tag")


def stage_latency(events: DataFrame) -> DataFrame:
    """Milliseconds from each event of a run to its next; null after the last."""
    following = F.lead("timestamp").over(Window.partitionBy("run_id").orderBy("event_seq"))
    return events.withColumn("took_ms", F.timestamp_diff("MILLISECOND", F.col("timestamp"), following))


def show_run(w: Warehouse, run: str) -> dict[str, DataFrame] | None:
    """A run and all that was recorded for it; None if there is no such run."""
    own = lambda df: df.where(F.col("run_id") == run)
    head = own(w.runs()).limit(1)
    if head.isEmpty():
        return None
    return {"run": head, "events": own(w.read("stage_events")).orderBy("event_seq"), "refusals": own(w.read("refusals_log")), "fires": own(w.read("policy_fires")), "counts": own(w.counts()).orderBy("stage", "field", "tag")}


def as_table(df: DataFrame) -> list[str]:
    """Left-justified lines of a small result; nulls are empty."""
    rows = [tuple("" if v is None else str(v) for v in r) for r in df.toLocalIterator()]
    if not rows:
        return ["(no rows)"]
    widths = [max(len(c), *(len(r[i]) for r in rows)) for i, c in enumerate(df.columns)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)).rstrip()
    return [line(df.columns), line(["-" * w for w in widths]), *map(line, rows)]


def success_rate(runs: DataFrame, least: float = 0.8) -> DataFrame:
    """total, ok, rate and whether it reaches the least; without runs the rate is null and doesn't."""
    ok = F.col("exit_state") == "SUCCESS"
    counts = runs.agg(F.count("*").alias("total"), F.count_if(ok).alias("ok"))
    rate = F.try_divide("ok", "total")
    return counts.withColumn("rate", rate).withColumn("enough", F.coalesce(rate >= least, F.lit(False)))


def affected(marked: DataFrame, unknown: str) -> DataFrame:
    """run_id, affected: how many rows (run_id, tag) of each run carry the unknown mark; runs without any are left out."""
    return marked.where(F.col("tag") == unknown).groupBy("run_id").agg(F.count("*").alias("affected"))
