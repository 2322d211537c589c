"""What a user interface shows of documents and runs, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbmark.functions.text import iso_utc
from plumbmark.params import EXIT_STATES, EXTRAPOLATED, GROUNDED, INFERRED, UNKNOWN

#: Fixed badges of the marks, and colours of the object types.
BADGES = {GROUNDED: "🟢 ⊢ grounded", INFERRED: "🔵 ⊨ inferred", EXTRAPOLATED: "🟡 ⊬ extrapolated", UNKNOWN: "🔴 ⊥ unknown"}
COLORS = {
    "wall_structural": (40, 40, 200),
    "wall_wet": (40, 120, 200),
    "wall_dry": (80, 80, 220),
    "door": (220, 60, 60),
    "window": (60, 180, 60),
    "balcony_sash": (90, 200, 60),
    "inspection_hatch": (180, 120, 50),
    "dimension_text": (160, 60, 200),
    "room_label": (60, 160, 200),
    "space_polygon": (200, 200, 80),
}
OTHER_COLOR, REFUSED_COLOR = (100, 100, 100), (200, 0, 0)


def _lookup(values: dict, key: Column, other: Column) -> Column:
    out = other
    for k, v in values.items():
        out = F.when(key == k, F.lit(v) if isinstance(v, str) else F.array(*[F.lit(x) for x in v])).otherwise(out)
    return out


def badge(tag: Column) -> Column:
    """A mark's name for people; any other text stays as it is."""
    return _lookup(BADGES, tag, tag)


def object_grid(objects: DataFrame) -> DataFrame:
    """drawing_id and seven columns of text; an object without millimetres shows a dash."""
    tags = [badge(F.col(f"{f}_epistemic.tag")).alias(f"{f}_tag") for f in ("type", "geometry", "measurement")]
    mm = F.coalesce(F.col("measurement_mm").cast("string"), F.lit("—"))
    return objects.select("drawing_id", F.col("object_id").alias("id"), "type", *tags, mm.alias("measurement_mm"), F.col("review_status").alias("review"))


def draw_commands(docs: DataFrame) -> DataFrame:
    """drawing_id, z, shape, coords, color: refusals below, objects above, each in its list's order. Shapes with too few points are left out."""
    color = lambda rgb: F.array(*[F.lit(v) for v in rgb])
    below = docs.select("drawing_id", F.posexplode("refusals").alias("n", "r")).select("drawing_id", F.lit(0).alias("layer"), "n", F.lit("bbox").alias("shape"), F.col("r.region").alias("coords"), color(REFUSED_COLOR).alias("color"))
    above = docs.select("drawing_id", F.posexplode("objects").alias("n", "o")).select("drawing_id", F.lit(1).alias("layer"), "n", F.col("o.geometry.kind").alias("shape"), F.col("o.geometry.coords_px").alias("coords"), _lookup(COLORS, F.col("o.type"), color(OTHER_COLOR)).alias("color"))
    least = F.when(F.col("shape") == "polygon", 3).otherwise(2)
    return below.unionByName(above).where(F.size("coords") >= least).select("drawing_id", F.struct("layer", "n").alias("z"), "shape", "coords", "color")


def run_label(drawing: Column, started: Column, state: Column, run: Column) -> Column:
    """One line to pick a run by."""
    return F.concat(F.concat_ws("  |  ", drawing.cast("string"), iso_utc(started), state), F.lit("  ("), F.substring(run, 1, 8), F.lit(")"))


def overview(runs: DataFrame, refusals: DataFrame, fires: DataFrame) -> DataFrame:
    """One row: runs, those that succeeded and failed, refusals and policy fires."""
    kinds = [runs.select(F.col("exit_state").alias("kind")), refusals.select(F.lit("refusal").alias("kind")), fires.select(F.lit("fire").alias("kind"))]
    at = lambda *names: F.count_if(F.col("kind").isin(*names))
    every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return every.agg(at(*EXIT_STATES).alias("total"), at("SUCCESS").alias("success"), at("FAILURE").alias("failure"), at("refusal").alias("refusals"), at("fire").alias("policy_fires"))


def default_index(options: Column, name: str) -> Column:
    """Where a name stands in a list, from 0; without it 1 if there are two, else 0."""
    at = F.array_position(options, name)
    return F.when(at > 0, at - 1).when(F.size(options) > 1, 1).otherwise(0).cast("long")


def class_histogram(texts: DataFrame, key: str) -> DataFrame:
    """How many texts (key, classification) of each class, 0 where there are none."""
    at = lambda k: F.count_if(F.col("classification") == k).alias(k)
    return texts.groupBy(key).agg(at("dimension_text"), at("room_label"), at("other"))


def diagnostic(**reasons: Column) -> Column:
    """The names of the conditions that hold, underscores as spaces, joined by bars; empty if none does."""
    return F.concat_ws(" | ", F.array_compact(F.array(*[F.when(c, name.replace("_", " ")) for name, c in reasons.items()])))
