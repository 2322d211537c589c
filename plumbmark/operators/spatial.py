"""Spatial joins. All are keyed by drawing_id, so one call takes any number of drawings.

Lines that may pair have directions within a few degrees, so the pair join also has a bin of directions as a key: one side
is copied to the bin before and after its own. Within a drawing that leaves a few of 60 bins to compare.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbmark.functions import geometry as G
from plumbmark.operators import matching
from plumbmark.params import DEFAULT, Params

SEG = "struct<x1:double,y1:double,x2:double,y2:double>"


def segment(x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    return F.struct(F.col(x1).cast("double").alias("x1"), F.col(y1).cast("double").alias("y1"), F.col(x2).cast("double").alias("x2"), F.col(y2).cast("double").alias("y2"))


def _binned(lines: DataFrame, idx: str, degrees: float) -> DataFrame:
    own = lines.select("drawing_id", F.col(idx).alias("idx"), segment().alias("s"))
    own = own.withColumn("angle", G.angle(F.col("s")))
    own = own.withColumn("size", G.length(F.col("s")))
    return own.withColumn("bin", F.least(F.floor(F.col("angle") / degrees), F.lit(int(180 // degrees) - 1)).cast("int"))


def _near_directions(lines: DataFrame, idx: str, degrees: float) -> DataFrame:
    """All ordered pairs (a, b) of different lines of a drawing whose directions differ by at most degrees."""
    bins = int(180 // degrees)
    left = _binned(lines, idx, degrees)
    right = left.select("drawing_id", F.col("idx").alias("idx_b"), F.col("s").alias("b"), F.col("angle").alias("angle_b"), F.col("size").alias("size_b"), F.explode(F.array_distinct(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: F.pmod(F.col("bin") + k, F.lit(bins))))).alias("bin"))
    pairs = left.select("drawing_id", F.col("idx").alias("idx_a"), F.col("s").alias("a"), F.col("angle").alias("angle_a"), F.col("size").alias("size_a"), "bin").join(right, ["drawing_id", "bin"])
    return pairs.where((F.col("idx_a") != F.col("idx_b")) & (G.angle_gap(F.col("angle_a"), F.col("angle_b")) <= degrees)).drop("bin")


def _cells(own: DataFrame, degrees: float, gap: float) -> DataFrame:
    """own with the cells (across, along) that a line may share with a partner, in the frame of its bin's middle direction.

    Faces that overlap have middles at most half their lengths apart along the wall, so across it at most gap and what the bin's
    angles turn that distance into. Each line takes half of both bounds to either side: partners' intervals meet in both axes.
    """
    turn = F.radians((F.col("bin") + 0.5) * degrees)
    mx, my, half = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, F.col("size") / 2
    reach = {"across": half * math.tan(math.radians(1.5 * degrees)) * 1.01 + gap / 2 + 1, "along": half / math.cos(math.radians(degrees)) + gap / 2 + 1}
    at = {"across": my * F.cos(turn) - mx * F.sin(turn), "along": mx * F.cos(turn) + my * F.sin(turn)}
    for axis, side in (("across", 4 * gap), ("along", 16 * gap)):
        first, last = F.floor((at[axis] - reach[axis]) / side), F.floor((at[axis] + reach[axis]) / side)
        own = own.withColumn(f"first_{axis}", first).withColumn(axis, F.explode(F.sequence(first, last)))
    return own


def wall_edges(lines: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Directed pairs of lines that may be the two faces of a wall: drawing_id, line_a, line_b, gap (of b's middle from a), overlap, length_a.

    Lines meet in a bin of directions and a cell of its frame, and count in the first cell they share. The sides are flat columns
    without nulls, which keeps the join's method small enough for the JIT; one side is dealt by the cells, so that dense drawings are spread.
    """
    ends, bins = ("x1", "y1", "x2", "y2"), int(180 // p.angle)
    own = _binned(lines, "line_idx", p.angle).where((F.col("size") > 0) & (F.col("size") < float("inf")))
    value = lambda c: F.coalesce(c, F.lit(0.0))
    own = own.select("drawing_id", "idx", "bin", *[value(F.col("s")[c]).alias(c) for c in ends], value(F.col("size")).alias("size"), value(F.col("angle")).alias("angle"))
    around = F.array_distinct(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: F.pmod(F.col("bin") + k, F.lit(bins))))
    keys = ["drawing_id", "bin", "across", "along"]
    side = lambda df, s: df.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c not in keys])
    left = side(_cells(own, p.angle, p.wall_gap[1]), "a").repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    right = side(_cells(own.withColumn("bin", F.explode(around)), p.angle, p.wall_gap[1]), "b")
    a, b = ({c: F.col(f"{c}_{s}") for c in (*ends, "size")} for s in "ab")
    once = [F.greatest(f"first_{axis}_a", f"first_{axis}_b") == F.col(axis) for axis in ("across", "along")]
    turn = G.angle_gap(F.col("angle_a"), F.col("angle_b"))
    mx, my = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    gap = F.abs((a["y2"] - a["y1"]) * mx - (a["x2"] - a["x1"]) * my + a["x2"] * a["y1"] - a["y2"] * a["x1"]) / a["size"]
    pairs = left.join(right, keys).where((F.col("idx_a") != F.col("idx_b")) & once[0] & once[1] & (turn <= p.angle) & gap.between(*p.wall_gap))
    found = pairs.withColumn("gap", gap).withColumn("overlap", G.overlap(a, b, a["size"], b["size"])).where(F.col("overlap") >= p.wall_overlap)
    return found.select("drawing_id", F.col("idx_a").alias("line_a"), F.col("idx_b").alias("line_b"), "gap", "overlap", F.col("size_a").alias("length_a"), F.col("size_b").alias("length_b"), turn.alias("angle_gap"))


def _matched(lines: DataFrame, idx: str, p: Params) -> DataFrame:
    """The lines that can be in a pair, as `matching` takes them."""
    own = _binned(lines, idx, p.angle)
    finite = [(F.abs(F.col("s")[c]) < float("inf")) for c in ("x1", "y1", "x2", "y2")]
    own = own.where(F.col("drawing_id").isNotNull() & F.col("idx").isNotNull() & finite[0] & finite[1] & finite[2] & finite[3] & (F.col("size") < float("inf")))
    return own.select("drawing_id", F.col("idx").cast("long").alias("idx"), "s.*", "angle", "size", "bin")


def walls(lines: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """drawing_id, wall_idx, s (the longer face), thickness, line_a, line_b: the `wall_edges` that are matched greedily, without making them all."""
    own = _matched(lines, "line_idx", p).where(F.col("size") > 0)
    kind = own.schema["drawing_id"].dataType.simpleString()
    schema = f"drawing_id {kind}, wall_idx int, x1 double, y1 double, x2 double, y2 double, thickness double, line_a long, line_b long, angle_gap double"
    found = own.groupBy("drawing_id").applyInArrow(lambda t: matching.walls(t, p), schema)
    return found.select("drawing_id", "wall_idx", segment().alias("s"), "thickness", "line_a", "line_b", "angle_gap")


def window_edges(segs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Pairs i < j of short lines that may be a window: drawing_id, seg_i, seg_j, gap, mid_x, mid_y and both segments."""
    pairs = _near_directions(segs, "seg_idx", p.angle).where("idx_a < idx_b")
    a, b = F.col("a"), F.col("b")
    found = pairs.withColumn("gap", G.normal_gap(a, b)).where(F.col("gap").between(*p.window_gap))
    return found.select("drawing_id", F.col("idx_a").alias("seg_i"), F.col("idx_b").alias("seg_j"), "gap", ((G.mid_x(a) + G.mid_x(b)) / 2).alias("mid_x"), ((G.mid_y(a) + G.mid_y(b)) / 2).alias("mid_y"), F.col("a").alias("i"), F.col("b").alias("j"))


def _beside(wall: DataFrame, x: Column, y: Column, slack: Column) -> Column:
    return G.from_segment(x, y, wall["s"]) < slack + wall["thickness"]


def near_wall(points: DataFrame, wall: DataFrame, x: str, y: str, slack: Column) -> DataFrame:
    """Semi-join: the points that some wall of their drawing is near."""
    return points.join(wall, (points["drawing_id"] == wall["drawing_id"]) & _beside(wall, points[x], points[y], slack), "left_semi")


def far_from_walls(points: DataFrame, wall: DataFrame, x: str, y: str, slack: Column) -> DataFrame:
    return points.join(wall, (points["drawing_id"] == wall["drawing_id"]) & _beside(wall, points[x], points[y], slack), "left_anti")


def windows(segs: DataFrame, wall: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """drawing_id, seg_i, seg_j, gap, accepted, i, j (their segments): of the `window_edges`, without making them all, the pairs on a wall, each line in one at most, and the pairs met off any wall, which are refused and stay free."""
    own = _matched(segs, "seg_idx", p)
    kind = own.schema["drawing_id"].dataType.simpleString()
    ends = [f"{c}_{k}" for k in "ij" for c in ("x1", "y1", "x2", "y2")]
    schema = f"drawing_id {kind}, seg_i long, seg_j long, gap double, accepted boolean, " + ", ".join(f"{c} double" for c in ends)
    beside = wall.select("drawing_id", "s.*", "thickness")
    found = own.groupBy("drawing_id").cogroup(beside.groupBy("drawing_id")).applyInArrow(lambda t, w: matching.windows(t, w, p), schema)
    return found.select("drawing_id", "seg_i", "seg_j", "gap", "accepted", *[segment(*[f"{c}_{k}" for c in ("x1", "y1", "x2", "y2")]).alias(k) for k in "ij"])


def label_contours(contours: DataFrame, texts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Large closed contours with the first room label, in the order of recognition, whose middle lies inside; null without one."""
    big = contours.where((F.col("area_px") >= p.space_area) & (F.size("points") >= 4))
    labels = texts.where((F.col("classification") == "room_label") & (F.size("quad") > 0)).select("drawing_id", "text_idx", "text", G.centroid(F.col("quad")).alias("c"))
    held = (big["drawing_id"] == labels["drawing_id"]) & G.inside(labels["c.x"], labels["c.y"], big["points"])
    first = big.join(labels, held).groupBy(big["drawing_id"], "contour_idx").agg(F.min_by("text", "text_idx").alias("label"))
    return big.join(first, ["drawing_id", "contour_idx"], "left")
