"""Synthetic drawings as vector primitives, in place of rasters: rectangles of double walls with doors, windows, labels and dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THICKNESS = 8.0
#: Fixed outlines (x1, y1, x2, y2), inner walls (share of the width), label texts and dimension texts of four layouts.
LAYOUTS = (
    ("apt_simple", (100, 100, 924, 668), (0.5,), ("거실", "침실"), ("824",)),
    ("apt_three_room", (80, 80, 944, 688), (0.33, 0.66), ("거실", "침실", "발코니"), ("4200", "2800")),
    ("office_open", (60, 60, 964, 708), (0.4,), ("Office", "Meeting"), ("7500",)),
    ("apt_kr_balcony", (100, 120, 924, 648), (0.8,), ("거실", "침실", "발코니"), ("5400",)),
)


def generate(spark: SparkSession, n: int = 12, seed: int = 1001) -> dict[str, DataFrame]:
    """drawings, lines, short_segs, circles, contours, texts of n drawings, the layouts in turn. Rows are made on the executors."""
    ids = spark.range(n).select(F.format_string("synth_%05d", F.col("id") + seed).alias("drawing_id"), (F.col("id") % len(LAYOUTS)).cast("int").alias("layout"), F.pmod(F.xxhash64(F.col("id") + seed), F.lit(9)).cast("double").alias("shift"))

    def per_layout(make) -> Column:
        out = F.lit(None)
        for k, layout in enumerate(LAYOUTS):
            out = F.when(F.col("layout") == k, make(*layout)).otherwise(out)
        return out

    d = F.col("shift")

    def seg(x1, y1, x2, y2) -> Column:
        return F.struct(*[(F.lit(float(v)) + d).alias(c) for v, c in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"), strict=True)])

    def faces(x1, y1, x2, y2) -> list[Column]:
        over = (THICKNESS, 0) if x1 == x2 else (0, THICKNESS)
        return [seg(x1, y1, x2, y2), seg(x1 + over[0], y1 + over[1], x2 + over[0], y2 + over[1])]

    def walls(name, box, inner, labels, dims) -> Column:
        x1, y1, x2, y2 = box
        outer = [(x1, y1, x2, y1), (x1, y2, x2, y2), (x1, y1, x1, y2), (x2, y1, x2, y2)]
        return F.array(*[f for w in outer + [(x1 + s * (x2 - x1), y1 + 20, x1 + s * (x2 - x1), y2 - 20) for s in inner] for f in faces(*w)])

    def windows(name, box, inner, labels, dims) -> Column:
        x1, y1, x2, y2 = box
        return F.array(*[s for k in (0.2, 0.7) for s in (seg(x1 + k * (x2 - x1), y1 + 1, x1 + k * (x2 - x1) + 60, y1 + 1), seg(x1 + k * (x2 - x1), y1 + 6, x1 + k * (x2 - x1) + 60, y1 + 6))])

    def arcs(name, box, inner, labels, dims) -> Column:
        x1, y1, x2, y2 = box
        on_wall = [F.struct((F.lit(float(x1 + s * (x2 - x1))) + d).alias("cx"), (F.lit((y1 + y2) / 2.0) + d).alias("cy"), F.lit(38.0).alias("r")) for s in inner]
        lost = F.struct((F.lit(float(x1 + 0.12 * (x2 - x1))) + d).alias("cx"), (F.lit((y1 + y2) / 2.0) + d).alias("cy"), F.lit(26.0).alias("r"))
        return F.array(*on_wall, lost)

    def point(x, y) -> Column:
        return F.struct((F.lit(float(x)) + d).alias("x"), (F.lit(float(y)) + d).alias("y"))

    def rooms(name, box, inner, labels, dims) -> Column:
        x1, y1, x2, y2 = box
        at = [0.0, *inner, 1.0]
        made = []
        for a, b in zip(at, at[1:], strict=False):
            left, right = x1 + a * (x2 - x1), x1 + b * (x2 - x1)
            made.append(F.struct(F.array(point(left, y1), point(right, y1), point(right, y2), point(left, y2)).alias("points"), F.lit(float((right - left) * (y2 - y1))).alias("area_px"), F.lit(True).alias("closed")))
        return F.array(*made)

    def texts(name, box, inner, labels, dims) -> Column:
        x1, y1, x2, y2 = box
        at = [0.0, *inner, 1.0]
        made = [(t, x1 + (a + b) / 2 * (x2 - x1), y1 + 60) for t, a, b in zip(labels, at, at[1:], strict=False)] + [(t, (x1 + x2) / 2, y1 - 20 - 20 * k) for k, t in enumerate(dims)]
        return F.array(*[F.struct(F.lit(t).alias("text"), F.array(point(x - 20, y - 8), point(x + 20, y - 8), point(x + 20, y + 8), point(x - 20, y + 8)).alias("quad"), F.lit(0.9).alias("char_conf")) for t, x, y in made])

    def rows(make, idx: str) -> DataFrame:
        return ids.select("drawing_id", F.posexplode(per_layout(make)).alias(idx, "v")).select("drawing_id", idx, "v.*")

    return {"drawings": ids.select("drawing_id", F.lit(1024).alias("width"), F.lit(768).alias("height")), "lines": rows(walls, "line_idx"), "short_segs": rows(windows, "seg_idx"), "circles": rows(arcs, "circle_idx"), "contours": rows(rooms, "contour_idx"), "texts": rows(texts, "text_idx")}
