"""Plane geometry as column expressions. A segment is a struct (x1, y1, x2, y2), a point a struct (x, y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def dx(s: Column) -> Column:
    return s["x2"] - s["x1"]


def dy(s: Column) -> Column:
    return s["y2"] - s["y1"]


def length(s: Column) -> Column:
    return F.sqrt(dx(s) * dx(s) + dy(s) * dy(s))


def angle(s: Column) -> Column:
    """Direction in [0, 180) degrees."""
    return F.pmod(F.degrees(F.atan2(dy(s), dx(s))), F.lit(180.0))


def angle_gap(a: Column, b: Column) -> Column:
    return F.least(F.abs(a - b), F.lit(180.0) - F.abs(a - b))


def mid_x(s: Column) -> Column:
    return (s["x1"] + s["x2"]) / 2


def mid_y(s: Column) -> Column:
    return (s["y1"] + s["y2"]) / 2


def from_line(x: Column, y: Column, s: Column) -> Column:
    """Distance from the infinite line through s; 0 from a segment without length."""
    area = F.abs(dy(s) * x - dx(s) * y + s["x2"] * s["y1"] - s["y2"] * s["x1"])
    return F.coalesce(F.try_divide(area, length(s)), F.lit(0.0))


def from_segment(x: Column, y: Column, s: Column) -> Column:
    """Distance from the segment; null from one without length."""
    along = F.try_divide((x - s["x1"]) * dx(s) + (y - s["y1"]) * dy(s), dx(s) * dx(s) + dy(s) * dy(s))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    ex, ey = s["x1"] + t * dx(s) - x, s["y1"] + t * dy(s) - y
    return F.when(along.isNotNull(), F.sqrt(ex * ex + ey * ey))


def normal_gap(a: Column, b: Column) -> Column:
    """Distance of the midpoints along the normal of a; null if a has no length."""
    across = F.abs((mid_y(b) - mid_y(a)) * dx(a) - (mid_x(b) - mid_x(a)) * dy(a))
    return F.try_divide(across, length(a))


def overlap(a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """How much of the shorter segment lies beside the longer (a, if they tie), from 0 to 1. Null if either has no length.

    The lengths are passed in, as columns of their own, so that the join's condition stays small enough to be compiled.
    """

    def shared(s: Column, size: Column, t: Column) -> Column:
        at = [((t[f"x{k}"] - s["x1"]) * dx(s) + (t[f"y{k}"] - s["y1"]) * dy(s)) / F.nullif(size, F.lit(0.0)) for k in (1, 2)]
        return F.least(F.greatest(*at), size) - F.greatest(F.least(*at), F.lit(0.0))

    return F.greatest(F.when(size_b > size_a, shared(b, size_b, a) / F.nullif(size_a, F.lit(0.0))).otherwise(shared(a, size_a, b) / F.nullif(size_b, F.lit(0.0))), F.lit(0.0))


def inside(x: Column, y: Column, points: Column) -> Column:
    """Whether a point lies in a polygon, by the parity of the edges that a ray to the right crosses."""
    n = F.size(points)

    def crosses(p: Column, i: Column) -> Column:
        q = F.element_at(points, F.when(i == 0, n).otherwise(i).cast("int"))
        spans = (p["y"] > y) != (q["y"] > y)
        at = (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"] + F.lit(1e-9)) + p["x"]
        return spans & F.when(spans, x < at).otherwise(False)

    return F.size(F.filter(F.transform(points, crosses), lambda c: c)) % 2 == 1


def in_box(x: Column, y: Column, s: Column) -> Column:
    """Whether a point lies in the box of two corners, edges included."""
    return x.between(F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"])) & y.between(F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"]))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def centroid(points: Column) -> Column:
    """Mean of the points as (x, y); (0, 0) of none."""
    n = F.greatest(F.size(points), F.lit(1))
    return F.struct((_sum(F.transform(points, lambda p: p["x"])) / n).alias("x"), (_sum(F.transform(points, lambda p: p["y"])) / n).alias("y"))


def box(points: Column) -> Column:
    """Corners (x1, y1, x2, y2) of the points' bounding box; zeros of none."""
    end = lambda f, c: F.coalesce(f(F.transform(points, lambda p: p[c])), F.lit(0.0))
    return F.struct(end(F.array_min, "x").alias("x1"), end(F.array_min, "y").alias("y1"), end(F.array_max, "x").alias("x2"), end(F.array_max, "y").alias("y2"))


def path_length(points: Column) -> Column:
    """Length of a polyline; 0 of fewer than two points."""
    rest = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    step = lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))
    return _sum(F.filter(F.zip_with(points, rest, step), lambda v: v.isNotNull()))


def to_mm(kind: Column, pixels: Column, px_per_mm: Column) -> Column:
    """Millimetres from pixels: twice the radius of a door, an area by the squared scale, lengths else. Null without a scale."""
    scaled = F.try_divide(pixels, px_per_mm)
    return F.when(kind == "door", 2 * scaled).when(kind == "space_polygon", F.try_divide(scaled, px_per_mm)).otherwise(scaled)
