"""Trust engine: scale anchor, objects with three marks each, taint-aware aggregates, policy constraints, the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbmark.functions import geometry as G
from plumbmark.functions import marks as M
from plumbmark.functions import text as X
from plumbmark.operators import spatial
from plumbmark.params import DEFAULT, EXTRAPOLATED, GROUNDED, INFERRED, UNKNOWN, Params
from plumbmark.session import settle, shared_folder

#: Fixed texts of the contract.
WINDOW_BASIS = "double line on a wall; no second view confirms a window"
SPACE_BASIS = "closed contour without a room label"
NO_ANCHOR = "no scale anchor; no millimetre value is given"


def scale_anchor(dims: DataFrame, lengths: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """drawing_id, detected, px_per_mm, agreeing from dims (drawing_id, mm) and lengths (drawing_id, px).

    Ratios are sorted; the seed is the smallest with another within the tolerance of itself, which its neighbours in the order
    decide, so no ratio is compared with all others. The scale is the mean of the ratios that agree with the seed.
    """
    good = dims.where("mm > 0").join(lengths.where(F.col("px") > p.anchor_length), "drawing_id")
    ratios = good.select("drawing_id", (F.col("px") / F.col("mm")).alias("ratio"))
    order = Window.partitionBy("drawing_id").orderBy("ratio")
    around = ratios.withColumn("before", F.lag("ratio").over(order)).withColumn("after", F.lead("ratio").over(order))
    near = lambda other: F.abs(F.col(other) - F.col("ratio")) / F.col("ratio") <= p.anchor_tolerance
    seeds = around.where(near("before") | near("after")).groupBy("drawing_id").agg(F.min("ratio").alias("seed"))
    agree = ratios.join(seeds, "drawing_id").where(F.abs(F.col("ratio") - F.col("seed")) / F.col("seed") <= p.anchor_tolerance)
    return agree.groupBy("drawing_id").agg(F.lit(True).alias("detected"), F.avg("ratio").alias("px_per_mm"), F.count("*").alias("agreeing"))


def anchors(drawings: DataFrame, texts: DataFrame, walls: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row a drawing: detected, px_per_mm, source, signal."""
    dims = texts.where(F.col("classification") == "dimension_text").select("drawing_id", F.expr("try_cast(text AS double)").alias("mm")).where("mm IS NOT NULL")
    lengths = walls.select("drawing_id", G.length(F.col("s")).alias("px"))
    usable = dims.groupBy("drawing_id").agg(F.lit(True).alias("has_dims")).join(lengths.groupBy("drawing_id").agg(F.max("px").alias("longest")), "drawing_id")
    found = drawings.select("drawing_id").join(scale_anchor(dims, lengths, p), "drawing_id", "left").join(usable, "drawing_id", "left")
    detected = F.coalesce("detected", F.lit(False))
    signal = (
        F.when(detected, F.concat(F.col("agreeing").cast("string"), F.lit(" ratios agree")))
        .when(F.col("has_dims").isNull(), "no dimension text with a wall")
        .when(F.col("longest") <= p.anchor_length, "no ratio could be formed")
        .otherwise("no ratios agree")
    )
    return found.select("drawing_id", detected.alias("detected"), "px_per_mm", F.when(detected, "dimension_text_match").alias("source"), signal.alias("signal"))


def _object(kind: str, idx: Column, type_mark: Column, geometry_mark: Column, shape: str, coords: Column, px: Column, review: Column) -> list[Column]:
    return [F.col("drawing_id"), F.lit(kind).alias("type"), idx.cast("long").alias("idx"), type_mark.alias("type_epistemic"), geometry_mark.alias("geometry_epistemic"), F.struct(F.lit(shape).alias("kind"), coords.alias("coords_px")).alias("geometry"), px.cast("double").alias("px"), review.alias("review_status")]


def _corners(s: Column) -> Column:
    return F.array(F.array(s["x1"], s["y1"]), F.array(s["x2"], s["y2"]))


def _path(points: Column) -> Column:
    return F.transform(points, lambda q: F.array(q["x"], q["y"]))


def objects(walls: DataFrame, doors: DataFrame, windows: DataFrame, spaces: DataFrame, dims: DataFrame, anchor: DataFrame) -> DataFrame:
    """All objects of all drawings, numbered walls, doors, windows, spaces, dimension texts, each in its own order."""
    seen = lambda source, signal: F.array(M.evidence(source, signal))
    auto = F.lit("auto_accepted")
    named = F.col("label").isNotNull()
    space_mark = F.when(named, M.grounded(seen("label_inside", "room label enclosed"))).otherwise(M.extrapolated(seen("contour", "closed contour"), F.lit(SPACE_BASIS)))
    kinds = [
        walls.select(*_object("wall_structural", F.col("wall_idx"), M.grounded(seen("line_pair", "parallel pair")), M.inferred(seen("line_pair", "end points of the longer line")), "polyline", _corners(F.col("s")), G.length(F.col("s")), auto)),
        doors.select(*_object("door", F.col("circle_idx"), M.inferred(seen("arc", "arc beside a wall")), M.inferred(seen("arc", "box of the arc")), "bbox", F.array(F.array(F.col("cx") - F.col("r"), F.col("cy") - F.col("r")), F.array(F.col("cx") + F.col("r"), F.col("cy") + F.col("r"))), F.col("r"), auto)),
        windows.select(*_object("window", F.col("win_idx"), M.extrapolated(seen("double_line", "pair on a wall"), F.lit(WINDOW_BASIS)), M.inferred(seen("double_line", "box of both lines")), "bbox", _corners(F.col("box")), F.col("span"), F.lit("needs_human"))),
        spaces.select(*_object("space_polygon", F.col("contour_idx"), space_mark, M.inferred(seen("contour", "polygon of the contour")), "polygon", _path(F.col("points")), F.col("area_px"), F.when(named, auto).otherwise("needs_human"))),
        dims.select(*_object("dimension_text", F.col("text_idx"), M.grounded(seen("text", "recognized number")), M.grounded(seen("text", "box of the text")), "bbox", _corners(G.box(F.col("quad"))), F.lit(None), auto)),
    ]
    every = kinds[0]
    for more in kinds[1:]:
        every = every.unionByName(more)
    rank = F.array_position(F.lit(["wall_structural", "door", "window", "space_polygon", "dimension_text"]), F.col("type"))
    number = F.row_number().over(Window.partitionBy("drawing_id").orderBy(rank, "idx"))
    scale = F.when(F.col("detected"), F.col("px_per_mm"))
    mm = F.when(F.col("type") != "dimension_text", G.to_mm(F.col("type"), F.col("px"), scale))
    measured = F.when(scale.isNotNull() & (F.col("type") != "dimension_text"), M.inferred(F.array(M.evidence("scale_anchor", "converted from pixels")))).otherwise(M.unknown(F.when(F.col("type") == "dimension_text", "a text has no measure of its own").otherwise(NO_ANCHOR)))
    return every.join(anchor.select("drawing_id", "detected", "px_per_mm"), "drawing_id", "left").select(
        "drawing_id", F.format_string("obj_%04d", number).alias("object_id"), "type", "idx", "type_epistemic", "geometry", "geometry_epistemic", mm.alias("measurement_mm"),
        F.when(F.col("type") == "space_polygon", "mm2").otherwise("mm").alias("measurement_unit"), measured.alias("measurement_epistemic"), "review_status", number.alias("number"),
    )


def count_taint(rows: DataFrame, keys: list[str], zero: DataFrame | None = None) -> DataFrame:
    """keys, value, tainted, tag, warning from rows (keys, tag). zero: all groups there are, so that empty ones count 0."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("value"), F.count_if(M.tainted(F.col("tag"))).alias("tainted"))
    if zero is not None:
        found = zero.join(found, keys, "left").na.fill(0, ["value", "tainted"])
    tag = F.when(F.col("value") == 0, GROUNDED).when(F.col("tainted") > 0, EXTRAPOLATED).otherwise(INFERRED)
    warning = F.when(F.col("tainted") > 0, F.format_string("%d of %d contributors tainted", "tainted", "value"))
    return found.withColumn("tag", tag).withColumn("warning", warning)


def sum_taint(rows: DataFrame, anchor: DataFrame) -> DataFrame:
    """drawing_id, value, tag, warning from rows (drawing_id, mm, tag) and one anchor row a drawing: null and unknown without a scale."""
    own = rows.where("mm IS NOT NULL").groupBy("drawing_id").agg(F.sum("mm").alias("total"), F.count("*").alias("n"), F.count_if(M.tainted(F.col("tag"))).alias("bad"))
    found = anchor.select("drawing_id", "detected").join(own, "drawing_id", "left")
    value = F.when(F.col("detected"), F.coalesce("total", F.lit(0.0)))
    tag = F.when(~F.col("detected"), UNKNOWN).when(F.col("n").isNull(), GROUNDED).when(F.col("bad") > 0, EXTRAPOLATED).otherwise(INFERRED)
    warning = F.when(~F.col("detected"), NO_ANCHOR).when(F.col("bad") > 0, F.format_string("%d of %d measurements tainted", "bad", "n"))
    return found.select("drawing_id", value.alias("value"), tag.alias("tag"), warning.alias("warning"))


def rollup_tags(objects_: DataFrame) -> DataFrame:
    """drawing_id, field, tag, count of the three marks; tags that don't occur have no row."""
    fields = ("type", "geometry", "measurement")
    each = objects_.select("drawing_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_epistemic.tag").alias("tag")) for f in fields])).alias("m"))
    return each.groupBy("drawing_id", "m.field", "m.tag").agg(F.count("*").alias("count"))


def aggregate_mark(tag: Column, warning: Column, signal: Column) -> Column:
    """The mark of an aggregate: what it was made from, and, if tainted or unknown, the warning as its basis or gap."""
    seen = F.array(M.evidence("compose", signal))
    return M.mark(tag, F.when(tag == UNKNOWN, F.array().cast(M.EVIDENCE)).otherwise(seen.cast(M.EVIDENCE)), F.when(tag == EXTRAPOLATED, warning), F.when(tag == UNKNOWN, warning))


def mark_violations(mark: Column) -> Column:
    """What a mark lacks: an extrapolated one its basis, an unknown one its gap; null if nothing."""
    return F.when((mark["tag"] == EXTRAPOLATED) & (F.coalesce(mark["basis"], F.lit("")) == ""), "basis").when((mark["tag"] == UNKNOWN) & (F.coalesce(mark["gap"], F.lit("")) == ""), "gap").when(~mark["tag"].isin(GROUNDED, INFERRED, EXTRAPOLATED, UNKNOWN), "tag")


def anchor_violation(detected: Column, px_per_mm: Column) -> Column:
    return F.when(detected != px_per_mm.isNotNull(), "anchor")


def measurement_violation(detected: Column, value: Column, tag: Column) -> Column:
    """Without an anchor no value may be given and no mark but unknown."""
    return F.when(~detected & value.isNotNull(), "value without anchor").when(~detected & (tag != UNKNOWN), "mark without anchor")


def violations(objects_: DataFrame, anchor: DataFrame) -> DataFrame:
    """drawing_id, object_id, rule for each breach of the contract."""
    rows = objects_.join(anchor.select("drawing_id", "detected", "px_per_mm"), "drawing_id")
    tests = [mark_violations(F.col(f"{f}_epistemic")) for f in ("type", "geometry", "measurement")] + [measurement_violation(F.col("detected"), F.col("measurement_mm"), F.col("measurement_epistemic.tag")), anchor_violation(F.col("detected"), F.col("px_per_mm"))]
    return rows.select("drawing_id", "object_id", F.explode(F.array_compact(F.array(*tests))).alias("rule"))


def aggregate_violations(docs: DataFrame) -> DataFrame:
    """drawing_id, field, rule for each breach of the contract in the aggregates of documents. Only the sum of lengths is bound to the anchor."""
    fields = ("wall_count", "door_count", "window_count", "measured_wall_length_mm")
    at = lambda f, part: F.col(f"aggregates.{f}.{part}")
    rows = [(f, mark_violations(at(f, "epistemic"))) for f in fields]
    rows.append((fields[-1], measurement_violation(F.col("scale_anchor.detected"), at(fields[-1], "value"), at(fields[-1], "epistemic.tag"))))
    found = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), rule.alias("rule")) for f, rule in rows]))
    return docs.select("drawing_id", found.alias("v")).where("v.rule IS NOT NULL").select("drawing_id", "v.*")


def strict(rows: DataFrame, violation: Column) -> DataFrame:
    """rows, failing at run time on the first violation."""
    return rows.where(F.when(violation.isNotNull(), F.raise_error(F.concat(F.lit("contract violation: "), violation)).cast("boolean")).otherwise(True))


def unknown_fields(json: Column, allowed: list[str]) -> Column:
    """Top-level names of a JSON text that the contract doesn't know."""
    return F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.lit(allowed) if allowed else F.array().cast("array<string>"))


def document(drawings: DataFrame, objects_: DataFrame, counts: DataFrame, total: DataFrame, refusals: DataFrame, anchor: DataFrame) -> DataFrame:
    """One nested row a drawing, lists in a fixed order."""
    listed = objects_.groupBy("drawing_id").agg(F.array_sort(F.collect_list(F.struct("number", "object_id", "type", "type_epistemic", "geometry", "geometry_epistemic", "measurement_mm", "measurement_epistemic", "review_status"))).alias("objects"))
    listed = listed.withColumn("objects", F.transform("objects", lambda o: o.dropFields("number")))
    aggregate = lambda what: F.struct(F.col("value").cast("double").alias("value"), aggregate_mark(F.col("tag"), F.col("warning"), F.lit(what)).alias("epistemic"), "warning")
    sums = counts.groupBy("drawing_id").agg(*[F.max_by(aggregate(f"count of {t} objects"), F.col("type") == t).alias(n) for t, n in (("wall_structural", "wall_count"), ("door", "door_count"), ("window", "window_count"))])
    sums = sums.join(total.select("drawing_id", aggregate("sum of wall lengths").alias("measured_wall_length_mm")), "drawing_id", "full")
    refused = refusals.groupBy("drawing_id").agg(F.array_sort(F.collect_list(F.struct("rank", "region", F.concat(F.lit("["), F.col("attempted_type"), F.lit("] "), F.col("why")).alias("why")))).alias("refusals"))
    refused = refused.withColumn("refusals", F.transform("refusals", lambda r: r.dropFields("rank")))
    scale = anchor.select("drawing_id", F.struct("detected", "px_per_mm", "source").alias("scale_anchor"))
    return drawings.select("drawing_id").join(listed, "drawing_id", "left").join(sums.select("drawing_id", F.struct("wall_count", "door_count", "window_count", "measured_wall_length_mm").alias("aggregates")), "drawing_id", "left").join(refused, "drawing_id", "left").join(scale, "drawing_id", "left")


def from_json(rows: DataFrame, schema) -> DataFrame:
    """Documents of a given schema from rows (json); the reverse of as_json."""
    return rows.select(F.from_json("json", schema).alias("d")).select("d.*")


def as_json(docs: DataFrame) -> DataFrame:
    """drawing_id, json: nulls are written, as they are part of the contract."""
    return docs.select("drawing_id", F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}).alias("json"))


def analyse(drawings: DataFrame, lines: DataFrame, short_segs: DataFrame, circles: DataFrame, contours: DataFrame, texts: DataFrame, p: Params = DEFAULT) -> dict[str, DataFrame]:
    """From detected primitives of any number of drawings to walls, objects, refusals, aggregates and documents.

    Walls, windows, the anchor and the objects are written below spark.checkpoint.dir and read again, as several results need them.
    """
    folder = shared_folder(drawings.sparkSession)
    texts = texts.where(X.strip(F.col("text")) != "").withColumn("classification", X.classify_text(F.col("text")))
    wall = settle(spatial.walls(lines, p), folder, "walls")
    slack = F.col("r") + p.door_slack
    doors = spatial.near_wall(circles, wall, "cx", "cy", slack)
    lost = spatial.far_from_walls(circles, wall, "cx", "cy", slack)
    matched = spatial.windows(short_segs, wall, p)
    ends = F.array(*[F.struct(F.col(f"{s}.x{k}").alias("x"), F.col(f"{s}.y{k}").alias("y")) for s in "ij" for k in "12"])
    span = F.sqrt(sum((((F.col(f"i.{c}2") + F.col(f"j.{c}2")) - (F.col(f"i.{c}1") + F.col(f"j.{c}1"))) / 2) ** 2 for c in "xy"))
    matched = settle(matched.withColumn("box", G.box(ends)).withColumn("span", span), folder, "windows")
    windows = matched.where("accepted").withColumn("win_idx", F.row_number().over(Window.partitionBy("drawing_id").orderBy("seg_i", "seg_j")))
    spaces = spatial.label_contours(contours, texts, p)
    anchor = settle(anchors(drawings, texts, wall, p), folder, "anchors")
    every = settle(objects(wall, doors, windows, spaces, texts.where(F.col("classification") == "dimension_text"), anchor), folder, "objects")
    arc_box = F.array(F.array(F.col("cx") - F.col("r"), F.col("cy") - F.col("r")), F.array(F.col("cx") + F.col("r"), F.col("cy") + F.col("r")))
    refusals = lost.select("drawing_id", F.struct(F.lit(0).alias("kind"), F.col("circle_idx").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("rank"), F.lit("door").alias("attempted_type"), arc_box.alias("region"), F.lit("arc without a wall beside it").alias("why")).unionByName(
        matched.where("NOT accepted").select("drawing_id", F.struct(F.lit(1).alias("kind"), F.col("seg_i").cast("long").alias("a"), F.col("seg_j").cast("long").alias("b")).alias("rank"), F.lit("window").alias("attempted_type"), _corners(F.col("box")).alias("region"), F.lit("parallel pair off any wall").alias("why"))
    )
    groups = drawings.select("drawing_id", F.explode(F.array(F.lit("wall_structural"), F.lit("door"), F.lit("window"))).alias("type"))
    counts = count_taint(every.select("drawing_id", "type", F.col("type_epistemic.tag").alias("tag")), ["drawing_id", "type"], groups)
    total = sum_taint(every.where("type = 'wall_structural'").select("drawing_id", F.col("measurement_mm").alias("mm"), F.col("measurement_epistemic.tag").alias("tag")), anchor)
    docs = document(drawings, every, counts, total, refusals, anchor)
    return {"texts": texts, "walls": wall, "doors": doors, "windows": windows, "spaces": spaces, "anchor": anchor, "objects": every, "refusals": refusals, "counts": counts, "total": total, "violations": violations(every, anchor), "aggregate_violations": aggregate_violations(docs), "document": docs}
