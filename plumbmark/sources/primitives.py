"""Detected primitives: saved tables of them, and detectors that are plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_POINTS = "array<struct<x:double,y:double>>"
_ENDS = "x1 double, y1 double, x2 double, y2 double"
#: Tables that trust.analyse takes.
SCHEMAS = {
    "drawings": "drawing_id string, width int, height int",
    "lines": f"drawing_id string, line_idx int, {_ENDS}",
    "short_segs": f"drawing_id string, seg_idx int, {_ENDS}",
    "circles": "drawing_id string, circle_idx int, cx double, cy double, r double",
    "contours": f"drawing_id string, contour_idx int, points {_POINTS}, area_px double, closed boolean",
    "texts": f"drawing_id string, text_idx int, text string, quad {_POINTS}, char_conf double",
}


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables saved as Parquet below a path; one that isn't there is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    found = {}
    for name, schema in SCHEMAS.items():
        at = hadoop(f"{path.rstrip('/')}/{name}")
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        found[name] = spark.read.schema(schema).parquet(at.toString()) if there else spark.createDataFrame([], schema)
    return found


def save(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("append").parquet(f"{path.rstrip('/')}/{name}")


def detect(images: DataFrame, table: str, make: Callable[[], Callable[..., list[tuple]]], least_height: int = 1) -> DataFrame:
    """The rows of a table that a detector finds in images (drawing_id, width, height, channels, data), and `diagnostic`.

    make() is called once a worker's task and returns detect(width, height, channels, data), which returns rows without the drawing
    and the number. An image without pixels, too low, or on which the detector fails is one row that says so and nothing else.
    """
    columns = [c.split()[0] for c in SCHEMAS[table].split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = None
        for batch in batches:
            out = []
            for image in batch.itertuples(index=False):
                why, found = None, []
                if not image.data or image.width <= 0:
                    why = "empty input image"
                elif image.height < least_height:
                    why = f"image too small (h={image.height}<{least_height})"
                else:
                    try:
                        run = run or make()
                        found = run(image.width, image.height, image.channels, image.data)
                    except Exception as error:  # a bad image must not end the whole job
                        why = f"{type(error).__name__}: {error}"
                if why:
                    out.append((image.drawing_id, *[None] * (len(columns) - 1), why))
                out += [(image.drawing_id, n, *row, None) for n, row in enumerate(found)]
            yield pd.DataFrame(out, columns=[*columns, "diagnostic"], dtype=object)

    own = images.select("drawing_id", "width", "height", "channels", "data")
    return own.mapInPandas(rows, SCHEMAS[table] + ", diagnostic string")
