"""Files of drawings as rows: what can't be read is a row with an error, not an exception."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbmark.functions.text import stem

FORMATS = {"png": "png", "jpg": "jpg", "jpeg": "jpg", "pdf": "pdf"}


def ingest(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    """drawing_id, path, source_format, length, error of the files below a path; contents are read only if asked for. Empty files are left out by the reader.

    A path that isn't there is one row with an error.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not any(c in path for c in "*?[{") and not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        rows = spark.range(1).select(stem(F.lit(path)).alias("drawing_id"), F.lit(path).alias("path"), F.lit(None).cast("string").alias("source_format"), F.lit(None).cast("long").alias("length"), F.lit(f"file not found: {path}").alias("error"))
        return rows.withColumn("content", F.lit(None).cast("binary")) if with_content else rows
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), suffix)
    rows = files.withColumn("source_format", kind).withColumn("error", F.when(F.col("source_format").isNull(), F.concat(F.lit("unsupported: ."), suffix)))
    return rows.select(stem(F.col("path")).alias("drawing_id"), "path", "source_format", "length", "error", *(["content"] if with_content else []))


def images(spark: SparkSession, path: str) -> DataFrame:
    """drawing_id, width, height, channels, data (BGR bytes), error of PNG and JPEG files."""
    rows = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{png,PNG,jpg,JPG,jpeg,JPEG}").load(path).select("image.*")
    return rows.select(stem(F.col("origin")).alias("drawing_id"), "width", "height", F.col("nChannels").alias("channels"), "data", F.when(F.col("width") <= 0, "not an image").alias("error"))


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """One record a JSON file; files that can't be parsed are left out."""
    schema = "drawing_id string, source string, license string, sha256 string, fetched_at timestamp, original_uri string, usage string, domain string, _corrupt string"
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    # always true, but the reader refuses queries that need no column but the corrupt one, such as a count
    needed = F.coalesce(F.length("drawing_id") >= 0, F.lit(True))
    return rows.where(F.col("_corrupt").isNull() & needed).drop("_corrupt")


def write_provenance(rows: DataFrame, path: str) -> None:
    """One file a record, below its source, as `provenance` reads them."""
    rows.write.mode("append").partitionBy("source").option("maxRecordsPerFile", 1).json(path)


def write_summary(row: DataFrame, path: str) -> None:
    row.write.mode("overwrite").json(path)
