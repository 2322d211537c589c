"""Tables written between steps, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir; where that isn't set, as in tests, below an own one. It goes when the session ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        base = tempfile.mkdtemp(prefix="plumbmark-")
        spark.conf.set("spark.checkpoint.dir", base)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/plumbmark-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()


#: Shuffle files of an execution go when it ends, and don't wait for the driver's garbage collector.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, path: str, name: str) -> DataFrame:
    """df written as a table and read again: its lineage ends here, and lost executors don't bring it back to work."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(f"{path}/{name}")
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")


def drop(spark: SparkSession, path: str, *names: str) -> None:
    """Removes kept tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for name in names:
        folder_ = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        folder_.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder_, True)


#: Rows of an Arrow batch at most: whole texts travel in batches, in the JVM and in the worker.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Lets the session send no larger batches to its workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores after it as long as df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
