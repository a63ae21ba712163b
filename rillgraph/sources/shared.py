"""Tables in the folder that driver and executors share: where fixpoints keep their rounds."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables made so far and not deleted.
made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; set here only where unset and Spark runs in this one process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and the executors share")
        root = f"file://{tempfile.mkdtemp(prefix='rillgraph-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; it goes with drop() or at the driver's end."""
    path = f"{shared_root(spark)}/rillgraph/{label}-{uuid.uuid4().hex}"
    made.append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table, or a part of one, that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def sweep() -> None:
    """Delete all tables made so far. Only for callers that have written out what reads them."""
    while made:
        try:
            drop(*made.pop())
        except Exception:  # noqa: BLE001  the session may have ended; the folder's owner clears it then
            pass


atexit.register(sweep)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut, and lost executors cost no recomputation."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
