"""What the operators share: the shared scratch folder, tables that cut lineage, files beside Spark's."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, [\x20\x09-\x0D]: what bytes.split() splits at.
SPACE = " \t\n\x0b\x0c\r"

#: Scratch folders made so far and not deleted.
made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; set here only where unset and Spark runs in this one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and the executors share")
        root = f"file://{tempfile.mkdtemp(prefix='rillgraph-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's URI below the shared folder; it goes with sweep() or at the driver's end."""
    path = f"{shared_root(spark)}/rillgraph/{label}-{uuid.uuid4().hex}"
    made.append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def sweep(which: list[tuple[SparkSession, str]] | None = None) -> None:
    """Delete those scratch folders, or all. Only for callers that have written out what reads them."""
    for one in list(made if which is None else which):
        if one in made:
            made.remove(one)
            try:
                drop(*one)
            except Exception:  # noqa: BLE001  the session may have ended; the folder's owner clears it then
                pass


atexit.register(sweep)


def settle(spark: SparkSession) -> None:
    """Let the driver's cleaner delete the shuffle files of what is no longer used: they go when the driver's heap is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of an Arrow batch at most, about, where whole texts go to Python: a batch is held twice outside the heap.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have BATCH_BYTES at most, a row at least. Spark reads the setting when the caller runs the plan, so
    it can't be set back here."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark, spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def _bytes(spark: SparkSession, size: str) -> int:
    return int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size))


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI (file, hdfs, s3 and what else Arrow opens)."""
    return fs.FileSystem.from_uri(uri)


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, by built-in functions only; null: none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACE[1:], " " * 5)
    return F.array_remove(F.split(spaced, " "), "")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def rows(batches: Iterable[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[list[tuple]]:
    """Rows as tuples, in lists whose strings have about `limit` characters together (one row at least)."""
    held, chars = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 256):  # a few rows at a time become Python objects
            for row in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns), strict=True):
                held.append(row)
                chars += sum(len(x) for x in row if isinstance(x, (str, bytes)))
                if chars >= limit:
                    yield held
                    held, chars = [], 0
    if held:
        yield held
    del held
    trim()


def trim() -> None:
    """Give freed memory back to the system, as a worker does at a task's end."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: Bits of the filter in likely() at most: 8 MB, which is what its broadcast is bounded by.
FILTER_BITS = 1 << 26


def likely(df: DataFrame, key: Column, members: DataFrame) -> DataFrame:
    """Those rows of df whose key (long) is one of the members (one column), and a few others: the exact join that follows
    need not shuffle the rest. The filter has 32 bits for each member, within FILTER_BITS; when it is too full to tell, more rows stay.
    """
    hashed = members.select(F.xxhash64(F.col(members.columns[0])).alias("h"))
    bits = min(FILTER_BITS, max(1 << 15, 1 << (32 * hashed.count()).bit_length()))
    place = F.pmod("h", F.lit(bits))
    held = hashed.groupBy(F.floor(place / (1 << 15)).alias("k")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(1 << 15))).alias("b"))
    filled = np.zeros(bits // 8, np.uint8)
    for k, b in held.collect():
        filled[k << 12 : (k + 1) << 12] = np.frombuffer(b, np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(filled)

    @F.arrow_udf("boolean")
    def known(h: pa.Array) -> pa.Array:
        at = h.to_numpy(zero_copy_only=False) % bits
        return pa.array((shared.value[at >> 3] >> (at & 7) & 1).astype(bool))

    return df.filter(known(F.xxhash64(key)))
