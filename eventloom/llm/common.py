"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark then removes the shuffle files of a query at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Links up to so many are broadcast; more are shuffled.
_FEW = 10_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, one of our own, on one machine only (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="eventloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scan_files(df: DataFrame, each: int = 8 << 20) -> int:
    """How many files of about `each` bytes df's input makes by Spark's own estimate; at least one for each core. Tables that are smaller
    than the input need no more files, however many partitions a shuffle has."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(df.sparkSession.sparkContext.defaultParallelism, min(1 << 20, -(-size // each)))


def materialize(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder, to at most `files` files, and read it back: this cuts the lineage, and a lost executor
    costs no recomputation.

    What the write has shuffled goes when it has ended, where Spark can do that, and the table when the driver's JVM ends.
    """
    spark = df.sparkSession
    df = df.coalesce(files) if files else df
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    known, before = spark.conf.isModifiable(_CLEANUP), spark.conf.get(_CLEANUP, None)
    try:
        if known:
            spark.conf.set(_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        if known and before is None:
            spark.conf.unset(_CLEANUP)
        elif known:
            spark.conf.set(_CLEANUP, before)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shuffled(df: DataFrame) -> DataFrame:
    """df, to be joined by a shuffle and never by a broadcast, which the driver builds in its own memory: Spark's estimates count neither the
    rows that an explode makes nor how far Parquet has compressed a table, so a broadcast may be many times the size that was allowed."""
    return df.hint("merge")


def give_back() -> None:
    """Return the memory that a Python worker has freed to the system: a worker outlives its tasks, and a heap does not shrink by itself."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def connected_components(edges: DataFrame, max_rounds: int = 60, files: int | None = None) -> DataFrame:
    """(node, root) for every node in edges (u, v); root is the component's smallest node.

    Alternating large-star and small-star rounds over DataFrames: minima are aggregated on the map side, and each
    round's links are written to the shared folder. The join of a hub's links with its minimum meets in one task, row by row, unless
    adaptive execution splits it. Nothing but a count
    and a checksum reaches the driver, and minima where there are at most _FEW links. Self links and repeated links are allowed; an empty input gives an empty result.
    """
    links = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links", files)
    seen, n = None, links.count()
    for _ in range(max_rounds):
        dealt = F.broadcast if n <= _FEW else shuffled
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(dealt(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(dealt(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        was, links = links, materialize(small, "links", files)
        discard(was)
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if tuple(now) == seen:
            break
        seen, n = tuple(now), now[0]
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
