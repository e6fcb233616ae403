"""Reading and writing recordings: blocked Parquet, NPY files, CSV; chunk sizes; the shared folder."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own, on one machine only (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="eventloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared folder and read it back, which cuts the lineage; the files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def suffix_number(name, separator: str = "_"):
    """The whole number after the last separator and before the first dot, for ordering files."""
    return F.substring_index(F.substring_index(name, ".", 1), separator, -1).try_cast("long")


def chunk_shape(shape: Sequence[int], itemsize: int, strategy: str = "balanced", least_bytes: float = 1e6) -> tuple[int, int, int]:
    """balanced: the smallest power-of-two cube of at least least_bytes; Z: full time; XY: full frames; each no larger than the shape."""
    z, x, y = shape
    side = 1
    size = {"balanced": lambda s: s**3, "Z": lambda s: z * s * s, "XY": lambda s: s * x * y}[strategy]
    while size(side) * itemsize < least_bytes and side < max(shape):
        side *= 2
    got = {"balanced": (side, side, side), "Z": (z, side, side), "XY": (side, x, y)}[strategy]
    return tuple(min(a, b) for a, b in zip(got, shape, strict=True))


def chunk_shape_by_mb(shape: Sequence[int], itemsize: int, mb: float) -> tuple[int, int, int]:
    """A chunk of about mb megabytes with the shape's proportions."""
    f = min(1.0, (mb * 1e6 / (math.prod(shape) * itemsize)) ** (1 / 3))
    return tuple(max(1, int(n * f)) for n in shape)


def save(voxels: DataFrame, path: str, overwrite: bool = False, block: int = 64) -> None:
    """Parquet, sorted and partitioned by blocks of frames so that slices of time are pruned; an existing path is an error unless overwrite."""
    voxels.withColumn("bz", F.floor(F.col("z") / block)).repartition("bz").sortWithinPartitions("z", "x", "y").write.partitionBy("bz").mode("overwrite" if overwrite else "errorifexists").parquet(path)


def load(spark: SparkSession, path: str, loc: str | None = None, z_slice: tuple[int, int] | None = None, block: int = 64) -> DataFrame:
    """By suffix: .npy files (or folders of them), .csv, else Parquet. A slice of frames is pushed to the scan."""
    if path.endswith((".npy", ".npy/")):
        out = spark.read.format("npy_volume").load(path)
    elif path.endswith(".csv"):
        out = spark.read.csv(path, header=True, inferSchema=True)
    elif path.endswith((".h5", ".hdf5", ".tdb", ".czi", ".tif", ".tiff")):
        raise NotImplementedError(f"{path}: this format needs a decoder that is not installed; convert it to Parquet or NPY")
    else:
        out = spark.read.parquet(path)
        if z_slice and "bz" in out.columns:
            out = out.where(F.col("bz").between(z_slice[0] // block, (z_slice[1] - 1) // block))
        out = out.drop("bz")
    if loc is not None:
        out = out.where(F.col("loc") == loc)
    return out.where((F.col("z") >= z_slice[0]) & (F.col("z") < z_slice[1])) if z_slice else out


def metadata(voxels: DataFrame) -> DataFrame:
    """One row: frames, width and height, from column statistics."""
    return voxels.agg(*((F.max(a) + 1).alias(n) for a, n in (("z", "frames"), ("x", "width"), ("y", "height"))))


class NpyVolume(DataSource):
    """Voxels of a 3-D .npy file, memory-mapped; one partition for each block of frames."""

    @classmethod
    def name(cls) -> str:
        return "npy_volume"

    def schema(self) -> str:
        return "z long, x long, y long, v double"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options["path"], int(self.options.get("frames", "64")))


class _NpyReader(DataSourceReader):
    def __init__(self, path: str, frames: int) -> None:
        self.path, self.frames = path, frames

    def partitions(self) -> list[InputPartition]:
        import numpy as np

        n = np.load(self.path, mmap_mode="r").shape[0]
        return [InputPartition((a, min(n, a + self.frames))) for a in range(0, n, self.frames)]

    def read(self, partition: InputPartition) -> Iterator:
        import numpy as np
        import pyarrow as pa

        a, b = partition.value
        data = np.load(self.path, mmap_mode="r")
        for z in range(a, b):
            x, y = (i.ravel() for i in np.indices(data.shape[1:]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), z)), pa.array(x), pa.array(y), pa.array(data[z].ravel().astype(float))], ["z", "x", "y", "v"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpyVolume)
