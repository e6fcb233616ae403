"""Patches of a recording for models: padded grids, loading, batches, augmentation and normalisation; all by joins on coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A fixed odd multiplier, near 2^32 over the golden ratio: spreads item numbers over 32 bits, in any SQL alike.
_SPREAD = 2654435761


def padded_grid(spark: SparkSession, frames: int, width: int, height: int, before: int, after: int, size: tuple[int, int], stride: tuple[int, int], every: int = 1) -> DataFrame:
    """(item, z, z0, z1, x0, x1, y0, y1): patches of before + 1 + after frames about each `every`th frame that cover whole images. Windows
    may pass the first and last frame and the right and lower sides; what lies outside is for `cells` to pad."""
    nx, ny = (max(1, -(-(n - s) // d) + 1) for n, s, d in ((width, size[0], stride[0]), (height, size[1], stride[1])))
    z = F.floor(F.col("id") / (nx * ny)) * every
    out = spark.range(-(-frames // every) * nx * ny).select(F.col("id").alias("item"), z.alias("z"), (F.floor(F.col("id") / ny) % nx * stride[0]).alias("x0"), (F.col("id") % ny * stride[1]).alias("y0"))
    return out.select("item", "z", (F.col("z") - before).alias("z0"), (F.col("z") + after + 1).alias("z1"), "x0", (F.col("x0") + size[0]).alias("x1"), "y0", (F.col("y0") + size[1]).alias("y1"))


def padded(at: Column, n: int, how: str) -> Column:
    """The coordinate in 0 .. n - 1 that stands for `at`: the nearest (`edge`), or mirrored with its edge repeated (`symmetric`)."""
    if how == "edge":
        return F.greatest(F.lit(0), F.least(at, F.lit(n - 1)))
    if how == "symmetric":
        turn = F.pmod(at, F.lit(2 * n))
        return F.when(turn < n, turn).otherwise(2 * n - 1 - turn)
    raise ValueError(f"unknown padding {how}")


def cells(voxels: DataFrame, index: DataFrame, shape: tuple[int, int, int], pad: str | None = None) -> DataFrame:
    """(item, dz, dx, dy, v): the voxels of each patch, by their place in it. Voxels that are not there are 0; without a padding neither are
    those outside the recording. The join is on the three coordinates, so it is as even as the voxels."""
    out = index
    for a in "zxy":
        out = out.select("*", F.posexplode(F.sequence(F.col(f"{a}0").cast("long"), F.col(f"{a}1").cast("long") - 1)).alias(f"d{a}", a if a != "z" else "at"))
        out = out.drop("z").withColumnRenamed("at", "z") if a == "z" else out
    for a, n in zip("zxy", shape, strict=True):
        out = out.withColumn(a, padded(F.col(a), n, pad).cast("long")) if pad else out
    got = out.select("item", "dz", "dx", "dy", "z", "x", "y").join(voxels.select("z", "x", "y", "v"), ["z", "x", "y"], "left")
    return got.select("item", "dz", "dx", "dy", F.coalesce("v", F.lit(0.0)).alias("v"))


def batches(df: DataFrame, size: int, item: str = "item") -> DataFrame:
    """df with the number of its batch of `size` items; items are numbered without gaps."""
    return df.withColumn("batch", F.floor(F.col(item) / size))


def _dice(item: str, seed: int, faces: int) -> Column:
    return F.floor(F.pmod(F.col(item) * F.lit(_SPREAD) + F.lit(seed * 40503), F.lit(1 << 32)) / (1 << 12)) % faces


def augmentation(index: DataFrame, rotations: Sequence[int] = (0, 1, 2, 3), flips: Sequence[int] = (0, 1, 2), drop_every: int = 0, frames: int = 1, seed: int = 0) -> DataFrame:
    """index with a rotation (quarter turns), a flip (0 none, 1 first axis, 2 second axis) and, for one item in `drop_every`, a frame to
    leave out (-1: none), drawn by a hash of the item: the same on every run and layout."""
    pick = lambda values, k: F.get(F.array(*(F.lit(int(v)) for v in values)), _dice("item", seed + k, len(values)).cast("int"))
    dropped = F.when(_dice("item", seed + 2, drop_every) == 0, _dice("item", seed + 3, frames).cast("int")).otherwise(-1) if drop_every else F.lit(-1)
    return index.withColumns({"rotation": pick(rotations, 0), "flip": pick(flips, 1), "drop_frame": dropped})


def augment(df: DataFrame, size: int) -> DataFrame:
    """Cells of square patches of `size` with their augmentation (rotation, flip, drop_frame): turned against the clock, then flipped, and
    the frame that is left out set to 0."""
    last = size - 1
    x, y, r = F.col("dx"), F.col("dy"), F.col("rotation") % 4
    tx = F.when(r == 1, last - y).when(r == 2, last - x).when(r == 3, y).otherwise(x)
    ty = F.when(r == 1, x).when(r == 2, last - y).when(r == 3, last - x).otherwise(y)
    turned = df.select("item", "dz", tx.alias("dx"), ty.alias("dy"), F.when(F.col("dz") == F.col("drop_frame"), 0.0).otherwise(F.col("v")).alias("v"), "flip")
    return turned.select("item", "dz", F.when(F.col("flip") == 1, last - F.col("dx")).otherwise(F.col("dx")).alias("dx"), F.when(F.col("flip") == 2, last - F.col("dy")).otherwise(F.col("dy")).alias("dy"), "v")


def local_stats(df: DataFrame, by: str = "item") -> DataFrame:
    """(by, mean, std) of the cells; a spread of 0 counts as 1."""
    spread = F.stddev_pop("v")
    return df.groupBy(by).agg(F.avg("v").alias("mean"), F.when(spread > 0, spread).otherwise(1.0).alias("std"))


def normalized(df: DataFrame, stats: DataFrame, by: str = "item", inverse: bool = False) -> DataFrame:
    """v by the mean and spread of its patch or recording, or back again; where there are none, both are 1."""
    mean, std = F.coalesce("mean", F.lit(1.0)), F.coalesce("std", F.lit(1.0))
    v = F.col("v") * std + mean if inverse else (F.col("v") - mean) / std
    return df.join(stats.select(by, "mean", "std"), by, "left").withColumn("v", v).drop("mean", "std")
