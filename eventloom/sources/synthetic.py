"""Synthetic signals, event tables and volumes. Every row follows from its key and the seed alone, so reruns and lost tasks give the same rows."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def plateau(t: np.ndarray, frequency: float, amplitude: float, level: float) -> np.ndarray:
    return level + np.cos(2 * np.pi * frequency * t) * amplitude


def leak(x: float, k: float, exponent: float, reduce: float = 1.0) -> float:
    """What a leaky integrator loses in a step."""
    return -k * max(x, 0.0) ** exponent * reduce


def richards_rise(t: float, a: float = 0.0, k: float = 1.0, b: float = 1.0, c: float = 1.0, v: float = 1.0, m: float = 0.0) -> float:
    q = float(np.exp(-b * (t - m)))
    return (k - a) * b * q / (v * (c + q) ** (1 / v + 1))


def burst(seed: int, length: int = 100, noise: float = 0.01, rise: float = 1.0, hold: tuple[int, int] = (3, 12), k: float = 0.1, exponent: float = 1.0, wobble: float = 0.02, frequency: float = 0.1) -> np.ndarray:
    """A calcium-like burst: rest, a rise by Richards' curve, an oscillating plateau, and a leaky decay, with Gaussian noise."""
    rng = np.random.default_rng(seed)
    start, stay = int(rng.integers(2, max(3, length // 4))), int(rng.integers(*hold))
    x, phase, since, out = 0.0, "rest", 0, []
    for t in range(length):
        if phase == "rest" and t >= start:
            phase, since = "rise", t
        elif phase == "rise" and t - since > 8:
            phase, since = "plateau", t
        elif phase == "plateau" and t - since >= stay:
            phase, since = "decay", t
        if phase == "rise":
            x += richards_rise(t - since, k=rise, m=4)
        elif phase == "decay":
            x += leak(x, k, exponent)
        level = float(plateau(np.array(t - since), frequency, wobble, x)) if phase == "plateau" else x
        out.append(level + noise * rng.standard_normal())
    return np.array(out)


def signals(spark: SparkSession, n: int, seed: int = 0, least: int = 0, **options) -> DataFrame:
    """(id, trace): n bursts, without those shorter than `least` active samples."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            made = [burst(seed * 1_000_003 + int(i), **options) for i in pdf["id"]]
            keep = [len(x[x > 0.1]) >= least for x in made]
            yield pd.DataFrame({"id": pdf["id"][keep], "trace": [x.tolist() for x, k in zip(made, keep, strict=True) if k]})

    return spark.range(n).mapInPandas(run, "id long, trace array<double>")


def mixed(spark: SparkSession, n: int, ratios: Sequence[float]) -> DataFrame:
    """(id, population): the last ratio takes what is left; shuffled by a hash of the id."""
    edges = np.cumsum([int(n * r) for r in ratios[:-1]]).tolist()
    kind = F.lit(len(ratios) - 1)
    for k, e in reversed(list(enumerate(edges))):
        kind = F.when(F.col("id") < e, k).otherwise(kind)
    return spark.range(n).withColumn("population", kind).orderBy(F.xxhash64("id"))


def dummy_events(spark: SparkSession, n: int = 25, length: int = 12, ragged: bool = True, groups: int = 1, clusters: int = 1, subjects: int = 1, z_range: tuple[int, int] = (0, 10_000), seed: int = 0) -> DataFrame:
    """An events table with random traces, labels and frames."""
    pick = lambda k, salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(k))
    size = (2 + pick(2 * length - 2, "n")).cast("int") if ragged else F.lit(length)
    unit = lambda i: F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    df = spark.range(n).withColumn("dz", size).withColumn("trace", F.transform(F.sequence(F.lit(1), size), unit))
    df = df.withColumns({"group": pick(groups, "g"), "cluster": pick(clusters, "c"), "subject_id": pick(subjects, "s")})
    return df.withColumn("z0", (z_range[0] + pick(z_range[1] - z_range[0], "z")).cast("int")).withColumn("z1", F.col("z0") + F.col("dz")).withColumnRenamed("id", "event_key")


def place(df: DataFrame, stimulus: str = "t", jitter: int = 0, offset: int | str = 0, key: str = "event_key", trace: str = "trace") -> DataFrame:
    """z0 and z1 about a stimulus with jitter and an offset; offset "max" puts the trace's peak on the stimulus."""
    shift = F.array_position(trace, F.array_max(trace)) - 1 if offset == "max" else F.lit(int(offset))
    noise = F.pmod(F.xxhash64(key), F.lit(2 * jitter + 1)) - jitter if jitter else F.lit(0)
    return df.withColumn("z0", F.col(stimulus) - shift + noise).withColumn("z1", F.col("z0") + F.size(trace))


def cells(spark: SparkSession, shape: Sequence[int], size: Sequence[int], gap: int = 0) -> DataFrame:
    """(cell, z0, x0, y0) of a grid of cells that fit the shape, `gap` frames apart."""
    axes = [F.explode(F.sequence(F.lit(0), F.lit(n - s), F.lit(s + (gap if k == 0 else 0)))) for k, (n, s) in enumerate(zip(shape, size, strict=True))]
    out = spark.range(1).select(axes[0].alias("z0")).select("z0", axes[1].alias("x0")).select("z0", "x0", axes[2].alias("y0"))
    return out.withColumn("cell", (F.col("z0") * shape[1] + F.col("x0")).cast("long") * shape[2] + F.col("y0"))


def blob(rng: np.random.Generator, size: Sequence[int], cells_: int) -> list[tuple[int, ...]]:
    """A random connected set of voxels in a box, grown face by face from its middle."""
    start = tuple(s // 2 for s in size)
    have, edge = {start}, [start]
    steps = [s for k in range(3) for s in (tuple(int(i == k) for i in range(3)), tuple(-int(i == k) for i in range(3)))]
    while edge and len(have) < cells_:
        p = edge[rng.integers(len(edge))]
        near = (tuple(a + b for a, b in zip(p, s, strict=True)) for s in steps)
        free = [q for q in near if q not in have and all(1 <= c < n - 1 or n < 3 for c, n in zip(q, size, strict=True))]
        if not free:
            edge.remove(p)
            continue
        q = free[rng.integers(len(free))]
        have.add(q)
        edge.append(q)
    return sorted(have)


def simulate_volume(spark: SparkSession, shape: Sequence[int] = (50, 100, 100), size: Sequence[int] = (10, 20, 20), probability: float = 0.5, voxels: int = 60, seed: int = 0) -> DataFrame:
    """(event_id, z, x, y): at most one blob in each cell, with empty voxels all round, so that blobs never touch."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for cell, z0, x0, y0 in pdf[["cell", "z0", "x0", "y0"]].itertuples(index=False):
                rng = np.random.default_rng((seed, int(cell)))
                if rng.random() < probability:
                    out += [(int(cell) + 1, z0 + z, x0 + x, y0 + y) for z, x, y in blob(rng, size, voxels)]
            yield pd.DataFrame(out, columns=["event_id", "z", "x", "y"]).astype("int64")

    return cells(spark, shape, size).mapInPandas(run, "event_id long, z long, x long, y long")


def recording_of(drawn: DataFrame, shape: Sequence[int], background: float = 1.0, intensity: float = 2.0, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """(z, x, y, v): a whole recording of a background with the drawn voxels on it, each event as bright as its hash says (half to one and a
    half times `intensity`), and noise that is nearly Gaussian: the sum of four hashes."""
    z, x, y = shape
    every = drawn.sparkSession.range(z * x * y).select(F.floor(F.col("id") / (x * y)).alias("z"), F.floor(F.col("id") / y % x).cast("long").alias("x"), (F.col("id") % y).alias("y"))
    unit = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 30)) / float(1 << 30)
    bright = drawn.select("z", "x", "y", (intensity * (0.5 + unit("event_id", F.lit(seed)))).alias("b"))
    noisy = sum((unit("z", "x", "y", F.lit(seed), F.lit(k)) - 0.5 for k in range(4)), F.lit(0.0)) * (noise * 3**0.5)
    return every.join(bright, ["z", "x", "y"], "left").select("z", "x", "y", (background + F.coalesce("b", F.lit(0.0)) + noisy).alias("v"))


def incidences(frames: int, distance: int, gap: int, seed: int = 0) -> list[int]:
    """A walk of stimulus frames: each within `distance` frames of the earliest allowed, the next allowed `gap` frames later."""
    rng, out, z = np.random.default_rng(seed), [], 0
    while z < frames:
        out.append(int(rng.integers(z, z + distance)))
        z = out[-1] + gap
    return out


def experiment_grid(spark: SparkSession, parameters: Mapping[str, Sequence], replicates: int) -> DataFrame:
    """One row for each combination of parameters and each replicate."""
    names = list(parameters)
    rows = [(*c, r) for c in itertools.product(*parameters.values()) for r in range(replicates)]
    return spark.createDataFrame(rows, [*names, "replicate"])
