"""Windows, labels and models of experiments: what happens about stimuli, and what can be told from traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.operators.learn import train_and_predict


def windows(time_map: DataFrame, stimuli: DataFrame, frames: int, width: int, slide: int = 1, skip_empty: bool = True, skip_first: int = 0, frame: str = "frame", cluster: str = "cluster", count: str = "n", at: str = "t") -> DataFrame:
    """(item, start, matrix, timing): windows of `width` frames every `slide` frames over the counts of a frame x cluster map; matrix is a list
    of (place, cluster, n) without zeros, timing has a 1 at each frame with a stimulus. Windows without a stimulus, or with one in their first
    `skip_first` frames, are left out. Both tables are dealt to the few windows that hold a frame; there is no join over ranges."""
    last = frames - width

    def dealt(df: DataFrame, name: str) -> DataFrame:
        low = F.greatest(F.ceil((F.col(name) - width + 1) / slide), F.lit(0))
        high = F.least(F.floor(F.col(name) / slide), F.lit(last // slide))
        return df.where(low <= high).withColumn("item", F.explode(F.sequence(low, high))).withColumn("place", (F.col(name) - F.col("item") * slide).cast("int"))

    own = dealt(time_map.where(F.col(frame).between(0, frames - 1)), frame).groupBy("item").agg(F.array_sort(F.collect_list(F.struct("place", cluster, count))).alias("matrix"))
    hits = dealt(stimuli.select(at).where(F.col(at).between(0, frames - 1)), at).groupBy("item").agg(F.collect_set("place").alias("hits"))
    out = time_map.sparkSession.range(0, max(0, last // slide + 1 if last >= 0 else 0)).withColumnRenamed("id", "item").join(hits, "item", "inner" if skip_empty else "left").join(own, "item", "left")
    out = out.withColumn("hits", F.coalesce("hits", F.array().cast("array<int>")))
    if skip_first:
        out = out.where(~F.exists("hits", lambda p: p < skip_first))
    timing = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.array_contains("hits", k).cast("int"))
    return out.select("item", (F.col("item") * slide).alias("start"), "matrix", timing.alias("timing"))


def trials_long(trials: DataFrame, key: str = "event_key", trial: str = "trial", lead: int = 0) -> DataFrame:
    """(key, t, timepoint, value): a row for each frame of each trial, timepoints from -lead."""
    return trials.select(key, "t", F.posexplode(trial).alias("timepoint", "value")).withColumn("timepoint", F.col("timepoint") - lead)


def melt(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """A row for each key and value column."""
    return df.unpivot(list(keys), list(values), name, value)


def display(df: DataFrame, drop: Sequence[str] = (), decimals: int = 2) -> DataFrame:
    """Without the dropped columns, and number columns with a fraction rounded."""
    kinds = dict(df.dtypes)
    cols = [c for c in df.columns if c not in drop]
    return df.select(*(F.round(c, decimals).alias(c) if kinds[c] in ("float", "double") or kinds[c].startswith("decimal") else F.col(c) for c in cols))


def length_filter(df: DataFrame, low: int | None = None, high: int | None = None, trace: str = "trace") -> DataFrame:
    """Rows whose trace has at least low and at most high samples."""
    n = F.size(trace)
    return df.where((n >= (low or 0)) & (n <= (high if high is not None else (1 << 31) - 1)))


def lost_labels(voxels: DataFrame, label: str = "label", frame: str = "z") -> DataFrame:
    """(frame, label): labels that the frame before has and this one has not, for frames that the table has."""
    own = voxels.select(frame, label).distinct()
    frames = voxels.select(frame).distinct()
    before = own.select((F.col(frame) + 1).alias(frame), label)
    return before.join(own, [frame, label], "left_anti").join(frames, frame, "left_semi")


def split_patch(frames: Column | str, before: int, after: int, gap: int = 0) -> tuple[Column, Column]:
    """(input, target) of an array of before + 1 + after + 2 gap frames: those on both sides, without `gap` frames next to the middle, and the middle."""
    f = F.col(frames) if isinstance(frames, str) else frames
    return F.concat(F.slice(f, 1, before), F.slice(f, before + 2 * gap + 2, after)), F.get(f, before + gap)


def pad_batches(df: DataFrame, size: int, key: str = "id", trace: str = "trace", value: float = 0.0) -> DataFrame:
    """`batch`, and traces padded to the longest of their batch: batches of `size` traces of like lengths, in order of length and key."""
    from eventloom.operators.events import ranked

    placed = ranked(df.withColumn("_n", F.size(trace).cast("double")), "_n", key, "_r").withColumn("batch", F.floor(F.col("_r") / size)).drop("_r")
    longest = F.max("_n").over(W.partitionBy("batch"))
    return placed.withColumn("length", F.size(trace)).withColumn(trace, F.concat(trace, F.array_repeat(F.lit(value), (longest - F.col("_n")).cast("int")))).drop("_n")


def rounded_timing(df: DataFrame, predicted: str, threshold: float = 0.5) -> DataFrame:
    """`rounded`: each place of an array of probabilities as 1 from the threshold on, else 0."""
    return df.withColumn("rounded", F.transform(predicted, lambda p: (p >= threshold).cast("int")))


def contrast_counts(df: DataFrame, contrast: str = "contrast", cluster: str = "cluster") -> DataFrame:
    return df.groupBy(contrast, cluster).agg(F.count(F.lit(1)).alias("n"))


def camera_frames(samples: DataFrame, factor: int, prominence: float, part: str = "channel", order: str = "i", value: str = "v") -> DataFrame:
    """(channel, i): peaks of every factor-th sample, at their places in the whole signal."""
    from eventloom.operators.kernels import peak_table

    few = samples.where(F.col(order) % factor == 0).withColumn(order, F.floor(F.col(order) / factor))
    return peak_table(few, part, order, value, prominence=prominence).select(part, (F.col("peak") * factor).alias(order))


def predict_coincidence(coincident: DataFrame, binary: bool = True, name: str = "RandomForestClassifier", trace: str = "trace", split: str = "split", **parameters) -> DataFrame:
    """A classifier of whether (binary) or how often an event coincides with a stimulus, from its trace; rows of coincidences() with `split`."""
    label = (F.col("n") >= 1).cast("int") if binary else F.col("n").cast("int")
    return train_and_predict(coincident.withColumn("incidence", label), "incidence", name, trace, split, **parameters)


def predict_incidence_location(coincident: DataFrame, name: str = "RandomForestRegressor", trace: str = "trace", split: str = "split", **parameters) -> DataFrame:
    """A regressor of where in an event its first stimulus lies, from its trace; events without a stimulus are left out."""
    ready = coincident.where("n > 0").withColumn("location", F.get("relative", 0))
    return train_and_predict(ready, "location", name, trace, split, **parameters)


class EarlyStopping:
    """Whether to stop: after `patience` rounds in a row that do not better the best loss by more than `least`."""

    def __init__(self, patience: int = 5, least: float = 0.0) -> None:
        self.patience, self.least, self.best, self.waited = patience, least, float("inf"), 0

    def __call__(self, loss: float) -> bool:
        if loss < self.best - self.least:
            self.best, self.waited = loss, 0
        else:
            self.waited += 1
        return self.waited >= self.patience
