"""Video and Events: thin, immutable handles over DataFrames, so that steps can be chained."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import features, normalize
from eventloom.operators import events as E
from eventloom.operators import graph as G
from eventloom.operators import kernels as K
from eventloom.operators import learn as L
from eventloom.operators import volume as V
from eventloom.sources import storage


@dataclass(frozen=True)
class Video:
    """A recording as voxels (z, x, y, v)."""

    df: DataFrame
    name: str = ""

    @classmethod
    def load(cls, spark: SparkSession, path: str, loc: str | None = None, z_slice: tuple[int, int] | None = None, name: str = "") -> Video:
        return cls(storage.load(spark, path, loc, z_slice), name)

    def save(self, path: str, overwrite: bool = False) -> None:
        storage.save(self.df, path, overwrite)

    def transform(self, step: Callable[..., DataFrame], *args, **kwargs) -> Video:
        return replace(self, df=step(self.df, *args, **kwargs))

    def project(self, axes: tuple[str, ...] = ("z",), how: Callable = F.avg, window: int | None = None) -> DataFrame:
        return V.project_windowed(self.df, window, how) if window else V.project(self.df, axes, how)

    def smooth(self, sigma: float, radius: int) -> Video:
        return self.transform(V.smooth, sigma, radius)

    def delta(self, method: str = "dF", **options) -> Video:
        return self.transform(V.delta, K.baselines(self.df, **options), method)

    def correct_motion(self, most: int | None = None) -> Video:
        return self.transform(K.correct_motion, K.motion_shifts(self.df, most))

    def mask(self, factor: float | None = None, spatial: Mapping[str, Any] | None = None, temporal: Mapping[str, Any] | None = None, how: str = "and", border: int = 0, holes: int = 0, least: int = 0) -> DataFrame:
        """Active voxels: absolute threshold, or spatial and temporal masks combined; border, holes and small objects then."""
        parts = []
        if factor is not None:
            parts.append(V.threshold(self.df, factor).where("active").select("z", "x", "y"))
        if spatial is not None:
            parts.append(K.spatial_mask(self.df, **spatial))
        if temporal is not None:
            parts.append(K.temporal_mask(self.df, **temporal))
        if not parts:
            raise ValueError("a factor, spatial or temporal options are needed")
        out = parts[0]
        for p in parts[1:]:
            out = V.combine_masks(out, p, how)
        if border:
            out = V.exclude_border(self.df, border).select("z", "x", "y").join(out, ["z", "x", "y"], "left_semi")
        if holes:
            flags = self.df.select("z", "x", "y").join(out.withColumn("_a", F.lit(True)), ["z", "x", "y"], "left")
            out = V.fill_holes(flags.select("z", "x", "y", F.coalesce("_a", F.lit(False)).alias("active")), holes)
        return V.remove_small(out, least) if least else out

    def detect(self, split: bool = False, **options) -> Events:
        """Label the mask's components and describe each: box, traces, noise, footprint shape and hull."""
        labels = V.label_components(self.mask(**options))
        if split:
            named = K.split_events(labels.join(self.df, ["z", "x", "y"])).withColumn("label", F.xxhash64("event_key"))
            labels = storage.materialize(named.select("z", "x", "y", "label"), "labels")
        out = V.bounding_boxes(labels)
        for more in (V.event_traces(labels, self.df), V.footprint_shape(labels), V.footprint_hulls(labels)):
            out = out.join(more, "label")
        return Events(E.derive(out.withColumnRenamed("label", "event_key")), voxels=labels, video=self)


@dataclass(frozen=True)
class Events:
    """Events, one row each, keyed by event_key; with the voxels of each and the recording where they are known."""

    df: DataFrame
    voxels: DataFrame | None = None
    video: Video | None = None

    @classmethod
    def load(cls, spark: SparkSession, path: str, z_slice: tuple[int, int] | None = None, index_prefix: str | None = None, custom_columns: Mapping[str, Callable[[DataFrame], Column]] | None = None, **recording) -> Events:
        df = E.derive(spark.read.parquet(path), custom_columns)
        if z_slice:
            df = E.slice_events(df, *z_slice)
        return cls(E.recording(E.prefix_keys(df, index_prefix) if index_prefix else df, **recording))

    @classmethod
    def combine(cls, parts: Sequence[Events], subjects: Sequence[Any]) -> Events:
        return cls(E.combine([p.df for p in parts], subjects))

    def then(self, step: Callable[..., DataFrame], *args, **kwargs) -> Events:
        return replace(self, df=step(self.df, *args, **kwargs))

    def filter(self, filters: Mapping[str, Any] | str, compat: bool = False) -> Events:
        return self.then(E.keep, E.parse_filters(filters) if isinstance(filters, str) else filters, compat)

    def normalize(self, program: Mapping) -> Events:
        return self.then(normalize.run, program)

    def enforce_length(self, low: int | None = None, high: int | None = None) -> Events:
        return self.then(normalize.enforce_length, low, high)

    def extend(self, before: int, after: int, frames: int) -> Events:
        if self.video is None:
            raise ValueError("extension needs the recording")
        return self.then(V.extend_events, self.video.df, before, after, frames)

    def features(self, names: Sequence[str] | None = None) -> Events:
        return self.then(features.all_features, names=names)

    def add_clusters(self, lookup: DataFrame, out: str = "cluster", default: Any = None) -> Events:
        return self.then(E.add_clusters, lookup, out=out, default=default)

    def trials(self, stimuli: DataFrame, length: int, behaviour: str = "first") -> DataFrame:
        return E.trials(self.df, stimuli, length, behaviour)

    def coincidences(self, stimuli: DataFrame) -> DataFrame:
        return E.coincidences(self.df, stimuli)

    def frequency(self, group: str, cluster: str = "cluster") -> DataFrame:
        return E.frequency(self.df, group, cluster)

    def summary(self, columns: Sequence[str], by: str | None = None) -> DataFrame:
        return E.summary(self.df, columns, by)

    def average_trace(self, window: int | None = None, gradient: bool = False) -> DataFrame:
        return E.average_trace(self.df, window, gradient)

    def long(self) -> DataFrame:
        return E.to_long(self.df)

    def distances(self, kind: str = "dtw", key: str = "event_key", **options) -> DataFrame:
        """(i, j, d): dtw (options as pair_distances has them), ragged_pearson (r), or euclidean or pearson (r) for traces of one length."""
        if kind == "dtw":
            return K.pair_distances(self.df, key, **options)
        return {"euclidean": G.euclidean_matrix, "pearson": G.pearson_matrix, "ragged_pearson": G.ragged_pearson_matrix}[kind](self.df, key, **options)

    def kmeans(self, k: int) -> Events:
        return self.then(L.kmeans, k)

    def save(self, path: str, overwrite: bool = False) -> None:
        self.df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
