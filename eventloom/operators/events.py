"""The events table: projections, filters, joins with stimuli and clusters, and aggregates.

Intervals are half-open [z0, z1) unless a function says otherwise.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions import arrays as A
from eventloom.operators.signals import rolling

# --- projections


def derive(df: DataFrame, custom: Mapping[str, Callable[[DataFrame], Column]] | None = None) -> DataFrame:
    """v_area_norm, v_area_footprint, cx and cy where their inputs are there, then custom columns, each from the frame so far."""
    has = set(df.columns)
    if {"v_area", "dz"} <= has:
        df = df.withColumn("v_area_norm", F.try_divide("v_area", "dz"))
    if "footprint" in has:
        df = df.withColumn("v_area_footprint", F.size(F.filter("footprint", lambda b: b)))
    for axis, k in (("x", 0), ("y", 1)):
        if {f"{axis}0", f"d{axis}", f"v_fp_centroid_local-{k}"} <= has:
            df = df.withColumn(f"c{axis}", F.col(f"{axis}0") + F.col(f"d{axis}") * F.col(f"`v_fp_centroid_local-{k}`"))
    for name, make in (custom or {}).items():
        df = df.withColumn(name, make(df))
    return df


def prefix_keys(df: DataFrame, prefix: str, key: str = "event_key") -> DataFrame:
    return df.withColumn(key, F.concat(F.lit(prefix), F.col(key).cast("string")))


def recording(df: DataFrame, group: Any = None, subject_id: Any = None, file_name: Any = None) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in (("group", group), ("subject_id", subject_id), ("file_name", file_name))})


def combine(frames: Sequence[DataFrame], subjects: Sequence[Any], key: str = "event_key") -> DataFrame:
    """All recordings' events, with keys <subject>x<key> and the old key in subject_idx."""
    parts = [prefix_keys(f.withColumn("subject_idx", F.col(key).cast("string")), f"{s}x", key) for f, s in zip(frames, subjects, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def frames_to_times(df: DataFrame, mapping: DataFrame | None = None, function: Callable[[Column], Column] | None = None) -> DataFrame:
    """t0, t1 and dt, by a mapping (frame, t), which comes first, or by a function of the frame."""
    if mapping is not None:
        for k in "01":
            df = df.join(mapping.select(F.col("frame").alias(f"z{k}"), F.col("t").alias(f"t{k}")), f"z{k}", "left")
    elif function is not None:
        df = df.withColumn("t0", function(F.col("z0"))).withColumn("t1", function(F.col("z1")))
    else:
        raise ValueError("a mapping or a function is needed")
    return df.withColumn("dt", F.col("t1") - F.col("t0"))


def to_long(df: DataFrame, key: str = "event_key", trace: str = "trace", start: str | None = None) -> DataFrame:
    """(key, time, value): one row for each element, NaN and NULL as 0; time counts from `start`, else from 0."""
    long = df.select(key, *([start] if start else []), F.posexplode(trace).alias("p", "value"))
    return long.select(key, (F.col("p") + (F.col(start) if start else F.lit(0))).cast("long").alias("time"), F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)).alias("value"))


def valid(df: DataFrame, trace: str = "trace") -> DataFrame:
    """Events whose trace is as long as they are and which do not begin before the first frame."""
    return df.where((F.size(trace) == F.col("dz")) & (F.col("z0") >= 0))


def to_dense(df: DataFrame, frames: int, key: str = "event_key", trace: str = "trace") -> DataFrame:
    """(key, dense): each valid event's trace at z0..z1 of a row of `frames`, NULL elsewhere."""
    blank = lambda n: F.array_repeat(F.lit(None).cast("double"), F.greatest(n, F.lit(0)).cast("int"))
    return valid(df, trace).select(key, F.slice(F.concat(blank(F.col("z0")), F.col(trace), blank(frames - F.col("z0") - F.col("dz"))), 1, frames).alias("dense"))


def average_trace(df: DataFrame, window: int | None = None, gradient: bool = False, how: Callable = F.avg, trace: str = "trace") -> DataFrame:
    """(time, value): mean over active events for each frame, then a strict centered rolling mean, then the gradient."""
    long = valid(df, trace).select("z0", F.posexplode(trace).alias("p", "v")).select((F.col("z0") + F.col("p")).alias("time"), "v")
    out = long.groupBy("time").agg(how("v").alias("value")).withColumn("_one", F.lit(0))  # one row a frame
    if window:
        out = out.withColumn("value", rolling(F.col("value"), F.avg, "_one", "time", window))
    if gradient:
        w = W.partitionBy("_one").orderBy("time")
        back, ahead = F.lag("value").over(w), F.lead("value").over(w)
        out = out.withColumn("value", F.when(F.col("value").isNull(), None).when(back.isNull(), ahead - F.col("value")).when(ahead.isNull(), F.col("value") - back).otherwise((ahead - back) / 2))
    return out.drop("_one")


# --- filters


def keep(df: DataFrame, filters: Mapping[str, Any], compat: bool = False) -> DataFrame:
    """Numeric columns: (low, high), both inclusive, None for an open bound (with compat also -1); other columns: a list of values."""
    for name, want in filters.items():
        kind = df.schema[name].dataType
        if isinstance(kind, T.NumericType):
            low, high = (None if b is None or (compat and b == -1) else b for b in want)
            if low is not None:
                df = df.where(F.col(name) >= low)
            if high is not None:
                df = df.where(F.col(name) <= high)
        elif isinstance(kind, T.StringType):
            df = df.where(F.col(name).isin(list(want)))
        else:
            raise TypeError(f"{name} is {kind.simpleString()}; only numbers and strings can be filtered")
    return df


def parse_filters(text: str) -> dict[str, Any]:
    """{column: filter} of lines col:(low,high) and col:[a,b]; an empty bound or None is open."""
    out: dict[str, Any] = {}
    for line in filter(None, (x.strip() for x in text.splitlines())):
        name, _, rest = (p.strip() for p in line.partition(":"))
        m = re.fullmatch(r"([(\[])(.*)[)\]]", rest)
        if not name or not m:
            raise ValueError(f"not a filter: {line!r}")
        parts = [p.strip().strip("'\"") for p in m[2].split(",")]
        out[name] = tuple(None if p in ("", "None") else float(p) for p in parts) if m[1] == "(" else parts
    return out


def slice_events(df: DataFrame, a: int | None, b: int | None) -> DataFrame:
    """Events with z0 >= a and z1 <= b."""
    return keep(df, {"z0": (a, None), "z1": (None, b)})


def slice_for_counts(df: DataFrame, a: int, b: int) -> DataFrame:
    """Events with z0 >= a and z1 < b."""
    return df.where((F.col("z0") >= a) & (F.col("z1") < b))


def split_outliers(df: DataFrame, column: str, k: float = 2.0) -> DataFrame:
    """`band`: low, mid or high, by mean -+ k population deviations; the two statistics are one row."""
    stat = df.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    band = F.when(F.col(column) < F.col("_m") - k * F.col("_s"), "low").when(F.col(column) > F.col("_m") + k * F.col("_s"), "high").otherwise("mid")
    return df.join(F.broadcast(stat), how="cross").withColumn("band", band).drop("_m", "_s")


def sample(df: DataFrame, n: int, by: str | None = None, key: str = "event_key", seed: int = 0) -> DataFrame:
    """n rows (of each value of `by`), the same for the same seed: those with the smallest hash of key and seed."""
    at = F.xxhash64(F.col(key), F.lit(seed))
    if by is None:
        return df.orderBy(at, key).limit(n)
    return df.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(at, key))).where(F.col("_r") <= n).drop("_r")


def bootstrap_means(df: DataFrame, value: str, by: str, key: str = "event_key", resamples: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(by, mean, low, high): median and interval of the mean of all of each group's values over resamples.

    Poisson bootstrap: in each resample a row has a weight by the hash of its key, the resample and the seed. Only weighted sums and
    counts leave the map side, so no group is ever in one task. NULL values do not count.
    """
    steps = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]
    rows = df.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("_v"), key, F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_b"))
    u = F.shiftrightunsigned(F.xxhash64(key, "_b", F.lit(seed)), 11) / F.lit(float(1 << 53))
    drawn = rows.withColumn("_u", u).withColumn("_w", sum((F.col("_u") >= s).cast("int") for s in steps))
    means = drawn.groupBy(by, "_b").agg((F.sum(F.col("_v") * F.col("_w")) / F.nullif(F.sum("_w"), F.lit(0))).alias("_m"))
    at = lambda q: F.percentile("_m", F.lit(q))
    return means.groupBy(by).agg(at(0.5).alias("mean"), at((1 - level) / 2).alias("low"), at((1 + level) / 2).alias("high"))


def drop_missing(df: DataFrame, how: str, columns: Sequence[str], fill: float = 0.0) -> DataFrame:
    """how: rows (with any NULL or NaN go), columns (that have any go), fill."""
    clean = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))})
    if how == "rows":
        return clean.dropna(subset=list(columns))
    if how == "fill":
        return clean.fillna(fill, subset=list(columns))
    if how == "columns":
        seen = clean.agg(F.count(F.lit(1)).alias("_n"), *(F.count(c).alias(c) for c in columns)).first()
        return clean.drop(*(c for c in columns if seen[c] < seen["_n"]))
    raise ValueError(f"rows, columns or fill, not {how!r}")


# --- joins


def add_clusters(df: DataFrame, lookup: DataFrame, key: str = "event_key", out: str = "cluster", default: Any = None) -> DataFrame:
    """Left join of (key, label); a default stands for keys that are not there. Spark broadcasts the lookup where it is small."""
    got = df.drop(out).join(lookup.select(key, F.col("label").alias(out)), key, "left")
    return got if default is None else got.withColumn(out, F.coalesce(out, F.lit(default)))


def compose_clusters(events: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """event_key -> (subject, cluster) -> super cluster: first (event_key, subject_id, cluster), second (subject_id, cluster, label)."""
    return events.join(first, ["event_key", "subject_id"], "left").join(second, ["subject_id", "cluster"], "left")


def within(events: DataFrame, points: DataFrame, at: str = "t", closed: bool = True, width: int = 64) -> DataFrame:
    """Events with each point in [z0, z1] (closed) or (z0, z1). Both sides are dealt to bins of `width` frames and joined on the bin,
    so there is no nested loop; the bounds are then checked."""
    bins = F.explode(F.sequence(F.floor(F.col("z0") / width), F.floor(F.col("z1") / width)))
    one, two = events.withColumn("_bin", bins), points.withColumn("_bin", F.floor(F.col(at) / width))
    test = (F.col(at) >= F.col("z0")) & (F.col(at) <= F.col("z1")) if closed else (F.col(at) > F.col("z0")) & (F.col(at) < F.col("z1"))
    return one.join(two, "_bin").where(test).drop("_bin")


def trials(events: DataFrame, stimuli: DataFrame, length: int, behaviour: str = "first", key: str = "event_key", trace: str = "trace") -> DataFrame:
    """(key, t, trial): `length` frames about each stimulus in [z0, z1], NULL where the event has no frame; an odd length puts the frame
    over before the stimulus. behaviour: first stimulus of an event, expand (all), exclude (events with several)."""
    hits = within(events, stimuli)
    if behaviour == "first":
        pick = hits.groupBy(key).agg(F.min("t").alias("t"))
    elif behaviour == "exclude":
        pick = hits.groupBy(key).agg(F.min("t").alias("t"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    elif behaviour == "expand":
        pick = hits.select(key, "t")
    else:
        raise ValueError(f"first, expand or exclude, not {behaviour!r}")
    lead = length - length // 2
    at = F.sequence(F.lit(0), F.lit(length - 1))
    cell = lambda k: A.let((F.col("t") - lead + k - F.col("z0")).cast("int"), lambda p: F.when(p >= 0, F.get(trace, p)))
    return events.join(pick, key).select(key, "t", F.transform(at, cell).alias("trial"))


def coincidences(events: DataFrame, stimuli: DataFrame, key: str = "event_key") -> DataFrame:
    """For every event: n stimuli in (z0, z1), their frames, and their places as shares of the event."""
    hits = within(events, stimuli, closed=False).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("t")).alias("at"))
    out = events.join(hits, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn("at", F.coalesce("at", F.array().cast("array<bigint>")))
    return out.withColumn("relative", F.transform("at", lambda t: (t - F.col("z0")) / (F.col("z1") - F.col("z0"))))


def active_by_cluster(events: DataFrame) -> DataFrame:
    """(frame, cluster, n): events of a cluster active in a frame of [z0, z1)."""
    return events.where("z1 > z0").select("cluster", F.explode(F.sequence("z0", F.col("z1") - 1)).alias("frame")).groupBy("frame", "cluster").agg(F.count(F.lit(1)).alias("n"))


def stimulus_windows(stimuli: DataFrame, frames: int, width: int, stride: int) -> DataFrame:
    """(start, hits): for windows [s, s + width) every `stride` frames, 0 or 1 for each frame, by whether it has a stimulus."""
    spark = stimuli.sparkSession
    starts = spark.range(0, frames - width + 1, stride).select(F.col("id").alias("start"))
    # a stimulus is in at most ceil(width / stride) windows: make those, not all pairs
    k = F.explode(F.sequence(F.greatest(F.ceil((F.col("t") - width + 1) / stride), F.lit(0)), F.floor(F.col("t") / stride)))
    hits = stimuli.select("t", k.alias("k")).select((F.col("k") * stride).alias("start"), (F.col("t") - F.col("k") * stride).cast("int").alias("p"))
    got = hits.groupBy("start").agg(F.collect_set("p").alias("ps"))
    flag = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.array_contains("ps", i), F.lit(False)).cast("int"))
    return starts.join(got, "start", "left").select("start", flag.alias("hits"))


# --- aggregates


def time_map(voxels: DataFrame) -> DataFrame:
    """(event_id, start, end) of (event_id, z, ...): first active frame, and one after the last."""
    return voxels.groupBy("event_id").agg(F.min("z").alias("start"), (F.max("z") + 1).alias("end"))


def counts(df: DataFrame, by: str = "cluster") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def contingency(df: DataFrame, rows: str, columns: str, values: Sequence[Any] | None = None) -> DataFrame:
    """Counts of rows x columns, 0 where there are none. Give the column's values to save the pass that finds them."""
    out = df.groupBy(rows).pivot(columns, list(values) if values else None).agg(F.count(F.lit(1)))
    return out.na.fill(0)


def frequency(df: DataFrame, group: str, cluster: str = "cluster") -> DataFrame:
    """(cluster, group, n) for every cluster and group, 0 where there are none; both are few values."""
    whole = df.select(group).distinct().join(F.broadcast(df.select(cluster).distinct()), how="cross")
    got = df.groupBy(group, cluster).agg(F.count(F.lit(1)).alias("n"))
    return whole.join(got, [group, cluster], "left").na.fill(0, ["n"])


def summary(df: DataFrame, columns: Sequence[str], by: str | None = None, digits: int = 2) -> DataFrame:
    """'mean ± sample deviation' of each column."""
    cell = lambda c: F.concat(F.format_string(f"%.{digits}f", F.avg(c)), F.lit(" ± "), F.format_string(f"%.{digits}f", F.stddev_samp(c))).alias(c)
    return (df.groupBy(by) if by else df).agg(*(cell(c) for c in columns))


def retention(sizes: DataFrame, lows: Sequence[float], highs: Sequence[float], size: str = "n") -> DataFrame:
    """(low, high, share): share of events in clusters whose size is in [low, high], for a grid of bounds."""
    grid = [(float(a), float(b)) for a in lows for b in highs]
    params = sizes.sparkSession.createDataFrame(grid, "low double, high double")
    inside = F.col(size).between(F.col("low"), F.col("high"))
    return sizes.join(F.broadcast(params), how="cross").groupBy("low", "high").agg(F.try_divide(F.sum(F.when(inside, F.col(size)).otherwise(0)), F.sum(size)).alias("share"))


def size_filter(df: DataFrame, low: float | None = None, high: float | None = None, cluster: str = "cluster") -> DataFrame:
    """Events of clusters with low <= size <= high; a low below 1 is a share of all events."""
    sizes = counts(df, cluster)
    if low is not None and 0 < low < 1:
        sizes = sizes.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("_all"))), how="cross").where(F.col("n") >= low * F.col("_all"))
    elif low is not None:
        sizes = sizes.where(F.col("n") >= low)
    if high is not None:
        sizes = sizes.where(F.col("n") <= high)
    return df.join(sizes.select(cluster), cluster, "left_semi")


def error_rates(df: DataFrame, missed: str, extra: str, expected: str, compat: bool = False) -> DataFrame:
    """One row: percent of false negatives, false positives, and rows with any error (compat: of the bitwise or of both counts)."""
    either = F.sum(F.col(missed).bitwiseOR(F.col(extra))) / F.sum(expected) if compat else F.avg(((F.col(missed) > 0) | (F.col(extra) > 0)).cast("double"))
    return df.agg((F.sum(missed) / F.sum(expected) * 100).alias("fn"), (F.sum(extra) / F.sum(expected) * 100).alias("fp"), (either * 100).alias("any"))


def worst_of(df: DataFrame, rows: str, columns: str, value: str, values: Sequence[Any] | None = None) -> DataFrame:
    """Pivot with the minimum over replicates."""
    return df.groupBy(rows).pivot(columns, list(values) if values else None).agg(F.min(value))


def balance(df: DataFrame, label: str, key: str) -> DataFrame:
    """As many rows of each class as the smallest has, the first by key (a number)."""
    from eventloom.operators.signals import number_rows

    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).agg(F.min("_n").alias("_n"))
    return number_rows(df, label, key, "_r").join(F.broadcast(least), how="cross").where(F.col("_r") < F.col("_n")).drop("_r", "_n")


def sequential_split(df: DataFrame, key: str, shares: Sequence[float] = (0.8, 0.2), names: Sequence[str] = ("train", "test")) -> DataFrame:
    """`split` by place in the order of key: floor(n * share) rows each, the rest to the last. Cut points come from the exact number of
    rows below each key in ranges of keys, not from one global sort."""
    from eventloom.operators.signals import number_rows

    numbered = number_rows(df.withColumn("_c", F.lit(0)), "_c", key, "_i")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    out, done = F.lit(names[-1]), 0.0
    for s, name in reversed(list(zip([sum(shares[: k + 1]) for k in range(len(shares) - 1)], names, strict=False))):
        out = F.when(F.col("_i") < F.floor(F.col("_n") * s), name).otherwise(out)
    return numbered.join(F.broadcast(n), how="cross").withColumn("split", out).drop("_c", "_i", "_n")


def ranked(df: DataFrame, column: str, key: str, out: str, pieces: int = 64) -> DataFrame:
    """Places from 0 in the order of a number column (ties by key, NULL first), without a sort of all rows in one task: the column is cut at
    approximate quantiles, pieces are numbered side by side, and each starts where those before it end."""
    cuts = df.agg(F.percentile_approx(column, [k / pieces for k in range(1, pieces)], 10 * pieces).alias("c")).first()["c"] or []
    piece = F.size(F.filter(F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))), lambda c: c < F.col(column))) if cuts else F.lit(0)
    cut = df.withColumn("_piece", F.when(F.col(column).isNull(), 0).otherwise(piece))
    before = W.partitionBy(F.lit(0)).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = cut.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return cut.join(starts, "_piece").withColumn(out, F.col("_start") + F.row_number().over(W.partitionBy("_piece").orderBy(column, key)) - 1).drop("_piece", "_start")


def contrasts(df: DataFrame, column: str, bins: int, key: str) -> DataFrame:
    """`contrast`: equal-sized classes of a number column from 1 (ties by key); the first classes take what is over."""
    out = ranked(df, column, key, "_r").join(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))), how="cross")
    q, m = F.floor(F.col("_n") / bins), F.col("_n") % bins
    big = m * (q + 1)
    tile = F.when(F.col("_r") < big, F.floor(F.col("_r") / (q + 1))).otherwise(m + F.floor(F.try_divide(F.col("_r") - big, q)))
    return out.withColumn("contrast", (tile + 1).cast("int")).drop("_r", "_n")
