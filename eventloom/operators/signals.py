"""One-dimensional signals and rolling windows. Frames are counted in rows of a channel ordered by an index column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions import arrays as A

#: Seconds in each unit that a sampling interval may be given in.
UNITS = {"ps": 1e-12, "ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0, "min": 60.0, "h": 3600.0}


#: Rows of a piece of a channel, about.
PIECE_ROWS = 1 << 16


def number_rows(df: DataFrame, channel: str, order: str, out: str) -> DataFrame:
    """Rows of each channel numbered from 0 in the order of a number column. A channel may hold most rows, so the column's range is cut into
    pieces of about PIECE_ROWS rows, numbered side by side, and each starts where those before it end."""
    n, low, high = df.agg(F.count(F.lit(1)), F.min(order).cast("double"), F.max(order).cast("double")).first()
    width = max(((high or 0.0) - (low or 0.0)) / max(1, -(-n // PIECE_ROWS)), 1e-300)
    pieces = W.partitionBy(channel, "_piece").orderBy(order)
    cut = df.withColumn("_piece", F.floor((F.col(order).cast("double") - F.lit(low or 0.0)) / F.lit(width)))
    sizes = cut.groupBy(channel, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(channel).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = cut["_piece"].eqNullSafe(starts["_piece"]) & cut[channel].eqNullSafe(starts[channel])
    return cut.join(starts, same).drop(starts[channel]).drop(starts["_piece"]).withColumn(out, F.col("_start") + F.row_number().over(pieces) - 1).drop("_piece", "_start")


def by_pieces(df: DataFrame, part: str, order: str, back: int, ahead: int, step: Callable[[DataFrame, list[str]], DataFrame], numbered: bool = False) -> DataFrame:
    """step(df, partition) where partition names pieces of PIECE_ROWS rows of each channel, so that no task holds a whole channel. Each piece
    also gets the `back` rows before and `ahead` rows after it, which go again when step is done. numbered: `order` already counts a
    channel's rows from 0."""
    at = F.col(order) if numbered else F.col("_n")
    rows = df if numbered else number_rows(df, part, order, "_n")
    own = F.floor(at / PIECE_ROWS)
    copies = F.sequence(F.greatest(F.floor((at - ahead) / PIECE_ROWS), F.lit(0)), F.floor((at + back) / PIECE_ROWS))
    out = step(rows.withColumn("_p", F.explode(copies)), [part, "_p"])
    return out.where(F.col("_p") == own).drop("_p", *([] if numbered else ["_n"]))


def sampling_seconds(rate: str | float) -> float:
    """Seconds between samples: a number is a frequency in Hz; a string has a unit, as 10ms."""
    if not isinstance(rate, str):
        return 1.0 / float(rate)
    for unit in sorted(UNITS, key=len, reverse=True):
        if rate.endswith(unit):
            return float(rate[: -len(unit)]) * UNITS[unit]
    raise ValueError(f"no unit in {rate!r}; known units: {', '.join(UNITS)}")


def deinterleave(df: DataFrame, channels: int, index: str = "z", factor: int = 1) -> DataFrame:
    """Rows dealt round robin to channels: channel = index mod channels, index = index div channels; then every factor-th is kept."""
    out = df.withColumn("channel", F.col(index) % channels).withColumn(index, F.floor(F.col(index) / channels))
    return out if factor == 1 else out.where(F.col(index) % factor == 0).withColumn(index, F.floor(F.col(index) / factor))


def read_interleaved(df: DataFrame, names: list[str], seconds: float, factor: int = 1, index: str = "i", value: str = "v") -> DataFrame:
    """(channel, i, t, v) of a single row of samples dealt to named channels, `seconds` apart, with every factor-th sample kept."""
    n = len(names)
    out = deinterleave(df.withColumn("_at", F.col(index)), n, index)
    named = F.get(F.array(*(F.lit(x) for x in names)), F.col("channel").cast("int"))
    out = out.where(F.col(index) % factor == 0)
    return out.select(named.alias("channel"), F.floor(F.col(index) / factor).alias("i"), (F.col("_at") * seconds).alias("t"), F.col(value).alias("v"))


def channel(df: DataFrame, name: str) -> DataFrame:
    """Rows of a channel; an error names the channels there are."""
    got = df.where(F.col("channel") == name)
    if got.isEmpty():
        raise KeyError(f"no channel {name!r}; there are {sorted(r[0] for r in df.select('channel').distinct().limit(50).collect())}")
    return got


def _rows(part: str | list[str], order: str, low: int, high: int):
    return W.partitionBy(part).orderBy(order).rowsBetween(low, high)


def full(stat: Column, frame, width: int) -> Column:
    """stat over a frame, NULL unless the frame has `width` rows."""
    return F.when(F.count(F.lit(1)).over(frame) == width, stat.over(frame))


def rolling(value: Column, how, part: str | list[str], order: str, width: int, center: bool = True, partial: bool = False) -> Column:
    """A rolling statistic of `width` rows; centered, an even width reaches one row further back. Unless partial, incomplete frames give NULL."""
    frame = _rows(part, order, -(width // 2), (width - 1) // 2) if center else _rows(part, order, -(width - 1), 0)
    if how is F.median:  # it has no frames of its own; a frame's values are as few as its width
        out = A.median(F.collect_list(value).over(frame))
        return out if partial else F.when(F.count(F.lit(1)).over(frame) == width, out)
    return how(value).over(frame) if partial else full(how(value), frame, width)


def rolled(df: DataFrame, out: str, how, width: int, part: str = "channel", order: str = "i", value: str = "v", center: bool = True, partial: bool = False, numbered: bool = False) -> DataFrame:
    """rolling() in column `out`, piece by piece."""
    step = lambda d, p: d.withColumn(out, rolling(F.col(value), how, p, order, width, center, partial))
    return by_pieces(df, part, order, width, width, step, numbered)


def detrend(df: DataFrame, width: int, part: str = "channel", order: str = "i", value: str = "v", absolute: bool = False, smooth: int | None = None, numbered: bool = False) -> DataFrame:
    """value (or its centered mean of `smooth` rows) - rolling minimum of the last `width` rows, in `detrended`; NULL for the first rows."""
    if smooth:
        df, value = rolled(df, "_smooth", F.avg, smooth, part, order, value, numbered=numbered), "_smooth"
    out = lambda p: F.col(value) - rolling(F.col(value), F.min, p, order, width, center=False)
    return by_pieces(df, part, order, width, 0, lambda d, p: d.withColumn("detrended", F.abs(out(p)) if absolute else out(p)), numbered).drop("_smooth")


def two_sided_minimum(df: DataFrame, width: int, part: str = "channel", order: str = "i", value: str = "v", numbered: bool = False) -> DataFrame:
    """`baseline`: the greater of the minima of the last and of the next `width` rows, the row itself in both; shorter at the ends."""
    least = lambda p, a, b: F.min(value).over(_rows(p, order, a, b))
    return by_pieces(df, part, order, width, width, lambda d, p: d.withColumn("baseline", F.greatest(least(p, -(width - 1), 0), least(p, 0, width - 1))), numbered)


def even_odd_minimum(df: DataFrame, width: int, part: str = "channel", order: str = "i", value: str = "v", numbered: bool = False) -> DataFrame:
    """`baseline`: centered minimum of width + 1 rows among rows of the same parity."""
    frame = lambda p: W.partitionBy(*p, F.col(order) % 2).orderBy(order).rowsBetween(-(width // 2), width // 2)
    return by_pieces(df, part, order, 2 * width + 2, 2 * width + 2, lambda d, p: d.withColumn("baseline", F.min(value).over(frame(p))), numbered)


def slopes(df: DataFrame, part: str = "channel", order: str = "i", value: str = "v", numbered: bool = False) -> DataFrame:
    """`gradient` and `diff`: gradient() and first_difference() of each channel, piece by piece."""
    step = lambda d, p: d.withColumn("gradient", gradient(value, p, order)).withColumn("diff", first_difference(value, p, order))
    return by_pieces(df, part, order, 1, 1, step, numbered)


def gradient(value: str, part: str | list[str], order: str) -> Column:
    """Central differences over rows, one-sided at both ends."""
    w = W.partitionBy(part).orderBy(order)
    back, ahead = F.lag(value).over(w), F.lead(value).over(w)
    return F.when(back.isNull(), ahead - F.col(value)).when(ahead.isNull(), F.col(value) - back).otherwise((ahead - back) / 2)


def first_difference(value: str, part: str | list[str], order: str) -> Column:
    return F.coalesce(F.col(value) - F.lag(value).over(W.partitionBy(part).orderBy(order)), F.lit(0.0))


def periods(df: DataFrame, part: str = "channel", at: str = "t") -> DataFrame:
    """pre and post: time to the peak before and after; frequency: 1 / pre."""

    def step(d: DataFrame, p: list[str]) -> DataFrame:
        w = W.partitionBy(p).orderBy(at)
        return d.withColumn("pre", F.col(at) - F.lag(at).over(w)).withColumn("post", F.lead(at).over(w) - F.col(at))

    return by_pieces(df, part, at, 1, 1, step).withColumn("frequency", F.try_divide(F.lit(1.0), F.col("pre")))


def median_normalised(df: DataFrame, width: int, part: str = "channel", order: str = "i", value: str = "v", center: bool = True, numbered: bool = False) -> DataFrame:
    """`normed`: value over its rolling median of up to `width` rows."""
    out = rolled(df, "_m", F.median, width, part, order, value, center, partial=True, numbered=numbered)
    return out.withColumn("normed", F.try_divide(F.col(value), F.col("_m"))).drop("_m")


def sighs(df: DataFrame, width: int, part: str = "channel", order: str = "i", value: str = "v", numbered: bool = False) -> DataFrame:
    """`sigh`: value above rolling median plus rolling sample deviation, of up to `width` centered rows."""

    def step(d: DataFrame, p: list[str]) -> DataFrame:
        m, s = (rolling(F.col(value), how, p, order, width, partial=True) for how in (F.median, F.stddev_samp))
        return d.withColumn("sigh", F.coalesce(F.col(value) > m + s, F.lit(False)))

    return by_pieces(df, part, order, width, width, step, numbered)


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """One row, the median of a column without gathering it: approximate quantiles on both sides of it bound the rows that are ranked."""
    n, cuts = df.agg(F.count(column), F.percentile_approx(column, [0.4995, 0.5005], 100_000)).first()
    low, high = cuts or (None, None)
    if not n:
        return df.agg(F.median(column).alias(column))
    below = F.count(F.when(F.col(column) < low, 1))
    start = df.agg(below).first()[0]
    near = df.where((F.col(column) >= low) & (F.col(column) <= high)).groupBy(column).agg(F.count(F.lit(1)).alias("k"))
    upto = F.lit(start) + F.sum("k").over(W.partitionBy(F.lit(0)).orderBy(column))
    ranked = near.withColumn("to", upto)
    pick = lambda r: F.min(F.when(F.col("to") > r, F.col(column)))
    return ranked.agg(((pick((n - 1) // 2) + pick(n // 2)) / 2).alias(column))


def frame_to_time(df: DataFrame, mapping: DataFrame, index: str = "i") -> DataFrame:
    """`t` of a frame by mapping (frame, t); past its end on the line through its last two frames. The last two frames are one row."""
    last = mapping.orderBy(F.desc("frame")).limit(2)
    ends = last.agg(F.max("frame").alias("f1"), F.min("frame").alias("f0"), F.max_by("t", "frame").alias("t1"), F.min_by("t", "frame").alias("t0"))
    slope = F.try_divide(F.col("t1") - F.col("t0"), F.col("f1") - F.col("f0"))
    out = df.join(mapping.withColumnRenamed("frame", index), index, "left").join(F.broadcast(ends), how="cross")
    return out.withColumn("t", F.coalesce("t", F.when(F.col(index) > F.col("f1"), F.col("t1") + slope * (F.col(index) - F.col("f1"))))).drop("f0", "f1", "t0", "t1")


def replace_first(df: DataFrame, part: list[str], order: str = "z", value: str = "v") -> DataFrame:
    """The first frame takes the second's value."""
    w = W.partitionBy(part).orderBy(order)
    return df.withColumn(value, F.when(F.lag(order).over(w).isNull(), F.coalesce(F.lead(value).over(w), F.col(value))).otherwise(F.col(value)))


def select_time(df: DataFrame, start: float, end: float, at: str = "t") -> DataFrame:
    return df.where((F.col(at) >= start) & (F.col(at) < end))
