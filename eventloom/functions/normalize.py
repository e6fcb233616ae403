"""Normalisation of traces: an ordered program of steps, by row, over the whole population, or by column (place in the trace)."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions import arrays as A

MODES: dict[str, Callable[[Column], Column]] = {
    "first": A.first,
    "mean": A.mean,
    "median": A.median,
    "min": F.array_min,
    "min_abs": lambda x: F.array_min(F.transform(x, F.abs)),
    "max": F.array_max,
    "max_abs": lambda x: F.array_max(F.transform(x, F.abs)),
    "std": A.std_pop,
}
#: Statistics over all rows of each row's deviation; they have no form by row.
SPREADS: dict[str, Callable[[Column], Column]] = {"std_mean": F.avg, "std_median": F.median, "std_max": F.max}
_AGGREGATES: dict[str, Callable[[Column], Column]] = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "min_abs": lambda v: F.min(F.abs(v)), "max_abs": lambda v: F.max(F.abs(v)), "std": F.stddev_pop}


def _population(df: DataFrame, mode: str, trace: str) -> DataFrame:
    """One row with the statistic over all elements of all rows (each element weighs the same, also in ragged data)."""
    if mode in SPREADS:
        return df.agg(SPREADS[mode](A.std_pop(F.col(trace))).alias("stat"))
    if mode == "first":
        return df.agg(F.avg(A.first(trace)).alias("stat"))
    return df.select(F.explode(trace).alias("v")).agg(_AGGREGATES[mode](F.col("v")).alias("stat"))


def _with_stat(df: DataFrame, mode: str, trace: str, population_wide: bool) -> DataFrame:
    if population_wide or mode in SPREADS:
        return df.join(F.broadcast(_population(df, mode, trace)), how="cross")  # one row
    return df.withColumn("stat", MODES[mode](F.col(trace)))


def _by_column(df: DataFrame, mode: str, trace: str, apply: Callable[[Column, Column], Column]) -> DataFrame:
    """Apply to every element the statistic of its place over all rows. The statistics are as many as the longest trace has places."""
    long = df.select(F.posexplode(trace).alias("pos", "v"))
    stats = long.groupBy("pos").agg(_AGGREGATES["mean" if mode == "first" else mode](F.col("v")).alias("s"))
    places = stats.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda p: p["s"]).alias("stats"))
    out = df.join(F.broadcast(places), how="cross")  # one row
    return out.withColumn(trace, F.zip_with(trace, F.slice("stats", F.lit(1), F.size(trace)), apply)).drop("stats")


def subtract(df: DataFrame, mode: str = "mean", population_wide: bool = False, rows: bool = True, trace: str = "trace") -> DataFrame:
    if not rows:
        return _by_column(df, mode, trace, lambda v, s: v - s)
    return _with_stat(df, mode, trace, population_wide).withColumn(trace, F.transform(trace, lambda v: v - F.col("stat"))).drop("stat")


def divide(df: DataFrame, mode: str = "max", population_wide: bool = False, rows: bool = True, trace: str = "trace") -> DataFrame:
    """A divisor of 0 leaves its row (or column) as it is."""
    if not rows:
        return _by_column(df, mode, trace, lambda v, s: F.when(s == 0, v).otherwise(F.try_divide(v, s)))
    out = _with_stat(df, mode, trace, population_wide)
    return out.withColumn(trace, F.when(F.col("stat") == 0, F.col(trace)).otherwise(F.transform(trace, lambda v: F.try_divide(v, F.col("stat"))))).drop("stat")


def impute_nan(df: DataFrame, fixed_value: float | None = None, trace: str = "trace") -> DataFrame:
    """Fill NULL and NaN elements: with a fixed value, else on the line between the nearest known neighbours, and at the ends with the
    nearest known one. A trace without known elements becomes all NULL."""
    clean = F.transform(trace, lambda v: F.when(~F.isnan(v), v))
    if fixed_value is not None:
        return df.withColumn(trace, F.transform(clean, lambda v: F.coalesce(v, F.lit(float(fixed_value)))))

    def line(c: Column) -> Column:
        # places of the nearest known elements, forwards and backwards, each in one pass
        known = lambda arr: F.aggregate(arr, F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("last"), F.array().cast("array<int>").alias("out")), lambda a, v: A.let(F.when(v.isNotNull(), a["i"] + 1).otherwise(a["last"]), lambda k: F.struct((a["i"] + 1).alias("i"), k.alias("last"), F.concat(a["out"], F.array(k)).alias("out"))), lambda a: a["out"])
        n = F.size(c)
        return A.let(F.struct(known(c).alias("before"), F.reverse(known(F.reverse(c))).alias("after")), lambda p: F.transform(c, lambda v, i: F.coalesce(v, _between(c, F.get(p["before"], i), n - 1 - F.get(p["after"], i), i, n))))

    return df.withColumn(trace, A.let(clean, line))


def _between(c: Column, a: Column, b: Column, i: Column, n: Column) -> Column:
    low, high = F.when(a >= 0, F.get(c, a)), F.when(b < n, F.get(c, b))
    return F.coalesce(low + F.try_divide((high - low) * (i - a), b - a), low, high)


def diff(df: DataFrame, trace: str = "trace") -> DataFrame:
    return df.withColumn(trace, A.diffs_from_zero(trace))


STEPS: dict[str, Callable[..., DataFrame]] = {"subtract": subtract, "divide": divide, "impute_nan": impute_nan, "diff": diff}
DEFAULTS: dict[str, dict[int, Any]] = {
    "min_max": {0: ["subtract", {"mode": "min"}], 1: ["divide", {"mode": "max_abs"}]},
    "mean_std": {0: ["subtract", {"mode": "mean"}], 1: ["divide", {"mode": "std"}]},
}


def run(df: DataFrame, program: Mapping[int, Any] | Mapping[str, str], trace: str = "trace") -> DataFrame:
    """Run {step: name or [name, parameters]} in ascending order of step, or {"default": name of a program}."""
    if "default" in program:
        program = DEFAULTS[program["default"]]
    for k in sorted(program):
        step = program[k]
        name, given = (step, {}) if isinstance(step, str) else (step[0], step[1])
        df = STEPS[name](df, trace=trace, **given)
    return df


def enforce_length(df: DataFrame, min_length: int | None = None, max_length: int | None = None, trace: str = "trace") -> DataFrame:
    """Repeat the first element in front up to min_length; cut at the end to max_length. Each bound stands alone."""
    c = F.col(trace)
    if min_length is not None:
        c = F.when(F.size(c) == 0, c).otherwise(F.concat(F.array_repeat(F.get(c, 0), F.greatest(F.lit(min_length) - F.size(c), F.lit(0))), c))
    if max_length is not None:
        c = F.slice(c, 1, max_length)
    return df.withColumn(trace, c)


def is_ragged(df: DataFrame, trace: str = "trace") -> DataFrame:
    """One row: whether traces differ in length."""
    return df.agg((F.min(F.size(trace)) != F.max(F.size(trace))).alias("ragged"))


def rank_labels(df: DataFrame, column: str, out: str) -> DataFrame:
    """Numbers from 0 for the sorted distinct values of a column; the values are few and broadcast only if Spark finds them small."""
    codes = df.select(column).distinct().where(F.col(column).isNotNull()).withColumn(out, (F.row_number().over(W.orderBy(column)) - 1).cast("int"))
    return df.join(codes, column, "left")
