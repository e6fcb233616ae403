"""The trace features, by name: each builds a Column from a column of array<double>."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import arrays as A

REGISTRY: dict[str, Callable[..., Column]] = {}


def feature(fn: Callable[..., Column]) -> Callable[..., Column]:
    REGISTRY[fn.__name__] = fn
    return fn


def _bound(x: Column, test: Callable[[Column, Column], Column]) -> Column:
    """Sum over neighbours (a, b) of test as 0 or 1."""
    pairs = F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), A.tail(x), lambda a, b: test(a, b))
    return A.count_where(pairs, lambda t: t)


@feature
def mean(x: Column) -> Column:
    return A.mean(x)


@feature
def median(x: Column) -> Column:
    return A.median(x)


@feature
def gmean(x: Column) -> Column:
    """exp(mean(ln x)); 0 where an element is 0, NULL where one is negative."""
    logs = F.exp(A.mean(F.transform(x, lambda v: F.ln(v))))
    return F.when(F.exists(x, lambda v: v < 0), F.lit(None)).when(F.exists(x, lambda v: v == 0), F.lit(0.0)).otherwise(logs)


@feature
def hmean(x: Column) -> Column:
    """n / sum(1 / x); 0 where an element is 0, NULL where one is negative."""
    rate = F.try_divide(F.size(x), A.total(F.transform(x, lambda v: F.try_divide(F.lit(1.0), v))))
    return F.when(F.exists(x, lambda v: v < 0), F.lit(None)).when(F.exists(x, lambda v: v == 0), F.lit(0.0)).otherwise(rate)


@feature
def vec_sum(x: Column) -> Column:
    return A.total(x)


@feature
def abs_sum(x: Column) -> Column:
    return A.total(F.transform(x, F.abs))


@feature
def abs_energy(x: Column) -> Column:
    return A.fold(x, lambda a, v: a + v * v)


@feature
def std(x: Column) -> Column:
    return A.std_pop(x)


@feature
def var(x: Column) -> Column:
    return A.var_pop(x)


@feature
def median_absolute_deviation(x: Column) -> Column:
    return A.let(A.median(x), lambda m: A.median(F.transform(x, lambda v: F.abs(v - m))))


@feature
def variation(x: Column) -> Column:
    return F.try_divide(A.std_pop(x), A.mean(x))


@feature
def minimum(x: Column) -> Column:
    return F.array_min(x)


@feature
def maximum(x: Column) -> Column:
    return F.array_max(x)


@feature
def skew(x: Column) -> Column:
    return F.try_divide(A.central_moment(x, 3), F.pow(A.var_pop(x), F.lit(1.5)))


@feature
def kurt(x: Column) -> Column:
    return F.try_divide(A.central_moment(x, 4), F.pow(A.var_pop(x), F.lit(2))) - 3


@feature
def mean_diff(x: Column) -> Column:
    return F.try_divide(F.try_element_at(x, F.lit(-1)) - F.get(x, 0), F.size(x) - 1)


@feature
def means_abs_diff(x: Column) -> Column:
    return A.mean(F.transform(A.diffs(x), F.abs))


@feature
def mse(x: Column) -> Column:
    """Mean squared magnitude of the discrete Fourier transform: by Parseval the sum of squares."""
    return abs_energy(x)


@feature
def mean_crossings(x: Column) -> Column:
    """Neighbours that lie on different sides of the mean (at the mean counts as neither)."""
    return A.let(A.mean(x), lambda m: _bound(x, lambda a, b: F.signum(a - m) != F.signum(b - m)))


@feature
def mean_abs(x: Column) -> Column:
    return A.mean(F.transform(x, F.abs))


@feature
def zero_crossing(x: Column, threshold: float = 0.0) -> Column:
    """Neighbours of different sign that are at least threshold apart."""
    return _bound(x, lambda a, b: (F.signum(a) != F.signum(b)) & (F.abs(a - b) >= threshold))


@feature
def slope_sign_changes(x: Column, threshold: float = 0.0) -> Column:
    """Inner places with (x[i] - x[i-1]) (x[i] - x[i+1]) >= threshold."""
    at = F.when(F.size(x) >= 3, F.sequence(F.lit(1), F.size(x) - 2)).otherwise(F.array().cast("array<int>"))
    return A.count_where(at, lambda i: (F.get(x, i) - F.get(x, i - 1)) * (F.get(x, i) - F.get(x, i + 1)) >= threshold)


@feature
def waveform_length(x: Column) -> Column:
    return A.total(F.transform(A.diffs(x), F.abs))


@feature
def root_mean_square(x: Column) -> Column:
    return F.sqrt(F.try_divide(abs_energy(x), F.size(x)))


@feature
def emg_var(x: Column) -> Column:
    return F.try_divide(abs_energy(x), F.size(x) - 1)


@feature
def willison_amplitude(x: Column, threshold: float = 0.0) -> Column:
    return A.count_where(A.diffs(x), lambda d: F.abs(d) >= threshold)


@feature
def shannon_entropy(x: Column, base: float = 2.0) -> Column:
    """Entropy of the trace taken as weights; NULL where one is negative or all are 0."""

    def of(s: Column) -> Column:
        return F.when(s > 0, A.fold(F.filter(x, lambda v: v > 0), lambda a, v: a - v / s * F.log(float(base), v / s)))

    return F.when(~F.exists(x, lambda v: v < 0), A.let(A.total(x), of))


@feature
def cid_ce(x: Column, normalize: bool = True) -> Column:
    """Root of the sum of squared differences, of z-scores if normalize (0 for a constant trace)."""
    root = F.sqrt(A.fold(A.diffs(x), lambda a, d: a + d * d))
    return F.coalesce(F.try_divide(root, A.std_pop(x)), F.lit(0.0)) if normalize else root


@feature
def large_standard_deviation(x: Column, r: float = 0.5) -> Column:
    return A.std_pop(x) > r * (F.array_max(x) - F.array_min(x))


@feature
def longest_strike_above_mean(x: Column) -> Column:
    return A.let(A.mean(x), lambda m: A.longest_run(x, lambda v: v > m))


@feature
def longest_strike_below_mean(x: Column) -> Column:
    return A.let(A.mean(x), lambda m: A.longest_run(x, lambda v: v < m))


@feature
def percentage_of_reoccurring_datapoints_to_all_datapoints(x: Column) -> Column:
    """Share of elements whose value occurs more than once; one sort and one pass."""
    start = F.struct(F.lit(None).cast("double").alias("v"), F.lit(0).alias("run"), F.lit(0).alias("n"))

    def step(a: Column, v: Column) -> Column:
        run = F.when(a["v"] == v, a["run"] + 1).otherwise(F.lit(1))
        return F.struct(v.alias("v"), run.alias("run"), (a["n"] + F.when(run == 2, 2).when(run > 2, 1).otherwise(0)).alias("n"))

    return F.try_divide(F.aggregate(F.sort_array(x), start, step, lambda a: a["n"].cast("double")), F.size(x))


@feature
def symmetry_looking(x: Column, r: float = 0.5) -> Column:
    return F.abs(A.mean(x) - A.median(x)) < r * (F.array_max(x) - F.array_min(x))


@feature
def variance_larger_than_standard_deviation(x: Column) -> Column:
    return A.var_pop(x) > A.std_pop(x)


def all_features(df: DataFrame, trace: str = "trace", names: Iterable[str] | None = None, drop_empty: bool = False) -> DataFrame:
    """df with a column v_<name> for each feature; user functions can be added to REGISTRY. With drop_empty, columns that are NULL in
    every row go (one more pass over the data)."""
    names = list(names or REGISTRY)
    out = df.withColumns({f"v_{n}": REGISTRY[n](F.col(trace)) for n in names})
    if drop_empty:
        seen = out.agg(*(F.count(f"v_{n}").alias(n) for n in names)).first()
        out = out.drop(*(f"v_{n}" for n in names if not seen[n]))
    return out
