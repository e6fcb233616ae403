"""Trace arithmetic on array<double> columns, as higher-order functions: no trace leaves the JVM.

All functions take a Column (or its name) of array<double> and give a Column. Empty traces give NULL statistics. Nulls inside a
trace are skipped by the statistics that say so, and otherwise make the result NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row."""
    return F.get(F.transform(F.array(value), body), 0)


def fold(x: Column | str, step: Callable[[Column, Column], Column], start: float = 0.0) -> Column:
    return F.aggregate(col(x), F.lit(float(start)), step)


def total(x: Column | str) -> Column:
    return fold(x, lambda a, v: a + v)


def mean(x: Column | str) -> Column:
    return F.try_divide(total(x), F.size(col(x)))


def central_moment(x: Column | str, order: int) -> Column:
    return let(mean(x), lambda m: mean(F.transform(col(x), lambda v: F.pow(v - m, F.lit(order)) if order != 2 else (v - m) * (v - m))))


def var_pop(x: Column | str) -> Column:
    return central_moment(x, 2)


def std_pop(x: Column | str) -> Column:
    return F.sqrt(var_pop(x))


def median(x: Column | str) -> Column:
    def mid(s: Column) -> Column:
        n = F.size(s)
        low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
        return (F.get(s, low) + F.get(s, high)) / 2

    return let(F.sort_array(col(x)), mid)


def first(x: Column | str) -> Column:
    return F.get(col(x), 0)


def last(x: Column | str) -> Column:
    return F.try_element_at(col(x), F.lit(-1))


def tail(x: Column | str) -> Column:
    """All but the first element."""
    return F.slice(col(x), 2, F.greatest(F.size(col(x)) - 1, F.lit(0)))


def diffs(x: Column | str) -> Column:
    """First differences; one shorter than the trace."""
    return F.zip_with(F.slice(col(x), 1, F.greatest(F.size(col(x)) - 1, F.lit(0))), tail(x), lambda a, b: b - a)


def diffs_from_zero(x: Column | str) -> Column:
    """First differences after a leading 0; as long as the trace."""
    return F.when(F.size(col(x)) == 0, col(x)).otherwise(F.concat(F.array(F.lit(0.0)), diffs(x)))


def gradient(x: Column | str) -> Column:
    """Central differences, one-sided at both ends; a trace of one gives 0."""
    c, n = col(x), F.size(col(x))
    inner = F.transform(F.sequence(F.lit(1), n - 2), lambda i: (F.get(c, i + 1) - F.get(c, i - 1)) / 2)
    ends = F.when(n == 2, F.array(F.get(c, 1) - F.get(c, 0), F.get(c, 1) - F.get(c, 0))).otherwise(F.array(F.lit(0.0)))
    return F.when(n >= 3, F.concat(F.array(F.get(c, 1) - F.get(c, 0)), inner, F.array(F.get(c, n - 1) - F.get(c, n - 2)))).otherwise(ends)


def count_where(x: Column | str, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(col(x), test))


def longest_run(x: Column | str, test: Callable[[Column], Column]) -> Column:
    """Length of the longest run of elements that pass the test."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(a: Column, v: Column) -> Column:
        now = F.when(test(v), a["now"] + 1).otherwise(F.lit(0))
        return F.struct(now.alias("now"), F.greatest(a["best"], now).alias("best"))

    return F.aggregate(col(x), start, step, lambda a: a["best"])


def dot(x: Column | str, y: Column | str) -> Column:
    return total(F.zip_with(col(x), col(y), lambda a, b: a * b))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation of two traces of one length; NULL where one is constant."""

    def of(m: Column) -> Column:
        pairs = F.zip_with(col(x), col(y), lambda a, b: F.struct((a - m["a"]).alias("a"), (b - m["b"]).alias("b")))
        zero = F.struct(*(F.lit(0.0).alias(n) for n in ("ab", "aa", "bb")))
        add = lambda s, p: F.struct((s["ab"] + p["a"] * p["b"]).alias("ab"), (s["aa"] + p["a"] * p["a"]).alias("aa"), (s["bb"] + p["b"] * p["b"]).alias("bb"))
        return F.aggregate(pairs, zero, add, lambda s: F.try_divide(s["ab"], F.sqrt(s["aa"] * s["bb"])))

    return let(F.struct(mean(x).alias("a"), mean(y).alias("b")), of)


def ragged_pearson(x: Column | str, y: Column | str, compat: bool = False) -> Column:
    """For traces of unequal length: the largest cross-correlation over all shifts at which the shorter lies within the longer, over
    the shorter's length and both deviations. compat divides by max(longer's length, shorter's length * both deviations)."""
    short = F.when(F.size(col(x)) <= F.size(col(y)), col(x)).otherwise(col(y))
    long = F.when(F.size(col(x)) <= F.size(col(y)), col(y)).otherwise(col(x))

    def of(p: Column) -> Column:
        s, g = p["s"], p["g"]
        centered = F.struct(let(mean(s), lambda m: F.transform(s, lambda v: v - m)).alias("s"), let(mean(g), lambda m: F.transform(g, lambda v: v - m)).alias("g"))

        def best(c: Column) -> Column:
            at = F.sequence(F.lit(1), F.size(c["g"]) - F.size(c["s"]) + 1)
            return F.array_max(F.transform(at, lambda i: dot(c["s"], F.slice(c["g"], i, F.size(c["s"])))))

        spread = F.size(s) * std_pop(s) * std_pop(g)
        return F.try_divide(let(centered, best), F.greatest(F.size(g).cast("double"), spread) if compat else spread)

    return let(F.struct(short.alias("s"), long.alias("g")), of)
