"""Steps that work through one trace, pair, cluster or tile in order: numpy kernels, applied to groups through Arrow."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.sources.storage import materialize

# --- peaks


def find_peaks(x: np.ndarray, height: float | None = None, prominence: float | None = None, width: float | None = None, distance: int | None = None, wlen: int | None = None, rel_height: float = 0.5, plateau_size: int | None = None) -> pd.DataFrame:
    """Local maxima (the middle of a flat top) with prominence, bases, width and interpolated edges at rel_height of the prominence.

    A base is the lowest place between the peak and the next higher sample on its side, within wlen / 2 samples if wlen is given.
    Of peaks closer than `distance` the higher stays; a flat top has at least plateau_size samples if that is given.
    """
    x = np.asarray(x, float)
    n, peaks, i = len(x), [], 1
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i] and (plateau_size is None or j - i + 1 >= plateau_size):
                peaks.append((i + j) // 2)
            i = j
        i += 1
    if height is not None:
        peaks = [p for p in peaks if x[p] >= height]
    if distance is not None and distance > 1:
        left = set(peaks)
        for p in sorted(peaks, key=lambda q: (-x[q], -q)):
            if p in left:
                left -= {q for q in left if q != p and abs(q - p) < distance}
        peaks = [p for p in peaks if p in left]
    rows = []
    for p in peaks:
        lo, hi = (0, n - 1) if wlen is None else (max(0, p - wlen // 2), min(n - 1, p + wlen // 2))
        i = lb = p
        while i >= lo and x[i] <= x[p]:
            if x[i] < x[lb]:
                lb = i
            i -= 1
        i = rb = p
        while i <= hi and x[i] <= x[p]:
            if x[i] < x[rb]:
                rb = i
            i += 1
        prom = x[p] - max(x[lb], x[rb])
        level = x[p] - rel_height * prom
        i = p
        while lb < i and x[i] > level:
            i -= 1
        left_ip = i + ((level - x[i]) / (x[i + 1] - x[i]) if x[i] < level else 0.0)
        i = p
        while i < rb and x[i] > level:
            i += 1
        right_ip = i - ((level - x[i]) / (x[i - 1] - x[i]) if x[i] < level else 0.0)
        rows.append((p, x[p], prom, lb, rb, left_ip, right_ip, right_ip - left_ip, level))
    out = pd.DataFrame(rows, columns=["peak", "val_peak", "prominence", "left_base", "right_base", "left_ip", "right_ip", "width", "width_height"])
    if prominence is not None:
        out = out[out["prominence"] >= prominence]
    return (out if width is None else out[out["width"] >= width]).reset_index(drop=True)


def simpson(y: np.ndarray) -> float:
    """Area under unit-spaced samples by Simpson's rule; an even number of samples ends with a trapezoid."""
    n = len(y)
    if n < 3:
        return float(np.trapezoid(y)) if n else 0.0
    m = n if n % 2 else n - 1
    area = (y[0] + y[m - 1] + 4 * y[1 : m - 1 : 2].sum() + 2 * y[2 : m - 2 : 2].sum()) / 3
    return float(area + (0 if m == n else (y[-2] + y[-1]) / 2))


PEAKS = "peak long, val_peak double, prominence double, left_base long, right_base long, left_ip double, right_ip double, width double, width_height double, auc double"


def peak_table(signals: DataFrame, by: str = "channel", order: str = "i", value: str = "v", **options) -> DataFrame:
    """find_peaks of each channel's samples in order, with the area between the bases."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf[value].to_numpy(float)
        out = find_peaks(x, **options)
        out["auc"] = [simpson(x[a : b + 1]) for a, b in zip(out["left_base"], out["right_base"], strict=True)]
        out.insert(0, by, pdf[by].iloc[0] if len(pdf) else None)
        return out

    kind = signals.schema[by].dataType.simpleString()
    return signals.select(by, order, value).groupBy(by).applyInPandas(run, f"{by} {kind}, {PEAKS}")


def temporal_mask(voxels: DataFrame, **options) -> DataFrame:
    """(z, x, y): for each pixel the frames [int(left edge), int(right edge)) of its peaks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("z")
        z = pdf["z"].to_numpy()
        found = find_peaks(pdf["v"].to_numpy(float), **options)
        at = np.unique(np.concatenate([np.arange(int(a), int(b)) for a, b in zip(found["left_ip"], found["right_ip"], strict=True)] or [np.empty(0, int)])).astype(int)
        return pd.DataFrame({"z": z[at], "x": pdf["x"].iloc[0], "y": pdf["y"].iloc[0]})

    return voxels.groupBy("x", "y").applyInPandas(run, "z long, x long, y long")


def triangle_level(values: np.ndarray, bins: int = 256) -> float:
    """Triangle threshold: of the histogram's bins from its mode to the end of its longer tail, the center of the one that lies farthest
    below the straight line from the mode's count to zero at that end; ties to the bin nearest the mode."""
    hist, edges = np.histogram(values, bins)
    centers = (edges[:-1] + edges[1:]) / 2
    mode = int(hist.argmax())
    low, high = np.flatnonzero(hist)[[0, -1]]
    end = int(low if mode - low > high - mode else high)
    if end == mode:
        return float(centers[mode])
    way = np.arange(mode, end + (1 if end > mode else -1), 1 if end > mode else -1)
    line = hist[mode] * (1 - np.arange(len(way)) / (len(way) - 1))
    return float(centers[way[int(np.argmax(line - hist[way]))]])


def spatial_mask(voxels: DataFrame, depth: int = 1, ratio: float = 1.1) -> DataFrame:
    """(z, x, y): voxels above the triangle threshold of their frame and `depth` frames on each side, in frames whose mean above it is more
    than `ratio` times the size of the mean below. Frames without all neighbours are empty. Each frame goes to the 2 depth + 1
    groups that need it."""
    dealt = voxels.select("z", "x", "y", "v", F.explode(F.sequence(F.col("z") - depth, F.col("z") + depth)).alias("at"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = int(pdf["at"].iloc[0])
        none = pd.DataFrame({"z": [], "x": [], "y": []}).astype("int64")
        if pdf["z"].nunique() < 2 * depth + 1 or pdf["v"].nunique() < 2:
            return none
        level = triangle_level(pdf["v"].to_numpy(float))
        own = pdf[pdf["z"] == at]
        above = own["v"] > level
        if not above.any() or above.all() or not own["v"][above].mean() > ratio * abs(own["v"][~above].mean()):
            return none
        return own[above][["z", "x", "y"]]

    return dealt.groupBy("at").applyInPandas(run, "z long, x long, y long")


# --- distances


def dtw(a: np.ndarray, b: np.ndarray, window: int | None = None, slope: float | None = None, local: Callable | None = None) -> float:
    """Dynamic time warping: root of the least sum of squared differences along a warping path (with `local`, the least sum of its values),
    within a Sakoe-Chiba band of `window` and an Itakura parallelogram of `slope`."""
    n, m = len(a), len(b)
    if not n or not m:
        return float("nan")
    cost = (np.subtract.outer(a, b) ** 2) if local is None else local(a[:, None], b[None, :])
    i, j = np.indices((n, m))
    if window is not None:
        cost = np.where(np.abs(i * m / n - j) <= max(window, abs(n - m)), cost, np.inf)
    if slope is not None and n > 1 and m > 1:
        u, v = i / (n - 1), j / (m - 1)
        ok = (v <= slope * u + 1e-12) & (v >= u / slope - 1e-12) & (1 - v <= slope * (1 - u) + 1e-12) & (1 - v >= (1 - u) / slope - 1e-12)
        cost = np.where(ok, cost, np.inf)
    acc = np.full((n + 1, m + 1), np.inf)
    acc[0, 0] = 0
    for k in range(2, n + m + 1):  # along antidiagonals, so that each is one vector step
        r = np.arange(max(1, k - m), min(n, k - 1) + 1)
        c = k - r
        acc[r, c] = cost[r - 1, c - 1] + np.minimum(np.minimum(acc[r - 1, c], acc[r, c - 1]), acc[r - 1, c - 1])
    return float(np.sqrt(acc[n, m]) if local is None else acc[n, m])


def dtw_many(a: np.ndarray, others: list[np.ndarray], window: int | None = None, slope: float | None = None, local: Callable | None = None) -> np.ndarray:
    """dtw of one trace with many at once: all their tables are filled together, and each is read at its own length."""
    n, m = len(a), max(map(len, others))
    size = np.array([len(o) for o in others])
    grid = np.zeros((len(others), m))
    for k, o in enumerate(others):
        grid[k, : len(o)] = o
    local_ = local or (lambda x, y: (x - y) ** 2)
    acc = np.full((n + 1, m + 1, len(others)), np.inf)
    acc[0, 0] = 0
    for d in range(2, n + m + 1):
        r = np.arange(max(1, d - m), min(n, d - 1) + 1)
        c = d - r
        cost = local_(a[r - 1, None], grid[:, c - 1].T)
        i, j = r[:, None] - 1, c[:, None] - 1
        if window is not None:
            cost = np.where(np.abs(i * size / n - j) <= np.maximum(window, np.abs(n - size)), cost, np.inf)
        if slope is not None and n > 1:
            u, v = i / (n - 1), j / np.maximum(size - 1, 1)
            ok = (v <= slope * u + 1e-12) & (v >= u / slope - 1e-12) & (1 - v <= slope * (1 - u) + 1e-12) & (1 - v >= (1 - u) / slope - 1e-12)
            cost = np.where(ok | (size < 2), cost, np.inf)
        acc[r, c] = cost + np.minimum(np.minimum(acc[r - 1, c], acc[r, c - 1]), acc[r - 1, c - 1])
    out = acc[n, size, np.arange(len(others))]
    return out if local is not None else np.sqrt(out)


#: Local dissimilarities by name, of broadcast values.
LOCAL: dict[str, Callable] = {
    "euclidean": lambda a, b: np.abs(a - b), "sqeuclidean": lambda a, b: (a - b) ** 2, "cityblock": lambda a, b: np.abs(a - b), "chebyshev": lambda a, b: np.abs(a - b),
    "canberra": lambda a, b: np.where((d := np.abs(a) + np.abs(b)) > 0, np.abs(a - b) / np.where(d > 0, d, 1), 0.0), "braycurtis": lambda a, b: np.where((d := np.abs(a + b)) > 0, np.abs(a - b) / np.where(d > 0, d, 1), 0.0),
    # of single values, as the multivariate definitions give for vectors of one: opposite signs are farthest apart, equal ones alike
    "cosine": lambda a, b: np.where((a == 0) | (b == 0), 0.0, 1 - np.sign(a) * np.sign(b)), "correlation": lambda a, b: np.zeros(np.broadcast(a, b).shape), "minkowski": lambda a, b: np.abs(a - b), "jensenshannon": lambda a, b: np.zeros(np.broadcast(a, b).shape),
    "rbf": lambda a, b: 1 - np.exp(-((a - b) ** 2) / 2), "discrete": lambda a, b: (a != b).astype(float),
}
#: Those that are the absolute difference of single values.
_ABSOLUTE = ("euclidean", "cityblock", "chebyshev", "minkowski")


# --- pairs of rows, block by block

#: Traces of a block and its bytes at most, so many blocks where there are traces enough, and pairs handed on at a time.
BLOCK_ROWS, BLOCK_BYTES, BLOCKS, BATCH = 4096, 1 << 21, 24, 1 << 18
#: Fewer and larger where traces of one length are taken together.
RAGGED_BLOCKS = 10


class Block(NamedTuple):
    """Traces in the order of their keys. sizes: their lengths, -1 of one that is null or has a null; values: one a row, zeros after its end,
    NaN where there is none."""

    keys: np.ndarray
    sizes: np.ndarray
    values: np.ndarray

    def groups(self, at: slice) -> list[tuple[int, np.ndarray]]:
        """(length, rows of values[at]) for each length."""
        order = np.argsort(self.sizes[at], kind="stable")
        lengths, starts = np.unique(self.sizes[at][order], return_index=True)
        return list(zip(lengths.tolist(), np.split(order, starts[1:]), strict=True))


def _block(keys: pa.Array | np.ndarray, traces: pa.ListArray | list) -> Block:
    traces = traces if isinstance(traces, pa.ListArray) else pa.array(traces, pa.list_(pa.float64()), from_pandas=False)
    flat = traces.flatten()
    sizes = np.array(traces.value_lengths().fill_null(0), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    values = np.zeros((len(sizes), int(sizes.max(initial=0))))
    values[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(flat.fill_null(0.0), float)
    bad = np.array(traces.is_null())
    bad[row[np.asarray(flat.is_null())]] = True
    values[bad], sizes[bad] = np.nan, -1
    return Block(np.asarray(keys, np.int64), sizes, values)


def blocks(df: DataFrame, key: str = "id", value: str = "trace", count: int | None = None, whole: bool = False) -> DataFrame:
    """(t, keys, sizes, traces) in the shared folder: about `count` Blocks of rows with neighbouring keys, t in the order of keys. Rows without
    a key are in no pair. whole: rows of one key stay in one block, however many."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(value).cast("array<double>").alias("value")).where(F.col("key").isNotNull())
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("value"))).first()
    most = min(BLOCK_ROWS, max(1, BLOCK_BYTES // (8 * max(width or 0, 1))), max(1, -(-n // (count or max(1, min(BLOCKS, n // 64))))))

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def cut(table: pa.Table, at: int) -> int:
            return int(np.searchsorted(k := np.asarray(table["key"]), k[at - 1], "right")) if whole else at

        def out(rows: pa.Table) -> pa.RecordBatch:
            block = _block(rows["key"].combine_chunks(), rows["value"].combine_chunks())
            return pa.RecordBatch.from_pydict({c: [x.tobytes()] for c, x in zip(("keys", "sizes", "traces"), block, strict=True)})

        for b in it:
            held, size = [*held, b], size + b.num_rows
            if size >= 2 * most:
                table = pa.Table.from_batches(held)
                while size >= 2 * most and (at := cut(table, most)) < size:
                    yield out(table.slice(0, at))
                    table, size = table.slice(at), size - at
                held = table.to_batches()
        table = pa.Table.from_batches(held) if size else None
        while size:
            at = cut(table, size if size <= 1.5 * most else min(most, -(-size // 2)))
            yield out(table.slice(0, at))
            table, size = table.slice(at), size - at

    ranged = rows.repartitionByRange(max(1, -(-n // most)), "key").sortWithinPartitions("key")
    return materialize(ranged.mapInArrow(pack, "keys binary, sizes binary, traces binary").withColumn("t", F.monotonically_increasing_id()), "blocks")


def over_blocks(df: DataFrame, key: str, value: str, work: Callable[[Iterator[tuple[Block, Block, np.ndarray | None]]], Iterator[pa.RecordBatch]], schema: str, count: int | None = None, whole: bool = False) -> DataFrame:
    """`work` over every two blocks (a, b, keep) once, in tasks of a few blocks' product: keep tells the pairs of keys i < j, None that all are.
    Blocks are read from their files wherever they are wanted: nothing is copied for each pair, and a task holds some blocks, never all rows."""
    own = blocks(df, key, value, count, whole)
    one, two = (own.select(*(F.col(c).alias(f"{c}{s}") for c in own.columns)) for s in "ab")
    met = one.join(two.hint("shuffle_replicate_nl"), F.col("ta") <= F.col("tb"))

    def read(keys: bytes, sizes: bytes, traces: bytes) -> Block:
        k = np.frombuffer(keys, np.int64)
        return Block(k, np.frombuffer(sizes, np.int64), np.frombuffer(traces).reshape(len(k), -1))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[Block, Block, np.ndarray | None]]:
            for batch in it:
                for k in range(batch.num_rows):
                    a, b = (read(*(batch[f"{c}{s}"][k].as_buffer() for c in ("keys", "sizes", "traces"))) for s in "ab")
                    yield a, b, None if a.keys[-1] < b.keys[0] else a.keys[:, None] < b.keys[None]

        return work(pairs())

    return met.select(*(f"{c}{s}" for s in "ab" for c in ("keys", "sizes", "traces"))).mapInArrow(run, schema)


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """As SQL rounds: halves away from zero, no negative zero."""
    with np.errstate(invalid="ignore", over="ignore"):
        t = x * 10.0**places
        out = np.rint(t)
        half = np.abs(t - out) == 0.5
    if half.any():
        out = np.where(half, np.trunc(t) + np.sign(t), out)
    out = out / 10.0**places + 0.0
    return out if np.isfinite(t).all() else np.where(np.isfinite(t), out, x)


def pair_table(df: DataFrame, key: str, value: str, measure: Callable[[Block, slice, Block], np.ndarray], name: str = "d", keep_if: Callable[[np.ndarray], np.ndarray] | None = None, places: int | None = None, ragged: bool = False, count: int | None = None) -> DataFrame:
    """(i, j, name) for all i < j, of those whose number passes keep_if: measure(a, rows, b) is the matrix of a's rows with all of b. NULL where
    a trace is null or has a null, or lengths differ, or, if ragged, where that is not a number. places: rounded() to these."""
    chunk = 1 << 22 if ragged else BATCH

    def work(pairs: Iterator[tuple[Block, Block, np.ndarray | None]]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for a, b, keep in pairs:
            step = max(1, chunk // len(b.keys))
            for s in range(0, len(a.keys), step):
                at = slice(s, s + step)
                d, take = measure(a, at, b), None if keep is None else keep[at]
                known = ~np.isnan(d) if ragged else same_length(a, at, b)
                if keep_if is not None:
                    ok = keep_if(d)
                    take = ok if take is None else take & ok
                    take = take if known is None else take & known
                if take is None:
                    got = np.repeat(a.keys[at], len(b.keys)), np.tile(b.keys, len(d)), d.ravel(), known if known is None else known.ravel()
                else:
                    p, q = np.nonzero(take)
                    got = a.keys[at][p], b.keys[q], d[p, q], known if known is None else known[p, q]
                if len(got[0]):
                    held.append(got)
                    size += len(got[0])
                if size >= BATCH:
                    yield from _pair_batches(held, name, places)
                    held, size = [], 0
        yield from _pair_batches(held, name, places)

    return over_blocks(df, key, value, work, f"i long, j long, {name} double", count)


def _pair_batches(held: list, name: str, places: int | None) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    i, j, d = (held[0][k] if len(held) == 1 else np.concatenate([h[k] for h in held]) for k in range(3))
    known = None if all(h[3] is None for h in held) else np.concatenate([np.ones(len(h[0]), bool) if h[3] is None else h[3] for h in held])
    for s in range(0, len(i), BATCH):
        v = slice(s, s + BATCH)
        x = d[v] if places is None else rounded(d[v], places)
        yield pa.RecordBatch.from_arrays([pa.array(i[v]), pa.array(j[v]), pa.array(x, mask=None if known is None else ~known[v])], ["i", "j", name])


def same_length(a: Block, at: slice, b: Block) -> np.ndarray | None:
    """Which pairs have two traces of one length; None if all."""
    x, y = a.sizes[at], b.sizes
    return None if x[0] >= 0 and (x == x[0]).all() and (y == x[0]).all() else (x[:, None] == y) & (x[:, None] >= 0)


def dots(a: Block, at: slice, b: Block) -> np.ndarray:
    """Inner products; no number where lengths differ."""
    w = min(a.values.shape[1], b.values.shape[1])
    r, known = a.values[at, :w] @ b.values[:, :w].T, same_length(a, at, b)
    return r if known is None else np.where(known, r, np.nan)


def gaps(a: Block, at: slice, b: Block) -> np.ndarray:
    """Euclidean distances by inner products; near ones, which these would blur, by their differences."""
    w = min(a.values.shape[1], b.values.shape[1])
    x, y = a.values[at, :w], b.values[:, :w]
    size = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)
    d = x @ y.T
    d *= -2
    d += size
    size *= 2e-3
    near = ~(d > size)
    count = np.count_nonzero(near)
    if count > d.size // 8:
        d[:] = 0
        for k in range(w):
            d += (x[:, k, None] - y[:, k]) ** 2
    elif count:
        p, q = np.nonzero(near)
        for s in range(0, len(p), 1 << 14):
            u, v = p[s : s + (1 << 14)], q[s : s + (1 << 14)]
            d[u, v] = ((x[u] - y[v]) ** 2).sum(1)
    return np.sqrt(d, out=d)


@functools.cache
def _diagonals(n: int, m: int, window: int | None, slope: float | None) -> tuple[list[tuple[int, int, np.ndarray | None]], bool]:
    """Of each antidiagonal of an n x m table (cells from 1): its first and last row within the limits, and the cells between that are not;
    and whether each starts and ends within one row of the two before it."""
    i, j = np.indices((n, m))
    ok = np.ones((n, m), bool)
    if window is not None:
        ok &= np.abs(i * m / n - j) <= max(window, abs(n - m))
    if slope is not None and n > 1 and m > 1:
        u, v = i / (n - 1), j / (m - 1)
        ok &= (v <= slope * u + 1e-12) & (v >= u / slope - 1e-12) & (1 - v <= slope * (1 - u) + 1e-12) & (1 - v >= (1 - u) / slope - 1e-12)
    out = []
    for d in range(2, n + m + 1):
        r = np.arange(max(1, d - m), min(n, d - 1) + 1)
        live = ok[r - 1, d - r - 1]
        if not live.any():
            out.append((1, 0, None))
            continue
        lo, hi = int(r[live][0]), int(r[live][-1])
        inner = live[lo - r[0] : hi - r[0] + 1]
        out.append((lo, hi, None if inner.all() else np.flatnonzero(~inner)))
    even = all(hi >= lo for lo, hi, _ in out) and all(out[k - g][0] <= out[k][0] and out[k][1] <= out[k - g][1] + g for k in range(len(out)) for g in (1, 2) if k >= g)
    return out, even


#: Cells of a diagonal that are worked out at a time: they and their neighbours stay in a core's cache.
CELLS = 1 << 16


def warped(x: np.ndarray, y: np.ndarray, window: int | None = None, slope: float | None = None, local: str | None = None, sizes: np.ndarray | None = None) -> np.ndarray:
    """dtw() of every row of x (all of one length) with every row of y (all of one, or, without limits, of `sizes` with anything after): their
    tables are filled side by side, a diagonal at a time, of which three are held, and only cells within the limits are worked out."""
    (p, n), (q, m) = x.shape, y.shape
    diagonals, even = _diagonals(n, m, window, slope)
    own = LOCAL[local] if local else None
    most = max(h - lo + 1 for lo, h, _ in diagonals)
    width = min(q, max(1, CELLS // most))
    batch = max(1, CELLS // most // q)
    ends = np.full(q, m) + n if sizes is None else sizes + n
    out = np.empty((p, q))
    for s in range(0, p, batch):
        k = min(batch, p - s)
        for t in range(0, q, width):
            w = min(width, q - t)
            down = np.ascontiguousarray(y[t : t + w].T)
            a, b = (np.repeat(x[s : s + k].T, w, axis=1), np.tile(down, (1, k))) if k > 1 else (np.ascontiguousarray(x[s])[:, None], down)
            back, last, now = (np.full((n + 2, k * w), np.inf) for _ in range(3))
            back[0] = 0
            cost = np.empty((most, k * w))
            for d, (lo, hi, out_of) in enumerate(diagonals, 2):
                c, u, v = cost[: hi - lo + 1], a[lo - 1 : hi], b[d - hi - 1 : d - lo][::-1]
                if own is None or local in _ABSOLUTE:
                    np.subtract(u, v, out=c)
                    np.multiply(c, c, out=c) if own is None else np.abs(c, out=c)
                else:
                    c[:] = own(u, v)
                if out_of is not None:
                    c[out_of] = np.inf
                if even:
                    now[lo - 1] = now[hi + 1] = np.inf
                else:
                    now.fill(np.inf)
                e = now[lo : hi + 1]
                np.minimum(last[lo - 1 : hi], last[lo : hi + 1], out=e)
                np.minimum(e, back[lo - 1 : hi], out=e)
                np.add(c, e, out=e)
                back, last, now = last, now, back
                done = ends[t : t + w] == d if d > n else None
                if done is not None and done.any():
                    out[s : s + k, t : t + w][:, done] = last[n].reshape(k, w)[:, done]
    return out if own is not None else np.sqrt(out)


def together(groups: list[tuple[int, np.ndarray]], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their lengths) of groups of neighbouring lengths, merged until each has `least` rows."""
    held = []
    for k, (m, q) in enumerate(groups):
        held.append((m, q))
        if sum(len(q) for _, q in held) >= least or k == len(groups) - 1:
            yield np.concatenate([q for _, q in held]), np.repeat([m for m, _ in held], [len(q) for _, q in held])
            held = []


def pair_distances(df: DataFrame, key: str = "id", value: str = "trace", tiles: int | None = None, measure: Callable[[np.ndarray, np.ndarray], float] | None = None, window: int | None = None, slope: float | None = None, local: str | None = None, sigma: float | None = None) -> DataFrame:
    """(i, j, d) for all i < j: dynamic time warping, or a measure of two traces. NULL for an empty trace and where that is not a number.

    window: a Sakoe-Chiba band; slope: an Itakura parallelogram; local: a name in LOCAL; sigma: exp(-d^2 / sigma^2) in place of d.
    """

    def of(a: Block, at: slice, b: Block) -> np.ndarray:
        d = np.full((len(a.keys[at]), len(b.keys)), np.nan)
        if measure is not None:
            for p, q in zip(*np.nonzero((a.sizes[at, None] >= 0) & (b.sizes >= 0)), strict=True):
                d[p, q] = measure(a.values[at][p, : a.sizes[at][p]], b.values[q, : b.sizes[q]])
        theirs = [] if measure is not None else [g for g in b.groups(slice(None)) if g[0] > 0]
        for n, p in a.groups(at):
            free = window is None and slope is None
            for y, sizes in together(theirs, 1024 // len(p) if free else 1) if n > 0 else ():
                d[np.ix_(p, y)] = warped(a.values[at][p, :n], b.values[y, : sizes.max()], window, slope, local, sizes)
        return d if sigma is None else np.exp(-(d**2) / sigma**2)

    return pair_table(df, key, value, of, ragged=True, count=tiles or RAGGED_BLOCKS)


# --- clustering of a bounded set


def linkage(d: np.ndarray, method: str = "average", rows_as_vectors: bool = False) -> np.ndarray:
    """Merges (left, right, height, size) of a square distance matrix, by nearest pairs with Lance-Williams updates; ties to the smaller ids.
    rows_as_vectors takes the rows for points and links their Euclidean distances."""
    if rows_as_vectors:
        d = np.sqrt(np.maximum(((d[:, None] - d[None]) ** 2).sum(-1), 0))
    n = len(d)
    D = np.array(d, float)
    np.fill_diagonal(D, np.inf)
    ids, size = np.arange(n), np.ones(n)
    alive = np.ones(n, bool)
    out = []
    for step in range(n - 1):
        i, j = divmod(int(np.argmin(D)), n)
        i, j = min(i, j), max(i, j)
        h = D[i, j]
        a, b = sorted((int(ids[i]), int(ids[j])))
        out.append((a, b, float(h), int(size[i] + size[j])))
        if method == "average":
            new = (size[i] * D[i] + size[j] * D[j]) / (size[i] + size[j])
        elif method == "single":
            new = np.minimum(D[i], D[j])
        elif method == "complete":
            new = np.maximum(D[i], D[j])
        elif method == "ward":
            t = size + size[i] + size[j]
            with np.errstate(invalid="ignore"):
                new = np.sqrt(((size + size[i]) * D[i] ** 2 + (size + size[j]) * D[j] ** 2 - size * h * h) / t)
        else:
            raise ValueError(method)
        new[~alive] = np.inf
        new[[i, j]] = np.inf
        D[i], D[:, i], D[j], D[:, j] = new, new, np.inf, np.inf
        size[i] += size[j]
        ids[i], alive[j] = n + step, False
    return np.array(out).reshape(-1, 4)


def average_joins(traces: list, slots: np.ndarray, cutoff: float) -> np.ndarray:
    """The smallest slot of each trace's cluster, of average linkage of Euclidean distances cut at `cutoff`, from clusters named by sorted slots.
    Distances of traces of two lengths, or with nulls, are greater than any."""
    if not len(slots):
        return slots
    block = _block(slots, traces)
    starts = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
    n = np.diff(np.append(starts, len(slots))).astype(float)
    d, known = gaps(block, slice(None), block), same_length(block, slice(None), block)
    d = d if known is None else np.where(known, d, np.inf)
    total = np.add.reduceat(np.add.reduceat(d, starts, axis=1), starts, axis=0)
    names, found = slots[starts], dict(zip(slots[starts].tolist(), slots[starts].tolist(), strict=True))
    while len(names) > 1:
        mean = np.triu(total / np.multiply.outer(n, n), 1)
        mean += mean.T
        np.fill_diagonal(mean, np.inf)
        mean[~(mean <= cutoff)] = np.inf
        near = mean.argmin(1)
        some = mean[np.arange(len(near)), near] < np.inf
        if not some.any():
            break
        one = np.flatnonzero(some & (near[near] == np.arange(len(near))) & (np.arange(len(near)) < near))
        two = near[one]
        total[one] += total[two]
        total[:, one] += total[:, two]
        n[one] += n[two]
        found |= dict(zip(names[two].tolist(), names[one].tolist(), strict=True))
        some[two] = False
        total, n, names = total[np.ix_(some, some)], n[some], names[some]

    def root(s: int) -> int:
        while found[s] != s:
            s = found[s]
        return s

    return np.array([root(s) for s in slots.tolist()], np.int64)


def inconsistency(merges: np.ndarray, n: int, depth: int = 2) -> np.ndarray:
    """For each merge (height - mean) / deviation over the heights of it and the merges at most depth - 1 levels under it; 0 without deviation."""
    out = np.zeros(len(merges))
    for k in range(len(merges)):
        heights, level = [], [k]
        for _ in range(depth):
            heights += [merges[m, 2] for m in level]
            level = [int(c) - n for m in level for c in merges[m, :2] if c >= n]
        spread = np.std(heights, ddof=1) if len(heights) > 1 else 0.0
        out[k] = (merges[k, 2] - np.mean(heights)) / spread if spread > 0 else 0.0
    return out


def _largest_below(merges: np.ndarray, n: int, value: np.ndarray) -> np.ndarray:
    """The largest value of each merge and all under it."""
    out = np.array(value, float)
    for k in range(len(merges)):
        out[k] = max([out[k], *(out[int(c) - n] for c in merges[k, :2] if c >= n)])
    return out


def flat_clusters(merges: np.ndarray, n: int, cutoff: float, criterion: str = "distance", monocrit: np.ndarray | None = None, depth: int = 2) -> np.ndarray:
    """Labels from 1 in the order of items. distance: merges whose and whose parts' heights are <= cutoff; inconsistent: the same of their
    inconsistency; monocrit: of a value for each merge; maxclust and maxclust_monocrit: the least bound on the height or the value
    that leaves at most cutoff clusters."""
    value = {"inconsistent": lambda: inconsistency(merges, n, depth), "monocrit": lambda: monocrit, "maxclust_monocrit": lambda: monocrit}.get(criterion, lambda: merges[:, 2])()
    if value is None:
        raise ValueError(f"{criterion} needs a value for each merge")
    top = _largest_below(merges, n, value)
    if criterion.startswith("maxclust"):
        ranked = np.sort(top)
        keep = max(0, n - int(cutoff))
        cutoff = ranked[keep - 1] if keep and len(ranked) else -np.inf
    parent = list(range(n + len(merges)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (a, b, _, _) in enumerate(merges):
        if top[k] <= cutoff:
            parent[root(int(a))] = parent[root(int(b))] = n + k
    names: dict[int, int] = {}
    return np.array([names.setdefault(root(i), len(names) + 1) for i in range(n)])


def warped_sums(center: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of a trace's samples at each sample of the center that its warping path goes through."""
    n, m = len(center), len(t)
    cost = np.subtract.outer(center, t) ** 2
    acc = np.full((n + 1, m + 1), np.inf)
    acc[0, 0] = 0
    for k in range(2, n + m + 1):
        r = np.arange(max(1, k - m), min(n, k - 1) + 1)
        c = k - r
        acc[r, c] = cost[r - 1, c - 1] + np.minimum(np.minimum(acc[r - 1, c], acc[r, c - 1]), acc[r - 1, c - 1])
    sums, counts = np.zeros(n), np.zeros(n)
    i, j = n, m
    while i and j:
        sums[i - 1] += t[j - 1]
        counts[i - 1] += 1
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda p: acc[p])
    return sums, counts


def barycenters(df: DataFrame, cluster: str = "cluster", key: str = "id", trace: str = "trace", rounds: int = 10) -> DataFrame:
    """(cluster, n, trace) by DTW barycenter averaging, from the member with the smallest key. Each round warps every member to its center where
    it is, and sums are aggregated by cluster and place: no cluster is gathered in one task."""
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.min_by(trace, key).alias("center"))

    def warp(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            got = [warped_sums(np.asarray(c, float), np.asarray(t, float)) for c, t in zip(pdf["center"], pdf["t"], strict=True)]
            yield pd.DataFrame({"c": pdf["c"], "sums": [s.tolist() for s, _ in got], "counts": [k.tolist() for _, k in got]})

    kind = df.schema[cluster].dataType.simpleString()
    centers = sizes
    for _ in range(rounds):
        near = df.select(F.col(cluster).alias("c"), F.col(trace).alias("t")).where(F.size("t") > 0).join(centers.select(F.col(cluster).alias("c"), "center"), "c").mapInPandas(warp, f"c {kind}, sums array<double>, counts array<double>")
        places = near.select("c", F.posexplode(F.arrays_zip("sums", "counts")).alias("p", "v")).groupBy("c", "p").agg((F.sum("v.sums") / F.sum("v.counts")).alias("v"))
        centers = places.groupBy(F.col("c").alias(cluster)).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda r: r["v"]).alias("center"))
    return sizes.select(cluster, "n").join(centers.select(cluster, F.col("center").alias(trace)), cluster)


def modularity_communities(edges: list[tuple[int, int]]) -> dict[int, int]:
    """Greedy modularity: join the pair of communities that gains most until none gains, ties to the smaller members; labels by smallest member.
    A pair is looked after by the one with more neighbours, whose best waits in a heap with the gain that it has or had before others joined,
    which is never less; so a join looks at the neighbours of two communities, not at all pairs."""
    degree: dict[int, int] = {}
    between: dict[int, dict[int, float]] = {}
    for u, v in edges:
        degree[u], degree[v] = degree.get(u, 0) + 1, degree.get(v, 0) + 1
        between.setdefault(u, {})[v] = between.setdefault(v, {})[u] = 1.0
    m = max(1, len(edges))
    group = {u: {u} for u in degree}
    a = {u: d / (2 * m) for u, d in degree.items()}
    own: dict[int, set[int]] = {u: set() for u in degree}
    latest: dict[int, tuple[float, int, int]] = {}
    heap: list[tuple[float, int, int, int]] = []

    def take(u: int, v: int) -> int:
        """The one with more neighbours looks after a pair."""
        one, two = (u, v) if len(between[u]) >= len(between[v]) else (v, u)
        own[one].add(two)
        own[two].discard(one)
        return one

    def push(u: int, entry: tuple[float, int, int]) -> None:
        latest[u] = entry
        heapq.heappush(heap, (*entry, u))

    def scan(u: int) -> None:
        near, twice = between[u], 2 * a[u]
        loss, v = min(((twice * a[v] - near[v] / m, v) for v in own[u]), default=(0.0, u))
        latest.pop(u, None)
        if v != u:
            push(u, (loss, min(u, v), max(u, v)))

    for u, near in between.items():
        for v in near:
            if u < v:
                take(u, v)
    for u in degree:
        scan(u)
    while heap:
        *entry, mine = heapq.heappop(heap)
        loss, u, v = entry
        if latest.get(mine) != (loss, u, v):
            continue
        other = v if mine == u else u
        if other not in own[mine] or 2 * a[u] * a[v] - between[u][v] / m != loss:
            scan(mine)
            continue
        if -loss <= 1e-15:
            break
        group[u] |= group.pop(v)
        theirs = between.pop(v)
        own.pop(v)
        latest.pop(v, None)
        for k, w in theirs.items():
            between[k].pop(v, None)
            own[k].discard(v)
            if k != u:
                between[u][k] = between[u].get(k, 0.0) + w
                between[k][u] = between[u][k]
        between[u].pop(v, None)
        own[u].discard(v)
        a[u] += a.pop(v)
        for k in theirs:  # only these can have gained
            if k != u and take(u, k) == k:
                entry = (2 * a[u] * a[k] - between[u][k] / m, min(u, k), max(u, k))
                if k not in latest or entry < latest[k]:
                    push(k, entry)
        scan(u)
    order = sorted(group.values(), key=min)
    return {n: i for i, g in enumerate(order) for n in g}


def match_greedily(true: list[float], found: list[float], most: float) -> tuple[int, int, int]:
    """(matched, missed, extra): each true time in order takes the nearest found one not yet taken, within `most`."""
    free = sorted(found)
    matched = 0
    for t in sorted(true):
        if free:
            k = min(range(len(free)), key=lambda i: (abs(free[i] - t), i))
            if abs(free[k] - t) <= most:
                free.pop(k)
                matched += 1
    return matched, len(true) - matched, len(free)


def spatial_median(points: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weiszfeld's iteration."""
    y = points.mean(0)
    for _ in range(rounds):
        d = np.maximum(np.sqrt(((points - y) ** 2).sum(1)), 1e-12)
        new = (points / d[:, None]).sum(0) / (1 / d).sum()
        if np.abs(new - y).max() < 1e-10:
            break
        y = new
    return y


# --- images


def frame_shift(frame: np.ndarray, template: np.ndarray, most: int | None = None) -> tuple[int, int]:
    """The whole-pixel shift of a frame against a template, by the peak of their circular cross-correlation."""
    f, t = frame - frame.mean(), template - template.mean()
    c = np.fft.ifft2(np.fft.fft2(f) * np.conj(np.fft.fft2(t))).real
    limit = [min(most if most is not None else n, n // 2 - 1 if n > 3 else 1) for n in c.shape]
    dx, dy = (np.minimum(np.arange(n), n - np.arange(n)) for n in c.shape)
    c = np.where((dx[:, None] <= limit[0]) & (dy[None] <= limit[1]), c, -np.inf)
    i, j = np.unravel_index(int(np.argmax(c)), c.shape)
    return int(i if i <= c.shape[0] // 2 else i - c.shape[0]), int(j if j <= c.shape[1] // 2 else j - c.shape[1])


def motion_shifts(voxels: DataFrame, most: int | None = None) -> DataFrame:
    """(z, dx, dy): each frame's rigid shift against the mean image. The image is one row and goes to every frame's task."""
    image = voxels.groupBy("x", "y").agg(F.avg("v").alias("m"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = lambda c: pdf.pivot(index="x", columns="y", values=c).to_numpy(float)
        dx, dy = frame_shift(grid("v"), grid("m"), most)
        return pd.DataFrame({"z": pdf["z"].iloc[:1], "dx": [dx], "dy": [dy]})

    return voxels.join(image, ["x", "y"]).select("z", "x", "y", "v", "m").groupBy("z").applyInPandas(run, "z long, dx long, dy long")


def correct_motion(voxels: DataFrame, shifts: DataFrame) -> DataFrame:
    return voxels.join(shifts, "z").select("z", (F.col("x") - F.col("dx")).alias("x"), (F.col("y") - F.col("dy")).alias("y"), "v")


def baseline(x: np.ndarray, scale: float = 0.25, prominence: float | None = None, neighbours: int = 25) -> np.ndarray:
    """A trace's baseline: peaks are masked from edge to edge, what is left is thinned to `scale` and carried over by a local thin-plate
    interpolation (r^2 log r in one dimension, with a linear part); a singular system falls back to the line between known samples."""
    n = len(x)
    keep = np.ones(n, bool)
    for a, b in find_peaks(x, prominence=prominence if prominence is not None else float(np.std(x)), rel_height=0.9)[["left_ip", "right_ip"]].itertuples(index=False):
        keep[int(np.floor(a)) : int(np.ceil(b)) + 1] = False
    keep[[0, -1]] = True
    at = np.flatnonzero(keep)
    at = np.unique(np.concatenate([at[:: max(1, int(1 / scale))], at[-1:]]))
    out = np.interp(np.arange(n), at, x[at])
    if len(at) < 4:
        return out
    phi = lambda r: np.where(r > 0, r * r * np.log(np.maximum(r, 1e-12)), 0.0)
    for s in range(0, n, neighbours):
        mid = s + neighbours / 2
        k = np.sort(np.argsort(np.abs(at - mid), kind="stable")[:neighbours])
        p, y = at[k] / n, x[at[k]]
        A = np.block([[phi(np.abs(p[:, None] - p)) + 1e-6 * np.eye(len(p)), np.ones((len(p), 1)), p[:, None]], [np.ones((1, len(p))), np.zeros((1, 2))], [p[None], np.zeros((1, 2))]])
        try:
            w = np.linalg.solve(A, np.concatenate([y, [0, 0]]))
        except np.linalg.LinAlgError:
            continue
        q = np.arange(s, min(n, s + neighbours)) / n
        out[s : s + neighbours] = phi(np.abs(q[:, None] - p)) @ w[:-2] + w[-2] + w[-1] * q
    return out


def baselines(voxels: DataFrame, **options) -> DataFrame:
    """(z, x, y, b): the baseline of every pixel's trace."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("z")
        return pdf[["z", "x", "y"]].assign(b=baseline(pdf["v"].to_numpy(float), **options))

    return voxels.groupBy("x", "y").applyInPandas(run, "z long, x long, y long, b double")


def split_event(z: np.ndarray, x: np.ndarray, y: np.ndarray, v: np.ndarray, distance: int = 3) -> np.ndarray:
    """Sub-events of one event: in each frame, local maxima take over the label of the frame before at their place, else start a label; the
    frame's other voxels take the label of the maximum that they reach by climbing."""
    out = np.zeros(len(z), np.int64)
    before: dict[tuple[int, int], int] = {}
    fresh = 0
    for frame in np.unique(z):
        rows = np.flatnonzero(z == frame)
        at = {(int(x[r]), int(y[r])): r for r in rows}
        up: dict[int, int] = {}
        for (a, b), r in at.items():
            near = [at[p] for dx in range(-distance, distance + 1) for dy in range(-distance, distance + 1) if (p := (a + dx, b + dy)) in at]
            up[r] = max(near, key=lambda q: (v[q], -q))
        names: dict[int, int] = {}
        now: dict[tuple[int, int], int] = {}
        for (a, b), r in sorted(at.items()):
            t = r
            while up[t] != t:
                t = up[t]
            if t not in names:
                held = before.get((int(x[t]), int(y[t])), 0)
                if not held or held in names.values():
                    fresh += 1
                    held = fresh
                names[t] = held
            out[r] = now[(a, b)] = names[t]
        before = now
    return out


def split_events(labelled: DataFrame, distance: int = 3) -> DataFrame:
    """(event_key, z, x, y): voxels (label, z, x, y, v) with keys <label>_<sub-event>."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["z", "x", "y"])
        sub = split_event(*(pdf[c].to_numpy() for c in "zxyv"), distance)
        return pd.DataFrame({"event_key": [f"{k}_{s}" for k, s in zip(pdf["label"], sub, strict=True)], "z": pdf["z"], "x": pdf["x"], "y": pdf["y"]})

    return labelled.groupBy("label").applyInPandas(run, "event_key string, z long, x long, y long")


def bootstrap_interval(values: np.ndarray, statistic: Callable = np.mean, resamples: int = 200, level: float = 0.95, seed: int = 0) -> tuple[float, float, float]:
    """Median and interval of a statistic over resamples."""
    rng = np.random.default_rng(seed)
    got = np.array([statistic(values[rng.integers(0, len(values), len(values))]) for _ in range(resamples)])
    return float(np.median(got)), *(float(q) for q in np.quantile(got, [(1 - level) / 2, (1 + level) / 2]))
