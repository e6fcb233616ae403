"""Quality classifier: a generalised additive model with pairwise interactions, fitted by cyclic boosting of shallow trees."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import materialize, read

FEATURES = ("log_bytes", "upper", "digits", "symbols", "shouts", "bars", "stops", "commas", "beyond_ascii", "word_length", "long_words", "marked_words", "distinct_words", "top_word", "distinct_pairs", "distinct_lines", "line_words", "compressed")
#: Most labelled rows that a fit reads on the driver, the first by a hash of doc_id.
MAX_LABELLED = 20_000
THRESHOLD = 0.3
_TOP = (1 << 63) - 1
_SYMBOLS = np.frombuffer(b"#$%&*+<=>@[]^_`{}~\\/", np.uint8)


def text_features(text: str | None) -> list[float]:
    """FEATURES of a whole text, all defined for an empty one."""
    b = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(b))
    c = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    letters = max(1, int(c[65:91].sum() + c[97:123].sum() + c[128:].sum()))
    words = b.split()
    m = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in b.split(b"\n") if x.strip()]
    marked = sum(k for w, k in counts.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:?")
    long = sum(k for w, k in counts.items() if len(w) > 14)
    return [
        float(np.log1p(len(b))), c[65:91].sum() / letters, c[48:58].sum() / n, c[_SYMBOLS].sum() / n, c[33] / n, c[124] / n, c[46] / n, c[44] / n, c[128:].sum() / n,
        sum(len(w) * k for w, k in counts.items()) / m, long / m, marked / m, len(counts) / m, max(counts.values(), default=0) / m,
        len(set(zip(words, words[1:], strict=False))) / max(1, m - 1), len(set(lines)) / max(1, len(lines)), float(np.log1p(m / max(1, len(lines)))), len(zlib.compress(b, 1)) / n,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [text_features(x.as_py()) for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "features"])


@dataclass
class PairGam:
    """score = 1 / (1 + exp(-(intercept + sum of tables[f][bin f] + sum of pair tables[bin f, bin g])))."""

    bins: int = 32
    pair_bins: int = 8
    pairs: int = 6
    rounds: int = 150
    rate: float = 0.1
    smooth: float = 5.0
    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    chosen: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def _leaf(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return g / (h + self.smooth)

    def _step(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The values of a tree of at most two splits on a feature's bins, from sums of gradients and curvatures by bin."""
        cg, ch = np.cumsum(g), np.cumsum(h)
        total_g, total_h = cg[-1], ch[-1]
        value = lambda a, b: a * a / (b + self.smooth)
        n = len(g)
        if n == 1:
            return self._leaf(cg, ch)
        one = value(cg[:-1], ch[:-1]) + value(total_g - cg[:-1], total_h - ch[:-1])
        first = int(np.argmax(one))
        left = value(cg[:first], ch[:first]) + value(cg[first] - cg[:first], ch[first] - ch[:first]) - value(cg[first], ch[first])
        mid = slice(first + 1, n - 1)
        right = value(cg[mid] - cg[first], ch[mid] - ch[first]) + value(total_g - cg[mid], total_h - ch[mid]) - value(total_g - cg[first], total_h - ch[first])
        second = (left.max(), int(np.argmax(left))) if left.size else (0.0, -1)
        third = (right.max(), first + 1 + int(np.argmax(right))) if right.size else (0.0, -1)
        edges = sorted({first, *(e for gain, e in (max(second, third),) if gain > 0)})
        out, at = np.empty(n), 0
        for e in [*edges, n - 1]:
            base_g, base_h = (cg[at - 1], ch[at - 1]) if at else (0.0, 0.0)
            out[at : e + 1] = self._leaf(cg[e] - base_g, ch[e] - base_h)
            at = e + 1
        return out

    def _quarters(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """Gain and values of the best cross of one cut of each of two features, over a grid of sums."""
        G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
        a = (G[:-1, :-1], H[:-1, :-1])
        b = (G[:-1, -1:] - a[0], H[:-1, -1:] - a[1])
        c = (G[-1:, :-1] - a[0], H[-1:, :-1] - a[1])
        d = (G[-1, -1] - a[0] - b[0] - c[0], H[-1, -1] - a[1] - b[1] - c[1])
        if not a[0].size:
            return 0.0, np.zeros_like(g)
        gain = sum(x * x / (y + self.smooth) for x, y in (a, b, c, d))
        i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
        out = np.empty_like(g)
        for (x, y), at in zip((a, b, c, d), (np.s_[: i + 1, : j + 1], np.s_[: i + 1, j + 1 :], np.s_[i + 1 :, : j + 1], np.s_[i + 1 :, j + 1 :]), strict=True):
            out[at] = self._leaf(x[i, j], y[i, j])
        return float(gain[i, j]), out

    def fit(self, x: np.ndarray, y: np.ndarray) -> PairGam:
        n, k = x.shape
        cuts_at = lambda v, m: np.unique(np.quantile(v, np.linspace(0, 1, m + 1)[1:-1])) if n else np.empty(0)
        self.cuts, self.pair_cuts = ([cuts_at(x[:, f], m) for f in range(k)] for m in (self.bins, self.pair_bins))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.chosen, self.pair_tables = [], []
        p = (y.sum() + 1) / (n + 2)
        self.intercept = float(np.log(p / (1 - p)))
        if n < 20 or y.min() == y.max():
            return self
        at = [np.searchsorted(self.cuts[f], x[:, f], side="left") for f in range(k)]
        z = np.full(n, self.intercept)

        def slope() -> tuple[np.ndarray, np.ndarray]:
            q = 1 / (1 + np.exp(-z))
            return y - q, q * (1 - q)

        for _ in range(self.rounds):
            for f in range(k):
                g, h = slope()
                m = len(self.tables[f])
                step = self.rate * self._step(np.bincount(at[f], g, m), np.bincount(at[f], h, m))
                self.tables[f] += step
                z += step[at[f]]
        coarse = [np.searchsorted(self.pair_cuts[f], x[:, f], side="left") for f in range(k)]

        def grid(f: int, e: int, v: np.ndarray) -> np.ndarray:
            a, b = len(self.pair_cuts[f]) + 1, len(self.pair_cuts[e]) + 1
            return np.bincount(coarse[f] * b + coarse[e], v, a * b).reshape(a, b)

        g, h = slope()
        gains = sorted(((self._quarters(grid(f, e, g), grid(f, e, h))[0], f, e) for f in range(k) for e in range(f + 1, k)), reverse=True)
        self.chosen = [(f, e) for _, f, e in gains[: self.pairs]]
        self.pair_tables = [np.zeros((len(self.pair_cuts[f]) + 1, len(self.pair_cuts[e]) + 1)) for f, e in self.chosen]
        for _ in range(self.rounds // 3):
            for t, (f, e) in zip(self.pair_tables, self.chosen, strict=True):
                g, h = slope()
                step = self.rate * self._quarters(grid(f, e, g), grid(f, e, h))[1]
                t += step
                z += step[coarse[f], coarse[e]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, t in enumerate(self.tables):
            z += t[np.searchsorted(self.cuts[f], x[:, f], side="left")]
        for t, (f, e) in zip(self.pair_tables, self.chosen, strict=True):
            z += t[np.searchsorted(self.pair_cuts[f], x[:, f], side="left"), np.searchsorted(self.pair_cuts[e], x[:, e], side="left")]
        return 1 / (1 + np.exp(-z))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of each document; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_measure, "doc_id long, features array<double>")


def held_out(folds: int = 5):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def chosen_labels(labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, good) of at most `most` labelled documents outside the held-out fold, those with the smallest hashes. Several labels of a
    document count as their mean, from 0.5 on as 1; labels of null are left out. Where there are many more, only those below a hash that
    about 1.2 times as many as are asked for lie under are sorted, so what one task sorts does not grow with the table."""
    marks = labels.select(F.col("doc_id").cast("long"), "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    marks, key = marks.where(~held_out()), F.xxhash64("doc_id")
    n = marks.count()
    if n > 2 * most:
        low = marks.where(key <= min(_TOP, (12 * most + 10_000) * 2 * (_TOP + 1) // (10 * n) - _TOP - 1))
        marks = low if low.count() >= most else marks  # else: hashes fell unevenly beyond all likelihood
    return marks.orderBy(key, "doc_id").limit(most)


def fit(measured: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> PairGam:
    """Fit on the chosen labels; these are as few as `max_labelled`, so they are broadcast. Of documents with one doc_id one is learnt from;
    without labels the model gives 0.5 to all."""
    rows = measured.join(F.broadcast(chosen_labels(labels, max_labelled)), "doc_id")
    got = rows.groupBy("doc_id").agg(F.min("features").alias("features"), F.max("good").alias("good")).orderBy("doc_id").toArrow()
    x = np.array(got["features"].to_pylist(), float).reshape(-1, len(FEATURES))
    return PairGam().fit(x, np.array(got["good"].to_pylist(), float))


def _score(model: PairGam):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.names.index("features")
            x = np.array(b.column(at).to_pylist(), float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each document, by a model fitted on `labels` (doc_id, quality).

    The score reads nothing but the text. Null and empty texts have a score too. Repeated rows are each scored; a row without
    doc_id is never held out nor learnt from.
    """
    measured = materialize(features(docs), "features")
    model = fit(measured, labels, max_labelled)
    scored = measured.mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _judge(model: PairGam):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([text_features(t.as_py()) for t in b.column(b.schema.names.index("text"))], float).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= THRESHOLD))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs, as they are, whose score is at least THRESHOLD. The fit reads labelled documents only."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = texts.join(F.broadcast(chosen_labels(labels, max_labelled).select("doc_id")), "doc_id")
    model = fit(materialize(features(known), "features"), labels, max_labelled)
    return docs.mapInArrow(_judge(model), docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
