"""LM scoring by masked pseudo-likelihood: a bidirectional window network, trained and applied in numpy."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import give_back, materialize, read

#: Ids: the most frequent words, then buckets of all others by the hash of their last three characters; then one for places outside a text.
VOCABULARY = 2048
BUCKETS = 256
CLASSES = 32
WIDTH = 16
REACH = (-2, -1, 1, 2)
#: Places to a step of training, and to a block of scoring.
_BATCH = 8192
_SPAN = 65_536
#: A trainer has about so many words, or more where there would be more than _MOST_TRAINERS.
TRAINER_WORDS = 2_000_000
_MOST_TRAINERS = 4096
#: Contexts (hashed) and classes of characters of the spelling model: class 0 ends a word, 1 to 238 are single characters, the others shared.
_CONTEXTS = 2048
_CHARACTERS = 256
_SHARED = 239
_KNOWN_WORDS = 300_000


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp of z, less what is subtracted: the greatest of z or, where values are far apart, of each row; the sums of rows; and what is
    subtracted. In place."""
    top = z.max()
    less = z.max(1) if top - z.min() > 40 else top
    z -= np.reshape(less, (-1, 1))
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype), less


def _softmax(z: np.ndarray) -> np.ndarray:
    z, total, _ = _exp(z)
    z *= (1 / total)[:, None]
    return z


@dataclass
class WindowNet:
    """p(word | two words on each side) = p(class | h) p(word | class, h), with h = tanh(sum over places of embedding * gate + bias).

    Words are in classes of VOCABULARY / CLASSES by frequency, so a word costs two short softmaxes and not one long one.
    """

    embed: np.ndarray
    gate: np.ndarray
    bias: np.ndarray
    to_class: np.ndarray
    class_bias: np.ndarray
    to_word: np.ndarray
    word_bias: np.ndarray

    @classmethod
    def begin(cls, counts: np.ndarray) -> WindowNet:
        """A network that gives the words' frequencies, whatever stands around them."""
        rng = np.random.default_rng(7)
        p = (counts + 1.0) / (counts.sum() + len(counts))
        grid = p.reshape(CLASSES, -1)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        return cls(small(VOCABULARY + 1, WIDTH), np.ones((len(REACH), WIDTH), np.float32) + small(len(REACH), WIDTH), np.zeros(WIDTH, np.float32), small(WIDTH, CLASSES), np.log(grid.sum(1)).astype(np.float32), small(CLASSES, WIDTH, grid.shape[1]), np.log(grid / grid.sum(1, keepdims=True)).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.gate, self.bias, self.to_class, self.class_bias, self.to_word, self.word_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @classmethod
    def of(cls, flat: np.ndarray, like: WindowNet) -> WindowNet:
        out, at = [], 0
        for p in like.parts():
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return cls(*out)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        h = self.bias + self.embed[around[:, 0]] * self.gate[0]
        for k in range(1, len(REACH)):
            h += self.embed[around[:, k]] * self.gate[k]
        return np.tanh(h, out=h)

    def _by_class(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of targets by class, and where each class ends in it."""
        cls = (target // (VOCABULARY // CLASSES)).astype(np.int16)
        order = np.argsort(cls, kind="stable")
        return order, np.searchsorted(cls[order], np.arange(CLASSES + 1))

    def log_probability(self, target: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Of each target given its window."""
        out = np.empty(len(target))
        per = VOCABULARY // CLASSES

        def picked(z: np.ndarray, at: np.ndarray) -> np.ndarray:
            own = z[np.arange(len(z)), at].astype(float)
            _, total, less = _exp(z)
            return own - less - np.log(total)

        for s in range(0, len(target), _BATCH):
            t = target[s : s + _BATCH]
            h = self.hidden(around[s : s + _BATCH])
            got = picked(h @ self.to_class + self.class_bias, t // per)
            order, ends = self._by_class(t)
            hs, ts, words = h[order], t[order] % per, np.empty(len(t))
            for c in range(CLASSES):
                own = slice(ends[c], ends[c + 1])
                if ends[c] < ends[c + 1]:
                    words[own] = picked(hs[own] @ self.to_word[c] + self.word_bias[c], ts[own])
            got[order] += words
            out[s : s + _BATCH] = got
        return out

    def gradients(self, target: np.ndarray, around: np.ndarray) -> list[np.ndarray]:
        """Of the mean of -log p over the batch, in the order of parts()."""
        n, per = len(target), VOCABULARY // CLASSES
        h = self.hidden(around)
        z = _softmax(h @ self.to_class + self.class_bias)
        z[np.arange(n), target // per] -= 1
        z /= n
        back = z @ self.to_class.T
        to_class, class_bias = h.T @ z, z.sum(0)
        to_word, word_bias = np.zeros_like(self.to_word), np.zeros_like(self.word_bias)
        order, ends = self._by_class(target)
        hs, ts, more = h[order], target[order] % per, np.empty_like(h)
        for c in range(CLASSES):
            own = slice(ends[c], ends[c + 1])
            if ends[c] < ends[c + 1]:
                w = _softmax(hs[own] @ self.to_word[c] + self.word_bias[c])
                w[np.arange(len(w)), ts[own]] -= 1
                to_word[c], word_bias[c], more[own] = hs[own].T @ w, w.sum(0), w @ self.to_word[c].T
        to_word /= n
        word_bias /= n
        back[order] += more / h.dtype.type(n)
        back *= 1 - h * h
        embed, gate = np.zeros_like(self.embed), np.empty_like(self.gate)
        for k in range(len(REACH)):
            at = around[:, k].astype(np.int16)
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            sums, ids = np.add.reduceat(back[order], first, axis=0), at[order[first]]
            gate[k] = (sums * self.embed[ids]).sum(0)
            embed[ids] += sums * self.gate[k]
        return [embed, gate, back.sum(0), to_class, class_bias, to_word, word_bias]


def windows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(target, around, document's index) for every place of every document; places outside a text have the id VOCABULARY."""
    pad = np.full(max(REACH), VOCABULARY, np.int32)
    line = np.concatenate([x for d in docs for x in (pad, d)] + [pad])
    sizes = np.array([len(d) for d in docs])
    of = np.repeat(np.arange(len(docs)), sizes)
    at = np.arange(len(of)) + len(pad) * (of + 1)
    return line[at], np.stack([line[at + r] for r in REACH], 1), of


def bucket_of(word: str) -> int:
    return zlib.crc32(word[-3:].encode("utf-8", "surrogatepass")) % BUCKETS


def _spelt(words: list[str], buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells (context, character) that spell each word from its end to its start, which word each is of, and how many characters of a
    shared class each word has. The context of the last character is the word's bucket, of the one before it the bucket and the last,
    of each other, and of the end mark, the two that follow it in the word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    line = "\0".join(w.replace("\0", "\ufffd")[::-1] for w in words) + "\0"
    code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    kind = np.where((code > 32) & (code < 127), code - 32, np.where((code >= 0xC0) & (code < 0x150), code - 0xC0 + 95, _SHARED + code % (_CHARACTERS - _SHARED)))
    kind[code == 0] = 0
    of = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(code)) - (np.cumsum(lengths) - lengths)[of]
    one, two = np.roll(kind, 1), np.roll(kind, 2)
    context = np.where(place == 0, (1 << 20) + buckets[of], np.where(place == 1, (2 << 20) + buckets[of] * _CHARACTERS + one, one * _CHARACTERS + two))
    context = ((context * 0x9E3779B1) >> 15) % _CONTEXTS
    return context * _CHARACTERS + kind, of, np.bincount(of, kind >= _SHARED, len(words))


@dataclass
class Spelling:
    """log p(word | its bucket) by a model of its characters, whose counts are those of all words outside the vocabulary."""

    log_p: np.ndarray

    @classmethod
    def of(cls, cells: np.ndarray, counts: np.ndarray) -> Spelling:
        n = np.zeros(_CONTEXTS * _CHARACTERS)
        n[cells] = counts
        n = n.reshape(_CONTEXTS, _CHARACTERS)
        base = (n.sum(0) + 1) / (n.sum() + _CHARACTERS)
        return cls(np.log((n + 4 * base) / (n.sum(1, keepdims=True) + 4)).astype(np.float32).ravel())

    def log_probability(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        cells, of, shared = _spelt(words, np.fromiter(map(bucket_of, words), np.int64, len(words)))
        return np.bincount(of, self.log_p[cells].astype(float), len(words)) - shared * np.log(65536.0)


@dataclass
class ScoringModel:
    """The vocabulary, the spelling of all other words, and the network over the vocabulary and the buckets."""

    words: list[str]
    spelling: Spelling
    net: WindowNet


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the words met, each in one or more rows; the empty word stands for all words."""
    counts: Counter[str] = Counter()

    def rows() -> pa.RecordBatch:
        counts[""] = counts.total()
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for b in batches:
        for text in b.column(1):
            counts.update(words_of(text.as_py()))
            if len(counts) > 200_000:
                yield rows()
                counts.clear()
    if counts:
        yield rows()
    counts.clear()
    give_back()


def _spell(known: list[str]) -> Callable:
    """(cell, n) of the words outside `known`."""
    common = frozenset(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(_CONTEXTS * _CHARACTERS)
        for b in batches:
            rare = [(w, n) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if w and w not in common]
            if rare:
                words = [w for w, _ in rare]
                cells, of, _ = _spelt(words, np.fromiter(map(bucket_of, words), np.int64, len(words)))
                sums += np.bincount(cells, np.array([n for _, n in rare], float)[of], len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at].astype(np.int64))], ["cell", "n"])

    return run


class WordCodes:
    """Ids and log p(word | bucket) of words; those outside the vocabulary are worked out once and kept while there are not too many."""

    def __init__(self, words: list[str], spelling: Spelling) -> None:
        self.words, self.spelling = words, spelling
        self.clear()

    def clear(self) -> None:
        self.slot = {w: i for i, w in enumerate(self.words)}
        self.ids, self.spelt = np.arange(len(self.words), dtype=np.int16), np.zeros(len(self.words))

    def encode(self, texts: list[list[str]]) -> list[tuple[np.ndarray, float]]:
        """(ids, sum of log p within buckets) of each text's words."""
        if len(self.slot) > _KNOWN_WORDS:
            self.clear()
        new = list(set().union(*texts).difference(self.slot))
        if new:
            self.slot.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
            self.ids = np.concatenate([self.ids, np.fromiter((VOCABULARY - BUCKETS + bucket_of(w) for w in new), np.int16, len(new))])
            self.spelt = np.concatenate([self.spelt, self.spelling.log_probability(new)])
        slot, out = self.slot.__getitem__, []
        for words in texts:
            at = np.fromiter(map(slot, words), np.int64, len(words))
            out.append((self.ids[at], float(self.spelt[at].sum())))
        return out


def _encode(words: list[str], spelling: Spelling) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes(words, spelling)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                got = codes.encode([words_of(t.as_py()) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(i) for i, _ in got], pa.int64()), pa.array([i.tobytes() for i, _ in got], pa.binary()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "text_key", "n_words", "ids", "spelt"])
        del codes
        give_back()

    return run


def encoded(docs: DataFrame, words: list[str], spelling: Spelling) -> DataFrame:
    """(doc_id, text_key, n_words, ids, spelt) of each document, in the shared folder: its ids as 16-bit numbers and the sum of log p(word |
    bucket) of its words outside the vocabulary."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    return materialize(texts.mapInArrow(_encode(words, spelling), "doc_id long, text_key long, n_words long, ids binary, spelt double"), "coded")


def _train(flat: np.ndarray, like: WindowNet, rate: float) -> Callable:
    """One row: the places trained on and the sum of places * weights over the trainers (first column) of a partition, whose documents come
    in order. Each trainer starts from `flat`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, summed, trainer, docs, have, places = 0, np.zeros(len(flat)), None, [], 0, 0
        net, seen = None, []

        def learn() -> None:
            t, a, _ = windows(docs)
            for s in range(0, len(t), _BATCH):
                for p, g, q in zip(net.parts(), net.gradients(t[s : s + _BATCH], a[s : s + _BATCH]), seen, strict=True):
                    q += g * g
                    p -= rate * g / np.sqrt(q)

        for b in batches:
            for own, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if own != trainer:
                    if have:
                        learn()
                    if places:
                        summed += places * net.flat().astype(float)
                        total += places
                    trainer, docs, have, places = own, [], 0, 0
                    net = WindowNet.of(flat, like)
                    seen = [np.full_like(p, 1e-6) for p in net.parts()]
                docs.append(np.frombuffer(ids.as_py(), np.int16))
                have += len(docs[-1])
                places += len(docs[-1])
                if have >= _SPAN:
                    learn()
                    docs, have = [], 0
        if have:
            learn()
        if places:
            summed += places * net.flat().astype(float)
            total += places
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([summed.tobytes()], pa.binary())], ["places", "weights"])

    return run


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"places": [pdf["places"].sum()], "weights": [sum(np.frombuffer(w) for w in pdf["weights"]).tobytes()]})


def fit_network(coded: DataFrame, net: WindowNet, words: int, rounds: int = 1, rate: float = 0.1) -> WindowNet:
    """`net` trained on every place of `coded` (encoded documents of `words` words in all).

    Documents are dealt by a hash to trainers of about TRAINER_WORDS words. Each trains a copy on all its documents, in order of
    doc_id and text, and the copies are averaged, each weighed by its places (parameter mixing). Who trains on what depends on the rows
    alone, not on how they are stored. Sums are added up in a partition, then in groups of partitions; a few arrays come to the driver.
    """
    trainers = max(1, min(_MOST_TRAINERS, -(-words // TRAINER_WORDS)))
    trainer = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(trainers))
    dealt = coded.select(trainer.alias("trainer"), "ids", "doc_id", "text_key").repartitionByRange(trainers, "trainer").sortWithinPartitions("trainer", "doc_id", "text_key").select("trainer", "ids")
    for _ in range(rounds):
        sums = dealt.mapInArrow(_train(net.flat(), net, rate), "places long, weights binary")
        grouped = sums.withColumn("g", F.pmod(F.monotonically_increasing_id().bitwiseXOR(F.spark_partition_id()), F.lit(int(trainers**0.5) + 1)))
        got = [(r["places"], np.frombuffer(r["weights"])) for r in grouped.groupBy("g").applyInPandas(_add, "places long, weights binary").collect()]
        if got:
            net = WindowNet.of(sum(w for _, w in got) / sum(n for n, _ in got), net)
    return net


def _score(net: WindowNet) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = [np.frombuffer(x.as_py(), np.int16) for x in b.column(2)]
            total = b.column(3).to_numpy().copy()
            ends = np.cumsum([len(d) for d in docs])
            at = 0
            while at < len(docs):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SPAN, side="right")))
                target, around, of = windows(docs[at:to])
                if len(of):
                    total[at:to] += np.bincount(of, net.log_probability(target, around), to - at)
                at = to
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total)], ["doc_id", "n_words", "log_likelihood"])

    return run


def fit_vocabulary(docs: DataFrame) -> tuple[list[str], Spelling, WindowNet, int]:
    """The most frequent words of all documents, the spelling of all others, a network that gives their frequencies, and the count of
    all words. What is gathered, the count of every word, grows with the input; what the driver gets has a fixed size."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = materialize(texts.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # the empty word has the count of all, so it comes first
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY - BUCKETS + 1).collect()
    total, top = (top[0]["n"], top[1:]) if top else (0, [])
    words = [r["word"] for r in top]
    cells = counts.mapInArrow(_spell(words), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(VOCABULARY)
    n[: len(top)] = [r["n"] for r in top]
    n[VOCABULARY - BUCKETS :] = max(0, total - n.sum()) / BUCKETS
    return words, Spelling.of(cells["cell"].to_numpy(), cells["n"].to_numpy()), WindowNet.begin(n), total


def train(docs: DataFrame, rounds: int = 1, rate: float = 0.1) -> ScoringModel:
    """Count, spell and fit the network on all documents; `rounds` passes, each from the average of the one before."""
    words, spelling, net, total = fit_vocabulary(docs)
    return ScoringModel(words, spelling, fit_network(encoded(docs, words, spelling), net, total, rounds, rate))


def score_encoded(coded: DataFrame, net: WindowNet) -> DataFrame:
    got = coded.select("doc_id", "n_words", "ids", "spelt").mapInArrow(_score(net), "doc_id long, n_words long, log_likelihood double")
    return got.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def score(docs: DataFrame, model: ScoringModel) -> DataFrame:
    """doc_id, n_words, log_likelihood (sum over all words of log p(word | both sides)), and its mean, for each document.

    A word outside the vocabulary counts as its bucket, given both sides, and then by its spelling, given its bucket. Null and empty texts
    have the sum 0 and no mean. Repeated rows are each scored; columns besides doc_id and text are not read.
    """
    return score_encoded(encoded(docs, model.words, model.spelling), model.net)


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    words, spelling, net, total = fit_vocabulary(docs)
    coded = encoded(docs, words, spelling)
    return score_encoded(coded, fit_network(coded, net, total))
