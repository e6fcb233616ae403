"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback and white-space markers."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import read

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: A byte piece costs this much more than the least likely piece.
BYTE_PENALTY = 10.0
_LONG = 64
_BLOCK_CHARS = 1 << 20


class DoubleArrayTrie:
    """Keys (bytes) to numbers: from a node s, byte c leads to t = base[s] + c + 1 if check[t] == s; value[t] is a key's number or -1."""

    def __init__(self, keys: dict[bytes, int]) -> None:
        kids: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for key, number in keys.items():
            at = 0
            for c in key:
                if c not in kids[at]:
                    kids[at][c] = len(kids)
                    kids.append({})
                    ends.append(-1)
                at = kids[at][c]
            ends[at] = number
        size = 4 * len(kids) + 1024
        base, check, value, free = [0] * size, [-1] * size, [-1] * size, bytearray(b"\1") * size
        free[0], place = 0, [0] * len(kids)
        hint: dict[int, int] = {}
        for node, sons in enumerate(kids):  # parents come before their children
            if not sons:
                continue
            codes = [c + 1 for c in sorted(sons)]
            many = min(len(codes), 8)
            first = max(0, hint.get(many, 0))
            while True:
                first = max(0, free.index(1, first + codes[0]) - codes[0])
                if first + 257 >= len(free):
                    base, check, value, free = base + [0] * len(base), check + [-1] * len(check), value + [-1] * len(value), free + bytearray(b"\1") * len(free)
                if all(free[first + c] for c in codes):
                    break
                first += 1
            hint[many] = first
            s = place[node]
            base[s] = first
            for c, son in sons.items():
                t = first + c + 1
                free[t], check[t], value[t], place[son] = 0, s, ends[son], t
        need = max(max(base), free.rindex(0)) + 258
        pad = lambda a, f: np.array((a + [f] * max(0, need - len(a)))[:need], np.int32)
        self.base, self.check, self.value = pad(base, 0), pad(check, -1), pad(value, -1)


class Unigram:
    """Pieces with log scores.

    The vocabulary file ranks its pieces; piece r (from 0) has the log probability of a Zipf-Mandelbrot law, proportional to
    1 / (r + 2.7). Where the file's scores are log probabilities themselves, pass them as `scores`.
    """

    def __init__(self, pieces: list[str], byte_ids: dict[int, int], scores: list[float] | None = None) -> None:
        plain = {p: i for i, p in enumerate(pieces) if p and i not in set(byte_ids.values())}
        self.pieces, self.byte_id = pieces, [byte_ids[b] for b in range(256)]
        if scores is None:
            law = {i: -float(np.log(r + 2.7)) for r, i in enumerate(plain.values())}
            norm = float(np.log(sum(np.exp(v) for v in law.values())))
            scores = [law.get(i, norm) - norm for i in range(len(pieces))]
        self.score = np.array(scores, float)
        self.byte_score = float(min(self.score[list(plain.values())])) - BYTE_PENALTY
        self.trie = DoubleArrayTrie({p.replace(MARK, " ").encode(): i for p, i in plain.items()})
        self.longest = max(len(p.replace(MARK, " ").encode()) for p in plain)
        is_byte = {i: bytes([b]) for b, i in byte_ids.items()}
        self.bytes_of = [is_byte.get(i) or p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.byte_set = frozenset(is_byte)
        #: No piece reaches from another character to a space, nor over a line feed, so texts may be cut there.
        inner = [p for p in plain if MARK in p.lstrip(MARK)]
        breaks = "" if any("\n" in p for p in plain) else "\n"
        self.units = re.compile(rf" +[^ {breaks}]*|[^ {breaks}]+" + (r"|\n" if breaks else "")) if not inner else re.compile(r"[\s\S]+")
        self.lists = self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist()
        self.table: dict[str, tuple[bytes, float]] = {}

    @classmethod
    def load(cls, path: str) -> Unigram:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        return cls(["" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else sp.id_to_piece(i) for i in range(n)], byte_ids)

    def viterbi(self, unit: bytes) -> tuple[list[int], float]:
        """The ids of the segmentation with the highest sum of scores; of equal ones that whose last pieces start earlier."""
        base, check, value = self.lists
        n = len(unit)
        best, back = [-1e300] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if best[i] == -1e300:
                continue
            s, j = 0, i
            while j < n:
                t = base[s] + unit[j] + 1
                if check[t] != s:
                    break
                s, j = t, j + 1
                if value[t] >= 0 and best[i] + self.score[value[t]] > best[j]:
                    best[j], back[j] = best[i] + self.score[value[t]], (i, value[t])
            size = 1 + (unit[i] >= 0xC0) + (unit[i] >= 0xE0) + (unit[i] >= 0xF0)
            if best[i] + size * self.byte_score > best[i + size]:
                best[i + size], back[i + size] = best[i] + size * self.byte_score, (i, -1)
        ids: list[int] = []
        at = n
        while at:
            i, piece = back[at]
            ids += [piece] if piece >= 0 else [self.byte_id[b] for b in reversed(unit[i:at])]
            at = i
        return ids[::-1], float(best[n])

    def viterbi_many(self, units: list[bytes]) -> list[tuple[list[int], float]]:
        """viterbi of many short units at once: all of them step through the trie together."""
        n, width = len(units), max(map(len, units))
        size = np.array([len(u) for u in units])
        grid = np.frombuffer(b"".join(u.ljust(width, b"\0") for u in units), np.uint8).reshape(n, width)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        best, came, piece = np.full((n, width + 1), -1e300), np.zeros((n, width + 1), np.int16), np.full((n, width + 1), -1, np.int32)
        best[:, 0] = 0.0
        for i in range(width):
            rows = np.flatnonzero((best[:, i] > -1e300) & (i < size))
            if not len(rows):
                continue
            starts, from_ = rows, best[rows, i]
            live, s, have = rows, np.zeros(len(rows), np.int32), from_
            for j in range(i, min(width, i + self.longest)):
                t = base[s] + grid[live, j] + 1
                ok = (check[t] == s) & (j < size[live])
                live, s, have = live[ok], t[ok], have[ok]
                if not len(live):
                    break
                v = value[s]
                hit = v >= 0
                to, new = live[hit], have[hit] + self.score[v[hit]]
                up = new > best[to, j + 1]
                to = to[up]
                best[to, j + 1], came[to, j + 1], piece[to, j + 1] = new[up], i, v[hit][up]
            lead = grid[starts, i]
            step = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0).astype(np.int64)
            new = from_ + step * self.byte_score
            up = new > best[starts, i + step]
            to, step = starts[up], step[up]
            best[to, i + step], came[to, i + step], piece[to, i + step] = new[up], i, -1
        came_, piece_, out = came.tolist(), piece.tolist(), []
        for k, u in enumerate(units):
            ids: list[int] = []
            at, c, p = len(u), came_[k], piece_[k]
            while at:
                i = c[at]
                ids += [p[at]] if p[at] >= 0 else [self.byte_id[b] for b in reversed(u[i:at])]
                at = i
            out.append((ids[::-1], float(best[k, len(u)])))
        return out

    def _learn(self, texts: list[str]) -> None:
        if len(self.table) > 800_000:
            self.table.clear()
        units = {t.encode("utf-8", "surrogatepass"): t for t in texts}
        short = sorted((u for u in units if len(u) <= _LONG), key=len)
        for k in range(0, len(short), 20_000):
            part = short[k : k + 20_000]
            self.table.update((units[u], (array("i", ids).tobytes(), score)) for u, (ids, score) in zip(part, self.viterbi_many(part), strict=True))
        for u in units:
            if len(u) > _LONG:
                ids, score = self.viterbi(u)
                self.table[units[u]] = (array("i", ids).tobytes(), score)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, float]]:
        """(ids, score) of each text. A space is put before a text that is not empty; spaces become the pieces' white-space marker; a
        marker in the text itself is spelt in bytes, so that decoding gives the text again."""
        cut = [self.units.findall(" " + t) if t else [] for t in texts]
        if len(self.table) > 800_000:
            self.table.clear()
        new = set().union(*cut).difference(self.table)  # looks up the new ones; an update in place would go through the whole table
        if new:
            self._learn(list(new))
        get = self.table.__getitem__
        out = []
        for us in cut:
            got = list(map(get, us))
            out.append((np.frombuffer(b"".join([g[0] for g in got]), np.int32), float(sum([g[1] for g in got]))))
        return out

    def decode(self, ids) -> str:
        """The text of ids: markers become spaces, byte pieces bytes, and the space before the text goes."""
        got = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return got[1:] if got[:1] == " " else got


_models: dict[str, Unigram] = {}


def model(path: str) -> Unigram:
    """One model for each worker process."""
    if path not in _models:
        _models[path] = Unigram.load(path)
    return _models[path]


def _blocks(texts: Iterator[str]) -> Iterator[list[str]]:
    block: list[str] = []
    size = 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size >= _BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _encode(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        is_byte = np.zeros(len(m.pieces), bool)
        is_byte[sorted(m.byte_set)] = True
        for b in batches:
            rows: list[tuple] = []
            ids_out = []
            for block in _blocks(x.as_py() or "" for x in b.column(1)):
                for t, (ids, score) in zip(block, m.encode(block), strict=True):
                    back = m.decode(ids.tolist())
                    rows.append((len(ids), int(np.count_nonzero(is_byte[ids])), score, zlib.crc32(ids.astype("<u4").tobytes()), back == t))
                    if with_ids:
                        ids_out.append(ids)
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_()), strict=True)]
            names = ["doc_id", "n_pieces", "n_byte_pieces", "score", "ids_crc32", "round_trip"]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, *([pa.array(ids_out, pa.list_(pa.int32()))] if with_ids else [])], names + ["ids"] * with_ids)

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x.as_py() is None else m.decode(x.as_py()) for x in b.column(1)], pa.string())], ["doc_id", "text"])

    return run


def _path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, score (sum of log scores), ids_crc32 (little-endian unsigned 32-bit ids), round_trip (whether
    decoding gives the text), and ids. Null and empty texts have no pieces. Repeated rows are each encoded."""
    schema = "doc_id long, n_pieces long, n_byte_pieces long, score double, ids_crc32 long, round_trip boolean" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encode(_path(path), with_ids), schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of (doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(_path(path)), "doc_id long, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), with_ids=False)
