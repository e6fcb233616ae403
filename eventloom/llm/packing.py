"""Packing token sequences: first-fit decreasing with a tournament tree, in randomised groups."""

from __future__ import annotations

import json
import os
import re
import threading
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import give_back, materialize, read

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
_SPACE = re.compile("[\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]+")
_ODD = re.compile(r"[\x1c-\x1f]")
#: Characters for which a chunk goes to the tokenizer whole.
_UNPLAIN = re.compile("[^\x00-\u012f\u0131-\u017f]")
_BLOCK_CHARS = 1 << 20


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_chunks(text: str) -> list[str]:
    """The runs between white space as Unicode has it (str.split() also parts at U+001C to U+001F)."""
    return [w for w in _SPACE.split(text) if w] if _ODD.search(text) else text.split()


class ChunkEncoder:
    """Ids of whole texts (bytes of little-endian unsigned 32-bit numbers), from ids of their chunks, each encoded once.

    The vocabulary's pre-tokenizer drops white space and none of its patterns reaches across it, and its normaliser works on
    chunks alone, so a text's ids are its chunks' ids one after another. A chunk of plain Latin letters and ASCII is lowered
    and parted by the vocabulary's own pattern here, and only words not met before go to the tokenizer; any other chunk goes
    to it whole. The table keeps the first `limit` chunks; later ones are kept until there are `extra` of them. Texts go to
    the tokenizer whole where a vocabulary has other steps.
    """

    def __init__(self, path: str, limit: int = 1_200_000, extra: int = 200_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole, self.limit, self.extra = Tokenizer.from_file(path), limit, extra
        self.index: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.later: list[str] = []
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])], [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.pattern = None
        if steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and spec["post_processor"] is None:
            self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
            # what stands before the run of letters needs an apostrophe: plain letters are one word
            self.letters = re.match(r"('\w+\|)*\[\\p\{L\}\]\+(\||$)", self.pattern.pattern) is not None
            spec |= {"normalizer": None, "pre_tokenizer": spec["pre_tokenizer"]["pretokenizers"][1], "added_tokens": []}
            self.single = Tokenizer.from_str(json.dumps(spec))

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        if len(self.words) > self.limit:
            self.words.clear()
        alone, parts, odd = {}, {}, []
        for c in chunks:
            if self.letters and c.isascii() and c.isalpha():
                alone[c] = c.lower()
            elif not c.isascii() and _UNPLAIN.search(c) or "<|" in c:
                odd.append(c)
            else:
                parts[c] = self.pattern.findall(c.lower())
        new = list(set(alone.values()).union(*parts.values()).difference(self.words))
        if new:
            self.words.update(zip(new, self._ids(self.single, new), strict=True))
        word = self.words.__getitem__
        self.index.update(zip(alone, map(word, alone.values()), strict=True))
        self.index.update({c: b"".join(map(word, p)) for c, p in parts.items()})
        self.index.update(zip(odd, self._ids(self.whole, odd), strict=True))
        if len(self.index) > self.limit:
            self.later += chunks

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        if self.pattern is None:
            for t in texts:
                yield from self._ids(self.whole, [t])
            return
        block: list[list[str]] = []
        size = 0
        for t in texts:
            block.append(split_chunks(t))
            size += len(t)
            if size >= _BLOCK_CHARS:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, block: list[list[str]]) -> Iterator[bytes]:
        if len(self.later) > self.extra:
            for c in self.later:
                del self.index[c]
            self.later = []
        new = set().union(*block).difference(self.index)
        if new:
            self._learn(list(new))
        chunk = self.index.__getitem__
        for words in block:
            yield b"".join(map(chunk, words))


_encoders: dict[str, ChunkEncoder] = {}
_IDLE_SECONDS = 8.0
_uses = 0


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process, until release_when_idle lets it go."""
    global _uses
    _uses += 1
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def release_when_idle() -> None:
    """Drop the encoders with their tables if no task asks for one within _IDLE_SECONDS: an idle worker then holds no memory."""
    now = _uses

    def release() -> None:
        if _uses == now:
            _encoders.clear()
            give_back()

    timer = threading.Timer(_IDLE_SECONDS, release)
    timer.daemon = True
    timer.start()


def _pieces(path: str, size: int, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), array("I", [end_id]).tobytes()
        for b in batches:
            docs, starts, lengths, crcs, totals = [], [], [], [], []
            ids_of = enc.encode((t.as_py() or "") for t in b.column(1))
            for doc, ids in zip(b.column(0).to_pylist(), ids_of, strict=True):
                whole = ids + end
                for at in range(0, len(whole), 4 * size):
                    part = whole[at : at + 4 * size]
                    docs.append(doc), starts.append(at // 4), lengths.append(len(part) // 4), crcs.append(zlib.crc32(part)), totals.append(len(whole) // 4)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, starts, lengths, crcs, totals)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        del enc
        release_when_idle()

    return run


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and what each bin holds; items longest first (ties in the order given), each into the first bin with room.

    A tournament tree holds the most room of any bin under each node, so the first fit is found in a descent.
    """
    n = 1
    while n < max(1, len(lengths)):
        n *= 2
    room = [capacity] * (2 * n)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need, at = lengths[k], 1
        if not 0 < need <= capacity:
            raise ValueError(f"an item of {need} does not fit {capacity}")
        while at < n:
            at *= 2
            if room[at] < need:
                at += 1
        bins[k], offsets[k] = at - n, capacity - room[at]
        room[at] -= need
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
    held = [capacity - r for r in room[n:] if r < capacity]
    return bins, offsets, held


def _pack_group(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets, held = first_fit_decreasing(pdf["length"].tolist(), capacity)
        at = np.array(bins, np.int64)
        used = np.array(held, np.int64)[at]
        out = pdf.drop(columns="part")
        out["sequence_id"] = (pdf["part"].to_numpy(np.int64) << 32) + at
        out["offset"] = np.array(offsets, np.int64)
        out["sequence_length"] = used
        out["padded_length"] = np.where(used & (used - 1) == 0, used, capacity)
        return out

    return run


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, path: str | None = None, size: int = 4096, end_id: int = END_ID) -> DataFrame:
    """Each document's ids and the end id, cut at multiples of `size`. Null texts count as empty: one piece with the end id."""
    path = path or vocabulary_path(VOCABULARY)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(path, size, end_id), PIECE)


def pack(docs: DataFrame, path: str | None = None, capacity: int = 4096, end_id: int = END_ID, group_pieces: int = 4096) -> DataFrame:
    """Pack documents into sequences of at most `capacity` tokens; one row for each piece with its sequence and offset.

    Long documents are cut at multiples of the capacity. Pieces are dealt to groups of about `group_pieces` by a hash of
    document and place, so no group grows with the input or with one long document, and each group is packed by itself.
    `padded_length` is the capacity, or the length itself where that is a power of two. Repeated rows are dealt apart and packed as often as
    they occur; rows without doc_id are packed too. An empty table gives an empty result.
    """
    pieces = materialize(token_pieces(docs, path, capacity, end_id), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    part = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))
    return pieces.withColumn("part", part).groupBy("part").applyInPandas(_pack_group(capacity), f"{PIECE}, sequence_id long, offset long, sequence_length long, padded_length long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
