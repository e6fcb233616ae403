"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import read

_PHRASES = re.compile(r"(?<=[.,!?;:|*$#%&] )")
_RUNS = re.compile(r"\s{0,256}\S{1,256}\s{0,256}|\s{1,256}")
#: Longer phrases are cut after words that a hash picks, one in _ONE_IN, and at _MOST characters at the latest.
_LONG, _ONE_IN, _MOST = 160, 8, 1024
_LOWEST = -(1 << 63)
MAX_BUCKETS = 16_384


class Node(NamedTuple):
    """A node of a tree: its hash's first 8 hex digits, its text's length, and its children (none for a phrase)."""

    short: str
    size: int
    children: tuple


def _hash(kind: bytes, *parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16, person=kind).digest()


def phrases(paragraph: str) -> list[str]:
    """The leaves of a paragraph: it ends a phrase after a mark and a space, and, so that an edit does not move the ends that follow it,
    within a long phrase after words that a hash of theirs picks. Joined they give the paragraph."""
    out = []
    for p in _PHRASES.split(paragraph):
        if len(p) <= _LONG:
            out.append(p)
            continue
        run = ""
        for w in _RUNS.findall(p):
            run += w
            if len(run) > _MOST or zlib.crc32(w.strip().encode("utf-8", "surrogatepass")) % _ONE_IN == 0:
                out.append(run)
                run = ""
        if run:
            out.append(run)
    return out


def sections(text: str) -> list[list[str]]:
    """Paragraphs (lines with their line feeds) by section; a blank line ends its section. Joined they give the text."""
    lines = text.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + lines[-1:]
    out: list[list[str]] = [[]]
    for p in lines:
        if out[-1] and not out[-1][-1].strip():
            out.append([])
        out[-1].append(p)
    return out


def tree(text: str | None) -> tuple[bytes, list[Node]]:
    """(root, sections), each section with its paragraphs and these with their phrases. Each level's hashes are salted by the level, and a
    parent hashes its children's hashes in order, so equal roots mean equal texts."""
    tops, out = [], []
    for s in sections(text or ""):
        below, paragraphs = [], []
        for p in s:
            leaves = phrases(p)
            hashes = [_hash(b"phrase", x.encode("utf-8", "surrogatepass")) for x in leaves]
            below.append(_hash(b"paragraph", *hashes))
            paragraphs.append(Node(below[-1].hex()[:8], len(p), tuple(Node(h.hex()[:8], len(x), ()) for h, x in zip(hashes, leaves, strict=True))))
        tops.append(_hash(b"section", *below))
        out.append(Node(tops[-1].hex()[:8], sum(p.size for p in paragraphs), tuple(paragraphs)))
    return _hash(b"document", *tops), out


Tree = tuple[bytes, list[Node]]


def fingerprint_string(t: Tree) -> str:
    """The root's hash, then the tree: sections parted by ';', each `hash/` and its paragraphs parted by ',', each `hash.` and its phrases,
    each the 8 digits of its hash and 4 of its length."""
    return t[0].hex() + ":" + ";".join(s.short + "/" + ",".join(p.short + "." + "".join(f"{x.short}{x.size:04x}" for x in p.children) for p in s.children) for s in t[1])


def parse(fingerprint: str) -> Tree:
    root, _, rest = fingerprint.partition(":")
    out = []
    for s in rest.split(";"):
        short, _, below = s.partition("/")
        paragraphs = []
        for p in below.split(","):
            own, _, leaves = p.partition(".")
            kids = tuple(Node(leaves[i : i + 8], int(leaves[i + 8 : i + 12], 16), ()) for i in range(0, len(leaves), 12))
            paragraphs.append(Node(own, sum(x.size for x in kids), kids))
        out.append(Node(short, sum(p.size for p in paragraphs), tuple(paragraphs)))
    return bytes.fromhex(root), out


def _aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Places (i, j) of equal nodes, in order: the k-th of a hash in a with the k-th in b, and of these pairs the longest run that
    ascends in both. n log n steps."""
    start, least = 0, min(len(a), len(b))
    while start < least and a[start].short == b[start].short:
        start += 1
    end = 0
    while end < least - start and a[-1 - end].short == b[-1 - end].short:
        end += 1
    places = defaultdict(list)
    for j in range(len(b) - end - 1, start - 1, -1):
        places[b[j].short].append(j)
    pairs = [(i, places[a[i].short].pop()) for i in range(start, len(a) - end) if places.get(a[i].short)]
    tails, at, before = [], [], [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        t = bisect_left(tails, j)
        tails[t : t + 1], at[t : t + 1] = [j], [k]
        before[k] = at[t - 1] if t else -1
    run, k = [], at[-1] if at else -1
    while k >= 0:
        run.append(pairs[k])
        k = before[k]
    return [(i, i) for i in range(start)] + run[::-1] + [(len(a) - e, len(b) - e) for e in range(end, 0, -1)]


def compare(a: Tree, b: Tree) -> tuple[float, list[tuple[int, int]]]:
    """(likeness, edits): twice the share of characters in equal branches, of both texts' (1 for equal texts and no others), and
    (section, paragraph) of each paragraph of b without an equal one in a.

    From the top, equal nodes are aligned in order and only what lies between them is entered, one level further down.
    """
    if a[0] == b[0]:
        return 1.0, []
    edits: list[tuple[int, int]] = []

    def matched(x: list, y: list, level: int, names: list) -> int:
        total, i0, j0 = 0, 0, 0
        for i, j in [*_aligned(x, y), (len(x), len(y))]:
            gap_x, gap_y = x[i0:i], y[j0:j]
            if level == 1:
                edits.extend(names[j0:j])
            if gap_x and gap_y and level < 2:
                below = [(n, k) for n, s in zip(names[j0:j], gap_y, strict=True) for k in range(len(s.children))] if level == 0 else []
                total += matched([c for s in gap_x for c in s.children], [c for s in gap_y for c in s.children], level + 1, below)
            elif gap_y and level == 0:
                edits.extend((n, k) for n, s in zip(names[j0:j], gap_y, strict=True) for k in range(len(s.children)))
            if i < len(x):
                total += x[i].size
            i0, j0 = i + 1, j + 1
        return total

    same = matched(a[1], b[1], 0, list(range(len(b[1]))))
    size = sum(s.size for s in a[1]) + sum(s.size for s in b[1])
    return 2 * same / size if size else 0.0, edits


def likeness(a: Tree, b: Tree) -> float:
    return compare(a, b)[0]


def locate_edits(a: str | None, b: str | None) -> list[tuple[int, int]]:
    """(section, paragraph) of each paragraph of b that has no equal one in its place in a."""
    return compare(tree(a), tree(b))[1]


def _rank(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are below key, by two short scans."""
    if not bounds:
        return F.lit(0)
    w = math.isqrt(len(bounds)) + 1
    rows = [bounds[i : i + w] for i in range(0, len(bounds), w)]
    below = lambda arr: F.size(F.filter(arr, lambda x: x < key))
    whole = below(F.array(*(F.lit(r[-1]).cast("long") for r in rows)))
    row = F.get(F.array(*(F.array(*(F.lit(x).cast("long") for x in r)) for r in rows)), whole)
    return whole * w + F.coalesce(below(row), F.lit(0))


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows (bucket, tail, key, doc_id, text) in partitions of whole buckets, each bucket sorted by descending doc_id and ended by the
    first document of the next one (tail), so that each document's successor follows it.

    Buckets are ranges of doc_id between approximate quantiles, at most MAX_BUCKETS of them; their first ids are all that
    reaches the driver. A text is shuffled once; only a bucket's first document twice.
    """
    spark = docs.sparkSession
    buckets = min(MAX_BUCKETS, buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("key"), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = rows.select("key")
    cuts = keys.agg(F.percentile_approx("key", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] if buckets > 1 else []
    bounds = sorted(set(cuts or []))
    firsts = {r["bucket"]: r["key"] for r in keys.groupBy(_rank(F.col("key"), bounds).alias("bucket")).agg(F.max("key").alias("key")).collect()}
    order = sorted(firsts)
    above = {b: order[(i + 1) % len(order)] for i, b in enumerate(order)}
    to = F.array(*(F.lit(above.get(b, 0)).cast("int") for b in range((order[-1] if order else 0) + 1)))
    bucket = _rank(F.col("key"), bounds).cast("int")
    own = F.struct(bucket.alias("bucket"), F.lit(False).alias("tail"))
    tail = F.struct(F.get(to, bucket).alias("bucket"), F.lit(True).alias("tail"))
    places = F.explode(F.when(F.col("key").isin(list(firsts.values())), F.array(own, tail)).otherwise(F.array(own)))
    dealt = rows.select(places.alias("p"), "key", "doc_id", "text").select("p.*", "key", "doc_id", "text")
    return dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket", "tail", F.desc("key"), "text")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple | None = None  # bucket, doc_id, text, tree
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_branches"]
    branch = pa.struct([("section", pa.int32()), ("paragraph", pa.int32())])
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(branch)]
    for b in batches:
        out: list[tuple] = []
        for bucket, tail, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), (x.as_py() for x in b.column(4)), strict=True):
            own = None
            if last and last[0] == bucket:
                own = tree(text)
                _, doc0, t, s = last
                half = len(t) // 2
                edited = t[: len(t) - half] + text[:half]
                e = tree(edited)
                near, edits = compare(s, e)
                out.append((doc0, len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint_string(s), fingerprint_string(e), near, likeness(s, own), [{"section": i, "paragraph": j} for i, j in edits]))
            last = None if tail else (bucket, doc, text, own or tree(text))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], names)


def edit_fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row for each document: its fingerprint, that of its text with the last half replaced by the start of the next
    document (descending doc_id, after the last the first), how alike these are, and which paragraphs of the edited text differ.

    Null texts are empty texts. Rows with one doc_id follow each other in order of text; rows without doc_id come after all
    others. A lone document is its own next one. An empty table gives an empty result. Columns besides doc_id and text are not read.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_branches array<struct<section: int, paragraph: int>>"
    return with_next(docs, buckets).mapInArrow(_compare, schema)


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(read(spark, sf_dir, "documents"))
