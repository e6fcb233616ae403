"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import connected_components, discard, materialize, read, scan_files, shuffled

_CHUNK = 1 << 15


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `words` words, repeats included; fewer words: of all of them; none: empty."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)], np.uint64)
    one, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((one(join(t), 42) for t in zip(*(w[i:] for i in range(words)), strict=False)), np.uint64, len(w) - words + 1)


def _majority(h: np.ndarray) -> int:
    """The 64-bit number whose bits are 1 where over half of h have a 1."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _CHUNK):
        ones += np.unpackbits(h[i : i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((ones * 2 > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0])


def _mixed(h: np.ndarray) -> np.ndarray:
    """Another hash of each shingle, from the first (a splitmix64 finaliser)."""
    z = (h + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text; 0 for a text without words."""
    return _majority(shingle_hashes(text, words))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _worker(words: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list[int]] = [[] for _ in range(parts + 1)]
            for text in b.column(1):
                h = shingle_hashes(text.as_py(), words)
                cols[-1].append(len(h))
                for k in range(parts):
                    cols[k].append(_signed(_majority(h)))
                    h = _mixed(h) if k + 1 < parts else h
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", *(f"fp{k}" for k in range(parts)), "n_shingles"])

    return run


def fingerprints(docs: DataFrame, words: int = 3, parts: int = 1) -> DataFrame:
    """(doc_id, fp0 .. , n_shingles): `parts` 64-bit fingerprints of each whole text, as signed longs."""
    schema = "doc_id long, " + ", ".join(f"fp{k} long" for k in range(parts)) + ", n_shingles long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_worker(words, parts), schema)


def _balls(bits: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def hamming_links(prints: DataFrame, distance: int = 2, segments: int = 2) -> DataFrame:
    """(a, b): all pairs a < b of the distinct signed longs in `fp` that differ in at most `distance` bits.

    Multi-index hashing: a fingerprint is cut into segments; of two within the distance, some segment differs in at most
    distance // segments bits. Each fingerprint probes the table of segment values with the small Hamming ball about each of
    its segments, and a match counts once (at the first segment that is near) after its complete distance is verified in the
    join itself, so only true links leave it. Rows shuffled: fingerprints * (segments + sum of ball sizes).
    """
    if 64 % segments:
        raise ValueError("segments must divide 64")
    bits, radius = 64 // segments, distance // segments
    mask = F.lit((1 << bits) - 1 if bits < 64 else -1).cast("long")

    def segment(c: Column, k: int) -> Column:
        return F.shiftrightunsigned(c, k * bits).bitwiseAND(mask)

    def rows(name: str, masks: list[int]) -> DataFrame:
        keys = F.array(*(F.struct(F.lit(k).alias("k"), segment(F.col("fp"), k).alias("v")) for k in range(segments)))
        out = prints.select(F.col("fp").alias(name), F.explode(keys).alias("s"))
        ball = F.explode(F.array(*(F.lit(m).cast("long") for m in masks)))
        return out.select(name, F.col("s.k").alias("k"), F.col("s.v").alias("v")) if len(masks) == 1 else out.select(name, "s", ball.alias("m")).select(name, F.col("s.k").alias("k"), F.col("s.v").bitwiseXOR(F.col("m")).alias("v"))

    gap = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(True)
    for j in range(segments - 1):
        first &= (F.col("k") <= j) | (F.bit_count(segment(gap, j)) > radius)
    joined = rows("a", _balls(bits, radius)).join(shuffled(rows("b", [0])), ["k", "v"])
    return joined.where((F.col("a") < F.col("b")) & (F.bit_count(gap) <= distance) & first).select("a", "b")


def simhash_groups(docs: DataFrame, words: int = 3, distance: int = 2, segments: int = 2) -> DataFrame:
    """(doc_id, fp0, component_id): each document's fingerprint and the smallest doc_id that links of at most `distance`
    differing bits reach, itself included.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows stay repeated. A null doc_id never names
    a component; a component of such rows only has a null component_id. Columns besides doc_id and text are not read.
    Copies share a fingerprint, so a group of copies of any size is one row in the search.
    """
    prints = materialize(fingerprints(docs, words).select("doc_id", "fp0"), "simhash")
    reps = prints.groupBy(F.col("fp0").alias("fp")).agg(F.min("doc_id").alias("rep"))
    roots = connected_components(hamming_links(reps.select("fp"), distance, segments).select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = roots.join(shuffled(reps), roots.node == reps.fp)
    ids = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    near = roots.join(shuffled(ids), "root").select(F.col("node").alias("fp"), "component_id")
    names = reps.join(shuffled(near), "fp", "left").select(F.col("fp").alias("fp0"), F.coalesce("component_id", "rep").alias("component_id"))
    return prints.join(shuffled(names), "fp0").select("doc_id", "fp0", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")


def shingle_prefix(h: np.ndarray, similarity: float, often: np.ndarray) -> np.ndarray:
    """The first len(h) - ceil(similarity * len(h)) + 1 of the distinct hashes h, rare ones first: any set that is similar to h shares one
    of them if it orders alike. `often`: sorted hashes that come last; the empty set has the one hash 0."""
    if not len(h):
        return np.zeros(1, np.uint64)
    at = np.searchsorted(often, h)
    late = np.zeros(len(h), bool)
    late[at < len(often)] = often[at[at < len(often)]] == h[at < len(often)]
    return np.concatenate([h[~late], h[late]])[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]


def _often(docs: DataFrame, words: int, one_in: int = 16, at_least: int = 3, most: int = 200_000) -> np.ndarray:
    """Shingles that many texts have, by a look at one text in `one_in`. They only settle the order of prefixes: links are the same with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.unique(shingle_hashes(t.as_py(), words)) for t in b.column(0)] or [np.empty(0, np.uint64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64))], ["h"])

    some = docs.where(F.pmod("text_key", F.lit(one_in)) == 0).dropDuplicates(["text_key"]).select("text").mapInArrow(run, "h long")
    top = some.groupBy("h").count().where(F.col("count") >= at_least).orderBy(F.desc("count"), "h").limit(most)
    return np.sort(top.select("h").toArrow()["h"].to_numpy().view(np.uint64))


def _keyed_worker(words: int, similarity: float, often: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, size, prefix = [], [], []
            for text in b.column(2):
                h = np.unique(shingle_hashes(text.as_py(), words))
                prints.append(_signed(_majority(h)))
                size.append(len(h))
                prefix.append(shingle_prefix(h, similarity, often).view(np.int64))
            cols = [b.column(0), b.column(1), pa.array(prints, pa.int64()), pa.array(size, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_order", "text_key", "fp", "size", "prefix"])

    return run


def _agree(words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                one, two = (np.unique(shingle_hashes(t.as_py(), words)) for t in (x, y))
                common = len(np.intersect1d(one, two, assume_unique=True))
                near.append(common >= similarity * (len(one) + len(two) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(near, pa.bool_()))

    return run


def nearest_prints(prints: DataFrame, most_differing: int = 18, segments: int = 4) -> DataFrame:
    """(a, b): for each of the distinct prints (fp) at most two others that differ from it in at most `most_differing` bits.

    Multi-index hashing, with one print, the smallest, for each value of a segment in its table: each print probes the tables with a ball
    of radius 1 about each of its segments, and of what it meets within the distance, the nearest print and the smallest are kept. So a
    group of near copies costs in proportion to its size; who shares a link with whom is settled by connected components.
    """
    bits = 64 // segments
    mask = F.lit((1 << bits) - 1).cast("long")
    # a segment's number stands above its value: bits of one key
    keys = F.explode(F.array(*(F.shiftrightunsigned("fp", k * bits).bitwiseAND(mask) + F.lit(k << bits) for k in range(segments))))
    table = prints.select("fp", keys.alias("key")).groupBy("key").agg(F.min("fp").alias("b"))
    balls = F.explode(F.array(*(F.lit(m).cast("long") for m in _balls(bits, 1))))
    probes = prints.select(F.col("fp").alias("a"), keys.alias("s")).select("a", "s", balls.alias("m")).select("a", F.col("s").bitwiseXOR(F.col("m")).alias("key"))
    gap = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    met = probes.join(shuffled(table), "key").where((F.col("a") != F.col("b")) & (gap <= most_differing))
    best = met.groupBy("a").agg(F.min(F.struct(gap.alias("gap"), "b"))["b"].alias("near"), F.min("b").alias("least"))
    return best.select("a", F.explode(F.array_distinct(F.array("near", "least"))).alias("b"))


def _verified(pairs: DataFrame, nodes: DataFrame, slim: DataFrame, words: int, similarity: float, files: int) -> DataFrame:
    """The pairs (u, v) of nodes whose whole texts are similar."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(shuffled(nodes), "node").select("node", "doc_order", "text_key")
    texts = materialize(wanted.join(shuffled(slim), ["doc_order", "text_key"]).select("node", "text").dropDuplicates(["node"]), "near-texts", files)
    one, two = (texts.select(F.col("node").alias(n), F.col("text").alias(t)) for n, t in (("u", "t"), ("v", "s")))
    links = materialize(pairs.join(shuffled(one), "u").join(shuffled(two), "v").select("u", "v", "t", "s").mapInArrow(_agree(words, similarity), "u string, v string"), "near-links", files)
    discard(texts)
    return links


def shingle_pairs(sets: DataFrame, similarity: float, files: int | None = None, rounds: int = 2) -> DataFrame:
    """(u, v): pairs of nodes in different groups that may be similar; all that are, are among them. sets: (node, g, size, prefix).

    Prefix, length and positional filters, which hold at the first shingle that two prefixes share; where both have the same one before
    it, the pair is met there. Shingles of one group only go before the join, whose shuffles need not all exist at once.
    """
    found = None
    for turn in range(rounds):
        keys = sets.select("node", "g", "size", "prefix", F.posexplode("prefix").alias("place", "h")).where(F.pmod("h", F.lit(rounds)) == turn)
        keys = keys.select("h", "node", "g", "size", "place", F.get("prefix", F.col("place") - 1).alias("before"))
        shared = keys.groupBy("h").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high").select("h")
        met = materialize(keys.join(shuffled(shared), "h", "left_semi"), "shingles", files)
        one, two = (met.select("h", *(F.col(c).alias(c + s) for c in ("node", "g", "size", "place", "before"))) for s in "12")
        need = F.lit(similarity / (1 + similarity)) * (F.col("size1") + F.col("size2")) - 1e-6
        most = F.least(F.col("size1") - F.col("place1"), F.col("size2") - F.col("place2"))
        first = F.coalesce(F.col("before1") != F.col("before2"), F.lit(True))
        may = (F.col("g1") != F.col("g2")) & (F.col("node1") < F.col("node2")) & first & ((most >= need) | (F.col("size1") + F.col("size2") == 0))
        pairs = one.join(shuffled(two), "h").where(may).select(F.col("node1").alias("u"), F.col("node2").alias("v")).distinct()
        pairs = materialize(pairs, "shingle-pairs", files)
        discard(met)
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def keep_one_of_each_group(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without all but one of each group of near duplicates: the row with the smallest (doc_id, text's hash) stays, as it is.

    Texts are linked when the Jaccard similarity of their sets of `words`-word shingles is `similarity` or more; groups are what
    links connect, and none is missed. Most links come from 64-bit SimHash prints by multi-index hashing (four segments, each with
    its Hamming ball of radius 1); an exact join on shingles then finds those between the groups that these make. Every link is
    verified on the whole texts. Copies of a text are one node of the search, whatever their number. Texts without words are
    alike; null counts as empty. Rows without doc_id come last. Of equal rows one stays. An empty table gives an empty one; columns
    besides doc_id and text are not read, whatever their names.
    """
    cols = docs.columns
    last = (1 << 63) - 1
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in cols)).alias("row"))
    text = F.col("row.text").cast("string")
    keyed = whole.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(last)).alias("doc_order"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"))
    slim = keyed.select("doc_order", "text_key", text.alias("text"))
    files = scan_files(docs)
    worker = _keyed_worker(words, similarity, _often(slim, words))
    prints = materialize(slim.mapInArrow(worker, "doc_order long, text_key long, fp long, size long, prefix array<long>"), "prints", files)
    node = F.concat(F.hex("text_key"), F.lit(":"), F.hex("fp")).alias("node")
    nodes = materialize(prints.groupBy("text_key", "fp").agg(F.min("doc_order").alias("doc_order")).withColumn("node", node), "nodes", files)
    reps = nodes.groupBy("fp").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n"))
    side = lambda s: reps.select(F.col("fp").alias(s), F.col("rep").alias(s + s))
    apart = nearest_prints(reps.select("fp")).join(shuffled(side("a")), "a").join(shuffled(side("b")), "b").select(F.col("aa").alias("u"), F.col("bb").alias("v"))
    same = nodes.join(shuffled(reps.where("n > 1")), "fp").where("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))
    pairs = materialize(apart.unionByName(same), "near-pairs", files)
    links = _verified(pairs, nodes, slim, words, similarity, files)
    near = connected_components(links, files=files)
    sets = prints.dropDuplicates(["text_key", "fp"]).select(node, "size", "prefix").join(shuffled(near), "node", "left")
    more = materialize(shingle_pairs(sets.select(F.xxhash64("node").alias("node"), F.xxhash64(F.coalesce("root", "node")).alias("g"), "size", "prefix"), similarity, files), "near-pairs", files)
    discard(prints)
    ids = nodes.select("node", F.xxhash64("node").alias("id"))
    named = more.join(shuffled(ids.select(F.col("id").alias("u"), F.col("node").alias("a"))), "u").join(shuffled(ids.select(F.col("id").alias("v"), F.col("node").alias("b"))), "v")
    roots = near
    if not more.isEmpty():
        more = _verified(materialize(named.select(F.col("a").alias("u"), F.col("b").alias("v")), "near-pairs", files), nodes, slim, words, similarity, files)
        roots = near if more.isEmpty() else connected_components(near.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more), files=files)
    grouped = nodes.join(shuffled(roots), "node", "left").withColumn("g", F.coalesce("root", "node"))
    kept = grouped.groupBy("g").agg(F.min(F.struct("doc_order", "text_key")).alias("k")).select("k.*")
    return keyed.join(shuffled(kept), ["doc_order", "text_key"]).dropDuplicates(["doc_order", "text_key"]).select("row.*")
