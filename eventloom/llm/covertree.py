"""Exact top-k search by inner product: dual-tree traversal of cover trees over queries and data."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.llm.common import materialize, read

SHRINK = 1.5
LEAF = 48
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
#: Most pivots that cut the space into cells, and most blocks of data, whose roots every task gets. Blocks grow where there would be more.
MAX_PIVOTS = 1024
MAX_BLOCKS = 65_536
#: Blocks that each group of queries is held against first, for its worst k-th score.
SEEDS = 2
_MOST_LONG = (1 << 63) - 1


@dataclass
class CoverTree:
    """Points in tree order; node i covers points[start[i]:end[i]], all within radius[i] of points[center[i]].

    Children of a node lie within its radius / SHRINK of their centers, and centers are further apart than that. Children with
    few points are put together into leaves of up to LEAF points, with the radius that these really have. Children are
    nodes first[i] to first[i] + count[i] - 1; a leaf has none.
    """

    ids: np.ndarray
    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    count: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray) -> CoverTree:
        order = np.arange(len(ids))
        start, end, center, radius, first, count = [0], [len(ids)], [0], [0.0], [0], [0]
        far = lambda at, c: np.sqrt(np.maximum(((points[at] - points[c]) ** 2).sum(1), 0))
        if len(ids):
            radius[0] = float(far(order, 0).max())
        todo = [0]
        while todo:
            node = todo.pop()
            s, e = start[node], end[node]
            if e - s <= LEAF or radius[node] == 0:
                continue
            left, c, reach = order[s:e], center[node], radius[node] / SHRINK
            groups, small = [], []
            while len(left):
                near = far(left, c) <= reach
                near[left == c] = True
                (groups if near.sum() > LEAF // 2 else small).append((c, left[near]))
                left = left[~near]
                c = left[0] if len(left) else c
            bucket: list = []
            for c, got in small:
                if bucket and sum(len(x) for _, x in bucket) + len(got) > LEAF:
                    groups.append((bucket[0][0], np.concatenate([x for _, x in bucket])))
                    bucket = []
                bucket.append((c, got))
            if bucket:
                groups.append((bucket[0][0], np.concatenate([x for _, x in bucket])))
            if len(groups) == 1 and len(groups[0][1]) == e - s and groups[0][0] == center[node] and len(small) == 0:
                radius[node] = float(far(groups[0][1], groups[0][0]).max())
            first[node], count[node] = len(start), len(groups)
            at = s
            for c, got in groups:
                order[at : at + len(got)] = got
                todo.append(len(start))
                start.append(at), end.append(at + len(got)), center.append(c), radius.append(float(far(got, c).max())), first.append(0), count.append(0)
                at += len(got)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        return cls(ids[order], points[order], np.array(start), np.array(end), place[np.array(center)] if len(ids) else np.array(center), np.array(radius), np.array(first), np.array(count))


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether inner products of these whole numbers, and all their partial sums, are exact in doubles."""
    return not len(a) or not len(b) or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53


def dual_search(queries: CoverTree, data: CoverTree, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids), each of one row for each query in queries.ids: its k best by inner product among data with another id, ties
    to the smaller id; -inf where there are fewer. `floor`: a score for each query below which none is wanted.

    The inner products of all pairs under two nodes are at most <c, d> + r |d| + s |c| + r s (centers c, d; radii r, s). A pair
    of nodes goes if that is less than the worst k-th score among the queries under the first. Where doubles would round, scores are
    Python's whole numbers, and only the bounds, which leave a margin, are doubles.
    """
    n = len(queries.ids)
    exact = _exact(queries.points, data.points)
    scores, ids = np.full((n, k), -np.inf, float if exact else object), np.full((n, k), np.iinfo(np.int64).max)
    if floor is not None:
        scores[:, -1] = floor if exact else np.nextafter(floor, -np.inf)
    if not n or not len(data.ids):
        return np.where(ids == np.iinfo(np.int64).max, -np.inf, scores), ids
    qc, dc = queries.points[queries.center], data.points[data.center]
    qn, dn = np.sqrt((qc**2).sum(1)), np.sqrt((dc**2).sum(1))
    slack = 1e-9 * (1 + float(qn.max() + queries.radius.max()) * float(dn.max() + data.radius.max()))

    def bounds(q: int, d: np.ndarray) -> np.ndarray:
        return dc[d] @ qc[q] + queries.radius[q] * dn[d] + data.radius[d] * qn[q] + queries.radius[q] * data.radius[d] + slack

    def compare(q: int, d: np.ndarray) -> None:
        a, b = queries.start[q], queries.end[q]
        at = np.concatenate([np.arange(data.start[x], data.end[x]) for x in d])
        if exact:
            s = queries.points[a:b] @ data.points[at].T
        else:
            whole = lambda p: np.array([[int(v) for v in r] for r in p], object)
            s = whole(queries.points[a:b]) @ whole(data.points[at]).T
        s[queries.ids[a:b, None] == data.ids[None, at]] = -np.inf
        rows = np.flatnonzero((s >= scores[a:b, -1:]).any(1) & (s.max(1) > -np.inf))
        if len(rows):
            got_s = np.concatenate([scores[a + rows], s[rows]], 1)
            got_i = np.concatenate([ids[a + rows], np.broadcast_to(data.ids[at], (len(rows), len(at)))], 1)
            best = np.lexsort((got_i, -got_s), axis=1)[:, :k] if exact else np.array([sorted(range(len(g)), key=lambda x: (-g[x], i[x]))[:k] for g, i in zip(got_s, got_i, strict=True)])
            scores[a + rows], ids[a + rows] = np.take_along_axis(got_s, best, 1), np.take_along_axis(got_i, best, 1)

    todo: list[tuple[float, int, int]] = [(np.inf, 0, 0)]
    while todo:
        bound, q, d = todo.pop()
        if bound < scores[queries.start[q] : queries.end[q], -1].min():
            continue
        if queries.count[q] and (queries.radius[q] >= data.radius[d] or not data.count[d]):
            kids = range(queries.first[q], queries.first[q] + queries.count[q])
            todo += sorted((float(bounds(x, np.array([d]))[0]), x, d) for x in kids)
        elif data.count[d]:
            kids = np.arange(data.first[d], data.first[d] + data.count[d])
            ahead = bounds(q, kids)
            keep = ahead >= scores[queries.start[q] : queries.end[q], -1].min()
            leaves = kids[keep & (data.count[kids] == 0)]
            if len(leaves) and not queries.count[q]:
                for part in np.array_split(leaves[np.argsort(-bounds(q, leaves))], max(1, len(leaves) // 8)):
                    still = part[bounds(q, part) >= scores[queries.start[q] : queries.end[q], -1].min()]
                    if len(still):
                        compare(q, still)
                keep &= data.count[kids] > 0
            todo += sorted((float(x), q, int(y)) for x, y in zip(ahead[keep], kids[keep], strict=True))
        else:
            compare(q, np.array([d]))
    return np.where(ids == np.iinfo(np.int64).max, -np.inf, scores), ids


_TREE = "dim int, block int, tree binary, center array<double>, radius double"


def _plant(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id", kind="stable")
    points = np.stack(pdf["p"].to_numpy()) if len(pdf["p"].iloc[0]) else np.zeros((len(pdf), 0))
    tree = CoverTree.build(pdf["vec_id"].to_numpy(np.int64), points)
    return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "block": pdf["block"].iloc[:1], "tree": [pickle.dumps(tree, protocol=5)], "center": [tree.points[tree.center[0]]], "radius": [tree.radius[0]]})


def _cells(pivots: dict[int, np.ndarray]) -> Callable:
    """Each vector with the nearest pivot of its length."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            cell = np.zeros(len(pdf), np.int32)
            for dim, at in pdf.groupby("dim").indices.items():
                if dim and len(pivots[dim]) > 1:
                    x, c = np.stack(pdf["p"].to_numpy()[at]), pivots[dim]
                    cell[at] = np.argmin((c**2).sum(1) - 2 * (x @ c.T), axis=1)
            yield pdf.assign(cell=cell)

    return run


def _trees(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """A cover tree, with its root's center and radius, for each block of about `rows` vectors of one length and cell, written to the shared
    folder. Larger cells are cut by a hash."""
    sizes = vectors.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["dim", "cell"])
    parts = -(-sizes["n"] // rows)
    sizes = sizes.assign(parts=parts, at=parts.cumsum() - parts)[["dim", "cell", "parts", "at"]].astype("int32")
    placed = vectors.join(F.broadcast(vectors.sparkSession.createDataFrame(sizes, "dim int, cell int, parts int, at int")), ["dim", "cell"])
    dealt = placed.withColumn("block", F.col("at") + F.pmod(F.xxhash64("vec_id", "p"), "parts").cast("int"))
    return materialize(dealt.groupBy("dim", "block").applyInPandas(_plant, _TREE), name)


def _bounds(center: np.ndarray, radius: float, roots: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """No inner product of a vector within `radius` of `center` and one under a root is greater."""
    c, r = roots[1], roots[2]
    top = c @ center + radius * np.sqrt((c**2).sum(1)) + r * np.sqrt(center @ center) + radius * r
    return top + 1e-9 * (1 + np.abs(top))


def _seeds(roots: dict, n: int) -> Callable:
    """(dim, q_block, block): the n blocks of data that may hold the best scores of each block of queries."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for dim, block, center, radius in zip(pdf["dim"], pdf["block"], pdf["center"], pdf["radius"], strict=True):
                own = roots[dim]
                near = own[1] @ center - own[2] * 1e-9
                out += [(dim, block, int(own[0][i])) for i in np.argsort(-near, kind="stable")[:n]]
            yield pd.DataFrame(out, columns=["dim", "q_block", "block"]).astype("int32")

    return run


def _search(k: int) -> Callable:
    """Each row is a tree of queries with floors (or none) and a tree of data."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for q, d, floor in zip(pdf["q_tree"], pdf["tree"], pdf["floor"], strict=True):
            queries, data = pickle.loads(q), pickle.loads(d)
            scores, ids = dual_search(queries, data, k, None if floor is None else np.frombuffer(floor))
            real = (ids < np.iinfo(np.int64).max) & (scores > -np.inf)
            whole = [max(-_MOST_LONG, min(_MOST_LONG, int(x))) for x in scores[real]]
            parts.append(pd.DataFrame({"dim": pdf["dim"].iloc[0], "q_block": pdf["q_block"].iloc[0], "query_id": np.repeat(queries.ids, real.sum(1)), "vec_id": ids[real], "score": np.array(whole, np.int64)}))
        return pd.concat(parts)

    return run


def _wanted(k: int, roots: dict, seeds: int) -> Callable:
    """(dim, q_block, block, floor): the blocks of data that a block of queries has still to meet, by its k-th scores so far (floor), and in
    a row with block -1 how many blocks there are."""

    def run(key: tuple, block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame({"dim": [], "q_block": [], "block": [], "floor": []})
        dim, tree, own = key[0], pickle.loads(block["tree"].iloc[0]), roots[key[0]]
        best = found.sort_values("score", ascending=False).groupby("query_id")["score"]
        kth = best.nth(k - 1)
        floors = pd.Series(kth.to_numpy(), index=found.loc[kth.index, "query_id"]).reindex(tree.ids).to_numpy(float)
        floors = np.where(np.isnan(floors), -np.inf, np.where(np.abs(floors) < 2.0**53, floors, np.nextafter(floors, -np.inf)))
        center, radius = np.asarray(block["center"].iloc[0], float), float(block["radius"].iloc[0])
        met = np.argsort(-(own[1] @ center - own[2] * 1e-9), kind="stable")[:seeds]
        left = _bounds(center, radius, own) >= floors.min()
        left[met] = False
        blocks = [*own[0][left].tolist(), -1]
        return pd.DataFrame({"dim": dim, "q_block": key[1], "block": blocks, "floor": [floors.tobytes()] * (len(blocks) - 1) + [len(own[0]).to_bytes(8, "little")]})

    return run


def _planted(vectors: DataFrame, is_query: Column, block_rows: int, query_rows: int) -> tuple[DataFrame, DataFrame, dict]:
    """Trees of data and of queries, and the data's roots by length: numbers, centers and radii."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("asks")).where("vec_id is not null and v is not null")
    rows = rows.where(F.coalesce(finite, F.lit(False))).select("vec_id", F.transform("v", lambda x: F.floor(x * 64).cast("double")).alias("p"), "asks", F.size("v").alias("dim"))
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    block_rows = max(block_rows, -(-sum(counts.values()) // MAX_BLOCKS))
    pivots = {}
    for dim, n in counts.items():
        some = rows.where(F.col("dim") == dim).groupBy("p").agg(F.min(F.xxhash64("vec_id")).alias("h")).orderBy("h", "p").limit(min(MAX_PIVOTS, -(-n // block_rows))).select("p").toPandas()["p"]
        pivots[dim] = np.stack(some.to_numpy()) if dim else np.zeros((1, 0))
    placed = rows.mapInPandas(_cells(pivots), "vec_id long, p array<double>, asks boolean, dim int, cell int")
    data = _trees(placed.select("vec_id", "p", "dim", "cell"), block_rows, "data-trees")
    asked = rows.where("asks").groupBy("vec_id").agg(F.min("p").alias("p")).select("vec_id", "p", F.lit(True).alias("asks"), F.size("p").alias("dim"))
    asked = asked.mapInPandas(_cells(pivots), "vec_id long, p array<double>, asks boolean, dim int, cell int")
    queries = _trees(asked.select("vec_id", "p", "dim", "cell"), query_rows, "query-trees")
    got = data.select("dim", "block", "center", "radius").orderBy("dim", "block").toPandas()
    roots = {dim: (g["block"].to_numpy(), np.stack(g["center"].to_numpy()).astype(float), g["radius"].to_numpy(float)) for dim, g in got.groupby("dim")}
    return data, queries, roots


def _met(data: DataFrame, queries: DataFrame, roots: dict, k: int, seeds: int) -> tuple[DataFrame, DataFrame]:
    """What the first meetings find, and the meetings that are left to hold."""
    trees = queries.select("dim", F.col("block").alias("q_block"), F.col("tree").alias("q_tree"))
    first = queries.select("dim", "block", "center", "radius").mapInPandas(_seeds(roots, seeds), "dim int, q_block int, block int").withColumn("floor", F.lit(None).cast("binary"))
    schema = "dim int, q_block int, query_id long, vec_id long, score long"
    hold = lambda meet: meet.join(trees, ["dim", "q_block"]).join(data.select("dim", "block", "tree"), ["dim", "block"]).groupBy("dim", "q_block", "block").applyInPandas(_search(k), schema)
    found = materialize(hold(first), "first-found")
    left = queries.withColumnRenamed("block", "q_block").groupBy("dim", "q_block").cogroup(found.groupBy("dim", "q_block")).applyInPandas(_wanted(k, roots, seeds), "dim int, q_block int, block int, floor binary")
    left = materialize(left, "meetings")
    return found.unionByName(hold(left.where("block >= 0"))), left


def block_pairs(vectors: DataFrame, is_query: Column, k: int = 20, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, seeds: int = SEEDS) -> tuple[int, int]:
    """How many pairs of a block of queries and one of data there are, and how many of them are never brought together."""
    data, queries, roots = _planted(vectors, is_query, block_rows, query_rows)
    if not roots:
        return 0, 0
    left = _met(data, queries, roots, k, seeds)[1]
    pairs = sum(int.from_bytes(r["floor"], "little") for r in left.where("block < 0").select("floor").collect())
    held = left.where("block >= 0").count() + sum(min(seeds, len(roots[r["dim"]][0])) for r in queries.select("dim").collect())
    return pairs, pairs - held


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, seeds: int = SEEDS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `vectors` (vec_id, embedding) that is_query holds for, the k others with the
    highest inner product of components floor(64 x), ties to the smaller vec_id.

    Pivots cut the space into cells, and cover trees are planted over blocks of each cell's data and of its queries. Each block of queries
    first meets the `seeds` blocks of data whose centers give it the highest scores; of the others, only those are brought to it whose root
    may hold a score above its queries' worst k-th, and each meeting is a dual-tree search. Every task gets the roots' centers and
    radii, MAX_BLOCKS at most. Vectors that are null, hold null or non-finite components or have no vec_id take no part; vectors are
    compared with those of their length. Rows with a query's own vec_id are never candidates; a query id that occurs twice is answered
    once, with its smallest vector; other repeated rows count as often as they occur. Fewer than k others: all of them. Scores that
    no long holds are returned as the nearest long. An empty table gives an empty result; other columns are not read.
    """
    data, queries, roots = _planted(vectors, is_query, block_rows, query_rows)
    if not roots:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = _met(data, queries, roots, k, seeds)[0]
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP1_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, d.vec_id, list_dot_product(q.v::double[], d.v::double[])::bigint as score from v q join v d on q.vec_id % 20 = 0 and q.vec_id <> d.vec_id)
select query_id, rank::integer as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20
"""
