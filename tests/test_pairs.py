"""Pairs of rows: over blocks that are read where they are wanted, with numbers as brute force gives them."""

import numpy as np
import pytest

from eventloom.operators import graph as G
from eventloom.operators import kernels as K

TRACES = "id long, trace array<double>"


@pytest.fixture(scope="module")
def traces():
    rng = np.random.default_rng(3)
    return {int(k): rng.normal(size=12) + (rng.normal() if k % 4 else 5) for k in rng.permutation(90)}


def frame(spark, rows):
    return spark.createDataFrame([(k, v if v is None else [None if x is None else float(x) for x in v]) for k, v in rows], TRACES)


def table(df):
    rows = [tuple(r) for r in df.collect()]
    got = {r[:2]: r[2] for r in rows}
    assert len(got) == len(rows)
    return got


def brute(traces, of):
    keys = sorted(traces)
    return {(a, b): of(traces[a], traces[b]) for k, a in enumerate(keys) for b in keys[k + 1 :]}


def same(got, want):
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-9) for k in want)


def test_rows_are_not_copied_for_pairs(spark, traces):
    df = frame(spark, traces.items())
    some, more = (K.blocks(df, count=n) for n in (3, 9))
    width = lambda b: b.selectExpr("sum(length(traces))").first()[0]
    assert 2 <= some.count() < more.count() and width(some) == width(more) == 90 * 12 * 8
    for pairs in (G.dot_products(df), G.euclidean_matrix(df), G.pearson_matrix(df, low=0.2), K.pair_distances(df), G.ragged_pearson_matrix(df), G.euclidean_similarities(df, "reverse")):
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan


def test_pair_numbers(spark, traces):
    df = frame(spark, traces.items())
    same(table(G.dot_products(df)), brute(traces, lambda a, b: float(a @ b)))
    same(table(G.euclidean_matrix(df)), brute(traces, lambda a, b: float(np.sqrt(((a - b) ** 2).sum()))))
    far = max(brute(traces, lambda a, b: float(np.sqrt(((a - b) ** 2).sum()))).values())
    same(table(G.euclidean_similarities(df, "gaussian")), brute(traces, lambda a, b: float(np.exp(-((a - b) ** 2).sum() / far**2))))
    r = brute(traces, lambda a, b: float(np.corrcoef(a, b)[0, 1]))
    same(table(G.pearson_matrix(df)), r)
    same(table(G.pearson_matrix(df, low=0.1, high=0.6)), {k: v for k, v in r.items() if 0.1 <= v < 0.6})
    degrees = dict(tuple(x) for x in G.pearson_degrees(df, 0.1, 0.6).collect())
    assert degrees == {n: c for n in traces if (c := sum(n in k and 0.1 <= v < 0.6 for k, v in r.items()))}


def test_odd_rows_in_pairs(spark):
    rows = [(1, [1, 2]), (2, [3, 4]), (2, [5, 6]), (3, [1]), (4, None), (5, [1, None]), (6, []), (None, [1, 1])]
    got = sorted((tuple(r) for r in G.dot_products(frame(spark, rows)).collect()), key=str)
    keys = [k for k, _ in rows if k is not None]
    assert [r[:2] for r in got] == sorted(((a, b) for a in keys for b in keys if a < b), key=str)
    assert sorted(r[2] for r in got if r[2] is not None) == [11, 17] and all(r[:2] == (1, 2) for r in got if r[2] is not None)
    assert frame(spark, rows[:1]).transform(G.dot_products).count() == 0 and frame(spark, []).transform(G.dot_products).count() == 0


def test_near_vectors_are_not_blurred(spark):
    a = np.full(8, 1000.0)
    traces = {0: a, 1: a.copy(), 2: a + 1e-7, 3: -a}
    got = table(G.euclidean_matrix(frame(spark, traces.items())))
    assert got[0, 1] == 0.0 and abs(got[0, 2] - np.sqrt(8) * 1e-7) < 1e-12 and abs(got[0, 3] - 2000 * np.sqrt(8)) < 1e-9


def test_rounded_as_sql():
    x = np.array([0.5, 1.5, -0.5, 2.25, -2.35, -0.04, np.nan, np.inf])
    got = K.rounded(x, 0)
    assert got[:6].tolist() == [1, 2, -1, 2, -2, 0] and not np.signbit(got[5]) and np.isnan(got[6]) and np.isinf(got[7])


@pytest.mark.parametrize("options", [{}, {"window": 0}, {"window": 3}, {"slope": 1.5}, {"slope": 2.0, "window": 2}, {"window": 4, "local": "cityblock"}, {"local": "canberra"}])
@pytest.mark.parametrize("cells", [1, 30, 1 << 16])
def test_warped_tables(options, cells, monkeypatch):
    monkeypatch.setattr(K, "CELLS", cells)
    rng = np.random.default_rng(1)
    plain = options | ({"local": K.LOCAL[options["local"]]} if "local" in options else {})
    for n, m in ((1, 1), (1, 5), (5, 1), (7, 7), (9, 4), (4, 9)):
        x, y = rng.normal(size=(3, n)), rng.normal(size=(5, m))
        assert np.array_equal(K.warped(x, y, **options), [[K.dtw(a, b, **plain) for b in y] for a in x])


def test_ragged_pairs(spark):
    rng = np.random.default_rng(2)
    traces = {k: rng.normal(size=1 + k % 7) for k in range(60)}
    df = frame(spark, [*traces.items(), (60, []), (61, None), (62, [1.0, 1.0])])
    none = {(a, b): None for a in range(62) for b in (60, 61) if a < b} | {(a, 62): None for a in (60, 61)}
    same(table(K.pair_distances(df, tiles=3)), brute(traces, K.dtw) | none | {(a, 62): float(K.dtw(traces[a], np.ones(2))) for a in traces})

    def best(a, b):
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        spread = len(a) * a.std() * b.std()
        return float(np.correlate(b - b.mean(), a - a.mean(), "valid").max() / spread) if spread > 0 else None

    same(table(G.ragged_pearson_matrix(df)), brute(traces, best) | none | {(a, 62): None for a in traces})


def test_edges_stay_where_they_are(spark, traces):
    df = frame(spark, traces.items())
    edges, r = G.pearson_matrix(df, low=0.2), brute(traces, lambda a, b: float(np.corrcoef(a, b)[0, 1]))
    named = G.map_edges(edges, df.selectExpr("id as i_idx", "id + 1000 as trace_idx"))
    modules = G.edge_modules(edges, df.selectExpr("id as node", "id % 3 as module"))
    for d in (named, modules):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    near = {k for k, v in r.items() if v >= 0.2}
    assert {tuple(x) for x in named.collect()} == {(a + 1000, b + 1000) for a, b in near}
    assert {(x.i, x.j): x.module for x in modules.collect()} == {(a, b): a % 3 if a % 3 == b % 3 else -1 for a, b in near}


def test_histogram_in_blocks(spark, traces):
    r = np.array(list(brute(traces, lambda a, b: float(np.corrcoef(a, b)[0, 1])).values()))
    got = dict(tuple(x) for x in G.pearson_histogram(frame(spark, traces.items()), -0.5, 0.5, 7).collect())
    assert [got[k] for k in range(7)] == np.histogram(r, 7, (-0.5, 0.5))[0].tolist()


@pytest.mark.parametrize(("cutoff", "few"), [(0.0, 340), (0.6, 340), (9.0, 340), (0.3, 0), (1.1, 150)])
def test_average_clusters_as_linkage(spark, cutoff, few, monkeypatch):
    monkeypatch.setattr(G, "FEW_ITEMS", few)
    rng = np.random.default_rng(5)
    points = rng.normal(size=(340, 3))
    points[40:60] = points[20]  # copies of one
    points[60:90] = points[7] + rng.normal(scale=0.01, size=(30, 3))
    df = frame(spark, [(int(k) * 3, points[k]) for k in rng.permutation(340)])
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    got = dict(tuple(r) for r in G.average_clusters(df, cutoff).collect())
    assert [got[3 * k] for k in range(340)] == K.flat_clusters(K.linkage(d), 340, cutoff).tolist()


def test_average_clusters_of_odd_rows(spark):
    got = dict(tuple(r) for r in G.average_clusters(frame(spark, [(4, [1, 1]), (2, None), (9, [1, 2]), (5, [1]), (7, [1, None]), (8, [9, 9])]), 1.5).collect())
    assert got == {2: 1, 4: 2, 9: 2, 5: 3, 7: 4, 8: 5}


def slow_modularity(edges):
    """As the definition says: the best of all pairs, each time."""
    nodes = sorted({n for e in edges for n in e})
    group, m = {n: {n} for n in nodes}, len(edges)
    degree = {n: sum(n in e for e in edges) for n in nodes}
    while True:
        best = (1e-15, 0, 0)
        for u in group:
            for v in group:
                w = sum((a in group[u] and b in group[v]) or (b in group[u] and a in group[v]) for a, b in edges)
                if u < v and w:
                    gain = w / m - 2 * sum(degree[n] for n in group[u]) * sum(degree[n] for n in group[v]) / (4 * m * m)
                    best = max(best, (round(gain, 12), -u, -v))
        if best[0] <= 1e-15:
            return {n: min(g) for g in group.values() for n in g}
        group[-best[1]] |= group.pop(-best[2])


def test_modularity_by_heap():
    rng = np.random.default_rng(8)
    for _ in range(4):
        edges = sorted({(int(min(e)), int(max(e))) for e in rng.integers(0, 24, (45, 2)) if e[0] != e[1]})
        want, got = slow_modularity(edges), K.modularity_communities(edges)
        first = {}
        for n in sorted(got):
            first.setdefault(got[n], n)
        assert {n: first[c] for n, c in got.items()} == want


def test_modularity_is_not_quadratic():
    import time

    n = 6000
    edges = [(k, k + 1) for k in range(n)] + [(k, k + 5) for k in range(0, n, 5)]
    began = time.time()
    got = K.modularity_communities(edges)
    assert len(got) == len({n for e in edges for n in e}) and time.time() - began < 10


def test_communities_of_many_components(spark):
    edges = [(9 * k + a, 9 * k + b) for k in range(40) for a, b in ((0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5))]
    got = dict(tuple(r) for r in G.communities(spark.createDataFrame(edges, "i long, j long").repartition(3)).collect())
    assert got == {9 * k + n: 9 * k + (0 if n < 3 else 3) for k in range(40) for n in range(6)}


def test_density_clusters_of_dense_points(spark, monkeypatch):
    from eventloom.operators import learn as L

    monkeypatch.setattr(L, "CELL_POINTS", 16)
    rng = np.random.default_rng(4)
    at = np.concatenate([rng.normal(scale=0.05, size=(150, 2)), rng.normal(1.0, 0.3, size=(150, 2)), np.repeat([[3.0, 3.0]], 20, 0), rng.uniform(-1, 4, size=(40, 2))])
    radius, least = 0.1, 4
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1))
    core = (d <= radius).sum(1) >= least
    root = np.arange(len(at))
    for _ in range(len(at)):
        root = np.array([min(root[j] for j in np.flatnonzero(core & (d[k] <= radius))) if core[k] else k for k in range(len(at))])
    want = [int(root[k]) if core[k] else int(root[min((d[k, j], j) for j in np.flatnonzero(core & (d[k] <= radius)))[1]]) if (core & (d[k] <= radius)).any() else -1 for k in range(len(at))]
    points = spark.createDataFrame([(k, float(p), float(q)) for k, (p, q) in enumerate(at)] + [(900, None, 1.0), (901, float("nan"), 0.0)], "id long, x double, y double")
    got = dict(tuple(r) for r in L.density_clusters(points, radius, least).collect())
    assert [got[k] for k in range(len(at))] == want and got[900] == got[901] == -1
    assert {r["cluster"] for r in L.density_clusters(points.where("id >= 320"), 1e-6, 4).collect()} == {-1}
