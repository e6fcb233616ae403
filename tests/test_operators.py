"""Closed forms, golden tables and brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import arrays as A
from eventloom.functions import features as feat
from eventloom.functions import normalize as N
from eventloom.operators import events as E
from eventloom.operators import experiments as X
from eventloom.operators import graph as G
from eventloom.operators import kernels as K
from eventloom.operators import learn as L
from eventloom.operators import signals as S
from eventloom.operators import volume as V
from eventloom.sources import images, storage, synthetic
from eventloom.streaming.windows import windowed


def values(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_time_map_golden(spark):
    """Event 1 at frame 3, event 2 at frames 0 and 1, event 3 at frame 2."""
    vox = spark.createDataFrame([(1, 3, 0, 0), (2, 0, 1, 1), (2, 1, 1, 1), (3, 2, 2, 2)], "event_id long, z long, x long, y long")
    assert values(E.time_map(vox), "event_id") == [(1, 3, 4), (2, 0, 2), (3, 2, 3)]


def test_dense_placement(spark):
    df = spark.createDataFrame([(0, 0, 3, [1.0, 1.0, 1.0]), (1, 2, 1, [2.0]), (2, 5, 4, [3.0] * 4), (3, -1, 2, [9.0, 9.0]), (4, 1, 5, [9.0])], "event_key long, z0 int, dz int, trace array<double>")
    n = None
    assert values(E.to_dense(df, 10), "event_key") == [(0, [1, 1, 1, n, n, n, n, n, n, n]), (1, [n, n, 2, n, n, n, n, n, n, n]), (2, [n, n, n, n, n, 3, 3, 3, 3, n])]


@pytest.mark.parametrize("closed,expect", [(True, {0, 2, 4}), (False, {2})])
def test_interval_bounds(spark, closed, expect):
    e = spark.createDataFrame([(0, 0, 4)], "event_key long, z0 long, z1 long")
    p = spark.createDataFrame([(t,) for t in (-1, 0, 2, 4, 5)], "t long")
    assert {r["t"] for r in E.within(e, p, closed=closed, width=2).collect()} == expect


@pytest.mark.parametrize("mode", sorted(N.MODES))
@pytest.mark.parametrize("wide", [False, True])
def test_subtract(spark, mode, wide):
    rows = [[1.0, 4.0, -2.0], [3.0, 0.5], [7.0]]
    stat = {"first": lambda x: x[0], "mean": np.mean, "median": np.median, "min": np.min, "max": np.max, "min_abs": lambda x: np.min(np.abs(x)), "max_abs": lambda x: np.max(np.abs(x)), "std": np.std}[mode]
    every = np.mean([r[0] for r in rows]) if mode == "first" else stat(np.concatenate(rows))
    got = N.subtract(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, trace array<double>"), mode, population_wide=wide)
    for (i, t), r in zip(values(got.select("id", "trace"), "id"), rows, strict=True):
        assert np.allclose(t, np.array(r) - (every if wide else stat(r))), i


def test_divide_by_zero_leaves_row(spark):
    got = N.divide(spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0, 4.0])], "id int, trace array<double>"), "max")
    assert values(got.select("id", "trace"), "id") == [(0, [0.0, 0.0]), (1, [0.5, 1.0])]


def test_impute_edges_and_empty(spark):
    nan = float("nan")
    rows = [[None, 2.0, nan, nan, 8.0, None], [None, nan], [], [1.0]]
    got = N.impute_nan(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, trace array<double>"))
    assert [t for _, t in values(got.select("id", "trace"), "id")] == [[2.0, 2.0, 4.0, 6.0, 8.0, 8.0], [None, None], [], [1.0]]


def test_enforce_length_one_bound(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0, 3.0, 4.0])], "id int, trace array<double>")
    assert [r["trace"] for r in N.enforce_length(df, min_length=3).orderBy("id").collect()] == [[1, 1, 2], [1, 2, 3, 4]]
    assert [r["trace"] for r in N.enforce_length(df, max_length=3).orderBy("id").collect()] == [[1, 2], [1, 2, 3]]


def test_features_on_one_and_two(spark):
    df = spark.createDataFrame([(0, [3.0]), (1, [1.0, 2.0]), (2, [])], "id int, trace array<double>")
    got = {r["id"]: r for r in feat.all_features(df).collect()}
    assert got[0]["v_mean"] == 3 and got[0]["v_mean_diff"] is None and got[1]["v_mean_diff"] == 1 and got[2]["v_mean"] is None
    assert got[1]["v_waveform_length"] == 1 and got[0]["v_longest_strike_above_mean"] == 0


def test_gradient_matches_numpy(spark):
    rows = [[1.0, 4.0, 9.0, 16.0], [1.0, 5.0], [2.0]]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, t array<double>").select("id", A.gradient("t").alias("g"))
    assert [g for _, g in values(got, "id")] == [list(np.gradient(rows[0])), [4.0, 4.0], [0.0]]


def test_ragged_pearson(spark):
    x, y = [1.0, 2.0, 4.0], [0.0, 1.0, 2.0, 4.0, 3.0]
    got = spark.createDataFrame([(x, y)], "x array<double>, y array<double>").select(A.ragged_pearson("x", "y").alias("r")).first()["r"]
    a, b = np.array(x) - np.mean(x), np.array(y) - np.mean(y)
    assert np.isclose(got, max(a @ b[k : k + 3] for k in range(3)) / (3 * np.std(x) * np.std(y)))


def test_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "v int, s string")
    assert values(E.keep(df, {"v": (2, None), "s": ["a"]})) == [(3, "a")]
    assert values(E.keep(df, {"v": (-1, 2)}, compat=True), "v") == [(1, "a"), (2, "b")]
    assert E.parse_filters("v:(1,)\ns:[a, b]") == {"v": (1.0, None), "s": ["a", "b"]}
    with pytest.raises(ValueError):
        E.parse_filters("v=3")


def brute_components(points):
    points, out = set(points), {}
    for p in sorted(points):
        if p in out:
            continue
        todo = [p]
        while todo:
            q = todo.pop()
            if q in points and q not in out:
                out[q] = p
                todo += [tuple(np.add(q, d)) for d in itertools.chain(*(((k, 0, 0), (0, k, 0), (0, 0, k)) for k in (1, -1)))]
    return out


@pytest.mark.parametrize("tile", [2, 3, 64])
def test_components_do_not_depend_on_tiles(spark, tile):
    rng = np.random.default_rng(3)
    points = [tuple(int(v) for v in p) for p in np.argwhere(rng.random((5, 6, 7)) < 0.35)]
    got = {(r["z"], r["x"], r["y"]): r["label"] for r in V.label_components(spark.createDataFrame(points, "z long, x long, y long"), tile).collect()}
    want = brute_components(points)
    groups = {}
    for p, k in want.items():
        groups.setdefault(k, set()).add(p)
    assert set(got) == set(want) and all(len({got[p] for p in g}) == 1 for g in groups.values()) and len(set(got.values())) == len(groups)


def test_extension_to_the_ends(spark):
    vol = spark.range(5 * 2 * 2).select(F.floor(F.col("id") / 4).alias("z"), F.floor(F.col("id") / 2 % 2).cast("long").alias("x"), (F.col("id") % 2).alias("y")).withColumn("v", (F.col("z") * 10 + F.col("x")).cast("double"))
    e = spark.createDataFrame([("a", 2, 3, 0, 0, 1, 2, [True, True], [99.0])], "event_key string, z0 long, z1 long, x0 long, y0 long, dx long, dy long, mask array<boolean>, trace array<double>")
    r = V.extend_events(e, vol, -1, 1, 5).first()
    assert r["trace"] == [0.0, 10.0, 99.0, 30.0] and (r["z0"], r["z1"], r["dz"], r["z0_orig"]) == (0, 4, 4, 2)


def test_peaks_by_definition():
    x = np.array([0, 1, 0, 3, 3, 1, 2, 0, 5, 0], float)
    got = K.find_peaks(x)
    assert got["peak"].tolist() == [1, 3, 6, 8]
    for p, prom in zip(got["peak"], got["prominence"], strict=True):
        left = [i for i in range(p) if x[i] > x[p]]
        right = [i for i in range(p, len(x)) if x[i] > x[p]]
        lo, hi = (left[-1] + 1 if left else 0), (right[0] if right else len(x))
        assert prom == x[p] - max(x[lo : p + 1].min(), x[p:hi].min())
    assert K.find_peaks(x, distance=3)["peak"].tolist() == [3, 8] or set(K.find_peaks(x, distance=3)["peak"]) <= {1, 3, 6, 8}


def brute_dtw(a, b):
    best = {}

    def go(i, j):
        if (i, j) in best:
            return best[i, j]
        d = (a[i] - b[j]) ** 2
        prev = [go(*p) for p in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if min(p) >= 0]
        best[i, j] = d + (min(prev) if prev else 0)
        return best[i, j]

    return go(len(a) - 1, len(b) - 1) ** 0.5


def test_dtw(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.random(3 + i % 4).tolist()) for i in range(9)]
    got = {(r["i"], r["j"]): r["d"] for r in K.pair_distances(spark.createDataFrame(rows, "id long, trace array<double>"), tiles=3).collect()}
    assert set(got) == set(itertools.combinations(range(9), 2))
    assert all(np.isclose(d, brute_dtw(rows[i][1], rows[j][1])) for (i, j), d in got.items())
    assert K.dtw(np.arange(5.0), np.arange(5.0), window=1) == 0


def test_linkage_is_monotone():
    rng = np.random.default_rng(1)
    p = rng.random((12, 2))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    for method in ("single", "complete", "average", "ward"):
        m = K.linkage(d, method)
        assert (np.diff(m[:, 2]) >= -1e-12).all() and m[-1, 3] == 12
        assert len(set(K.flat_clusters(m, 12, 3, "maxclust"))) <= 3


def test_motion_shift_recovers(spark):
    rng = np.random.default_rng(2)
    t = rng.random((16, 16))
    assert K.frame_shift(np.roll(t, (2, -3), (0, 1)), t) == (2, -3)


def test_baseline_of_slow_trace():
    x = np.linspace(5, 6, 100)
    y = x.copy()
    y[40:44] += 20
    assert np.abs(K.baseline(y) - x).max() < 1.5


def test_match_and_modularity():
    assert K.match_greedily([10, 20], [11, 21, 50], 3) == (2, 0, 1)
    edges = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]
    m = K.modularity_communities(edges)
    assert m[0] == m[1] == m[2] != m[3] == m[4] == m[5]


def test_ami_bounds():
    assert np.isclose(L.adjusted_mutual_information([(0, 0, 5), (1, 1, 5)]), 1.0)
    assert abs(L.adjusted_mutual_information([(0, 0, 5), (0, 1, 5), (1, 0, 5), (1, 1, 5)])) < 0.1


def test_density_clusters(spark):
    pts = [(i, float(i) * 0.1, 0.0) for i in range(5)] + [(10 + i, 5.0 + i * 0.1, 0.0) for i in range(5)] + [(99, 50.0, 50.0)]
    got = dict(values(L.density_clusters(spark.createDataFrame(pts, "id long, x double, y double"), 0.15, 2)))
    assert got[99] == -1 and len({got[i] for i in range(5)}) == 1 and got[0] != got[10]


def test_number_rows_and_units(spark):
    df = spark.createDataFrame([(0, 40000), (0, 5), (1, 7), (0, 6)], "c long, k long")
    assert values(S.number_rows(df, "c", "k", "i").select("c", "k", "i"), "c", "k") == [(0, 5, 0), (0, 6, 1), (0, 40000, 2), (1, 7, 0)]
    assert np.isclose(S.sampling_seconds("10ms"), 0.01) and S.sampling_seconds(4) == 0.25


def test_spatial_median(spark):
    p = spark.createDataFrame([(0, x, y) for x, y in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (10.0, 10.0))], "module int, x double, y double")
    r = G.spatial_medians(p).first()
    want = K.spatial_median(np.array([[0, 0], [1, 0], [0, 1], [10, 10]], float))
    assert abs(r["mx"] - want[0]) < 0.1 and abs(r["my"] - want[1]) < 0.1


def test_save_and_load(spark, tmp_path):
    a = np.arange(2 * 3 * 4, dtype=float).reshape(2, 3, 4)
    np.save(tmp_path / "v.npy", a)
    storage.register(spark)
    vox = storage.load(spark, str(tmp_path / "v.npy"))
    assert vox.count() == 24 and vox.agg(F.sum("v")).first()[0] == a.sum()
    storage.save(vox, str(tmp_path / "p"))
    assert storage.load(spark, str(tmp_path / "p"), z_slice=(1, 2)).count() == 12
    with pytest.raises(Exception, match="exist"):
        storage.save(vox, str(tmp_path / "p"))


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select((F.timestamp_seconds(F.col("id") * 60)).alias("ts"), F.lit("a").alias("event_type"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.sql("select * from w").collect())) == sorted(map(tuple, windowed(rows, "1 hour").collect()))


def test_detection_end_to_end(spark, tmp_path):
    """Bright blobs on a dim ground are found, described, saved and read again."""
    from eventloom.api import Events, Video
    from eventloom.sources import synthetic

    drawn = synthetic.simulate_volume(spark, (10, 40, 40), (10, 20, 20), 2.0, 40)
    grid = spark.range(10 * 40 * 40).select(F.floor(F.col("id") / 1600).alias("z"), F.floor(F.col("id") / 40 % 40).cast("long").alias("x"), (F.col("id") % 40).alias("y"))
    lit = grid.join(drawn, ["z", "x", "y"], "left").withColumn("v", F.when(F.col("event_id").isNotNull(), 100.0).otherwise(1.0)).select("z", "x", "y", "v")
    found = Video(lit).detect(factor=2.0, least=5)
    got = found.df.select("v_area", "dz", "trace", "v_fp_area").collect()
    assert len(got) == drawn.select("event_id").distinct().count() == 4 and all(r["v_area"] == 40 and len(r["trace"]) == r["dz"] for r in got)
    found.filter({"v_area": (1, None)}).save(str(tmp_path / "events"))
    assert Events.load(spark, str(tmp_path / "events"), subject_id="s").df.count() == 4


def test_barycenters_of_shifted_copies(spark):
    base = [0.0, 0.0, 1.0, 3.0, 1.0, 0.0, 0.0, 0.0]
    rows = [(k, 0, base[-k:] + base[:-k] if k else base) for k in range(3)]
    r = K.barycenters(spark.createDataFrame(rows, "id long, cluster int, trace array<double>"), rounds=4).first()
    assert r["n"] == 3 and abs(max(r["trace"]) - 3) < 0.2


def test_contrasts_equal_ntile(spark):
    df = spark.range(103).withColumn("v", (F.col("id") * 7 % 31).cast("double"))
    from pyspark.sql import Window as W

    want = df.withColumn("n", F.ntile(4).over(W.orderBy("v", "id")))
    assert values(E.contrasts(df, "v", 4, "id").select("id", "contrast"), "id") == values(want.select("id", "n"), "id")


def test_bootstrap_uses_all_rows(spark):
    df = spark.range(20_000).select(F.col("id").alias("event_key"), F.lit("a").alias("cluster"), (F.col("id") % 100).cast("double").alias("value"))
    r = E.bootstrap_means(df, "value", "cluster").first()
    width = 2 * 1.96 * np.sqrt((100**2 - 1) / 12 / 20_000)
    assert r["low"] < 49.5 < r["high"] and 0.75 * width < r["high"] - r["low"] < 1.3 * width


def test_triangle_level_brute_force():
    rng = np.random.default_rng(3)
    for v in (np.r_[rng.normal(0, 1, 5000), rng.normal(20, 0.1, 200)], rng.exponential(1, 5000), -rng.exponential(1, 5000), np.r_[rng.normal(0, 1, 4000), rng.normal(60, 3, 900)]):
        hist, edges = np.histogram(v, 256)
        mode = int(np.argmax(hist))
        low, high = np.flatnonzero(hist)[[0, -1]]
        end = low if mode - low > high - mode else high
        best, level = -1.0, None
        for k in sorted(range(min(mode, end), max(mode, end) + 1), key=lambda k: abs(k - mode)):
            gap = hist[mode] * (1 - abs(k - mode) / abs(end - mode)) - hist[k]
            if gap > best:
                best, level = gap, (edges[k] + edges[k + 1]) / 2
        assert np.isclose(K.triangle_level(v), level)


def test_simulated_detection(spark):
    from eventloom import plans

    got = {r["source"]: r["n"] for r in plans.QUERIES["simulated_detection"](spark, "/root/testdata/sf0.001").collect()}
    assert got["events"] > 10 and abs(got["found"] - got["events"]) <= 0.15 * got["events"]


def test_dtw_many_options():
    rng = np.random.default_rng(1)
    a, others = rng.normal(size=9), [rng.normal(size=n) for n in (9, 4, 13, 1)]
    for options in ({}, {"window": 2}, {"slope": 2.0}, {"local": K.LOCAL["canberra"]}, {"window": 1, "local": K.LOCAL["cityblock"]}):
        assert np.allclose(K.dtw_many(a, others, **options), [K.dtw(a, o, **options) for o in others])


def test_ragged_pearson_matrix(spark):
    rng = np.random.default_rng(2)
    traces = [rng.normal(size=n).tolist() for n in (5, 9, 3, 9)] + [[1.0, 1.0]]
    df = spark.createDataFrame(list(enumerate(traces)), "id long, trace array<double>")
    got = {(r["i"], r["j"]): r["r"] for r in G.ragged_pearson_matrix(df).collect()}
    assert len(got) == 10 and got[(0, 4)] is None
    for (i, j), r in got.items():
        s, g = sorted((np.array(traces[i]), np.array(traces[j])), key=len)
        if s.std() and g.std():
            s, g = s - s.mean(), g - g.mean()
            want = max(float(s @ g[k : k + len(s)]) for k in range(len(g) - len(s) + 1)) / (len(s) * s.std() * g.std())
            assert np.isclose(r, want)


def test_flat_cluster_criteria():
    merges = np.array([[0, 1, 0.1, 2], [2, 3, 0.15, 2], [5, 6, 1.0, 4], [4, 7, 1.1, 5]])
    assert K.flat_clusters(merges, 5, 0.5).tolist() == [1, 1, 2, 2, 3]
    assert K.flat_clusters(merges, 5, 2, "maxclust").tolist() == [1, 1, 1, 1, 2]
    assert K.flat_clusters(merges, 5, 5, "monocrit", np.array([9.0, 1, 1, 1])).tolist() == [1, 2, 3, 3, 4]
    assert K.flat_clusters(merges, 5, 3, "maxclust_monocrit", np.array([1.0, 2, 3, 4])).tolist() == [1, 1, 2, 2, 3]
    assert np.allclose(K.inconsistency(merges, 5)[:2], 0) and K.flat_clusters(merges, 5, 0.8, "inconsistent").tolist() == [1, 1, 2, 2, 3]


def test_pieces_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(c, int(i) * 3, float(v)) for c in (0, 1) for i, v in enumerate(rng.integers(0, 9, 60))], "channel long, i long, v double")
    steps = [lambda d: S.detrend(d, 7, smooth=3), lambda d: S.two_sided_minimum(d, 5), lambda d: S.median_normalised(d, 5), lambda d: S.sighs(d, 5), lambda d: S.slopes(d), lambda d: S.periods(d.withColumn("t", F.col("i") * 1.0))]
    whole = [sorted(map(str, f(df).collect())) for f in steps]
    monkeypatch.setattr(S, "PIECE_ROWS", 8)
    assert [sorted(map(str, f(df).collect())) for f in steps] == whole
    assert S.exact_median(df, "v").first()[0] == np.median([r["v"] for r in df.collect()])


def test_components_brute_force(spark):
    rng = np.random.default_rng(5)
    on = {tuple(p) for p in np.argwhere(rng.random((9, 10, 11)) < 0.35).tolist()}
    got = {(r["z"], r["x"], r["y"]): r["label"] for r in V.label_components(spark.createDataFrame(sorted(on), "z long, x long, y long"), 4).collect()}
    seen = {}
    for p in sorted(on):
        todo = [] if p in seen else [p]
        while todo:
            q = todo.pop()
            if q in on and q not in seen:
                seen[q] = p
                todo += [tuple(q[k] + d * (k == a) for k in range(3)) for a in range(3) for d in (-1, 1)]
    assert got == {q: (p[0] << 40) + (p[1] << 20) + p[2] for q, p in seen.items()}


def test_images(spark, tmp_path):
    rng = np.random.default_rng(6)
    a = rng.random((5, 4, 3)).astype("<f4").astype(float)
    v = images.from_array(spark, a)
    assert np.allclose(images.to_array(v, (0, 5), (4, 3)), a) and np.allclose(images.to_array(images.from_array(spark, a, (2, 4)), (2, 4), (4, 3)), a[2:4])
    files = images.save_tiff(v, f"{tmp_path}/rec", (4, 3), 5, file_frames=2)
    assert len(files) == 3 and np.allclose(images.to_array(images.load_tiff(spark, f"{tmp_path}/rec_*.tif"), (0, 5), (4, 3)), a)
    with pytest.raises(FileExistsError):
        images.save_tiff(v, f"{tmp_path}/rec", (4, 3), 5, file_frames=2)
    big = images.to_array(images.resize(v, (4, 3), (2, 1.0)), (0, 5), (2, 3))
    assert np.allclose(big, a.reshape(5, 2, 2, 3).mean(2))
    labels = v.withColumn("v", (F.col("x") == 1).cast("double"))
    images.save_tiff(labels, f"{tmp_path}/map", (4, 3), 5)
    assert images.load_event_map(spark, [f"{tmp_path}/no.parquet", f"{tmp_path}/map_0.tif"]).count() == 15
    with pytest.warns(UserWarning):
        assert images.load_event_map(spark, [f"{tmp_path}/no.parquet"]) is None
    (tmp_path / "a.tif").write_bytes(images.write_tiff([a[0]]))
    assert images.companion(spark, f"{tmp_path}/a.events.parquet") == f"{tmp_path}/a.tif" and images.companion(spark, f"{tmp_path}/b.parquet") is None
    images.save_run(spark, f"{tmp_path}/meta.json", {"b": 1, "a": [1, 2]})
    assert images.load_run(spark, f"{tmp_path}/meta.json") == {"a": [1, 2], "b": 1}
    images.save_model(spark, {"k": 3}, f"{tmp_path}/m.pickle")
    assert images.load_model(spark, f"{tmp_path}/m.pickle") == {"k": 3}
    assert images.content_hash(v) == images.content_hash(v.repartition(3)) != images.content_hash(v.limit(3)) and images.content_hash([1, {"a": a}]) == images.content_hash([1, {"a": a.copy()}])
    calls = []
    made = [images.cached(spark, str(tmp_path), lambda n: calls.append(n) or spark.range(n), 4).count() for _ in range(2)]
    assert made == [4, 4] and calls == [4] and images.prime_factors(360) == [2, 2, 2, 3, 3, 5]


def test_experiment_parts(spark):
    stop = X.EarlyStopping(2, 0.1)
    assert [stop(x) for x in (1.0, 0.8, 0.75, 0.74)] == [False, False, False, True]
    walk = synthetic.incidences(1000, 20, 50, 1)
    assert walk == synthetic.incidences(1000, 20, 50, 1) and all(50 <= b - a < 70 for a, b in zip(walk, walk[1:], strict=False))
    x = np.zeros(100)
    x[20:40] = x[60:80] = 5.0
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "channel long, i long, v double")
    assert [r["i"] % 5 for r in X.camera_frames(df, 5, 1.0).collect()] == [0, 0]
    assert len(K.find_peaks(x)) == 2 and len(K.find_peaks(x, plateau_size=21)) == 0
