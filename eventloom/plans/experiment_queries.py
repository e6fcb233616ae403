"""Queries over windows of stimuli, long forms, resizing, lookups, and recordings that grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import events as E
from eventloom.operators import experiments as X
from eventloom.operators import graph as G
from eventloom.operators import kernels as K
from eventloom.operators import volume as V
from eventloom.plans.registry import query, r6, s6
from eventloom.plans.signal_queries import _CODE
from eventloom.sources import images
from eventloom.sources.adapters import Tables


@query(
    """with f as (select cluster, unnest(range(z0, z1)) as frame from intervals), m as (select cluster, frame, count(*) as n from f group by all), w as (select i as item, i * 6 as start from range(0, (select (max(z1) - 12) // 6 + 1 from intervals)) x(i)),
h as (select w.item, list(distinct t - start order by t - start) as hits from w join stimuli s on s.t >= start and s.t < start + 12 group by all having min(t - start) >= 2),
a as (select w.item, sum(n) as active, count(*) as cells from w join m on m.frame >= start and m.frame < start + 12 group by all)
select w.item, w.start, coalesce(a.active, 0)::bigint as active, coalesce(a.cells, 0)::bigint as cells, list_transform(range(12), lambda k: list_contains(hits, k)::integer) as timing from w join h using (item) left join a using (item)""",
    "intervals", "stimuli",
)
def stimulus_windows(t: Tables) -> DataFrame:
    frames = t.intervals().agg(F.max("z1")).first()[0]
    got = X.windows(E.active_by_cluster(t.intervals()), t.stimuli(), frames, 12, 6, skip_first=2)
    active = F.aggregate("matrix", F.lit(0).cast("long"), lambda a, c: a + c["n"])
    return got.select("item", "start", F.coalesce(active, F.lit(0)).alias("active"), F.coalesce(F.size("matrix"), F.lit(0)).cast("long").alias("cells"), "timing")


@query(f"select id, unnest(range(len(trace)))::integer - 2 as timepoint, {s6('unnest(trace)')} as value from traces_ragged", "traces_ragged")
def trials_long_rows(t: Tables) -> DataFrame:
    got = X.trials_long(t.traces_ragged().withColumn("t", F.lit(0)), "id", "trace", lead=2)
    return got.select("id", "timepoint", r6("value").alias("value"))


@query(
    f"""with o as (select i as p, n, m from (values (8, 3), (8, 5)) s(n, m), range(8) x(i)), c as (select n, m, p, unnest(range((p * m) // n, ceil((p + 1) * m / n)::bigint)) as k from o),
w as (select n, m, p, k, least((p + 1) * m, (k + 1) * n) - greatest(p * m, k * n) as w from c)
select z, a.k as x, b.k as y, {s6('sum(v * a.w * b.w) / sum(a.w * b.w)')} as v from volume_data join w a on a.m = 3 and a.p = x join w b on b.m = 5 and b.p = y group by all""",
    "volume_data",
)
def resize_area(t: Tables) -> DataFrame:
    return images.resize(t.volume_data(), (8, 8), (3, 0.625)).select("z", "x", "y", r6("v").alias("v"))


@query("select z, x, y, round_even(v / (select max(v) from volume_data) * 65535, 0)::integer as v from volume_data", "volume_data")
def scaled_uint16(t: Tables) -> DataFrame:
    top = t.volume_data().agg(F.max("v").cast("double").alias("m"))
    scaled = t.volume_data().join(F.broadcast(top), how="cross").withColumn("v", F.col("v").cast("double") / F.col("m")).drop("m")
    return images.convert(scaled, "uint16").select("z", "x", "y", "v")


@query("select event_key, cluster, round(value, 2) as value from intervals", "intervals")
def display_rounded(t: Tables) -> DataFrame:
    return X.display(t.intervals().select("event_key", "cluster", "value", "grp"), ["grp"], 2)


@query("select id, len(trace)::integer as n from traces_ragged where len(trace) between 10 and 40", "traces_ragged")
def length_bounds(t: Tables) -> DataFrame:
    return X.length_filter(t.traces_ragged(), 10, 40).select("id", F.size("trace").alias("n"))


@query("with o as (select distinct unnest(range(z0, z1)) as z, subject_id as label from intervals) select p.z + 1 as z, p.label from o p where not exists (select 1 from o n where n.z = p.z + 1 and n.label = p.label) and p.z + 1 in (select z from o)", "intervals")
def labels_lost(t: Tables) -> DataFrame:
    own = t.intervals().select(F.explode(F.sequence("z0", F.col("z1") - 1)).alias("z"), F.col("subject_id").alias("label"))
    return X.lost_labels(own)


@query("select 1000 + i as source, 1000 + j as target from rs where r >= 0.4", "rs")
def edges_by_name(t: Tables) -> DataFrame:
    names = t.traces_equal().select(F.col("id").alias("i_idx"), (F.col("id") + 1000).alias("trace_idx"))
    return G.map_edges(G.pearson_matrix(t.traces_equal(), low=0.4), names)


@query("select id as item, cluster from traces_equal", "traces_equal")
def barycenter_members(t: Tables) -> DataFrame:
    return G.members(t.traces_equal().groupBy("cluster").agg(F.collect_list("id").alias("idx")))


@query("with c as (select cluster, avg(trace[1]) as x, avg(trace[2]) as y from traces_equal group by all) select id, arg_min(c.cluster, ((trace[1] - c.x) ** 2 + (trace[2] - c.y) ** 2, c.cluster)) as center from traces_equal, c group by id", "traces_equal")
def nearest_center(t: Tables) -> DataFrame:
    p = t.traces_equal().select("id", "cluster", F.get("trace", 0).alias("x"), F.get("trace", 1).alias("y"))
    centers = p.groupBy(F.col("cluster").alias("center")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return G.nearest(p, centers, ["x", "y"])


@query("with r as (select *, ntile(4) over (order by value, event_key) as contrast from intervals) select contrast::integer as contrast, cluster, count(*) as n from r group by all", "intervals")
def contrast_counts(t: Tables) -> DataFrame:
    return X.contrast_counts(E.contrasts(t.intervals(), "value", 4, "event_key"))


@query(f"select id, list_transform(trace[1:3] || trace[7:9], lambda v: {s6('v')}) as input, {s6('trace[5]')} as target from traces_equal", "traces_equal")
def patch_target(t: Tables) -> DataFrame:
    source, target = X.split_patch(F.slice("trace", 1, 9), 3, 3, gap=1)
    return t.traces_equal().select("id", F.transform(source, r6).alias("input"), r6(target).alias("target"))


@query("with r as (select id, trace, len(trace) as n, (row_number() over (order by len(trace), id) - 1) // 32 as batch from traces_ragged) select id, batch, n::integer as length, max(n) over (partition by batch)::integer as padded from r", "traces_ragged")
def padded_batches(t: Tables) -> DataFrame:
    return X.pad_batches(t.traces_ragged(), 32).select("id", "batch", "length", F.size("trace").alias("padded"))


@query("select id, list_transform(trace, lambda v: (v >= 0.1)::integer) as rounded from traces_equal", "traces_equal")
def timing_rounded(t: Tables) -> DataFrame:
    return X.rounded_timing(t.traces_equal(), "trace", 0.1).select("id", "rounded")


def _data_ccl(active: str) -> str:
    """Components of a mask of volume_data; its neighbours are looked up by their codes, so the recursion stays short."""
    return f"""m as (select z, x, y, {_CODE} as code from volume_data where {active}),
e as (select a.code as a, b.code as b from m a, (values (1099511627776), (-1099511627776), (1048576), (-1048576), (1), (-1)) s(d) join m b on b.code = a.code + d),
r(code, label) as (select code, code from m union select e.b, r.label from r join e on e.a = r.code where r.label < e.b),
c as (select m.z, m.x, m.y, l.label from m join (select code, min(label) as label from r group by code) l using (code))"""


@query(f"with recursive {_data_ccl('v > 60')} select z, x, y, label from c", "volume_data")
def ccl_label_data(t: Tables) -> DataFrame:
    """Components in a recording that grows with the input."""
    return V.label_components(t.volume_data().where("v > 60").select("z", "x", "y"))


@query(f"with recursive {_data_ccl('v > 60')} select label, min(z) as z0, max(z) + 1 as z1, min(x) as x0, max(x) + 1 as x1, min(y) as y0, max(y) + 1 as y1, count(*) as v_area from c group by label", "volume_data")
def bbox_extent_data(t: Tables) -> DataFrame:
    b = V.bounding_boxes(V.label_components(t.volume_data().where("v > 60").select("z", "x", "y")))
    return b.select("label", "z0", "z1", "x0", "x1", "y0", "y1", "v_area")


@query()
def ragged_pearson_pairs(t: Tables) -> DataFrame:
    return G.ragged_pearson_matrix(t.traces_ragged())


@query()
def dtw_band_pairs(t: Tables) -> DataFrame:
    """Warping within a band, as a kernel."""
    return K.pair_distances(t.traces_equal(), window=4, local="cityblock", sigma=2.0)


@query()
def coincidence_classifier(t: Tables) -> DataFrame:
    return X.predict_coincidence(_coincident(t), numTrees=10, seed=1).select("event_key", "incidence", "prediction")


@query()
def incidence_location(t: Tables) -> DataFrame:
    return X.predict_incidence_location(_coincident(t), numTrees=10, seed=1).select("event_key", "location", "prediction")


def _coincident(t: Tables) -> DataFrame:
    c = E.coincidences(t.intervals(), t.stimuli())
    c = c.withColumn("trace", F.array(F.col("dz").cast("double"), "value", (F.col("z0") % 24).cast("double")))
    return E.sequential_split(c, "event_key")
