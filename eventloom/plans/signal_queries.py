"""Queries over signals, windows and volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import kernels as K
from eventloom.operators import signals as S
from eventloom.operators import volume as V
from eventloom.plans.registry import query, r6, s6
from eventloom.sources.adapters import Tables
from eventloom.sources.storage import chunk_shape

_W = "over (partition by channel order by i rows between {a} and {b})"


def _w(a: int, b: int) -> str:
    side = lambda k: "current row" if k == 0 else f"{abs(k)} {'preceding' if k < 0 else 'following'}"
    return _W.format(a=side(a), b=side(b))


@query(f"select channel, i, case when count(*) {_w(-19, 0)} = 20 then {s6(f'v - min(v) {_w(-19, 0)}')} end as detrended from signal", "signal")
def detrend_rolling_min(t: Tables) -> DataFrame:
    return S.detrend(t.signal(), 20, numbered=True).select("channel", "i", r6("detrended").alias("detrended"))


@query(f"select channel, i, greatest(min(v) {_w(-9, 0)}, min(v) {_w(0, 9)}) as baseline from signal", "signal")
def baseline_two_sided_min(t: Tables) -> DataFrame:
    return S.two_sided_minimum(t.signal(), 10, numbered=True).select("channel", "i", "baseline")


@query("select channel, i, min(v) over (partition by channel, i % 2 order by i rows between 5 preceding and 5 following) as baseline from signal", "signal")
def baseline_even_odd(t: Tables) -> DataFrame:
    return S.even_odd_minimum(t.signal(), 10, numbered=True).select("channel", "i", "baseline")


@query(f"select channel, i, {s6(f'v / median(v) {_w(-5, 5)}')} as normed from signal", "signal")
def rolling_median_norm(t: Tables) -> DataFrame:
    return S.median_normalised(t.signal(), 11, numbered=True).select("channel", "i", r6("normed").alias("normed"))


@query(f"select channel, i, coalesce(v > median(v) {_w(-5, 5)} + stddev_samp(v) {_w(-5, 5)}, false) as sigh from signal", "signal")
def sigh_flag(t: Tables) -> DataFrame:
    return S.sighs(t.signal(), 11, numbered=True).select("channel", "i", "sigh")


@query(f"with p as (select channel, i * 0.5 as t from signal where v > 50) select channel, t::double as t, {s6('t - lag(t) over w')} as pre, {s6('lead(t) over w - t')} as post, {s6('1.0 / (t - lag(t) over w)')} as frequency from p window w as (partition by channel order by t)", "signal")
def interpeak_periods(t: Tables) -> DataFrame:
    p = t.signal().where("v > 50").select("channel", (F.col("i") * 0.5).alias("t"))
    return S.periods(p).select("channel", "t", *(r6(c).alias(c) for c in ("pre", "post", "frequency")))


@query(f"select channel, i, {s6(f'avg(v) {_w(-2, 2)}')} as smooth, case when count(*) {_w(-2, 1)} = 4 then {s6(f'avg(v) {_w(-2, 1)}')} end as even from signal", "signal")
def rolling_means(t: Tables) -> DataFrame:
    v = F.col("v")
    step = lambda d, p: d.withColumn("smooth", S.rolling(v, F.avg, p, "i", 5, partial=True)).withColumn("even", S.rolling(v, F.avg, p, "i", 4))
    return S.by_pieces(t.signal(), "channel", "i", 5, 5, step, numbered=True).select("channel", "i", r6("smooth").alias("smooth"), r6("even").alias("even"))


@query(f"with l as (select channel, i, v, lag(v) over w as p, lead(v) over w as n from signal window w as (partition by channel order by i)) select channel, i, {s6('case when p is null then n - v when n is null then v - p else (n - p) / 2 end')} as gradient, {s6('coalesce(v - p, 0)')} as diff from l", "signal")
def signal_gradient(t: Tables) -> DataFrame:
    return S.slopes(t.signal(), numbered=True).select("channel", "i", r6("gradient").alias("gradient"), r6("diff").alias("diff"))


@query("select z % 3 as channel, z // 3 as z, x, y, v from volume", "volume")
def channel_deinterleave(t: Tables) -> DataFrame:
    return S.deinterleave(t.volume(), 3).select("channel", "z", "x", "y", "v")


@query(f"with s as (select event_id as k, value as v from events) select case k % 2 when 0 then 'a' else 'b' end as channel, k // 2 // 5 as i, {s6('k * 0.01')} as t, v from s where (k // 2) % 5 = 0")
def interleaved_load(t: Tables) -> DataFrame:
    rows = t.table("events").select(F.col("event_id").alias("i"), F.col("value").alias("v"))
    return S.read_interleaved(rows, ["a", "b"], S.sampling_seconds("10ms"), 5).withColumn("t", r6("t"))


@query(f"with m as (select i as f, i * 1.5 as t from range(100) x(i)) select s.i as i, {s6('coalesce(m.t, 99 * 1.5 + 1.5 * (s.i - 99))')} as t from (select unnest(range(0, 200, 7)) as i) s left join m on m.f = s.i")
def align_extrapolate(t: Tables) -> DataFrame:
    mapping = t.spark.range(100).select(F.col("id").alias("frame"), (F.col("id") * 1.5).alias("t"))
    return S.frame_to_time(t.spark.range(0, 200, 7).withColumnRenamed("id", "i"), mapping).select("i", r6("t").alias("t"))


@query("select z, x, y, case when z = 0 then lead(v) over (partition by x, y order by z) else v end as v from volume", "volume")
def overwrite_first_frame(t: Tables) -> DataFrame:
    return S.replace_first(t.volume(), ["x", "y"]).select("z", "x", "y", "v")


# --- volumes


@query(f"select x, y, {s6('avg(v)')} as v from volume_data group by x, y", "volume_data")
def projection_mean_z(t: Tables) -> DataFrame:
    return V.project(t.volume_data()).select("x", "y", r6("v").alias("v"))


@query(f"select z, {s6('max(v)')} as v from volume_data group by z", "volume_data")
def projection_trace(t: Tables) -> DataFrame:
    return V.project(t.volume_data(), ("x", "y"), F.max).select("z", r6("v").alias("v"))


@query(f"with k as (select unnest(range(0, 4)) as k), m as (select k, x, y, avg(v) as v from volume, k where z >= k * 2 and z < k * 2 + 4 and k * 2 + 4 <= 12 group by all) select x, y, {s6('sum(v)')} as v from (select k, x, y, avg(v) as v from volume, (select unnest(range(0, 6)) as k) where z >= k * 2 and z < k * 2 + 4 and k * 2 + 4 <= 12 group by all) group by x, y", "volume")
def projection_windowed(t: Tables) -> DataFrame:
    return V.project_windowed(t.volume(), 4).select("x", "y", r6("v").alias("v"))


@query(f"with d as (select x, y, v - lag(v) over (partition by x, y order by z) as d from volume_data), s as (select sqrt(median(d * d) / 0.9133) as s from d where d is not null group by x, y) select {s6('median(s)')} as noise from s", "volume_data")
def noise_estimate(t: Tables) -> DataFrame:
    return V.noise_level(t.volume_data()).select(r6("noise").alias("noise"))


@query(f"select z, x, y, {s6('v - avg(v) over (partition by x, y)')} as v from volume_data", "volume_data")
def background_subtract(t: Tables) -> DataFrame:
    return V.subtract_background(t.volume_data()).select("z", "x", "y", r6("v").alias("v"))


@query(f"select z, x // 2 as x, y // 5 as y, {s6('avg(v)')} as v from volume group by all", "volume")
def pooling_rescale(t: Tables) -> DataFrame:
    return V.pool(t.volume(), 2, 5).select("z", "x", "y", r6("v").alias("v"))


@query(f"with b as (select *, min(v) over (partition by x, y) as b from volume_data) select z, x, y, {s6('(v - b) / nullif(b, 0)')} as v from b", "volume_data")
def dff_expression(t: Tables) -> DataFrame:
    v = t.volume_data()
    b = v.join(v.groupBy("x", "y").agg(F.min("v").alias("b")), ["x", "y"]).select("z", "x", "y", "b")
    return V.delta(v, b, "dFF").select("z", "x", "y", r6("v").alias("v"))


_GK = V.gaussian_kernel(1.0, 2)


def _axis(source: str, axis: str, size: int) -> str:
    terms = " + ".join(f"{w!r} * (select v from {source} b where {' and '.join(f'b.{a} = a.{a}' for a in 'zxy' if a != axis)} and b.{axis} = least(greatest(a.{axis} + {k}, 0), {size - 1}))" for k, w in zip(range(-2, 3), _GK, strict=True))
    return f"select z, x, y, {terms} as v from {source} a"


@query(f"with g1 as ({_axis('volume', 'z', 12)}), g2 as ({_axis('g1', 'x', 10)}), g3 as ({_axis('g2', 'y', 10)}) select z, x, y, {s6('v')} as v from g3", "volume")
def gaussian_separable(t: Tables) -> DataFrame:
    return V.smooth(t.volume(), 1.0, 2).select("z", "x", "y", r6("v").alias("v"))


@query("select z, x, y, v > 1.5 * (select stddev_pop(v) from volume) as active from volume", "volume")
def absolute_threshold(t: Tables) -> DataFrame:
    return V.threshold(t.volume(), 1.5).select("z", "x", "y", "active")


@query("select z, x, y from volume where x between 2 and 7 and y between 2 and 7", "volume")
def border_exclusion(t: Tables) -> DataFrame:
    return V.exclude_border(t.volume(), 2).select("z", "x", "y")


@query("select 'and' as how, count(*) as n from (select z, x, y from volume where v < 4 intersect select z, x, y from volume where v > 1) union all select 'or', count(*) from (select z, x, y from volume where v < 4 union select z, x, y from volume where v > 8)", "volume")
def mask_and_or(t: Tables) -> DataFrame:
    v = t.volume()
    m = lambda c: v.where(c).select("z", "x", "y")
    one = V.combine_masks(m("v < 4"), m("v > 1")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("and").alias("how"), "n")
    return one.union(V.combine_masks(m("v < 4"), m("v > 8"), "or").agg(F.count(F.lit(1)).alias("n")).select(F.lit("or").alias("how"), "n"))


_CODE = "(z * 1099511627776 + x * 1048576 + y)"


def _ccl(active: str, name: str = "c") -> str:
    return f"""m as (select z, x, y, {_CODE} as code from volume where {active}),
e as (select a.code as a, b.code as b from m a join m b on abs(a.z - b.z) + abs(a.x - b.x) + abs(a.y - b.y) = 1),
r(code, label) as (select code, code from m union select e.b, r.label from r join e on e.a = r.code where r.label < e.b),
{name} as (select m.z, m.x, m.y, l.label from m join (select code, min(label) as label from r group by code) l using (code))"""


def _active(t: Tables, cond: str = "v < 4") -> DataFrame:
    return t.volume().where(cond).select("z", "x", "y")


@query(f"with recursive {_ccl('v < 4')} select z, x, y, label from c", "volume")
def ccl_label(t: Tables) -> DataFrame:
    return V.label_components(_active(t), tile=5)


@query(f"with recursive {_ccl('v < 4')} select z, x, y from c where label in (select label from c group by label having count(*) >= 4)", "volume")
def remove_small_objects(t: Tables) -> DataFrame:
    return V.remove_small(_active(t), 4)


@query(f"with recursive {_ccl('v >= 7')} select z, x, y from volume where v < 7 union all select z, x, y from c where label in (select label from c group by label having count(*) < 3)", "volume")
def fill_small_holes(t: Tables) -> DataFrame:
    return V.fill_holes(t.volume().withColumn("active", F.col("v") < 7), 3)


@query(f"with recursive {_ccl('v < 4')} select label, min(z) as z0, max(z) + 1 as z1, min(x) as x0, max(x) + 1 as x1, min(y) as y0, max(y) + 1 as y1, count(*) as v_area, {s6('sqrt((max(x) + 1 - min(x)) ** 2 + (max(y) + 1 - min(y)) ** 2)')} as v_diameter, ((max(z) + 1 - min(z)) * (max(x) + 1 - min(x)) * (max(y) + 1 - min(y))) as v_bbox_pix_num from c group by label", "volume")
def bbox_extent(t: Tables) -> DataFrame:
    b = V.bounding_boxes(V.label_components(_active(t), tile=5))
    return b.select("label", "z0", "z1", "x0", "x1", "y0", "y1", "v_area", r6("v_diameter").alias("v_diameter"), "v_bbox_pix_num")


@query(
    f"""with recursive {_ccl('v < 4')}, b as (select label, min(z) as z0, max(z) as z1, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from c group by label),
f as (select b.label, v.z, avg(v.v) filter (where c.label is not null) as m, avg(v.v) filter (where c.label is null) as o from b join volume v on v.z between z0 and z1 and v.x between x0 and x1 and v.y between y0 and y1 left join c on c.label = b.label and c.z = v.z and c.x = v.x and c.y = v.y group by all),
t as (select label, list(coalesce(m, 0) order by z) as trace, list(coalesce(o, 0) order by z) as noise from f group by label)
select label, {s6('list_max(trace) - list_min(trace)')} as height, {s6('list_sum(trace)')} as total, {s6('abs((list_max(trace) - list_min(trace)) / nullif(list_sum(noise) / len(noise), 0))')} as snr from t""",
    "volume",
)
def masked_trace_snr(t: Tables) -> DataFrame:
    labels = V.label_components(_active(t), tile=5)
    got = V.event_traces(labels, t.volume())
    return got.select("label", r6("v_max_height").alias("height"), r6(F.aggregate("trace", F.lit(0.0), lambda a, v: a + v)).alias("total"), r6("v_signal_to_noise_ratio").alias("snr"))


@query(f"with recursive {_ccl('v < 4')} select label, count(distinct x * 100 + y) as n from c group by label", "volume")
def footprint_area(t: Tables) -> DataFrame:
    return V.footprints(V.label_components(_active(t), tile=5)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with recursive {_ccl('v < 4')}, f as (select distinct label, x, y from c),
mm as (select label, count(*) as n, avg(x) as cx, avg(y) as cy, var_pop(x) + 1.0::double / 12 as a, var_pop(y) + 1.0::double / 12 as c, covar_pop(x, y) as b, (max(x) - min(x) + 1) * (max(y) - min(y) + 1) as box from f group by label),
q as (select *, (a + c) / 2 + sqrt((a - c) ** 2 / 4 + b * b) as l1, (a + c) / 2 - sqrt((a - c) ** 2 / 4 + b * b) as l2 from mm)
select label, n as v_fp_area, {s6('cx')} as cx, {s6('cy')} as cy, {s6('4 * sqrt(l1)')} as major, {s6('4 * sqrt(greatest(l2, 0))')} as minor, {s6('n / box')} as extent, {s6('sqrt(4 * n / pi())')} as equivalent from q""",
    "volume",
)
def moments_shape(t: Tables) -> DataFrame:
    s = V.footprint_shape(V.label_components(_active(t), tile=5))
    return s.select("label", "v_fp_area", r6("v_fp_cx").alias("cx"), r6("v_fp_cy").alias("cy"), r6("v_fp_axis_major_length").alias("major"), r6("v_fp_axis_minor_length").alias("minor"), r6("v_fp_extent").alias("extent"), r6("v_fp_equivalent_diameter_area").alias("equivalent"))


@query()
def footprint_hulls(t: Tables) -> DataFrame:
    return V.footprint_hulls(V.label_components(_active(t), tile=5))


@query(f"with recursive {_ccl('v < 4')} select distinct c.label, c.z, c.x, c.y from c, (values (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy) where not exists (select 1 from c d where d.label = c.label and d.z = c.z and d.x = c.x + dx and d.y = c.y + dy)", "volume")
def contour_pixels(t: Tables) -> DataFrame:
    return V.contour_pixels(V.label_components(_active(t), tile=5))


_MASKED = "ev as (select id, id % 5 as z0, id % 4 as x0, id % 3 as y0, 2 as dx, 3 as dy, list_transform(range(12), lambda p: (p * 7 + id) % 3 <> 0) as mask, id::double as tr from range(1, 9) r(id))"


def _masked(t: Tables) -> DataFrame:
    e = t.spark.range(1, 9).select("id", (F.col("id") % 5).alias("z0"), (F.col("id") % 4).alias("x0"), (F.col("id") % 3).alias("y0"), F.lit(2).cast("long").alias("dx"), F.lit(3).cast("long").alias("dy"))
    return e.withColumn("mask", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda p: (p * 7 + F.col("id")) % 3 != 0))


@query(f"with {_MASKED}, p as (select *, unnest(range(12)) as p, unnest(mask) as live from ev) select z0 + p // 6 as z, x0 + p % 6 // 3 as x, y0 + p % 3 as y, sum(id)::bigint as v from p where live group by all")
def event_map_recreate(t: Tables) -> DataFrame:
    return V.event_map(_masked(t))


@query(
    f"""with {_MASKED}, p as (select *, unnest(range(12)) as p, unnest(mask) as live from ev), q as (select id, z0, z0 + 2 as z1, x0 + p % 6 // 3 as x, y0 + p % 3 as y, p // 6 as f from p where live),
b as (select q.id, v.z, avg(v.v) as v from q join volume v using (x, y) where (f = 0 and v.z >= greatest(z0 - 2, 0) and v.z < z0) or (f = 1 and v.z >= z1 and v.z < least(z1 + 3, 12)) group by all),
x as (select id, z, v from b union all select id, z0, tr from ev union all select id, z0 + 1, tr + 1 from ev)
select ev.id as event_key, greatest(z0 - 2, 0) as z0, least(z0 + 5, 12) as z1, z0 as z0_orig, list({s6('x.v')} order by x.z) as trace from ev join x using (id) group by ev.id, z0""",
    "volume",
)
def extend_traces(t: Tables) -> DataFrame:
    e = _masked(t).withColumn("z1", F.col("z0") + 2).withColumn("trace", F.array(F.col("id").cast("double"), F.col("id") + 1.0)).withColumnRenamed("id", "event_key")
    got = V.extend_events(e, t.volume(), 2, 3, 12)
    return got.select("event_key", "z0", "z1", "z0_orig", F.transform("trace", r6).alias("trace"))


@query("select (z - 2) * 9 + (x0 // 3) * 3 + y0 // 3 as item, z, z - 2 as z0, z + 2 as z1, x0::integer as x0, (x0 + 4)::integer as x1, y0::integer as y0, (y0 + 4)::integer as y1 from range(2, 11) a(z), range(0, 7, 3) b(x0), range(0, 7, 3) c(y0)")
def patch_index(t: Tables) -> DataFrame:
    return V.patch_index(12, 10, 10, 2, 1, (4, 4), (3, 3), t.spark)


@query("select z, x, y, v from volume", "volume")
def patch_stitch(t: Tables) -> DataFrame:
    p = V.patch_index(12, 10, 10, 0, 0, (4, 4), (2, 2), t.spark).select("z", "x0", "x1", "y0", "y1")
    axis = lambda a: F.explode(F.sequence(F.col(f"{a}0").cast("long"), F.col(f"{a}1").cast("long") - 1)).alias(a)
    cells = p.select("*", axis("x")).select("*", axis("y"))
    return V.stitch(cells.join(t.volume(), ["z", "x", "y"]), 1, 10, 10).select("z", "x", "y", "v")


@query("select * from (values ('balanced', 64, 64, 64), ('Z', 1000, 16, 16), ('XY', 2, 256, 256)) c(strategy, z, x, y)")
def chunk_inference(t: Tables) -> DataFrame:
    rows = [(s, *chunk_shape((1000, 256, 256), 8 if s != "balanced" else 4, s)) for s in ("balanced", "Z", "XY")]
    return t.spark.createDataFrame(rows, "strategy string, z int, x int, y int")


@query(f"select {s6('avg((abs(y_pred - y_true) + 1e-8) ** 4)')} as annealed, {s6('avg(sqrt(abs(y_pred - y_true) + 1e-8))')} as root from pred_true", "pred_true")
def annealed_loss(t: Tables) -> DataFrame:
    got = V.annealed_loss(t.pred_true(), "y_pred", "y_true")
    return got.select(r6("annealed").alias("annealed"), r6("root").alias("root"))


@query("select max(z) + 1 as frames, max(x) + 1 as width, max(y) + 1 as height from volume", "volume")
def metadata_scan(t: Tables) -> DataFrame:
    from eventloom.sources.storage import metadata

    return metadata(t.volume())


# --- kernels: tested against brute force


@query()
def find_peaks(t: Tables) -> DataFrame:
    return K.peak_table(t.signal(), prominence=50.0)


@query()
def temporal_threshold(t: Tables) -> DataFrame:
    return K.temporal_mask(t.volume(), prominence=3.0)


@query(
    """with d as (select c.zc, v.* from volume v, (select distinct z as zc from volume) c where v.z between c.zc - 1 and c.zc + 1), g as (select zc, min(v) as lo, max(v) as hi from d group by zc having count(distinct z) = 3 and count(distinct v) > 1),
h as (select zc, b.b as bin, lo, hi from g, range(256) b(b)), n as (select d.zc, least(floor((v - lo) / (hi - lo) * 256), 255)::bigint as bin, count(*) as n from d join g using (zc) group by all),
f as (select zc, bin, lo, hi, coalesce(n, 0) as n from h left join n using (zc, bin)), m as (select zc, max(n) as peak, arg_max(bin, (n, -bin)) as mode from f group by zc),
w as (select *, case when mode > 255 - mode then 0 else 255 end as stop from m),
l as (select f.zc, arg_max(lo + (bin + 0.5) * (hi - lo) / 256, (peak * (1 - abs(bin - mode) / abs(stop - mode)) - n, -abs(bin - mode))) as level from f join w using (zc) where bin between least(mode, stop) and greatest(mode, stop) group by f.zc),
s as (select v.z as zc, level, avg(v) filter (where v > level) as up, avg(v) filter (where v <= level) as down from volume v join l on l.zc = v.z group by all)
select z, x, y from volume v join s on s.zc = v.z where v.v > level and up > 1.1 * abs(down)""",
    "volume",
)
def spatial_threshold(t: Tables) -> DataFrame:
    return K.spatial_mask(t.volume())


@query()
def motion_shift(t: Tables) -> DataFrame:
    return K.motion_shifts(t.volume())


@query()
def rbf_baseline(t: Tables) -> DataFrame:
    return K.baselines(t.volume())


@query()
def sub_event_split(t: Tables) -> DataFrame:
    labels = V.label_components(_active(t), tile=5)
    return K.split_events(labels.join(t.volume(), ["z", "x", "y"]), 1)
