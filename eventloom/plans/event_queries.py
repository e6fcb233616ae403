"""Queries over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions import arrays as A
from eventloom.functions import features as feat
from eventloom.functions import normalize as N
from eventloom.operators import events as E
from eventloom.operators.graph import dot_products
from eventloom.plans.registry import query, r6, s6
from eventloom.sources.adapters import Tables
from eventloom.sources.storage import suffix_number

_MEAN = "(list_sum(t) / len(t))"


@query(
    f"""with n as (select id, cluster, list_transform(trace, lambda v: v - list_min(trace)) as t from traces_equal),
m as (select id, cluster, list_transform(t, lambda v: v / list_max(list_transform(t, lambda u: abs(u)))) as t from n)
select cluster, count(*) as n, {s6(f"avg({_MEAN})")} as mean_of_means, {s6("avg(sqrt(list_sum(list_transform(t, lambda v: (v - list_sum(t) / len(t)) ** 2)) / len(t)))")} as mean_std, {s6("avg(list_max(t))")} as mean_max from m group by cluster""",
    "traces_equal",
)
def entry_flagship(t: Tables) -> DataFrame:
    """Traces scaled to 0..1, three features each, by cluster."""
    got = feat.all_features(N.run(t.traces_equal(), {"default": "min_max"}), names=["mean", "std", "maximum"])
    return got.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *(r6(F.avg(c)).alias(o) for c, o in (("v_mean", "mean_of_means"), ("v_std", "mean_std"), ("v_maximum", "mean_max"))))


@query(f"select event_key, z0, z1, {s6('value / dz')} as value_norm, {s6('value * 2')} as twice, 'a' as \"group\", 'f' as file_name from intervals where z0 >= 10", "intervals")
def load_events_custom_columns(t: Tables) -> DataFrame:
    df = E.derive(t.intervals().withColumn("v_area", F.col("value")), {"twice": lambda d: F.col("value") * 2})
    df = E.recording(E.keep(df, {"z0": (10, None)}), "a", "s", "f")
    return df.select("event_key", "z0", "z1", r6("v_area_norm").alias("value_norm"), r6("twice").alias("twice"), "group", "file_name")


@query("select event_key, z0, cluster from intervals where z0 between 50 and 400 and cluster in ('view', 'click')", "intervals")
def filter_between_isin(t: Tables) -> DataFrame:
    return E.keep(t.intervals(), {"z0": (50, 400), "cluster": ["view", "click"]}).select("event_key", "z0", "cluster")


@query("select event_key, z0, z1 from intervals where z0 <= 100 and z1 >= 20", "intervals")
def filter_open_bounds(t: Tables) -> DataFrame:
    return E.keep(t.intervals(), E.parse_filters("z0:(,100)\nz1:(20,None)")).select("event_key", "z0", "z1")


@query("select event_key, z0, z1 from intervals where z0 >= 24 and z1 <= 240", "intervals")
def z_slice_events(t: Tables) -> DataFrame:
    return E.slice_events(t.intervals(), 24, 240).select("event_key", "z0", "z1")


@query("select cluster, count(*) as n from intervals where z0 >= 24 and z1 < 240 group by cluster", "intervals")
def z_slice_counts(t: Tables) -> DataFrame:
    return E.counts(E.slice_for_counts(t.intervals(), 24, 240))


@query("select (recording || 'x' || event_id) as event_key, event_id::varchar as subject_idx, file_name, value from recordings", "recordings")
def index_prefix_union(t: Tables) -> DataFrame:
    parts = [p.withColumnRenamed("event_id", "event_key") for p in t.recordings()]
    return E.combine(parts, [0, 1]).select("event_key", "subject_idx", "file_name", "value")


@query("select event_key, z0 from intervals where event_key = 77", "intervals")
def point_lookup(t: Tables) -> DataFrame:
    return t.intervals().where(F.col("event_key") == 77).limit(1).select("event_key", "z0")


@query(f"select id, unnest(range(len(trace))) as time, {s6('unnest(list_transform(trace, lambda v: coalesce(v, 0)))')} as value from traces_nan", "traces_nan")
def to_long_traces(t: Tables) -> DataFrame:
    return E.to_long(t.traces_nan(), "id").withColumn("value", r6("value"))


_PLACED = "select id, id % 40 as z0, len(trace) as dz, trace, cluster from traces_ragged"


def _placed(t: Tables) -> DataFrame:
    return t.traces_ragged().select("id", (F.col("id") % 40).alias("z0"), F.size("trace").alias("dz"), "trace", "cluster")


@query(f"with p as ({_PLACED}) select id, f.i as frame, {s6('trace[f.i - z0 + 1]')} as v from p, (select unnest(range(110)) as i) f where f.i >= z0 and f.i < z0 + dz", "traces_ragged")
def to_dense_spine(t: Tables) -> DataFrame:
    dense = E.to_dense(_placed(t), 110, "id").select("id", F.posexplode("dense").alias("frame", "v")).where("v is not null")
    return dense.select("id", F.col("frame").cast("long").alias("frame"), r6("v").alias("v"))


@query("select cluster, count(*) as n from intervals group by cluster", "intervals")
def counts_per_cluster(t: Tables) -> DataFrame:
    return E.counts(t.intervals())


@query("select cluster, count(*) filter (where grp = 0) as g0, count(*) filter (where grp = 1) as g1, count(*) filter (where grp = 2) as g2 from intervals group by cluster", "intervals")
def contingency_cluster_group(t: Tables) -> DataFrame:
    got = E.contingency(t.intervals(), "cluster", "grp", [0, 1, 2])
    return got.select("cluster", *(F.col(str(k)).alias(f"g{k}") for k in range(3)))


@query("select g.subject_id, c.cluster, count(i.event_key) as n from (select distinct subject_id from intervals) g cross join (select distinct cluster from intervals) c left join intervals i on i.subject_id = g.subject_id and i.cluster = c.cluster group by all", "intervals")
def frequency_pivot(t: Tables) -> DataFrame:
    return E.frequency(t.intervals(), "subject_id")


@query("select cluster, printf('%.2f', avg(value)) || ' ± ' || printf('%.2f', stddev_samp(value)) as value, printf('%.2f', avg(dz)) || ' ± ' || printf('%.2f', stddev_samp(dz)) as dz from intervals group by cluster", "intervals")
def summary_mean_std(t: Tables) -> DataFrame:
    return E.summary(t.intervals(), ["value", "dz"], "cluster")


_AVG = f"p as ({_PLACED}), l as (select z0 + unnest(range(len(trace))) as time, unnest(trace) as v from p), a as (select time, avg(v) as value from l group by time)"


@query(f"with {_AVG} select time, {s6('value')} as value from a", "traces_ragged")
def average_trace(t: Tables) -> DataFrame:
    return E.average_trace(_placed(t)).select("time", r6("value").alias("value"))


@query(f"with {_AVG} select time, case when count(*) over w = 5 then {s6('avg(value) over w')} end as value from a window w as (order by time rows between 2 preceding and 2 following)", "traces_ragged")
def average_trace_smoothed(t: Tables) -> DataFrame:
    return E.average_trace(_placed(t), window=5).select("time", r6("value").alias("value"))


@query(f"with {_AVG}, b as (select time, value, lag(value) over w as p, lead(value) over w as n from a window w as (order by time)) select time, {s6('case when p is null then n - value when n is null then value - p else (n - p) / 2 end')} as value from b", "traces_ragged")
def average_trace_gradient(t: Tables) -> DataFrame:
    return E.average_trace(_placed(t), gradient=True).select("time", r6("value").alias("value"))


def _rounded(df: DataFrame, key: str = "id", trace: str = "trace") -> DataFrame:
    return df.select(key, F.transform(trace, r6).alias("trace"))


def _each(expr: str, source: str = "traces_equal", extra: str = "") -> str:
    return f"select id, list_transform({expr}, lambda r: {s6('r')}) as trace from {source} {extra}"


_STD = "sqrt(list_sum(list_transform(trace, lambda u: (u - list_sum(trace) / len(trace)) ** 2)) / len(trace))"


@query(f"with m as (select id, list_transform(trace, lambda v: v - list_min(trace)) as trace from traces_ragged) {_each('list_transform(trace, lambda v: v / list_max(list_transform(trace, lambda u: abs(u))))', 'm')}", "traces_ragged")
def normalize_min_max(t: Tables) -> DataFrame:
    return _rounded(N.run(t.traces_ragged(), {"default": "min_max"}))


@query(_each(f"list_transform(trace, lambda v: (v - list_sum(trace) / len(trace)) / {_STD})"), "traces_equal")
def normalize_mean_std(t: Tables) -> DataFrame:
    return _rounded(N.run(t.traces_equal(), {"default": "mean_std"}))


@query(f"with s as (select max(v) as m from (select unnest(trace) as v from traces_ragged)) {_each('list_transform(trace, lambda v: v - m)', 'traces_ragged, s')}", "traces_ragged")
def normalize_population_max(t: Tables) -> DataFrame:
    return _rounded(N.subtract(t.traces_ragged(), "max", population_wide=True))


@query(f"with l as (select id, unnest(range(len(trace))) as p, unnest(trace) as v from traces_equal), s as (select p, max(abs(v)) as m from l group by p) select id, list({s6('case when m = 0 then v else v / m end')} order by p) as trace from l join s using (p) group by id", "traces_equal")
def normalize_columnwise(t: Tables) -> DataFrame:
    return _rounded(N.divide(t.traces_equal(), "max_abs", rows=False))


@query(f"with d as (select id, trace, {_STD} as s from traces_ragged), s as (select avg(s) as a, median(s) as b, max(s) as c from d) select id, {s6('trace[1] / a')} as by_mean, {s6('trace[1] / b')} as by_median, {s6('trace[1] / c')} as by_max from d, s", "traces_ragged")
def normalize_std_summaries(t: Tables) -> DataFrame:
    out = t.traces_ragged().select("id", F.array(F.get("trace", 0)).alias("trace"), F.col("trace").alias("full"))
    base = t.traces_ragged()
    parts = [N.divide(base, m).select("id", r6(F.get("trace", 0)).alias(o)) for m, o in (("std_mean", "by_mean"), ("std_median", "by_median"), ("std_max", "by_max"))]
    return out.select("id").join(parts[0], "id").join(parts[1], "id").join(parts[2], "id")


@query(_each("list_transform(trace, lambda v: v - trace[1])"), "traces_equal")
def normalize_first(t: Tables) -> DataFrame:
    return _rounded(N.subtract(t.traces_equal(), "first"))


@query(_each("list_transform(trace, lambda v: v - list_median(trace))", "traces_ragged"), "traces_ragged")
def normalize_median(t: Tables) -> DataFrame:
    return _rounded(N.subtract(t.traces_ragged(), "median"))


@query(_each("list_transform(trace, lambda v, i: case when i = 1 then 0 else v - trace[i - 1] end)", "traces_ragged"), "traces_ragged")
def normalize_diff(t: Tables) -> DataFrame:
    return _rounded(N.diff(t.traces_ragged()))


@query(_each("list_transform(trace, lambda v, i: coalesce(v, case when i = 1 then trace[2] when i = len(trace) then trace[i - 1] else (trace[i - 1] + trace[i + 1]) / 2 end))", "traces_nan"), "traces_nan")
def impute_nan_linear(t: Tables) -> DataFrame:
    return _rounded(N.impute_nan(t.traces_nan()))


@query(_each("list_transform(trace, lambda v: coalesce(v, 999))", "traces_nan"), "traces_nan")
def impute_nan_fixed(t: Tables) -> DataFrame:
    return _rounded(N.impute_nan(t.traces_nan(), 999))


@query(_each("list_concat(list_transform(range(greatest(10 - len(trace), 0)), lambda k: trace[1]), trace)[1:20]", "traces_ragged"), "traces_ragged")
def enforce_length(t: Tables) -> DataFrame:
    return _rounded(N.enforce_length(t.traces_ragged(), 10, 20))


@query("select (select min(len(trace)) <> max(len(trace)) from traces_equal) as equal_ragged, (select min(len(trace)) <> max(len(trace)) from traces_ragged) as ragged_ragged", "traces_equal", "traces_ragged")
def is_ragged(t: Tables) -> DataFrame:
    a, b = (N.is_ragged(x).withColumn("_k", F.lit(0)) for x in (t.traces_equal(), t.traces_ragged()))
    return a.withColumnRenamed("ragged", "equal_ragged").join(b.withColumnRenamed("ragged", "ragged_ragged"), "_k").drop("_k")


# --- features

_M = "list_sum(trace) / len(trace)"
_D = "list_transform(range(1, len(trace)), lambda i: trace[i + 1] - trace[i])"


def _moment(k: int) -> str:
    return f"(list_sum(list_transform(trace, lambda v: (v - {_M}) ** {k})) / len(trace))"


def _features(names: dict[str, str], *, doubles: set[str] | None = None, source: str = "traces_ragged") -> str:
    keep = set(names) if doubles is None else doubles
    return f"select id, {', '.join((s6(e) if n in keep else e) + ' as v_' + n for n, e in names.items())} from {source}"


def _feature_query(t: Tables, names: list[str], whole: tuple[str, ...] = ()) -> DataFrame:
    got = feat.all_features(t.traces_ragged(), names=names)
    return got.select("id", *(F.col(f"v_{n}") if n in whole else r6(f"v_{n}").alias(f"v_{n}") for n in names))


_MOMENTS = {"mean": _M, "var": _moment(2), "std": f"sqrt{_moment(2)}", "skew": f"{_moment(3)} / {_moment(2)} ** 1.5", "kurt": f"{_moment(4)} / {_moment(2)} ** 2 - 3", "variation": f"sqrt{_moment(2)} / nullif({_M}, 0)"}


@query(_features(_MOMENTS), "traces_ragged")
def feat_moments(t: Tables) -> DataFrame:
    return _feature_query(t, list(_MOMENTS))


_ORDER = {"median": "list_median(trace)", "minimum": "list_min(trace)", "maximum": "list_max(trace)", "median_absolute_deviation": "list_median(list_transform(trace, lambda v: abs(v - list_median(trace))))"}


@query(_features(_ORDER), "traces_ragged")
def feat_order_stats(t: Tables) -> DataFrame:
    return _feature_query(t, list(_ORDER))


_SQ = "list_sum(list_transform(trace, lambda v: v * v))"
_ENERGY = {"vec_sum": "list_sum(trace)", "abs_sum": "list_sum(list_transform(trace, lambda v: abs(v)))", "abs_energy": _SQ, "mse": _SQ, "mean_abs": "list_sum(list_transform(trace, lambda v: abs(v))) / len(trace)", "root_mean_square": f"sqrt({_SQ} / len(trace))", "emg_var": f"{_SQ} / (len(trace) - 1)"}


@query(_features(_ENERGY), "traces_ragged")
def feat_energy(t: Tables) -> DataFrame:
    return _feature_query(t, list(_ENERGY))


_DIFFS = {"mean_diff": "(trace[len(trace)] - trace[1]) / (len(trace) - 1)", "means_abs_diff": f"list_sum(list_transform({_D}, lambda d: abs(d))) / (len(trace) - 1)", "waveform_length": f"list_sum(list_transform({_D}, lambda d: abs(d)))", "cid_ce": f"sqrt(list_sum(list_transform({_D}, lambda d: d * d))) / sqrt{_moment(2)}", "willison_amplitude": f"len(list_filter({_D}, lambda d: abs(d) >= 0))::integer"}


@query(_features(_DIFFS, doubles=set(_DIFFS) - {"willison_amplitude"}), "traces_ragged")
def feat_diffs(t: Tables) -> DataFrame:
    return _feature_query(t, list(_DIFFS), ("willison_amplitude",))


_CROSS = {
    "mean_crossings": f"len(list_filter(range(1, len(trace)), lambda i: sign(trace[i] - {_M}) <> sign(trace[i + 1] - {_M})))::integer",
    "zero_crossing": "len(list_filter(range(1, len(trace)), lambda i: sign(trace[i]) <> sign(trace[i + 1])))::integer",
    "slope_sign_changes": "len(list_filter(range(2, len(trace)), lambda i: (trace[i] - trace[i - 1]) * (trace[i] - trace[i + 1]) >= 0))::integer",
}


@query(_features(_CROSS, doubles=set()), "traces_ragged")
def feat_crossings(t: Tables) -> DataFrame:
    return _feature_query(t, list(_CROSS), tuple(_CROSS))


_RUNS = "with l as (select id, unnest(range(len(trace))) as p, unnest(trace) as v, {m} as m from traces_ragged), g as (select id, v > m as a, v < m as b, p - row_number() over (partition by id, v > m order by p) as ga, p - row_number() over (partition by id, v < m order by p) as gb from l), x as (select id, count(*) as n from g where a group by id, ga), y as (select id, count(*) as n from g where b group by id, gb) select t.id, coalesce((select max(n) from x where x.id = t.id), 0)::integer as v_longest_strike_above_mean, coalesce((select max(n) from y where y.id = t.id), 0)::integer as v_longest_strike_below_mean from traces_ragged t"


@query(_RUNS.format(m=_M), "traces_ragged")
def feat_strikes(t: Tables) -> DataFrame:
    names = ["longest_strike_above_mean", "longest_strike_below_mean"]
    return _feature_query(t, names, tuple(names))


@query(f"with q as (select id, list_transform(trace, lambda v: round(v, 1)) as trace from traces_ragged) select id, {s6('len(list_filter(trace, lambda v: len(list_filter(trace, lambda w: w = v)) > 1)) / len(trace)')} as v_reoccurring from q", "traces_ragged")
def feat_reoccurring(t: Tables) -> DataFrame:
    x = t.traces_ragged().withColumn("trace", F.transform("trace", lambda v: F.round(v, 1)))
    return x.select("id", r6(feat.percentage_of_reoccurring_datapoints_to_all_datapoints(F.col("trace"))).alias("v_reoccurring"))


_RANGE = "(list_max(trace) - list_min(trace))"


@query(f"select id, sqrt{_moment(2)} > 0.5 * {_RANGE} as v_large_standard_deviation, abs({_M} - list_median(trace)) < 0.5 * {_RANGE} as v_symmetry_looking, {_moment(2)} > sqrt{_moment(2)} as v_variance_larger_than_standard_deviation from traces_equal", "traces_equal")
def feat_flags(t: Tables) -> DataFrame:
    names = ["large_standard_deviation", "symmetry_looking", "variance_larger_than_standard_deviation"]
    return feat.all_features(t.traces_equal(), names=names).select("id", *(f"v_{n}" for n in names))


@query(f"with p as (select id, list_transform(trace, lambda v: abs(v) + 0.01) as trace from traces_ragged) select id, {s6('exp(list_sum(list_transform(trace, lambda v: ln(v))) / len(trace))')} as v_gmean, {s6('len(trace) / list_sum(list_transform(trace, lambda v: 1 / v))')} as v_hmean, {s6('-list_sum(list_transform(trace, lambda v: v / list_sum(trace) * log2(v / list_sum(trace))))')} as v_shannon_entropy from p", "traces_ragged")
def feat_means_entropy(t: Tables) -> DataFrame:
    x = t.traces_ragged().withColumn("trace", F.transform("trace", lambda v: F.abs(v) + 0.01))
    names = ["gmean", "hmean", "shannon_entropy"]
    return feat.all_features(x, names=names).select("id", *(r6(f"v_{n}").alias(f"v_{n}") for n in names))


# --- joins

_LOOKUP = "lookup as (select event_key, (event_key % 7)::integer as label from intervals where event_key % 3 = 0)"


def _lookup(t: Tables) -> DataFrame:
    return t.intervals().where("event_key % 3 = 0").select("event_key", (F.col("event_key") % 7).cast("int").alias("label"))


@query(f"with {_LOOKUP} select i.event_key, l.label as c from intervals i left join lookup l using (event_key)", "intervals")
def add_clustering_left_join(t: Tables) -> DataFrame:
    return E.add_clusters(t.intervals(), _lookup(t), out="c").select("event_key", "c")


@query(f"with {_LOOKUP} select i.event_key, coalesce(l.label, -1) as c from intervals i left join lookup l using (event_key)", "intervals")
def lookup_default(t: Tables) -> DataFrame:
    return E.add_clusters(t.intervals(), _lookup(t), out="c", default=-1).select("event_key", "c")


@query("with f as (select event_key, subject_id, event_key % 4 as cluster from intervals), s as (select distinct subject_id, cluster, (subject_id * 4 + cluster) % 6 as label from f) select i.event_key, f.cluster, s.label from intervals i left join f using (event_key, subject_id) left join s on s.subject_id = f.subject_id and s.cluster = f.cluster", "intervals")
def two_step_compose(t: Tables) -> DataFrame:
    i = t.intervals().drop("cluster")
    f = i.select("event_key", "subject_id", (F.col("event_key") % 4).alias("cluster"))
    s = f.select("subject_id", "cluster").distinct().withColumn("label", (F.col("subject_id") * 4 + F.col("cluster")) % 6)
    return E.compose_clusters(i.select("event_key", "subject_id"), f, s).select("event_key", "cluster", "label")


_TRACED = "e as (select event_key, z0, z1, list_transform(range(dz), lambda k: (event_key + k * 3) % 17 + value) as trace from intervals)"


def _traced(t: Tables) -> DataFrame:
    return t.intervals().withColumn("trace", F.transform(F.sequence(F.lit(0).cast("long"), F.col("dz") - 1), lambda k: (F.col("event_key") + k * 3) % 17 + F.col("value"))).select("event_key", "z0", "z1", "trace")


def _trials_sql(pick: str) -> str:
    cell = f"list_transform(range(7), lambda k: case when t - 4 + k - z0 >= 0 then {s6('trace[t - 4 + k - z0 + 1]')} end)"
    return f"with {_TRACED}, h as (select event_key, t from e join stimuli on t >= z0 and t <= z1), p as ({pick}) select event_key, t, {cell} as trial from e join p using (event_key)"


def _trials(t: Tables, how: str) -> DataFrame:
    return E.trials(_traced(t), t.stimuli(), 7, how).select("event_key", "t", F.transform("trial", r6).alias("trial"))


@query(_trials_sql("select event_key, min(t) as t from h group by event_key"), "intervals", "stimuli")
def trials_first(t: Tables) -> DataFrame:
    return _trials(t, "first")


@query(_trials_sql("select event_key, t from h"), "intervals", "stimuli")
def trials_expand(t: Tables) -> DataFrame:
    return _trials(t, "expand")


@query(_trials_sql("select event_key, min(t) as t from h group by event_key having count(*) = 1"), "intervals", "stimuli")
def trials_exclude(t: Tables) -> DataFrame:
    return _trials(t, "exclude")


@query("select event_key, count(t) as n from intervals left join stimuli on t > z0 and t < z1 group by event_key", "intervals", "stimuli")
def coincidence_counts(t: Tables) -> DataFrame:
    return E.coincidences(t.intervals(), t.stimuli()).select("event_key", "n")


@query(f"select event_key, list(t order by t) as at, list({s6('(t - z0) / (z1 - z0)')} order by t) as relative from intervals join stimuli on t > z0 and t < z1 group by event_key", "intervals", "stimuli")
def coincidence_relative_location(t: Tables) -> DataFrame:
    return E.coincidences(t.intervals(), t.stimuli()).where("n > 0").select("event_key", "at", F.transform("relative", r6).alias("relative"))


@query("with v as (select event_key % 500 as event_id, z0 as z from intervals) select event_id, min(z) as start, max(z) + 1 as \"end\" from v group by event_id", "intervals")
def time_map(t: Tables) -> DataFrame:
    return E.time_map(t.intervals().select((F.col("event_key") % 500).alias("event_id"), F.col("z0").alias("z")))


@query("select frame, cluster, count(*) as n from (select cluster, unnest(range(z0, z1)) as frame from intervals) group by all", "intervals")
def time_map_by_cluster(t: Tables) -> DataFrame:
    return E.active_by_cluster(t.intervals())


@query("select s as start, list_transform(range(48), lambda i: case when (s + i) % 24 = 0 then 1 else 0 end) as hits from (select unnest(range(0, 700 - 48 + 1, 10)) as s)", "intervals", "stimuli")
def stimulus_windows(t: Tables) -> DataFrame:
    return E.stimulus_windows(t.stimuli(), 700, 48, 10)


@query(f"select event_key, {s6('z0 * 2.0')} as t0, {s6('z1 * 2.0')} as t1, {s6('(z1 - z0) * 2.0')} as dt from intervals", "intervals")
def frame_to_time(t: Tables) -> DataFrame:
    mapping = t.spark.range(2000).select(F.col("id").alias("frame"), (F.col("id") * 2.0).alias("t"))
    return E.frames_to_times(t.intervals(), mapping).select("event_key", r6("t0").alias("t0"), r6("t1").alias("t1"), r6("dt").alias("dt"))


# --- sampling, splits, statistics


@query("select event_key, cluster, case when value < m - 2 * s then 'low' when value > m + 2 * s then 'high' else 'mid' end as band from intervals, (select avg(value) as m, stddev_pop(value) as s from intervals)", "intervals")
def outlier_split(t: Tables) -> DataFrame:
    return E.split_outliers(t.intervals(), "value").select("event_key", "cluster", "band")


@query()
def sample_stratified(t: Tables) -> DataFrame:
    return E.sample(t.intervals(), 20, "cluster").select("event_key", "cluster")


@query(f"with s as (select subject_id, count(*) as n from intervals group by subject_id), g as (select unnest([40.0, 60.0, 70.0]) as low, unnest([65.0, 75.0, 200.0]) as high) select low::double as low, high::double as high, {s6('sum(case when n between low and high then n else 0 end) / sum(n)')} as share from s, (select a.low, b.high from g a, g b) group by all", "intervals")
def retention_grid(t: Tables) -> DataFrame:
    got = E.retention(E.counts(t.intervals(), "subject_id"), [40, 60, 70], [65, 75, 200])
    return got.select("low", "high", r6("share").alias("share"))


@query("with s as (select subject_id from intervals group by subject_id having count(*) between 60 and 70) select event_key from intervals where subject_id in (select subject_id from s)", "intervals")
def cluster_size_filter(t: Tables) -> DataFrame:
    return E.size_filter(t.intervals(), 60, 70, "subject_id").select("event_key")


@query(f"with e as (select event_key % 3 as missed, event_key % 2 as extra, 4 as expected from intervals) select {s6('sum(missed) / sum(expected) * 100')} as fn, {s6('sum(extra) / sum(expected) * 100')} as fp, {s6('avg(case when missed > 0 or extra > 0 then 1.0 else 0 end) * 100')} as any_error from e", "intervals")
def timing_error_rates(t: Tables) -> DataFrame:
    e = t.intervals().select((F.col("event_key") % 3).alias("missed"), (F.col("event_key") % 2).alias("extra"), F.lit(4).alias("expected"))
    return E.error_rates(e, "missed", "extra", "expected").select(r6("fn").alias("fn"), r6("fp").alias("fp"), r6("any").alias("any_error"))


@query("select cluster, min(value) filter (where grp = 0) as g0, min(value) filter (where grp = 1) as g1, min(value) filter (where grp = 2) as g2 from intervals group by cluster", "intervals")
def experiment_min_pivot(t: Tables) -> DataFrame:
    got = E.worst_of(t.intervals(), "cluster", "grp", "value", [0, 1, 2])
    return got.select("cluster", *(F.col(str(k)).alias(f"g{k}") for k in range(3)))


@query("with c as (select min(n) as n from (select count(*) as n from intervals group by cluster)), r as (select event_key, cluster, row_number() over (partition by cluster order by event_key) as k from intervals) select event_key, cluster from r, c where k <= n", "intervals")
def balance_classes(t: Tables) -> DataFrame:
    return E.balance(t.intervals(), "cluster", "event_key").select("event_key", "cluster")


@query("select event_key, case when row_number() over (order by event_key) <= floor((select count(*) from intervals) * 0.7) then 'train' else 'test' end as split from intervals", "intervals")
def sequential_split(t: Tables) -> DataFrame:
    return E.sequential_split(t.intervals(), "event_key", (0.7, 0.3)).select("event_key", "split")


@query("select event_key, ntile(4) over (order by value, event_key)::integer as contrast from intervals", "intervals")
def qcut_contrasts(t: Tables) -> DataFrame:
    return E.contrasts(t.intervals(), "value", 4, "event_key").select("event_key", "contrast")


@query("select event_key, cluster, dense_rank() over (order by cluster)::integer - 1 as code from intervals", "intervals")
def label_encoding(t: Tables) -> DataFrame:
    return N.rank_labels(t.intervals(), "cluster", "code").select("event_key", "cluster", "code")


@query("select min(z0) as first, max(z1) as last, count(*) as n, count(distinct cluster) as clusters from intervals", "intervals")
def events_overview(t: Tables) -> DataFrame:
    return t.intervals().agg(F.min("z0").alias("first"), F.max("z1").alias("last"), F.count(F.lit(1)).alias("n"), F.countDistinct("cluster").alias("clusters"))


@query("select name, string_split(name, '#')[2]::bigint as number from names", "names")
def numeric_suffix_order(t: Tables) -> DataFrame:
    return t.table("customer").select(F.col("c_name").alias("name"), suffix_number("c_name", "#").alias("number")).orderBy("number")


@query(f"select i.id as i, j.id as j, {s6('list_dot_product(i.trace, j.trace)')} as d from traces_equal i join traces_equal j on i.id < j.id", "traces_equal")
def dot_pairs(t: Tables) -> DataFrame:
    return dot_products(t.traces_equal(), places=6)
