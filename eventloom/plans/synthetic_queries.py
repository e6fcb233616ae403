"""Queries over synthetic sources, long forms and patches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import events as E
from eventloom.operators import kernels as K
from eventloom.operators import volume as V
from eventloom.plans.registry import query, r6, s6
from eventloom.sources import storage, synthetic
from eventloom.sources.adapters import Tables


@query()
def synthetic_signals(t: Tables) -> DataFrame:
    return synthetic.signals(t.spark, 200, least=5)


@query()
def dummy_events(t: Tables) -> DataFrame:
    return synthetic.dummy_events(t.spark, 200, groups=3, clusters=10)


@query()
def simulated_volume(t: Tables) -> DataFrame:
    return synthetic.simulate_volume(t.spark)


@query()
def simulated_detection(t: Tables) -> DataFrame:
    """Blobs drawn with intensities into a noisy recording, smoothed, thresholded by frame, and counted: drawn and found."""
    drawn = synthetic.simulate_volume(t.spark, (36, 80, 80), (12, 20, 20), 0.5, voxels=150)
    noisy = storage.materialize(synthetic.recording_of(drawn, (36, 80, 80)), "recording")
    mask = K.spatial_mask(V.smooth(noisy, 0.8, 1))
    labels = V.label_components(V.remove_small(mask, 30), 20)
    n = lambda df, c, s: df.agg(F.countDistinct(c).alias("n")).select(F.lit(s).alias("source"), "n")
    return n(drawn, "event_id", "events").union(n(labels, "label", "found"))


@query("select case when i < 30 then 0 when i < 80 then 1 else 2 end as population, count(*) as n from range(100) x(i) group by all")
def population_mix(t: Tables) -> DataFrame:
    return synthetic.mixed(t.spark, 100, (0.3, 0.5, 0.2)).groupBy("population").agg(F.count(F.lit(1)).alias("n"))


@query("select z0::integer as z0, x0::integer as x0, y0::integer as y0, z0 * 9 * 8 + x0 * 8 + y0 as cell from range(0, 9, 6) a(z0), range(0, 7, 3) b(x0), range(0, 5, 4) c(y0)")
def grid_cells(t: Tables) -> DataFrame:
    return synthetic.cells(t.spark, (14, 9, 8), (4, 3, 4), 2).select("z0", "x0", "y0", "cell")


@query(f"with l as (select id, grp, unnest(trace) as value, unnest(range(len(trace))) as timepoint from traces_equal) select grp, timepoint::integer as timepoint, {s6('avg(value)')} as value from l group by all", "traces_equal")
def trials_long(t: Tables) -> DataFrame:
    long = t.traces_equal().select("grp", F.posexplode("trace").alias("timepoint", "value"))
    return long.groupBy("grp", "timepoint").agg(r6(F.avg("value")).alias("value"))


@query("select event_key, 'z0' as feature, z0 as v from intervals union all select event_key, 'dz', dz from intervals", "intervals")
def melted_features(t: Tables) -> DataFrame:
    return t.intervals().select("event_key", "z0", "dz").unpivot(["event_key"], ["z0", "dz"], "feature", "v")


@query("select event_key, z0 * 10 as t0, z1 * 10 as t1 from intervals where event_key % 5 <> 0", "intervals")
def missing_rows(t: Tables) -> DataFrame:
    df = E.frames_to_times(t.intervals(), function=lambda z: z * 10).withColumn("gap", F.when(F.col("event_key") % 5 != 0, F.lit(1.0)))
    return E.drop_missing(df, "rows", ["gap"]).select("event_key", "t0", "t1")


@query()
def bootstrap_means(t: Tables) -> DataFrame:
    """Median and interval of each cluster's mean over resamples of all its values."""
    return E.bootstrap_means(t.intervals(), "value", "cluster")
