"""Windowed counts over the events stream, in their batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.plans.registry import query, r6, s6
from eventloom.sources.adapters import Tables
from eventloom.streaming.windows import sessions, windowed


def _events(t: Tables) -> DataFrame:
    return t.table("events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"select (epoch(time_bucket(interval '6 hours', ts)) / 3600)::bigint as hour, event_type, count(*) as n, {s6('sum(value)')} as total from events group by all")
def tumbling_windows(t: Tables) -> DataFrame:
    hour = F.expr("timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', start)").cast("long")
    return windowed(_events(t), "6 hours").select(hour.alias("hour"), "event_type", "n", r6("total").alias("total"))


@query("with l as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '2 hours' then 0 else 1 end as f from events), s as (select user_id, sum(f) over (partition by user_id order by ts, f desc rows unbounded preceding) as k from l) select user_id, count(*) as n from s group by user_id, k")
def session_windows(t: Tables) -> DataFrame:
    return sessions(_events(t), "2 hours").select("user_id", "n")
