"""Views of the driver's tables in the shapes that the operators take, each with its DuckDB twin in VIEWS."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STIMULUS_EVERY = 24

VIEWS: dict[str, str] = {
    "traces_equal": "select vec_id as id, label as cluster, vec_id % 3 as grp, vec_id % 5 as subject_id, embedding::double[] as trace from embeddings",
    "traces_ragged": "select id, cluster, grp, subject_id, trace[1:2 + id % 63] as trace from traces_equal",
    "traces_nan": "select id, cluster, grp, subject_id, list_transform(trace, lambda v, i: case when i = 1 + id % len(trace) then null else v end) as trace from traces_equal",
    "intervals": "select event_id as event_key, z0, z0 + dz as z1, dz, event_type as cluster, user_id % 3 as grp, user_id as subject_id, value from (select *, floor((epoch(ts) - epoch(timestamp '2024-01-01')) / 3600)::bigint as z0, 1 + event_id % 12 as dz from events)",
    "stimuli": f"select t from (select unnest(range(0, (select max(z1) + 1 from intervals), {STIMULUS_EVERY})) as t)",
    "signal": "select user_id % 2 as channel, row_number() over (partition by user_id % 2 order by event_id) - 1 as i, event_id, value as v from events",
    "volume": "select z::bigint as z, x::bigint as x, y::bigint as y, ((z * 7 + x * x * 3 + y * 5 + x * y) % 11)::double as v from range(12) a(z), range(10) b(x), range(10) c(y)",
    "volume_data": "select date_diff('day', date '1995-01-01', l_shipdate::date)::bigint as z, l_suppkey % 8 as x, l_partkey % 8 as y, sum(l_quantity) as v from lineitem group by all",
    "recordings": "select *, user_id % 2 as recording, 'rec' || (user_id % 2)::varchar as file_name from events",
    "pred_true": "select doc_id as id, quality as y_true, toxic as y_pred from labels",
    "units": "select id, list_transform(c, lambda v: v / sqrt(list_dot_product(c, c))) as u from (select id, list_transform(trace, lambda v: v - m) as c from (select id, trace, list_sum(trace) / len(trace) as m from traces_equal))",
    "rs": "select a.id as i, b.id as j, list_dot_product(a.u, b.u) as r from units a join units b on a.id < b.id",
    "ds": "select a.id as i, b.id as j, list_distance(a.trace, b.trace) as d from traces_equal a join traces_equal b on a.id < b.id",
    "names": "select c_name as name from customer",
}
_NEEDS = {"traces_ragged": ["traces_equal"], "traces_nan": ["traces_equal"], "stimuli": ["intervals"], "units": ["traces_equal"], "rs": ["units"], "ds": ["traces_equal"]}


def with_views(sql: str, *names: str) -> str:
    """sql with the named views, and those that they need, in front of it."""
    order: list[str] = []

    def need(n: str) -> None:
        for m in _NEEDS.get(n, []):
            need(m)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    head = ", ".join(f"{n} as ({VIEWS[n]})" for n in order)
    sql = sql.strip()
    return f"with recursive {head}, {sql[15:]}" if sql.startswith("with recursive ") else f"with {head}, {sql[5:]}" if sql.startswith("with ") else f"with {head} {sql}"


class Tables:
    """The driver's tables in a folder, and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def traces_equal(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), (F.col("vec_id") % 3).alias("grp"), (F.col("vec_id") % 5).alias("subject_id"), F.col("embedding").cast("array<double>").alias("trace"))

    def traces_ragged(self) -> DataFrame:
        return self.traces_equal().withColumn("trace", F.slice("trace", F.lit(1), (2 + F.col("id") % 63).cast("int")))

    def traces_nan(self) -> DataFrame:
        return self.traces_equal().withColumn("trace", F.transform("trace", lambda v, i: F.when(i != F.col("id") % F.size("trace"), v)))

    def intervals(self) -> DataFrame:
        hours = F.expr("floor(timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) / 3600)").cast("long")
        base = self.table("events").withColumn("z0", hours).withColumn("dz", 1 + F.col("event_id") % 12)
        return base.select(F.col("event_id").alias("event_key"), "z0", (F.col("z0") + F.col("dz")).alias("z1"), "dz", F.col("event_type").alias("cluster"), (F.col("user_id") % 3).alias("grp"), F.col("user_id").alias("subject_id"), "value")

    def stimuli(self) -> DataFrame:
        """One stimulus every STIMULUS_EVERY frames of the intervals' range; one row a frame, made where it is needed."""
        top = self.intervals().agg(F.max("z1").alias("m"))
        return top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"), F.lit(STIMULUS_EVERY).cast("long"))).alias("t"))

    def signal(self) -> DataFrame:
        from eventloom.operators.signals import number_rows

        return number_rows(self.table("events").select((F.col("user_id") % 2).alias("channel"), "event_id", F.col("value").alias("v")), "channel", "event_id", "i")

    def volume(self) -> DataFrame:
        cells = self.spark.range(12 * 10 * 10).select(F.floor(F.col("id") / 100).alias("z"), F.floor(F.col("id") / 10 % 10).cast("long").alias("x"), (F.col("id") % 10).alias("y"))
        return cells.withColumn("v", ((F.col("z") * 7 + F.col("x") * F.col("x") * 3 + F.col("y") * 5 + F.col("x") * F.col("y")) % 11).cast("double"))

    def volume_data(self) -> DataFrame:
        day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
        return self.table("lineitem").groupBy(day.alias("z"), (F.col("l_suppkey") % 8).alias("x"), (F.col("l_partkey") % 8).alias("y")).agg(F.sum("l_quantity").alias("v"))

    def recordings(self) -> list[DataFrame]:
        e = self.table("events")
        return [e.where(F.col("user_id") % 2 == k).withColumn("recording", F.lit(k).cast("long")).withColumn("file_name", F.lit(f"rec{k}")) for k in (0, 1)]

    def pred_true(self) -> DataFrame:
        return self.table("labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))
