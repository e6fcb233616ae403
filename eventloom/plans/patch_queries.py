"""Queries over patches of a recording that grows with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import patches as P
from eventloom.plans.registry import query, r6, s6
from eventloom.sources.adapters import Tables

#: Patches of 3 frames and 6 x 6 pixels about each eighth frame of images of 8 x 8.
_GRID = "g as (select zi * 4 + xi * 2 + yi as item, zi * 8 as z0, xi * 6 as x0, yi * 6 as y0 from (select unnest(range(0, (select (max(z) + 8) // 8 from volume_data))) as zi) a, range(2) b(xi), range(2) c(yi))"
_PLACES = "q as (select item, dz, dx, dy, z0 - 1 + dz as cz, x0 + dx as cx, y0 + dy as cy from g, range(3) a(dz), range(6) b(dx), range(6) c(dy)), n as (select max(z) + 1 as n from volume_data)"


def _padded(at: str, n: str, how: str) -> str:
    return f"greatest(0, least({at}, {n} - 1))" if how == "edge" else f"(case when (({at} % (2 * {n})) + 2 * {n}) % (2 * {n}) < {n} then (({at} % (2 * {n})) + 2 * {n}) % (2 * {n}) else 2 * {n} - 1 - (({at} % (2 * {n})) + 2 * {n}) % (2 * {n}) end)"


def _cells_sql(how: str) -> str:
    places = ", ".join(f"{_padded('c' + a, n, how)} as {a}" for a, n in (("z", "n"), ("x", "8"), ("y", "8"))) if how else "cz as z, cx as x, cy as y"
    return f"{_GRID}, {_PLACES}, p as (select item, dz, dx, dy, {places} from q, n), c as (select item, dz, dx, dy, coalesce(v, 0) as v from p left join volume_data using (z, x, y))"


def _dice(seed: int, faces: int) -> str:
    return f"((item * 2654435761 + {seed} * 40503) % 4294967296) // 4096 % {faces}"


def _cells(t: Tables, how: str | None) -> DataFrame:
    voxels = t.volume_data()
    frames = voxels.agg(F.max("z") + 1).first()[0]
    return P.cells(voxels, P.padded_grid(t.spark, frames, 8, 8, 1, 1, (6, 6), (6, 6), 8), (frames, 8, 8), how)


def _sums(df: DataFrame) -> DataFrame:
    place = F.col("dz") * 36 + F.col("dx") * 6 + F.col("dy") + 1
    return df.groupBy("item").agg(F.count(F.lit(1)).alias("cells"), r6(F.sum("v")).alias("total"), r6(F.sum(F.col("v") * place)).alias("placed"))


_SUMS = f"select item, count(*) as cells, {s6('sum(v)')} as total, {s6('sum(v * (dz * 36 + dx * 6 + dy + 1))')} as placed from c group by item"


@query(f"with {_cells_sql('edge')} {_SUMS}", "volume_data")
def patch_cells_edge(t: Tables) -> DataFrame:
    return _sums(_cells(t, "edge"))


@query(f"with {_cells_sql('symmetric')} {_SUMS}", "volume_data")
def patch_cells_symmetric(t: Tables) -> DataFrame:
    return _sums(_cells(t, "symmetric"))


@query(f"with {_cells_sql('')}, s as ({_SUMS}) select item, cells, total, placed, item // 16 as batch from s", "volume_data")
def patch_batches(t: Tables) -> DataFrame:
    return P.batches(_sums(_cells(t, None)), 16)


@query(
    f"""with {_cells_sql("edge").replace(", c as (", ", k as (")},
a as (select *, {_dice(0, 4)} as rotation, {_dice(1, 3)} as flip, case when {_dice(2, 4)} = 0 then {_dice(3, 3)} else -1 end as drop_frame from k),
t as (select item, dz, flip, case rotation when 1 then 5 - dy when 2 then 5 - dx when 3 then dy else dx end as dx, case rotation when 1 then dx when 2 then 5 - dy when 3 then 5 - dx else dy end as dy, case when dz = drop_frame then 0 else v end as v from a),
c as (select item, dz, case when flip = 1 then 5 - dx else dx end as dx, case when flip = 2 then 5 - dy else dy end as dy, v from t) {_SUMS}""",
    "volume_data",
)
def patch_augmented(t: Tables) -> DataFrame:
    return _sums(P.augment(P.augmentation(_cells(t, "edge"), drop_every=4, frames=3), 6))


@query(
    f"""with {_cells_sql("edge").replace(", c as (", ", k as (")},
s as (select item, avg(v) as m, case when stddev_pop(v) > 0 then stddev_pop(v) else 1 end as sd from k group by item),
c as (select item, dz, dx, dy, (v - m) / sd as v from k join s using (item)) {_SUMS}""",
    "volume_data",
)
def patch_local_norm(t: Tables) -> DataFrame:
    cells = _cells(t, "edge")
    return _sums(P.normalized(cells, P.local_stats(cells)))
