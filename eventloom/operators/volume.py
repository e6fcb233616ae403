"""Image volumes as voxel tables (z, x, y, v): projections, noise, masks, morphology, component labels and event descriptors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions import arrays as A
from eventloom.operators.signals import exact_median
from eventloom.sources.storage import materialize


def project(voxels: DataFrame, axes: tuple[str, ...] = ("z",), how: Callable[[str], Column] = F.avg) -> DataFrame:
    """Reduce over axes: over z to an image, over x and y to a trace."""
    left = [a for a in ("z", "x", "y") if a not in axes]
    return voxels.groupBy(*left).agg(how("v").alias("v"))


def project_windowed(voxels: DataFrame, width: int, how: Callable = F.avg, how_windows: Callable = F.sum) -> DataFrame:
    """Reduce each complete window of `width` frames, taken every width // 2, and then over windows."""
    step = max(1, width // 2)
    top = voxels.agg((F.max("z") + 1).alias("frames"))
    at = F.sequence(F.greatest(F.ceil((F.col("z") - width + 1) / step), F.lit(0)), F.floor(F.col("z") / step))
    dealt = voxels.join(F.broadcast(top), how="cross").select("x", "y", "v", F.explode(at).alias("k"), "frames").where(F.col("k") * step + width <= F.col("frames"))
    return dealt.groupBy("k", "x", "y").agg(how("v").alias("v")).groupBy("x", "y").agg(how_windows("v").alias("v"))


def noise_level(voxels: DataFrame) -> DataFrame:
    """One row: median over pixels of sqrt(median over frames of squared differences / 0.9133)."""
    w = W.partitionBy("x", "y").orderBy("z")
    d = voxels.withColumn("d", F.col("v") - F.lag("v").over(w)).where("d is not null")
    # 0.9133 is a fixed value of the definition
    pixels = materialize(d.groupBy("x", "y").agg(F.sqrt(F.median(F.col("d") * F.col("d")) / 0.9133).alias("s")))
    return exact_median(pixels, "s").select(F.col("s").alias("noise"))


def subtract_background(voxels: DataFrame, background: DataFrame | None = None, how: Callable = F.avg) -> DataFrame:
    """v minus a background (x, y, b); by default each pixel's own reduction over frames."""
    b = background if background is not None else project(voxels, ("z",), how).withColumnRenamed("v", "b")
    return voxels.join(b, ["x", "y"]).withColumn("v", F.col("v") - F.col("b")).drop("b")


def delta(voxels: DataFrame, background: DataFrame, method: str = "dF") -> DataFrame:
    """By a background (z, x, y, b): background, dF = v - b, or dFF = (v - b) / b, NULL where b is 0."""
    out = voxels.join(background, ["z", "x", "y"])
    value = {"background": F.col("b"), "dF": F.col("v") - F.col("b"), "dFF": F.try_divide(F.col("v") - F.col("b"), F.col("b"))}[method]
    return out.withColumn("v", value).drop("b")


def pool(voxels: DataFrame, fx: int, fy: int) -> DataFrame:
    """Rescale by whole factors: the mean of each fx x fy block."""
    return voxels.groupBy("z", F.floor(F.col("x") / fx).alias("x"), F.floor(F.col("y") / fy).alias("y")).agg(F.avg("v").alias("v"))


def gaussian_kernel(sigma: float, radius: int) -> list[float]:
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return (k / k.sum()).tolist()


def smooth(voxels: DataFrame, sigma: float, radius: int, axes: tuple[str, ...] = ("z", "x", "y")) -> DataFrame:
    """Separable Gaussian smoothing, one axis after another; beyond an end the end's voxel counts. Every voxel must be there."""
    kernel = gaussian_kernel(sigma, radius)
    for axis in axes:
        w = W.partitionBy(*(a for a in ("z", "x", "y") if a != axis)).orderBy(axis)
        ends = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        first, last = F.first("v").over(ends), F.last("v").over(ends)
        value = F.lit(0.0)
        for k, weight in zip(range(-radius, radius + 1), kernel, strict=True):
            near = F.lag("v", -k).over(w) if k < 0 else F.lead("v", k).over(w)
            value = value + weight * F.coalesce(near, first if k < 0 else last)
        voxels = voxels.withColumn("v", value)
    return voxels


def threshold(voxels: DataFrame, factor: float) -> DataFrame:
    """`active`: v above factor times the square root of the variance of all voxels."""
    s = voxels.agg(F.sqrt(F.var_pop("v")).alias("_s"))
    return voxels.join(F.broadcast(s), how="cross").withColumn("active", F.col("v") > factor * F.col("_s")).drop("_s")


def exclude_border(voxels: DataFrame, border: int) -> DataFrame:
    """Voxels at least `border` away from the ends of x and y."""
    ends = voxels.agg(F.max("x").alias("_x"), F.max("y").alias("_y"))
    inside = F.col("x").between(border, F.col("_x") - border) & F.col("y").between(border, F.col("_y") - border)
    return voxels.join(F.broadcast(ends), how="cross").where(inside).drop("_x", "_y")


def combine_masks(a: DataFrame, b: DataFrame, how: str = "and") -> DataFrame:
    """Sparse masks (z, x, y): intersection or union."""
    return a.intersect(b) if how == "and" else a.union(b).distinct()


# --- component labelling


def _tile_label(pdf: pd.DataFrame) -> pd.DataFrame:
    """The components of one tile's voxels; the label is the smallest voxel code of the tile's component. All voxels at once: roots that
    touch are hooked to the smaller, and paths are halved until they are flat."""
    pdf = pdf.sort_values("code", ignore_index=True)
    xyz = pdf[["z", "x", "y"]].to_numpy(np.int64)
    low = xyz.min(0)
    shape = xyz.max(0) - low + 2
    steps = np.array([shape[1] * shape[2], shape[2], 1])
    place = (xyz - low) @ steps
    grid = np.full(int(shape.prod()), -1)
    grid[place] = np.arange(len(place))
    one, two = [], []
    for step in steps:
        near = grid[place + step]
        one.append(np.flatnonzero(near >= 0))
        two.append(near[near >= 0])
    a, b = np.concatenate(one), np.concatenate(two)
    root = np.arange(len(place))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (root[root] != root).any():
            root = root[root]
    return pd.DataFrame({"z": xyz[:, 0], "x": xyz[:, 1], "y": xyz[:, 2], "label": pdf["code"].to_numpy(np.int64)[root]})


def propagate(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of the components of links (u, v), root the smallest node: large-star and small-star rounds."""
    links = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        links = materialize(large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError("components did not settle")


def label_components(mask: DataFrame, tile: int = 32) -> DataFrame:
    """(z, x, y, label) of a sparse mask (z, x, y) by face connectivity. Tiles are labelled by union-find, each in its own task; labels
    that touch across tiles are then merged by star rounds, whose number depends on tiles and not on a component's length.
    A label is the code ((z * 2^20) + x) * 2^20 + y of the component's first voxel."""
    code = (F.col("z") * (1 << 40) + F.col("x") * (1 << 20) + F.col("y")).cast("long")
    keys = [F.floor(F.col(a) / tile).alias(f"t{a}") for a in ("z", "x", "y")]
    coded = mask.select(*(F.col(a).cast("long").alias(a) for a in ("z", "x", "y"))).distinct().select("z", "x", "y", code.alias("code"), *keys)
    local = materialize(coded.groupBy("tz", "tx", "ty").applyInPandas(_tile_label, "z long, x long, y long, label long"))
    edges = None
    for a in ("z", "x", "y"):
        edge = local.where((F.col(a) % tile == tile - 1) | (F.col(a) % tile == 0))
        one, two = edge.where(F.col(a) % tile == tile - 1).withColumn(a, F.col(a) + 1).withColumnRenamed("label", "u"), edge.where(F.col(a) % tile == 0).withColumnRenamed("label", "v")
        found = one.join(two, ["z", "x", "y"]).select("u", "v").distinct()
        edges = found if edges is None else edges.unionByName(found)
    roots = propagate(edges)
    return local.join(roots, local.label == roots.node, "left").select("z", "x", "y", F.coalesce("root", "label").alias("label"))


def remove_small(mask: DataFrame, least: int) -> DataFrame:
    """The voxels of components with at least `least` voxels."""
    labels = label_components(mask)
    big = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return labels.join(big.select("label"), "label", "left_semi").select("z", "x", "y")


def fill_holes(volume: DataFrame, most: int) -> DataFrame:
    """The mask of a full grid (z, x, y, active), with background components of fewer than `most` voxels filled."""
    labels = label_components(volume.where("not active").select("z", "x", "y"))
    small = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < most)
    holes = labels.join(small.select("label"), "label", "left_semi").select("z", "x", "y")
    return volume.where("active").select(*(F.col(a).cast("long").alias(a) for a in ("z", "x", "y"))).union(holes)


# --- events in a volume


def bounding_boxes(labels: DataFrame) -> DataFrame:
    """Box (half-open), extents, voxel count, diameter and box size of each label of (z, x, y, label)."""
    ends = [e for a in ("z", "x", "y") for e in (F.min(a).alias(f"{a}0"), (F.max(a) + 1).alias(f"{a}1"))]
    out = labels.groupBy("label").agg(*ends, F.count(F.lit(1)).alias("v_area"))
    out = out.withColumns({f"d{a}": F.col(f"{a}1") - F.col(f"{a}0") for a in ("z", "x", "y")})
    return out.withColumn("v_length", F.col("dz")).withColumn("v_diameter", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).withColumn("v_bbox_pix_num", F.col("dz") * F.col("dx") * F.col("dy"))


def event_traces(labels: DataFrame, volume: DataFrame) -> DataFrame:
    """Per label: trace (mean inside the mask, 0 in a frame without), noise_mask_trace (mean of the box outside it), heights, gradient and
    signal-to-noise ratios. Each box is dealt to its own voxels, so no label meets the whole volume."""
    boxes = bounding_boxes(labels)
    cells = boxes.select("label", "z0", "dz", F.explode(F.sequence("z0", F.col("z1") - 1)).alias("z"), "x0", "x1", "y0", "y1").select("label", "z0", "z", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"), "y0", "y1").select("label", "z0", "z", "x", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"))
    mine = labels.select("label", "z", "x", "y", F.lit(True).alias("inside"))
    values = cells.join(volume, ["z", "x", "y"]).join(mine, ["label", "z", "x", "y"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    frames = values.groupBy("label", "z").agg(F.avg(F.when(F.col("inside"), F.col("v"))).alias("m"), F.avg(F.when(~F.col("inside"), F.col("v"))).alias("o"))
    row = frames.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("z", "m", "o"))).alias("f"))
    out = row.select("label", F.transform("f", lambda r: F.coalesce(r["m"], F.lit(0.0))).alias("trace"), F.transform("f", lambda r: F.coalesce(r["o"], F.lit(0.0))).alias("noise_mask_trace"))
    out = out.withColumn("v_max_height", F.array_max("trace") - F.array_min("trace")).withColumn("v_max_gradient", F.array_max(A.diffs("trace")))
    out = out.withColumn("v_noise_mask_mean", A.mean("noise_mask_trace")).withColumn("v_noise_mask_std", A.std_pop("noise_mask_trace"))
    out = out.withColumn("v_signal_to_noise_ratio", F.abs(F.try_divide("v_max_height", "v_noise_mask_mean")))
    return out.withColumn("v_signal_to_noise_ratio_fold", F.abs(F.try_divide("v_signal_to_noise_ratio", "v_noise_mask_std")))


def footprints(labels: DataFrame) -> DataFrame:
    return labels.select("label", "x", "y").distinct()


def footprint_shape(labels: DataFrame) -> DataFrame:
    """Of each footprint: area, centroid, axis lengths, eccentricity, orientation, extent and equivalent diameter, from second moments
    of unit pixels (each adds 1/12 to its own variance)."""
    fp = footprints(labels)
    m = fp.groupBy("label").agg(F.count(F.lit(1)).alias("v_fp_area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy"), ((F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1)).alias("box"))
    a, b, c = F.col("vx") + 1 / 12, F.col("vxy"), F.col("vy") + 1 / 12
    root = F.sqrt((a - c) * (a - c) / 4 + b * b)
    big, small = (a + c) / 2 + root, (a + c) / 2 - root
    return m.select(
        "label", "v_fp_area", F.col("cx").alias("v_fp_cx"), F.col("cy").alias("v_fp_cy"), (4 * F.sqrt(big)).alias("v_fp_axis_major_length"), (4 * F.sqrt(F.greatest(small, F.lit(0.0)))).alias("v_fp_axis_minor_length"),
        F.sqrt(1 - F.greatest(small, F.lit(0.0)) / big).alias("v_fp_eccentricity"), (F.col("v_fp_area") / F.col("box")).alias("v_fp_extent"), F.sqrt(4 * F.col("v_fp_area") / np.pi).alias("v_fp_equivalent_diameter_area"), (0.5 * F.atan2(2 * b, a - c)).alias("v_fp_orientation"),
    )


def hull_points(points: np.ndarray) -> np.ndarray:
    """The convex hull of whole-numbered points, counter-clockwise (monotone chain)."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts)
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    sides = []
    for seq in (pts, pts[::-1]):
        side: list = []
        for p in seq:
            while len(side) > 1 and cross(side[-2], side[-1], p) <= 0:
                side.pop()
            side.append(p)
        sides += side[:-1]
    return np.array(sides)


def _hull(pdf: pd.DataFrame) -> pd.DataFrame:
    xy = pdf[["x", "y"]].to_numpy(np.int64)
    corners = np.concatenate([xy + d for d in ((0, 0), (0, 1), (1, 0), (1, 1))])
    h = hull_points(corners)
    area = 0.5 * abs(float(np.dot(h[:, 0], np.roll(h[:, 1], -1)) - np.dot(h[:, 1], np.roll(h[:, 0], -1))))
    feret = float(np.sqrt(((h[:, None] - h[None]) ** 2).sum(-1)).max())
    have = set(map(tuple, xy.tolist()))
    edge = sum((x + dx, y + dy) not in have for x, y in have for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))
    return pd.DataFrame({"label": pdf["label"].iloc[:1], "v_fp_area_convex": [area], "v_fp_solidity": [len(have) / area], "v_fp_feret_diameter_max": [feret], "v_fp_perimeter": [float(edge)]})


def footprint_hulls(labels: DataFrame) -> DataFrame:
    """Convex area, solidity, largest Feret diameter and perimeter (pixel edges) of each footprint."""
    return footprints(labels).groupBy("label").applyInPandas(_hull, "label long, v_fp_area_convex double, v_fp_solidity double, v_fp_feret_diameter_max double, v_fp_perimeter double")


def contour_pixels(labels: DataFrame) -> DataFrame:
    """The pixels of each label's frames with a 4-neighbour outside it: the outline that iso-contours follow."""
    step = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))))
    near = labels.select("label", "z", F.col("x").alias("px"), F.col("y").alias("py"), step.alias("s")).select("label", "z", "px", "py", (F.col("px") + F.col("s.dx")).alias("x"), (F.col("py") + F.col("s.dy")).alias("y"))
    return near.join(labels, ["label", "z", "x", "y"], "left_anti").select("label", "z", F.col("px").alias("x"), F.col("py").alias("y")).distinct()


def event_map(events: DataFrame) -> DataFrame:
    """(z, x, y, v) from events (id, z0, x0, y0, dx, dy, mask): ids of masks are added where they overlap."""
    cell = events.select("id", "z0", "x0", "y0", "dx", "dy", F.posexplode("mask").alias("p", "on")).where("on")
    plane = F.col("dx") * F.col("dy")
    at = cell.select("id", (F.col("z0") + F.floor(F.col("p") / plane)).alias("z"), (F.col("x0") + F.floor(F.col("p") % plane / F.col("dy"))).alias("x"), (F.col("y0") + F.col("p") % F.col("dy")).alias("y"))
    return at.groupBy("z", "x", "y").agg(F.sum("id").alias("v"))


def extend_events(events: DataFrame, volume: DataFrame, before: int, after: int, frames: int) -> DataFrame:
    """Traces of (event_key, z0, z1, x0, y0, dx, dy, mask, trace) longer by up to `before` and `after` frames (-1: to the end): means over the
    mask of the first and of the last frame. The old bounds stay in z0_orig, z1_orig and dz_orig."""
    low = F.lit(0) if before == -1 else F.greatest(F.col("z0") - before, F.lit(0))
    high = F.lit(frames) if after == -1 else F.least(F.col("z1") + after, F.lit(frames))
    e = events.withColumn("_low", low.cast("long")).withColumn("_high", high.cast("long"))
    plane = F.col("dx") * F.col("dy")
    side = F.when(F.floor(F.col("p") / plane) == 0, F.array(F.lit("b"))).otherwise(F.array().cast("array<string>"))
    both = F.concat(side, F.when(F.floor(F.col("p") / plane) == F.col("z1") - F.col("z0") - 1, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")))
    px = e.select("event_key", "z0", "z1", "x0", "y0", "dx", "dy", "_low", "_high", F.posexplode("mask").alias("p", "on")).where("on")
    px = px.select("event_key", "z0", "z1", "_low", "_high", (F.col("x0") + F.floor(F.col("p") % plane / F.col("dy"))).alias("x"), (F.col("y0") + F.col("p") % F.col("dy")).alias("y"), F.explode(both).alias("side"))
    span = F.when(F.col("side") == "b", F.when(F.col("_low") < F.col("z0"), F.sequence("_low", F.col("z0") - 1))).otherwise(F.when(F.col("z1") < F.col("_high"), F.sequence("z1", F.col("_high") - 1)))
    means = px.select("event_key", "x", "y", "side", F.explode(span).alias("z")).join(volume, ["z", "x", "y"]).groupBy("event_key", "side", "z").agg(F.avg("v").alias("v"))
    parts = means.groupBy("event_key").agg(*(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("z", "v")))).alias(s) for s in "ba"))
    none = F.array().cast("array<double>")
    values = lambda c: F.coalesce(F.transform(c, lambda r: r["v"]), none)
    out = e.join(parts, "event_key", "left").withColumn("trace", F.concat(values("b"), F.col("trace"), values("a")))
    out = out.withColumns({"z0_orig": F.col("z0"), "z1_orig": F.col("z1"), "dz_orig": F.col("z1") - F.col("z0")})
    return out.withColumn("z0", F.col("_low")).withColumn("z1", F.col("_high")).withColumn("dz", F.col("_high") - F.col("_low")).drop("_low", "_high", "a", "b")


# --- patches


def patch_index(frames: int, width: int, height: int, before: int, after: int, size: tuple[int, int], stride: tuple[int, int], spark) -> DataFrame:
    """(item, z, z0, z1, x0, x1, y0, y1): windows of before + 1 + after frames about each frame that has them, on a grid of strides."""
    axis = lambda n, s, d: F.sequence(F.lit(0), F.lit(n - s), F.lit(d))
    z = spark.range(before, frames - after).select(F.col("id").alias("z"))
    out = z.select("z", F.explode(axis(width, size[0], stride[0])).alias("x0")).select("z", "x0", F.explode(axis(height, size[1], stride[1])).alias("y0"))
    item = ((F.col("z") - before) * len(range(0, width - size[0] + 1, stride[0])) + F.floor(F.col("x0") / stride[0])) * len(range(0, height - size[1] + 1, stride[1])) + F.floor(F.col("y0") / stride[1])
    return out.select(item.cast("long").alias("item"), "z", (F.col("z") - before).alias("z0"), (F.col("z") + after + 1).alias("z1"), "x0", (F.col("x0") + size[0]).alias("x1"), "y0", (F.col("y0") + size[1]).alias("y1"))


def stitch(patches: DataFrame, overlap: int, width: int, height: int) -> DataFrame:
    """Voxels of overlapping patches (x0, x1, y0, y1, z, x, y, v), each taken from the inside of one patch: `overlap` pixels go from each side
    that is not the image's; where insides still overlap, the first patch counts."""
    inside = (F.col("x") >= F.when(F.col("x0") > 0, F.col("x0") + overlap).otherwise(0)) & (F.col("x") < F.when(F.col("x1") < width, F.col("x1") - overlap).otherwise(width))
    inside &= (F.col("y") >= F.when(F.col("y0") > 0, F.col("y0") + overlap).otherwise(0)) & (F.col("y") < F.when(F.col("y1") < height, F.col("y1") - overlap).otherwise(height))
    return patches.where(inside).groupBy("z", "x", "y").agg(F.min_by("v", F.struct("x0", "y0")).alias("v"))


def annealed_loss(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    e = F.abs(F.col(predicted) - F.col(actual)) + 1e-8
    return df.agg(F.avg(F.pow(e, F.lit(4))).alias("annealed"), F.avg(F.sqrt(e)).alias("root"))

