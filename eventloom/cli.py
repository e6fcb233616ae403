"""The command line: `python -m eventloom.cli COMMAND ...`; each command reads a recording, runs operators and writes a result."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.api import Video
from eventloom.operators import volume as V
from eventloom.sources import images, storage

REDUCERS = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_pop, "median": F.median}


def _load(spark: SparkSession, path: str, z_slice: Sequence[int] | None = None) -> DataFrame:
    """Voxels of Parquet, NPY, CSV or TIFF."""
    if not path.endswith((".tif", ".tiff")):
        if path.endswith(".npy"):
            storage.register(spark)
        return storage.load(spark, path, None, tuple(z_slice) if z_slice else None)
    out = images.load_tiff(spark, path)
    return out.where((F.col("z") >= z_slice[0]) & (F.col("z") < z_slice[1])) if z_slice else out


def _shape(voxels: DataFrame) -> tuple[int, int, int]:
    row = storage.metadata(voxels).first()
    return row["frames"] or 0, row["width"] or 0, row["height"] or 0


def convert_input(spark: SparkSession, a: argparse.Namespace) -> None:
    """Channels of interleaved frames to one recording each, with frames numbered anew, resized and of another type where asked for."""
    voxels = _load(spark, a.input, a.z_slice)
    for k, name in enumerate(a.channels):
        own = voxels.where(F.col("z") % len(a.channels) == k).withColumn("z", F.floor(F.col("z") / len(a.channels)))
        if a.rescale is not None:
            _, width, height = _shape(own)
            own = images.resize(own, (width, height), (a.rescale, a.rescale))
        own = images.convert(own, a.dtype) if a.dtype else own
        storage.save(own, f"{a.output}/{name}" if len(a.channels) > 1 else a.output, a.overwrite)


def motion_correction(spark: SparkSession, a: argparse.Namespace) -> None:
    Video(_load(spark, a.input)).correct_motion(a.max_shift).save(a.output, a.overwrite)


def subtract_delta(spark: SparkSession, a: argparse.Namespace) -> None:
    Video(_load(spark, a.input)).delta(a.method, scale=a.scale, neighbours=a.neighbours).save(a.output, a.overwrite)


def detect_events(spark: SparkSession, a: argparse.Namespace) -> None:
    """Events as Parquet, with the parameters of the run beside them; a path that is there is an error unless overwritten."""
    found = Video(_load(spark, a.input)).detect(split=a.split, factor=a.factor, spatial={} if a.spatial else None, border=a.border, holes=a.holes, least=a.least)
    found.df.write.mode("overwrite" if a.overwrite else "errorifexists").parquet(a.output)
    options = {k: v for k, v in vars(a).items() if k not in ("run", "overwrite")}
    images.save_run(spark, f"{a.output.rstrip('/')}.json", options, a.overwrite)


def export_projection(spark: SparkSession, a: argparse.Namespace) -> None:
    V.project(_load(spark, a.input, a.z_slice), ("z",), REDUCERS[a.how]).write.mode("overwrite" if a.overwrite else "errorifexists").parquet(a.output)


def export_video(spark: SparkSession, a: argparse.Namespace) -> None:
    """TIFF files of at most --file-frames frames, whose frames alone come to the driver."""
    voxels = _load(spark, a.input, a.z_slice)
    frames, width, height = _shape(voxels)
    start = a.z_slice[0] if a.z_slice else 0
    for path in images.save_tiff(voxels.withColumn("z", F.col("z") - start), a.output, (width, height), frames - start, a.file_frames, a.overwrite):
        print(path)


def visualize(spark: SparkSession, a: argparse.Namespace) -> None:
    """The datasets under a folder, as lines of path, kind and bytes."""
    fs, root = _files(spark, a.path)

    def walk(where, depth: int) -> None:
        for s in sorted(fs.listStatus(where), key=lambda s: s.getPath().getName()):
            name = s.getPath().getName()
            if name.startswith(("_", ".")) or "=" in name or name.startswith("part-"):
                continue
            print("  " * depth + name, "folder" if s.isDirectory() else "file", fs.getContentSummary(s.getPath()).getLength(), sep="\t")
            if s.isDirectory():
                walk(s.getPath(), depth + 1)

    walk(root, 0)


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def move_dataset(spark: SparkSession, a: argparse.Namespace) -> None:
    fs, source = _files(spark, a.path)
    target = _files(spark, a.to)[1]
    if not fs.exists(source):
        raise FileNotFoundError(a.path)
    if fs.exists(target):
        raise FileExistsError(a.to)
    if not fs.rename(source, target):
        raise OSError(f"{a.path} cannot be moved to {a.to}")


def delete_dataset(spark: SparkSession, a: argparse.Namespace) -> None:
    fs, where = _files(spark, a.path)
    if not fs.exists(where):
        raise FileNotFoundError(a.path)
    fs.delete(where, True)


def preview(spark: SparkSession, a: argparse.Namespace) -> None:
    """One line of JSON: range, mean and spread of each frame asked for."""
    frame = _load(spark, a.input, (a.frame, a.frame + 1)).agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    print(json.dumps(frame.first().asDict()))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="eventloom")
    top.add_argument("--config", help="a JSON file: options of commands by name, which the command line overrides")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, output: bool = True, slices: bool = False) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=(run.__doc__ or "").split("\n")[0] or None)
        p.set_defaults(run=run)
        if output:
            p.add_argument("input")
            p.add_argument("output")
            p.add_argument("--overwrite", action="store_true")
        if slices:
            p.add_argument("--z-slice", type=int, nargs=2)
        return p

    p = command("convert-input", convert_input, slices=True)
    p.add_argument("--channels", nargs="+", default=["ch0"])
    p.add_argument("--rescale", type=float)
    p.add_argument("--dtype")
    command("motion-correction", motion_correction).add_argument("--max-shift", type=int)
    p = command("subtract-delta", subtract_delta)
    p.add_argument("--method", choices=["background", "dF", "dFF"], default="dF")
    p.add_argument("--scale", type=float, default=0.25)
    p.add_argument("--neighbours", type=int, default=25)
    p = command("detect-events", detect_events)
    p.add_argument("--factor", type=float)
    p.add_argument("--spatial", action="store_true")
    p.add_argument("--split", action="store_true")
    for name in ("--border", "--holes", "--least"):
        p.add_argument(name, type=int, default=0)
    command("export-projection", export_projection, slices=True).add_argument("--how", choices=sorted(REDUCERS), default="mean")
    command("export-video", export_video, slices=True).add_argument("--file-frames", type=int, default=256)
    command("visualize", visualize, False).add_argument("path")
    p = command("move-dataset", move_dataset, False)
    p.add_argument("path")
    p.add_argument("to")
    command("delete-dataset", delete_dataset, False).add_argument("path")
    p = command("preview", preview, False)
    p.add_argument("input")
    p.add_argument("--frame", type=int, default=0)
    return top


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    top = parser()
    a = top.parse_args(arguments)
    if a.config:
        with open(a.config) as f:
            options = json.load(f).get(a.command, {})
        own = top._subparsers._group_actions[0].choices[a.command]
        unknown = set(options) - {x.dest for x in own._actions}
        if unknown:
            raise ValueError(f"{a.config}: unknown options {sorted(unknown)} of {a.command}")
        own.set_defaults(**options)
        a = top.parse_args(arguments)
    a.run(spark or SparkSession.builder.appName("eventloom").getOrCreate(), a)


if __name__ == "__main__":
    main()
