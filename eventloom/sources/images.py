"""Images and arrays: arrays in memory, uncompressed TIFF files and sequences, event maps, companions of a recording, run records."""

from __future__ import annotations

import hashlib
import json
import pickle
import struct
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.sources.storage import suffix_number

VOXEL = "z long, x long, y long, v double"
#: Fixed values of the TIFF format: the tags read here, and the numpy kind of each sample format.
_TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "offsets", 277: "samples", 278: "rows", 279: "counts", 339: "format"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}
_KINDS = {1: "u", 2: "i", 3: "f"}


def from_array(spark: SparkSession, array: np.ndarray, z_slice: tuple[int, int] | None = None) -> DataFrame:
    """Voxels (z, x, y, v) of a frames x width x height array that the driver holds."""
    a, b = z_slice or (0, len(array))
    part = np.asarray(array)[a:b]
    z, x, y = (i.ravel() for i in np.indices(part.shape))
    return spark.createDataFrame(pd.DataFrame({"z": z + a, "x": x, "y": y, "v": part.ravel().astype(float)}), VOXEL)


def to_array(voxels: DataFrame, z_slice: tuple[int, int], shape: tuple[int, int], value: str = "v") -> np.ndarray:
    """The frames of a slice as an array, 0 where there is no voxel; the slice must fit the driver."""
    a, b = z_slice
    got = voxels.where(F.col("z").between(a, b - 1)).select("z", "x", "y", value).toPandas()
    out = np.zeros((b - a, *shape))
    out[got["z"] - a, got["x"], got["y"]] = got[value]
    return out


def read_tiff(data: bytes) -> list[np.ndarray]:
    """The pages of an uncompressed grey TIFF file (classic or big), as arrays of rows and columns."""
    end = {b"II": "<", b"MM": ">"}.get(data[:2])
    if end is None:
        raise ValueError("not a TIFF file")
    big = struct.unpack_from(end + "H", data, 2)[0] == 43
    word, count, step = ("Q", "Q", 20) if big else ("I", "H", 12)
    at = struct.unpack_from(end + word, data, 8 if big else 4)[0]
    pages = []
    while at:
        n = struct.unpack_from(end + count, data, at)[0]
        at += struct.calcsize(count)
        tags: dict[str, Sequence[int]] = {}
        for k in range(n):
            tag, kind, many = struct.unpack_from(end + "HH" + word, data, at + k * step)
            if tag in _TAGS and kind in _SIZES:
                where = at + k * step + (12 if big else 8)
                if many * _SIZES[kind] > (8 if big else 4):
                    where = struct.unpack_from(end + word, data, where)[0]
                tags[_TAGS[tag]] = struct.unpack_from(f"{end}{many}{ {1: 'B', 2: 'B', 3: 'H', 4: 'I', 16: 'Q'}.get(kind, 'Q') }", data, where)
        if tags.get("compression", (1,))[0] != 1 or tags.get("samples", (1,))[0] != 1:
            raise ValueError("only uncompressed grey TIFF files can be read here")
        kind = np.dtype(f"{end}{_KINDS[tags.get('format', (1,))[0]]}{tags['bits'][0] // 8}")
        raw = b"".join(data[o : o + c] for o, c in zip(tags["offsets"], tags["counts"], strict=True))
        pages.append(np.frombuffer(raw, kind).reshape(tags["height"][0], tags["width"][0]))
        at = struct.unpack_from(end + word, data, at + n * step)[0]
    return pages


def write_tiff(frames: Sequence[np.ndarray]) -> bytes:
    """An uncompressed TIFF file of 32-bit floats, a page for each frame; files of more than 4 GB are not written."""
    out, before = bytearray(struct.pack("<2sHI", b"II", 42, 0)), 4
    for f in frames:
        raw = np.asarray(f, "<f4").tobytes()
        at = len(out)
        if at + len(raw) > 2**32 - 200:
            raise ValueError("more than 4 GB: write fewer frames to a file")
        out += raw
        struct.pack_into("<I", out, before, len(out))
        tags = ((256, f.shape[1]), (257, f.shape[0]), (258, 32), (259, 1), (262, 1), (273, at), (277, 1), (278, f.shape[0]), (279, len(raw)), (339, 3))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags)
        before = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def load_tiff(spark: SparkSession, path: str) -> DataFrame:
    """Voxels of a TIFF file, or of a folder or pattern of files: in the order of the numbers their names end with, then of the names, each
    file's frames after those of the one before. A file is read by one task, through Spark's own file reader."""
    files = spark.read.format("binaryFile").load(path)

    def sizes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"path": p["path"], "n": [len(read_tiff(c)) for c in p["content"]]})

    counted = files.mapInPandas(sizes, "path string, n long").toPandas()
    names = spark.createDataFrame(counted).withColumn("k", suffix_number(F.substring_index("path", "/", -1))).orderBy(F.asc_nulls_last("k"), "path").toPandas()
    starts = dict(zip(names["path"], (names["n"].cumsum() - names["n"]).tolist(), strict=True))

    def voxels(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, content in zip(p["path"], p["content"], strict=True):
                for z, page in enumerate(read_tiff(content), starts[name]):
                    x, y = (i.ravel() for i in np.indices(page.shape))
                    yield pd.DataFrame({"z": z, "x": x, "y": y, "v": page.ravel().astype(float)})

    return files.select("path", "content").mapInPandas(voxels, VOXEL)


def _put(spark: SparkSession, path: str, data: bytes, overwrite: bool) -> None:
    """Bytes to a path of any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not overwrite and fs.exists(where):
        raise FileExistsError(path)
    out = fs.create(where, overwrite)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def save_tiff(voxels: DataFrame, path: str, shape: tuple[int, int], frames: int, file_frames: int = 256, overwrite: bool = False) -> list[str]:
    """Files path_0.tif, path_1.tif ... of file_frames frames each; one file's frames at a time come to the driver."""
    out = []
    for k, a in enumerate(range(0, frames, file_frames)):
        out.append(f"{path}_{k}.tif")
        _put(voxels.sparkSession, out[-1], write_tiff(list(to_array(voxels, (a, min(frames, a + file_frames)), shape))), overwrite)
    return out


def convert(voxels: DataFrame, kind: str) -> DataFrame:
    """v as another number type; `uint16` scales [0, 1] to whole numbers of 16 bits, as images are, and an error stands for values outside."""
    if kind != "uint16":
        return voxels.withColumn("v", F.col("v").cast(kind))
    inside = F.col("v").between(0, 1)
    return voxels.withColumn("v", F.when(inside | F.col("v").isNull(), F.rint(F.col("v") * 65535).cast("int")).otherwise(F.raise_error(F.lit("values must lie in [0, 1]")).cast("int")))


def resize(voxels: DataFrame, shape: tuple[int, int], to: tuple[float, float] | tuple[int, int]) -> DataFrame:
    """Frames of `shape` at a new size: whole numbers are pixels, fractions shares of the old size. Each new pixel is the mean of the old ones
    under it, weighed by the area that it covers of each."""
    size = tuple(max(1, round(n * t)) if isinstance(t, float) else t for n, t in zip(shape, to, strict=True))

    def cover(axis: str, n: int, m: int) -> Column:
        first, last = F.floor(F.col(axis) * m / n), F.ceil((F.col(axis) + 1) * m / n) - 1
        share = lambda k: F.struct(k.alias("at"), (F.least((F.col(axis) + 1) * m, (k + 1) * n) - F.greatest(F.col(axis) * m, k * n)).alias("w"))
        return F.explode(F.transform(F.sequence(first, last), share))

    dealt = voxels.withColumn("_a", cover("x", shape[0], size[0])).withColumn("_b", cover("y", shape[1], size[1]))
    w = F.col("_a.w") * F.col("_b.w")
    return dealt.groupBy("z", F.col("_a.at").alias("x"), F.col("_b.at").alias("y")).agg((F.sum(F.col("v") * w) / F.sum(w)).alias("v"))


def load_event_map(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """(z, x, y, label) from the first of the paths that is there: Parquet, or TIFF with the labels as values. None, with a warning, if none is."""
    for p in paths:
        if exists(spark, p):
            got = load_tiff(spark, p).withColumnRenamed("v", "label") if p.endswith((".tif", ".tiff")) else spark.read.parquet(p)
            return got.where("label <> 0").select("z", "x", "y", F.col("label").cast("long").alias("label"))
    import warnings

    warnings.warn(f"no event map at {', '.join(paths)}", stacklevel=2)
    return None


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def companion(spark: SparkSession, events: str, suffixes: Sequence[str] = (".parquet", ".h5", ".hdf5", ".tiff", ".tif", ".tdb")) -> str | None:
    """The recording that events were found in: the events' path without its last suffixes, with the first of `suffixes` that is there."""
    stem = events.rstrip("/").rsplit("/", 1)
    name = stem[-1].split(".")[0]
    return next((p for s in suffixes if exists(spark, p := "/".join([*stem[:-1], name + s])) and p != events), None)


def load_or_make(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at a path, made and written there if it is not yet: time maps, results of long steps."""
    if not exists(spark, path):
        make().write.parquet(path)
    return spark.read.parquet(path)


def cached(spark: SparkSession, folder: str, fn: Callable[..., DataFrame], *args: Any, **kwargs: Any) -> DataFrame:
    """fn's result in a folder, under a name that its name and arguments give; arguments are told apart by their values."""
    return load_or_make(spark, f"{folder}/{fn.__name__}-{content_hash([args, sorted(kwargs.items())])}.parquet", lambda: fn(*args, **kwargs))


def content_hash(value: Any) -> str:
    """A hash of a value's content: of a table's rows in any order and its columns, of arrays, lists, mappings and plain values."""
    if isinstance(value, DataFrame):
        row = value.select(F.xxhash64(*value.columns).alias("h")).agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.shiftright("h", 16))).first()
        return hashlib.sha256(repr((value.dtypes, tuple(row))).encode()).hexdigest()[:16]
    if isinstance(value, np.ndarray):
        return hashlib.sha256(repr((value.shape, str(value.dtype))).encode() + value.tobytes()).hexdigest()[:16]
    if isinstance(value, Mapping):
        return content_hash(["mapping", *sorted((str(k), content_hash(v)) for k, v in value.items())])
    if isinstance(value, (list, tuple)):
        return hashlib.sha256(" ".join(content_hash(v) for v in value).encode()).hexdigest()[:16]
    return hashlib.sha256(f"{type(value).__name__}:{value!r}".encode()).hexdigest()[:16]


def save_run(spark: SparkSession, path: str, parameters: Mapping[str, Any], overwrite: bool = False) -> None:
    """The parameters of a run as one JSON file."""
    _put(spark, path, json.dumps(dict(parameters), sort_keys=True, default=str).encode(), overwrite)


def load_run(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def save_model(spark: SparkSession, model: Any, path: str, overwrite: bool = False) -> None:
    """A pyspark.ml model by its own writer; any other object as a pickle."""
    if hasattr(model, "write"):
        (model.write().overwrite() if overwrite else model.write()).save(path)
    else:
        _put(spark, path, pickle.dumps(model), overwrite)


def load_model(spark: SparkSession, path: str, kind: Any = None) -> Any:
    """A model saved by save_model; `kind` is its class for models of pyspark.ml. Only load pickles of your own."""
    return kind.load(path) if kind is not None else pickle.loads(spark.read.format("binaryFile").load(path).first()["content"])


def prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        while n % p == 0:
            out.append(p)
            n //= p
        p += 1
    return out + [n] if n > 1 else out
