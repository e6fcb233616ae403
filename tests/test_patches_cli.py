"""Patches against numpy; the commands end to end."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom import cli
from eventloom.operators import patches as P
from eventloom.sources import images, storage


def arrays(df, size):
    out = {}
    for r in df.collect():
        out.setdefault(r["item"], np.full(size, np.nan))[r["dz"], r["dx"], r["dy"]] = r["v"]
    return out


@pytest.mark.parametrize("how", ["edge", "symmetric"])
def test_padding_as_numpy(spark, how):
    a = np.arange(4 * 5 * 7, dtype=float).reshape(4, 5, 7)
    index = P.padded_grid(spark, 4, 5, 7, 1, 1, (4, 4), (4, 4))
    got = arrays(P.cells(images.from_array(spark, a), index, a.shape, how), (3, 4, 4))
    wide = np.pad(a, ((1, 1), (0, 3), (0, 1)), mode=how)
    want = [wide[z : z + 3, x : x + 4, y : y + 4] for z in range(4) for x in (0, 4) for y in (0, 4)]
    assert len(got) == len(want)
    for i, w in enumerate(want):
        np.testing.assert_array_equal(got[i], w)


def test_augmentation_as_numpy(spark):
    a = np.random.default_rng(0).normal(size=(8, 4, 4))
    cells = P.cells(images.from_array(spark, a), P.padded_grid(spark, 8, 4, 4, 0, 0, (4, 4), (4, 4)), a.shape)
    for r in range(4):
        for flip in range(3):
            got = arrays(P.augment(cells.withColumns({"rotation": F.lit(r), "flip": F.lit(flip), "drop_frame": F.when(F.col("item") == 3, 0).otherwise(-1)}), 4), (1, 4, 4))
            for i in range(8):
                want = np.rot90(a[i], r)
                want = np.flip(want, flip - 1) if flip else want
                np.testing.assert_array_equal(got[i][0], np.zeros((4, 4)) if i == 3 else want)
    drawn = P.augmentation(spark.range(3000).withColumnRenamed("id", "item"), drop_every=5, frames=7)
    assert drawn.select("rotation", "flip").distinct().count() == 12 and 400 < drawn.where("drop_frame >= 0").count() < 800


def test_normalise_and_back(spark):
    a = np.random.default_rng(1).normal(3, 2, size=(4, 4, 4))
    a[2] = 5
    cells = P.cells(images.from_array(spark, a), P.padded_grid(spark, 4, 4, 4, 0, 0, (4, 4), (4, 4)), a.shape)
    stats = P.local_stats(cells)
    norm = P.normalized(cells, stats)
    got = arrays(norm, (1, 4, 4))
    for i in range(4):
        np.testing.assert_allclose(got[i][0], (a[i] - a[i].mean()) / (a[i].std() or 1), atol=1e-12)
    back = arrays(P.normalized(norm, stats, inverse=True), (1, 4, 4))
    np.testing.assert_allclose(back[1][0], a[1])


def test_commands(spark, tmp_path, capsys):
    a = np.random.default_rng(2).normal(0, 0.1, size=(12, 10, 10))
    a[2:6, 2:5, 2:5] += 5
    source, out = f"{tmp_path}/in.parquet", f"{tmp_path}/out"
    both = np.repeat(a, 2, axis=0)
    storage.save(images.from_array(spark, both), source)
    run = lambda *args: cli.main(args, spark)
    run("convert-input", source, out, "--channels", "one", "two")
    np.testing.assert_allclose(images.to_array(storage.load(spark, f"{out}/two"), (0, 12), (10, 10)), a)
    run("export-projection", f"{out}/one", f"{out}/mean", "--how", "max", "--z-slice", "2", "6")
    assert spark.read.parquet(f"{out}/mean").agg(F.max("v")).first()[0] == a[2:6].max()
    run("export-video", f"{out}/one", f"{out}/film", "--file-frames", "5")
    assert capsys.readouterr().out.split() == [f"{out}/film_{k}.tif" for k in range(3)]
    run("preview", f"{out}/one", "--frame", "3")
    assert json.loads(capsys.readouterr().out)["max"] == pytest.approx(a[3].max())
    config = tmp_path / "options.json"
    config.write_text(json.dumps({"detect-events": {"factor": 2.0, "least": 5}}))
    run("--config", str(config), "detect-events", f"{out}/one", f"{out}/events")
    assert spark.read.parquet(f"{out}/events").count() == 1 and images.load_run(spark, f"{out}/events.json")["factor"] == 2.0
    config.write_text(json.dumps({"detect-events": {"unheard": 1}}))
    with pytest.raises(ValueError):
        run("--config", str(config), "detect-events", f"{out}/one", f"{out}/events")
    run("move-dataset", f"{out}/two", f"{out}/three")
    run("visualize", out)
    assert "three" in capsys.readouterr().out
    run("delete-dataset", f"{out}/three")
    with pytest.raises(FileNotFoundError):
        run("move-dataset", f"{out}/three", f"{out}/four")
