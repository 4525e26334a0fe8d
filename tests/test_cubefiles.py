"""Cubes and features in array files: round trips, chosen parts, scale and null value, failures."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismloom.operators.spectral import NDVIExtractor
from prismloom.sources import cubefiles
from prismloom.sources.cube import PIXELS, Cube
from prismloom.sources.cubefiles import CubeReader, read_array_cube, read_array_features, write_cube, write_features

WAVES = (450.0, 550.0, 650.0, 850.0)


def rows_of(df):
    return sorted((r["image_id"], r["row"], r["col"], tuple(r["spectrum"]), r["valid"]) for r in df.collect())


@pytest.fixture(scope="module")
def cube(spark):
    rng = np.random.default_rng(3)
    rows = [(i, r, c, [float(x) for x in rng.random(4).astype(np.float32)], bool(rng.random() < 0.8)) for i in ("a", "b/ü") for r in range(2, 40) for c in range(3, 12) if rng.random() < 0.9]
    return Cube(spark.createDataFrame(rows, PIXELS).repartition(5), WAVES)


def test_round_trip_and_chosen_parts(spark, cube, tmp_path):
    write_cube(cube, f"{tmp_path}/cube", rows=8)
    found = read_array_cube(spark, f"file://{tmp_path}/cube", block=9 * 4 * 4 * 4)
    assert found.wavelengths == WAVES and rows_of(found.pixels) == rows_of(cube.pixels)
    some = read_array_cube(spark, f"{tmp_path}/cube", rows=(10, 13), cols=(5, 7), images=["a"], block=9 * 4 * 4 * 4).pixels
    assert rows_of(some) == rows_of(cube.pixels.where("row >= 10 AND row < 13 AND col IN (5, 6) AND image_id = 'a'")) and some.count() > 1
    assert some.rdd.getNumPartitions() <= 2 < found.pixels.rdd.getNumPartitions() / 4
    for odd in ("row > 100", "row < 5 AND row > 7", "NOT valid AND row <= 20", "row = 4 OR col = 4", "spectrum[1] > 0.5", "image_id IS NULL", "true"):
        assert rows_of(found.pixels.where(odd)) == rows_of(cube.pixels.where(odd)), odd
    for none in ({"rows": (90, 99)}, {"cols": (50, 60)}, {"images": []}, {"images": ["c"]}, {"rows": (9, 9)}, {"cols": (7, 5)}):
        assert read_array_cube(spark, f"{tmp_path}/cube", **none).pixels.count() == 0, none
    picked = read_array_cube(spark, f"{tmp_path}/cube", bands=[3, 0])
    assert picked.wavelengths == (850.0, 450.0) and rows_of(picked.pixels) == rows_of(cube.select_bands([3, 0]).pixels)
    with pytest.raises(ValueError):
        write_cube(cube, f"{tmp_path}/cube")
    with pytest.raises(IndexError):
        read_array_cube(spark, f"{tmp_path}/cube", bands=[4])


def test_features(spark, cube, tmp_path):
    features = NDVIExtractor().extract(cube).data
    write_features(features, f"{tmp_path}/ndvi")
    rows = lambda df: sorted((r["image_id"], r["row"], r["col"], tuple(r["features"])) for r in df.collect())
    back = read_array_features(spark, f"{tmp_path}/ndvi")
    assert rows(back) == rows(features.select("image_id", "row", "col", "features"))
    assert back.schema["features"].dataType == features.schema["features"].dataType
    with pytest.raises(ValueError):
        read_array_cube(spark, f"{tmp_path}/ndvi")


def test_edges(spark, cube, tmp_path):
    write_cube(Cube(cube.pixels.limit(0), WAVES), f"{tmp_path}/none")
    assert read_array_cube(spark, f"{tmp_path}/none").pixels.count() == 0
    write_cube(Cube(cube.pixels.limit(1).withColumn("spectrum", F.lit(None).cast("array<float>")), WAVES), f"{tmp_path}/null")
    (row,) = read_array_cube(spark, f"{tmp_path}/null").pixels.collect()
    assert not row["valid"] and all(np.isnan(row["spectrum"]))
    twice = cube.pixels.where("row = 5 AND col = 5 AND image_id = 'a'")
    twice = twice if twice.count() else cube.pixels.limit(1)
    with pytest.raises(Exception, match="occurs twice"):
        write_cube(Cube(twice.union(twice), WAVES), f"{tmp_path}/twice")
    assert not os.path.exists(f"{tmp_path}/twice/cube.json")


def test_blocks_end_where_they_are_full(spark, cube, tmp_path, monkeypatch):
    monkeypatch.setattr(cubefiles, "BLOCK_BYTES", 100)
    batches = cube.pixels.orderBy("image_id", "row", "col").toArrow().to_batches(max_chunksize=7)
    writer = cubefiles.CubeWriter(f"{tmp_path}/full", list(WAVES), "spectrum", "float")
    done = writer.write(iter(batches))
    writer.commit([done, None])
    assert len(done.blocks) > 60 and all(b["shape"][0] <= 2 for b in done.blocks)
    assert rows_of(read_array_cube(spark, f"{tmp_path}/full").pixels) == rows_of(cube.pixels)
    lost = writer.write(iter(batches))  # an attempt that isn't committed leaves nothing that is read
    assert rows_of(read_array_cube(spark, f"{tmp_path}/full").pixels) == rows_of(cube.pixels)
    writer.abort([lost])
    assert len(os.listdir(f"{tmp_path}/full")) == 2 * len(done.blocks) + 1


def test_scale_and_null_of_arrays(spark, tmp_path):
    raw = np.arange(7 * 5 * 4, dtype=np.int16).reshape(7, 5, 4)
    raw[2, 3, 1] = -9999
    np.save(tmp_path / "scene.npy", raw)
    (tmp_path / "scene.json").write_text(json.dumps({"wavelengths": WAVES, "scale_factor": 10.0, "null_value": -9999}))
    found = read_array_cube(spark, f"{tmp_path}/scene.npy", block=raw[0].nbytes * 2)
    assert found.pixels.rdd.getNumPartitions() == 4 and found.metadata["scale_factor"] == 10.0
    for r in found.pixels.collect():
        assert r["image_id"] == "scene.npy" and r["valid"] == ((r["row"], r["col"]) != (2, 3))
        assert np.array_equal(np.float32(r["spectrum"]), (raw[r["row"], r["col"]] / 10.0).astype(np.float32))
    (tmp_path / "scene.json").write_text(json.dumps({"wavelengths": WAVES[:3]}))
    with pytest.raises(ValueError):
        read_array_cube(spark, f"{tmp_path}/scene.npy")


def test_nothing_planned_outside():
    reader = CubeReader([cubefiles.Image(str(i), "", 10 * i, 0, (10, 8, 3), "<f4") for i in range(50)], None, 3 * 8 * 3 * 4)
    assert len(reader.partitions()) == 200
    reader.within["row"] = (25, 31)
    assert [(p.image.image_id, p.lo, p.hi) for p in reader.partitions()] == [("2", 5, 8), ("2", 8, 10), ("3", 0, 1)]


def test_h5(spark, tmp_path):
    h5py = pytest.importorskip("h5py")
    raw = np.arange(7 * 5 * 4, dtype=np.int16).reshape(7, 5, 4)
    raw[2, 3, 1] = -9999
    with h5py.File(tmp_path / "scene.h5", "w") as file:
        data = file.create_dataset("site/Reflectance", data=raw)
        data.attrs["Scale_Factor"], data.attrs["Data_Ignore_Value"] = [10.0], [-9999]
        file.create_dataset("site/wavelength", data=np.array(WAVES))
    found = read_array_cube(spark, f"{tmp_path}/scene.h5", bands=[1, 2])
    assert found.wavelengths == WAVES[1:3] and found.metadata["reflectance_name"] == "site/Reflectance"
    for r in found.pixels.collect():
        assert r["valid"] == ((r["row"], r["col"]) != (2, 3))
        assert np.array_equal(np.float32(r["spectrum"]), (raw[r["row"], r["col"], 1:3] / 10.0).astype(np.float32))
