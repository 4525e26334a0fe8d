"""Cubes, plans, configurations and the registry."""

import numpy as np
import pytest

from prismloom.operators.base import Extractor, Feature, Input
from prismloom.operators.morphology import MPExtractor
from prismloom.operators.reduction import PCAExtractor
from prismloom.operators.spectral import NDVIExtractor
from prismloom.operators.texture import LBPExtractor
from prismloom.plans.config import Config, Runner, from_dict, from_json, load
from prismloom.plans.space import FeatureSpace, Registry, registry
from prismloom.sources.cube import from_arrays, read_cube, write_cube
from prismloom.sources.hdf5 import find_datasets
from prismloom.streaming.rowwise import indices_of


@pytest.fixture
def array():
    return np.random.RandomState(1).rand(5, 6, 8).astype(np.float32)


@pytest.fixture
def cube(spark, array):
    mask = np.ones((5, 6), dtype=bool)
    mask[0, 1] = False
    return from_arrays(spark, {"a": array}, np.linspace(400, 900, 8), masks={"a": mask})


def as_array(cube):
    rows = cube.pixels.collect()
    out = np.full((max(r["row"] for r in rows) + 1, max(r["col"] for r in rows) + 1, len(rows[0]["spectrum"])), np.nan)
    for r in rows:
        out[r["row"], r["col"]] = r["spectrum"]
    return out


def test_cube(cube, array):
    d = cube.describe().first()
    assert (d["height"], d["width"], d["bands"], d["valid_pixels"], d["total_pixels"]) == (5, 6, 8, 29, 30)
    assert np.isnan(as_array(cube.masked())[0, 1]).all() and not np.isnan(as_array(cube.masked())[1, 1]).any()
    np.testing.assert_allclose(cube.pixel(2, 3).first()["spectrum"], array[2, 3])
    np.testing.assert_allclose(as_array(cube.pseudo_rgb()), array[:, :, [3, 2, 1]])
    stretched = as_array(cube.stretched())
    assert stretched.min() >= 0 and stretched.max() <= 1
    for bad in (lambda: cube.band(8), lambda: cube.pixel(9, 0), lambda: cube.pixel(-1, 0)):
        with pytest.raises(IndexError):
            bad()


@pytest.mark.parametrize("rows, cols", [(slice(1, 3), None), (slice(-3, None), slice(0, -2)), (None, slice(None, None, 2)), (slice(None, None, -1), slice(4, 0, -2)), (slice(1, 99), slice(-99, 2))])
def test_crop(cube, array, rows, cols):
    np.testing.assert_allclose(as_array(cube.crop(rows, cols)), array[rows or slice(None), cols or slice(None)])


@pytest.mark.parametrize("size", [2, 3, 4, 5, 9])
def test_crop_center(cube, array, size):
    r, c = (5 - size) // 2, (6 - size) // 2
    want = array if size >= 6 else array[r : r + size, c : c + size]
    np.testing.assert_allclose(as_array(cube.crop_center(size)), want)


def test_bad_cubes(spark):
    for shape, bands, mask in (((2, 2), 2, None), ((2, 2, 3), 2, None), ((2, 2, 2), 2, np.ones((3, 2)))):
        with pytest.raises(ValueError):
            from_arrays(spark, {"a": np.zeros(shape)}, [500.0] * bands, None if mask is None else {"a": mask})


def test_cube_round_trip(spark, cube, array, tmp_path):
    write_cube(cube, str(tmp_path / "c"))
    back = read_cube(spark, str(tmp_path / "c"))
    np.testing.assert_allclose(as_array(back), array)
    assert back.wavelengths == cube.wavelengths


class First(Extractor):
    def _extract(self, cube):
        return Feature(cube.pixels)


class Second(Extractor):
    @classmethod
    def inputs(cls):
        return {"first": Input(First)}

    def _extract(self, cube, first):
        return first


def test_space(cube, tmp_path, spark):
    space = FeatureSpace.from_list([LBPExtractor(radius=1), PCAExtractor(n_components=3), NDVIExtractor(), MPExtractor(radii=(1,), n_components=1)])
    assert space.nodes["lbp"][1] == {"pca": "pca"} and set(space.nodes) == {"lbp", "pca", "ndvi", "m_p"}
    assert space.order().index("pca") < space.order().index("lbp")
    assert space.layers()[1] == ["lbp"] and space.ancestors("lbp") == {"pca"} and space.descendants("pca") == {"lbp"}
    found = FeatureSpace.from_list([LBPExtractor(radius=1), PCAExtractor(n_components=3), NDVIExtractor()]).extract(cube)
    assert len(found) == 3 and found.stacked().count() == 30 and {d["feature_name"] for d in found.describe()} == {"lbp", "pca", "ndvi"}
    found.save(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/features")).count() == 90
    assert spark.read.parquet(str(tmp_path / "out/metadata")).count() == 3
    alone = FeatureSpace.from_list([LBPExtractor(radius=1)]).extract(cube)["lbp"].data
    assert {tuple(r) for r in alone.selectExpr("row", "col", "features[0]").collect()} == {tuple(r) for r in found["lbp"].data.selectExpr("row", "col", "features[0]").collect()}
    assert FeatureSpace.from_list([]).order() == []


def test_bad_spaces():
    with pytest.raises(ValueError):
        FeatureSpace.from_list([NDVIExtractor(), NDVIExtractor()])
    with pytest.raises(ValueError):
        FeatureSpace.from_list([Second()])
    with pytest.raises(ValueError):
        FeatureSpace({"s": (Second(), {"first": "nothing"})})
    with pytest.raises(TypeError):
        FeatureSpace({"s": (Second(), {"first": "n"}), "n": (NDVIExtractor(), {})})
    with pytest.raises(ValueError, match="cycle"):

        class Loop(Extractor):
            @classmethod
            def inputs(cls):
                return {"x": Input(Loop)}

        FeatureSpace({"a": (Loop(), {"x": "b"}), "b": (Loop(), {"x": "a"})})


def test_registry():
    assert len(registry) == 17 and "GLCMExtractor" in registry
    own = Registry()
    own.register(First)
    for bad, error in ((lambda: own.register(First), ValueError), (lambda: own.register(int), TypeError), (lambda: own.get("x"), ValueError)):
        with pytest.raises(error):
            bad()
    own.unregister("First")
    assert list(own) == []


def test_config(tmp_path):
    spec = {"pipeline": {"components": {"extractor": "PCAExtractor", "params": {"n_components": 3}}, "patterns": {"extractor": "LBPExtractor", "params": {"radius": [1, 2]}}}, "runner": {"type": "dask-threads", "params": {"num_threads": 4}}}
    config = from_dict(spec)
    assert config.space.nodes["patterns"][1] == {"pca": "components"} and config.runner.master() == "local[4]"
    for name in ("c.yaml", "c.json"):
        config.save(str(tmp_path / name))
        assert load(str(tmp_path / name)) == config
        config.space.save_config(str(tmp_path / f"space-{name}"))
        assert load(str(tmp_path / f"space-{name}")) == Config(config.space)
    for bad in ({}, {"pipeline": {}}, {"pipeline": {"a": {}}}, {"pipeline": {"a": {"extractor": "No"}}}, {"pipeline": {"a": {"extractor": "NDVIExtractor", "params": {"x": 1}}}}, {"pipeline": {"a": {"extractor": "NDVIExtractor", "params": 3}}}, spec | {"runner": {"type": "no"}}):
        with pytest.raises(ValueError):
            from_dict(bad)
    with pytest.raises(ValueError):
        from_json("{")
    with pytest.raises(FileNotFoundError):
        load(str(tmp_path / "none.yaml"))
    assert Runner().master() == "local[1]" and isinstance(config, Config)


def test_hdf5_names():
    found = {"sensor/radiance_cube": 3, "sensor/Reflectance_cube": 3, "meta/wavelengths": 1, "other": 2}
    assert find_datasets(found) == ("sensor/Reflectance_cube", "meta/wavelengths")
    assert find_datasets(found, "sensor/radiance_cube")[0] == "sensor/radiance_cube"
    for bad in ({"x": 3, "wavelength": 1}, {"reflectance": 3}, {"reflectance": 2, "wavelength": 1}):
        with pytest.raises(ValueError):
            find_datasets(bad)
    with pytest.raises(ValueError):
        find_datasets(found, "other")


def test_stream(spark, cube, tmp_path):
    source = str(tmp_path / "in")
    cube.pixels.write.parquet(source)
    stream = spark.readStream.schema(cube.pixels.schema).parquet(source)
    features = indices_of(stream, cube.wavelengths, [NDVIExtractor()])
    query = features.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30


def test_sql_is_text_and_belongs_to_queries():
    from prismloom.plans import catalogue

    sql = catalogue.oracle_sql()
    assert all(isinstance(x, str) for x in sql.values()) and set(sql) <= set(catalogue.queries())
