"""Cubes in array files as a Spark data source: tasks read blocks of image rows, and only the rows, columns and bands asked for.

A path is a .npy file of (rows, columns, bands), with what its numbers mean in a .json file of the same name; a .h5 file, where
h5py is installed; or a folder that ``write_cube`` filled. Paths may be whatever pyarrow opens (file, hdfs, s3, gs), and executors
must reach them. Images, rows, columns and bands are chosen as the path is read: blocks outside are never planned. They are
options rather than conditions pushed from a query, because Spark keeps a Python source with what a query has pushed to it
for the table's next query, which then lacks rows.

    read_array_cube(spark, "hdfs:///scenes/a.npy", bands=[29, 55, 12], rows=(100, 200))
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from prismloom.sources.cube import Cube
from prismloom.sources.hdf5 import NULL_ATTRIBUTE, SCALE_ATTRIBUTE, find_datasets

FORMAT = "prismloom_cube"
#: Bytes of a block of whole image rows that a task reads or writes at a time, about.
BLOCK_BYTES = 32 << 20
#: What a written folder says of a place: no pixel, one that isn't valid, one that is.
ABSENT, INVALID, VALID = 0, 1, 2
_MANIFEST = "cube.json"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _json(path: str) -> dict:
    store, at = _opened(path)
    with store.open_input_stream(at) as f:
        return json.loads(f.read())


@dataclass
class Image:
    """A dense block of an image in one file: where its first pixel stands, its shape, and what its numbers mean."""

    image_id: str
    path: str
    row: int
    col: int
    shape: tuple[int, int, int]
    dtype: str
    scale: float = 1.0
    null: float | None = None
    dataset: str | None = None
    state: str | None = None

    def read(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows from lo up to hi, counted from the first of the file: values, and what is known of each place."""
        store, at = _opened(self.path)
        if self.dataset is not None:
            import h5py

            with store.open_input_file(at) as f, h5py.File(f, "r") as file:
                raw = file[self.dataset][lo:hi]
        else:
            raw = _npy_rows(self.path, lo, hi)
        if self.state is not None:
            return raw, _npy_rows(self.state, lo, hi)
        valid = np.ones(raw.shape[:2], dtype=bool) if self.null is None else (raw != self.null).all(axis=2)
        return raw if self.scale == 1 else raw / self.scale, np.where(valid, VALID, INVALID)


def _npy_header(f) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and where the numbers begin."""
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if fortran:
        raise ValueError("arrays must be in C order")
    return shape, dtype, f.tell()


def _npy_rows(path: str, lo: int, hi: int) -> np.ndarray:
    store, at = _opened(path)
    with store.open_input_file(at) as f:
        shape, dtype, begin = _npy_header(f)
        each = int(np.prod(shape[1:])) * dtype.itemsize
        f.seek(begin + lo * each)
        return np.frombuffer(f.read((hi - lo) * each), dtype).reshape(-1, *shape[1:])


def _h5_images(path: str, reflectance: str | None, wavelength: str | None) -> tuple[list[Image], list[float], dict]:
    import h5py

    store, at = _opened(path)
    with store.open_input_file(at) as f, h5py.File(f, "r") as file:
        datasets: dict[str, int] = {}
        file.visititems(lambda name, x: datasets.update({name: x.ndim}) if isinstance(x, h5py.Dataset) else None)
        reflectance, wavelength = find_datasets(datasets, reflectance, wavelength)
        data = file[reflectance]
        first = lambda name: np.ravel(data.attrs[name])[0].item() if name in data.attrs else None
        scale = first(SCALE_ATTRIBUTE) or 1.0
        image = Image(at.rpartition("/")[2], path, 0, 0, data.shape, "float32", scale, first(NULL_ATTRIBUTE), reflectance)
        return [image], [float(w) for w in file[wavelength][:]], {"file_path": path, "reflectance_name": reflectance, "wavelength_name": wavelength, "scale_factor": scale}


def images_of(path: str, reflectance: str | None = None, wavelength: str | None = None) -> tuple[list[Image], list[float], dict]:
    """What stands in a path: blocks of images, wavelengths and metadata (with the column's name and type). Reads headers only."""
    plain = path.rstrip("/")
    if plain.lower().endswith(".h5"):
        images, waves, more = _h5_images(plain, reflectance, wavelength)
        return images, waves, more | {"column": "spectrum", "type": "float"}
    if plain.lower().endswith(".npy"):
        store, at = _opened(plain)
        with store.open_input_file(at) as f:
            shape, dtype, _ = _npy_header(f)
        if len(shape) != 3:
            raise ValueError("a cube has three dimensions")
        told = _json(f"{plain[:-4]}.json")
        scale, null = told.get("scale_factor") or 1.0, told.get("null_value")
        waves = [float(w) for w in told["wavelengths"]]
        if len(waves) != shape[2]:
            raise ValueError(f"{len(waves)} wavelengths for {shape[2]} bands")
        return [Image(at.rpartition("/")[2], plain, 0, 0, shape, dtype.str, scale, null)], waves, {"file_path": plain, "scale_factor": scale, "column": "spectrum", "type": "float"}
    told = _json(f"{plain}/{_MANIFEST}")
    images = [Image(b["image_id"], f"{plain}/{b['file']}", b["row"], b["col"], tuple(b["shape"]), told["dtype"], state=f"{plain}/{b['state']}") for b in told["blocks"]]
    return images, told["wavelengths"], {"file_path": plain, "column": told["column"], "type": told["type"]}


@dataclass
class Rows(InputPartition):
    image: Image
    lo: int
    hi: int


class CubeReader(DataSourceReader):
    def __init__(self, images: list[Image], bands: list[int] | None, most: int, names: Sequence[str] = ("image_id", "row", "col", "spectrum", "valid"), within: dict[str, Sequence[int]] | None = None, ids: Sequence[str] | None = None):
        self.images, self.bands, self.most, self.names = images, bands, most, list(names)
        self.within = {"row": (0, 1 << 31), "col": (0, 1 << 31)} | (within or {})
        self.ids = None if ids is None else set(ids)

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for image in self.images:
            height, width, bands = image.shape
            lo, hi = max(0, self.within["row"][0] - image.row), min(height, self.within["row"][1] - image.row)
            outside = self.within["col"][0] >= image.col + width or self.within["col"][1] <= image.col
            if outside or self.ids is not None and image.image_id not in self.ids:
                continue
            each = max(1, self.most // max(1, width * bands * np.dtype(image.dtype).itemsize))
            out += [Rows(image, a, min(a + each, hi)) for a in range(lo, hi, each)]
        return out or [Rows(Image("", "", 0, 0, (0, 0, 0), "f4"), 0, 0)]  # Spark asks for one at least

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        image = part.image
        if part.lo >= part.hi:
            return
        first, last = max(0, self.within["col"][0] - image.col), min(image.shape[1], self.within["col"][1] - image.col)
        values, state = image.read(part.lo, part.hi)
        values, state = values[:, first:last], state[:, first:last]
        if self.bands is not None:
            values = values[:, :, self.bands]
        r, c = np.nonzero(state != ABSENT)
        kind = np.float64 if image.dtype == "<f8" and image.state else np.float32
        flat = pa.array(np.ascontiguousarray(values[r, c]).astype(kind).ravel())
        lists = pa.ListArray.from_arrays(np.arange(len(r) + 1, dtype=np.int32) * values.shape[2], flat)
        columns = [pa.array([image.image_id] * len(r), pa.string()), pa.array((r + part.lo + image.row).astype(np.int32)), pa.array((c + first + image.col).astype(np.int32)), lists, pa.array(state[r, c] == VALID)]
        for at in range(0, len(r), 4096):
            yield pa.RecordBatch.from_arrays([x.slice(at, 4096) for x in columns], self.names)


@dataclass
class Committed(WriterCommitMessage):
    blocks: list[dict]


class CubeWriter(DataSourceArrowWriter):
    """Blocks of whole image rows as .npy files. Only what tasks report as done is in the manifest, which is written last."""

    def __init__(self, path: str, wavelengths: list[float], column: str, kind: str):
        self.path, self.wavelengths, self.column, self.kind = path.rstrip("/"), wavelengths, column, kind
        self.dtype = "<f8" if kind == "double" else "<f4"

    def _save(self, name: str, data: np.ndarray) -> str:
        store, at = _opened(f"{self.path}/{name}")
        store.create_dir(at.rpartition("/")[0], recursive=True)
        with store.open_output_stream(at) as f:
            np.lib.format.write_array_header_1_0(f, np.lib.format.header_data_from_array_1_0(data))
            f.write(np.ascontiguousarray(data).tobytes())
        return name

    def _block(self, image: str, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, valid: np.ndarray) -> dict:
        row, col = int(rows.min()), int(cols.min())
        shape = (int(rows.max()) - row + 1, int(cols.max()) - col + 1)
        data = np.zeros((*shape, values.shape[1]), dtype=self.dtype)
        state = np.full(shape, ABSENT, dtype=np.uint8)
        np.add.at(state, (rows - row, cols - col), np.where(valid, VALID, INVALID).astype(np.uint8))
        if np.count_nonzero(state) < len(rows):
            raise ValueError(f"a pixel of {image} occurs twice")
        data[rows - row, cols - col] = values
        name = uuid.uuid4().hex  # an attempt that runs again leaves no file that the manifest names
        return {"image_id": image, "row": row, "col": col, "shape": list(data.shape), "file": self._save(f"{name}.npy", data), "state": self._save(f"{name}.state.npy", state)}

    def write(self, batches: Iterator[pa.RecordBatch]) -> Committed:
        """Rows come sorted by image, row and column; a block ends where the image or the run of rows does, or where it is full."""
        blocks, held, size = [], [], 0

        def flush(part: pa.Table) -> None:
            if part.num_rows:
                lists = part.column("spectrum").combine_chunks()
                flat, n = np.asarray(lists.flatten()), np.asarray(lists.value_lengths())
                if len(set(n.tolist())) != 1:
                    raise ValueError("pixels of an image have as many values each")
                column = lambda name: part.column(name).to_numpy()
                blocks.append(self._block(part.column("image_id")[0].as_py(), column("row"), column("col"), flat.reshape(len(n), -1), column("valid").astype(bool)))

        def cut(table: pa.Table, last: bool) -> pa.Table:
            """Writes what is complete; gives the rest."""
            rows, images = table.column("row").to_numpy(), table.column("image_id").to_numpy()
            ends = np.flatnonzero((images[1:] != images[:-1]) | (rows[1:] > rows[:-1] + 1)) + 1
            turns = np.flatnonzero((images[1:] != images[:-1]) | (rows[1:] != rows[:-1])) + 1
            if last:
                ends = np.append(ends, len(rows))
            elif len(turns):
                ends = np.union1d(ends, turns[-1:])
            at = 0
            for end in ends.tolist():
                flush(table.slice(at, end - at))
                at = end
            return table.slice(at)

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                rest = cut(pa.Table.from_batches(held), False)
                held, size = rest.to_batches(), 0
        if held:
            cut(pa.Table.from_batches(held), True)
        return Committed(blocks)

    def commit(self, messages: list[Committed | None]) -> None:
        blocks = sorted((b for m in messages if m for b in m.blocks), key=lambda b: (b["image_id"], b["row"], b["col"]))
        store, at = _opened(f"{self.path}/{_MANIFEST}")
        store.create_dir(at.rpartition("/")[0], recursive=True)
        with store.open_output_stream(at) as f:
            f.write(json.dumps({"wavelengths": self.wavelengths, "column": self.column, "type": self.kind, "dtype": self.dtype, "blocks": blocks}).encode())

    def abort(self, messages: list[Committed | None]) -> None:
        for b in (b for m in messages if m for b in m.blocks):
            for name in (b["file"], b["state"]):
                store, at = _opened(f"{self.path}/{name}")
                store.delete_file(at)


class CubeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _found(self):
        return images_of(self.options["path"], self.options.get("reflectance"), self.options.get("wavelength"))

    def schema(self) -> str:
        told = self._found()[2]
        return f"image_id string, row int, col int, {told['column']} array<{told['type']}>, valid boolean"

    def reader(self, schema: StructType) -> CubeReader:
        told = json.loads(self.options.get("chosen", "{}"))
        return CubeReader(self._found()[0], told.get("bands"), int(self.options.get("block", BLOCK_BYTES)), schema.names, told.get("within"), told.get("ids"))

    def writer(self, schema: StructType, overwrite: bool) -> CubeWriter:
        return CubeWriter(self.options["path"], json.loads(self.options.get("wavelengths", "[]")), self.options.get("column", "spectrum"), schema["spectrum"].dataType.elementType.simpleString())


def _loaded(spark: SparkSession, path: str, **options: str | None) -> DataFrame:
    spark.dataSource.register(CubeSource)
    reader = spark.read.format(FORMAT)
    for k, v in options.items():
        reader = reader if v is None else reader.option(k, v)
    return reader.load(path)


def _chosen(bands: Sequence[int] | None, rows: tuple[int, int] | None, cols: tuple[int, int] | None, images: Sequence[str] | None) -> str:
    within = {name: list(ends) for name, ends in (("row", rows), ("col", cols)) if ends is not None}
    return json.dumps({"bands": None if bands is None else list(bands), "within": within, "ids": None if images is None else list(images)})


def read_array_cube(
    spark: SparkSession, path: str, *, bands: Sequence[int] | None = None, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None,
    images: Sequence[str] | None = None, reflectance: str | None = None, wavelength: str | None = None, block: int = BLOCK_BYTES,
) -> Cube:
    """The cube of a path: of the images named, rows and columns from the first number up to the second, bands in the order given.

    Pixels keep their row and column. Values are divided by the scale factor; a pixel with the null value, compared before
    scaling, in any band is not valid. ``block``: bytes that a task reads, about.
    """
    _, waves, told = images_of(path, reflectance, wavelength)
    if told["column"] != "spectrum":
        raise ValueError("the path holds features; read_array_features reads them")
    for b in bands if bands is not None else ():
        if not 0 <= b < len(waves):
            raise IndexError(f"band {b} is not within 0 to {len(waves) - 1}")
    found = _loaded(spark, path, chosen=_chosen(bands, rows, cols, images), reflectance=reflectance, wavelength=wavelength, block=str(block))
    return Cube(found, tuple(waves if bands is None else (waves[b] for b in bands)), {k: v for k, v in told.items() if k not in ("column", "type")})


def read_array_features(spark: SparkSession, path: str, *, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, images: Sequence[str] | None = None) -> DataFrame:
    """(image_id, row, col, features) of a folder of ``write_features``."""
    return _loaded(spark, path, chosen=_chosen(None, rows, cols, images)).drop("valid")


def _write(pixels: DataFrame, path: str, wavelengths: Sequence[float], column: str, rows: int) -> None:
    if rows < 1:
        raise ValueError("blocks have a row at least")
    pixels.sparkSession.dataSource.register(CubeSource)
    store, at = _opened(f"{path.rstrip('/')}/{_MANIFEST}")
    if store.get_file_info(at).type != fs.FileType.NotFound:
        raise ValueError(f"there is a cube in {path} already")
    # Blocks of rows go to tasks whole, so that files are dense; no task gets a whole image.
    dealt = pixels.select("image_id", "row", "col", "spectrum", "valid").repartition("image_id", F.floor(F.col("row") / rows)).sortWithinPartitions("image_id", "row", "col")
    dealt.write.format(FORMAT).mode("append").option("wavelengths", json.dumps(list(wavelengths))).option("column", column).save(path)


def write_cube(cube: Cube, path: str, rows: int = 64) -> None:
    """A cube as a folder of blocks of ``rows`` image rows.

    Absent pixels stay absent; those without a spectrum get NaN in all bands and aren't valid; one that occurs twice raises
    an error, and so does a folder that holds a cube. An empty table gives a cube without pixels.
    """
    none = F.array_repeat(F.lit(float("nan")).cast("float"), cube.n_bands)
    pixels = cube.pixels.withColumns({"valid": F.col("valid") & F.col("spectrum").isNotNull(), "spectrum": F.coalesce("spectrum", none)})
    _write(pixels, path, cube.wavelengths, "spectrum", rows)


def write_features(features: DataFrame, path: str, rows: int = 64) -> None:
    """(image_id, row, col, features), as extractors give them, as a folder of dense blocks."""
    _write(features.select("image_id", "row", "col", F.col("features").alias("spectrum"), F.lit(True).alias("valid")), path, [], "features", rows)
