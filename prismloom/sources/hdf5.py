"""HDF5 files of one image each, where h5py is installed; the main format is Parquet (``read_cube``)."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from prismloom.sources.cube import PIXELS, Cube

#: What names of datasets and attributes hold.
REFLECTANCE_NAMES = (("reflectance", "reflectancia"), ("radiance",))
WAVELENGTH_NAME = "wavelength"
SCALE_ATTRIBUTE, NULL_ATTRIBUTE = "Scale_Factor", "Data_Ignore_Value"
#: Image rows that a task reads at a time.
ROWS = 64


def find_datasets(datasets: dict[str, int], reflectance: str | None = None, wavelength: str | None = None) -> tuple[str, str]:
    """Paths of reflectance (three dimensions) and wavelengths (one), given or found by their names."""
    for path, n in ((reflectance, 3), (wavelength, 1)):
        if path is not None and datasets.get(path) != n:
            raise ValueError(f"{path} is not a dataset of {n} dimensions")
    if reflectance is None:
        ranked = [(rank, p) for p, n in datasets.items() if n == 3 for rank, words in enumerate(REFLECTANCE_NAMES) if any(w in p.lower() for w in words)]
        if not ranked:
            raise ValueError("Could not find reflectance dataset")
        reflectance = min(ranked, key=lambda x: x[0])[1]
    if wavelength is None:
        wavelength = next((p for p, n in datasets.items() if n == 1 and WAVELENGTH_NAME in p.lower()), None)
        if wavelength is None:
            raise ValueError("Could not find wavelength dataset")
    return reflectance, wavelength


def load_h5(spark: SparkSession, path: str, reflectance: str | None = None, wavelength: str | None = None) -> Cube:
    """The image of a .h5 file, on a path that all executors see; blocks of its rows are read by tasks.

    Values are divided by the scale factor; a pixel with the null value in any band is not valid.
    """
    if not path.lower().endswith(".h5"):
        raise ValueError("the file must end in .h5")
    import h5py

    with h5py.File(path, "r") as file:
        datasets: dict[str, int] = {}
        file.visititems(lambda name, x: datasets.update({name: x.ndim}) if isinstance(x, h5py.Dataset) else None)
        reflectance, wavelength = find_datasets(datasets, reflectance, wavelength)
        data = file[reflectance]
        first = lambda name: np.ravel(data.attrs[name])[0].item() if name in data.attrs else None
        scale, null, height = first(SCALE_ATTRIBUTE) or 1.0, first(NULL_ATTRIBUTE), data.shape[0]
        wavelengths = tuple(float(w) for w in file[wavelength][:])
    name = os.path.basename(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with h5py.File(path, "r") as file:
            for batch in batches:
                for lo in (ROWS * i for i in batch.column(0).to_pylist()):
                    raw = file[reflectance][lo : lo + ROWS]
                    r, c = np.indices(raw.shape[:2])
                    valid = np.ones(raw.shape[:2], dtype=bool) if null is None else (raw != null).all(axis=2)
                    values = pa.array((raw / scale).astype(np.float32).ravel())
                    spectra = pa.ListArray.from_arrays(np.arange(r.size + 1, dtype=np.int32) * raw.shape[2], values)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * r.size), pa.array((r + lo).ravel().astype(np.int32)), pa.array(c.ravel().astype(np.int32)), spectra, pa.array(valid.ravel())], ["image_id", "row", "col", "spectrum", "valid"])

    pixels = spark.range(-(-height // ROWS)).mapInArrow(read, PIXELS)
    return Cube(pixels, wavelengths, {"file_path": path, "reflectance_name": reflectance, "wavelength_name": wavelength, "scale_factor": scale})
