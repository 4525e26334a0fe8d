"""Wavelet features: of spectra, of band planes, and of the whole cube."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from prismloom.functions.borders import Tile, tiled
from prismloom.functions.filters import filter_bank
from prismloom.functions.wavelets import MODES, along, most_levels, stationary_reach, transform_matrix
from prismloom.operators.base import NATURAL, NOTHING, Extractor, Feature, among
from prismloom.operators.reduction import matrix_of
from prismloom.sources.cube import Cube


@dataclass(frozen=True)
class DWT1DExtractor(Extractor):
    """The multilevel transform of every spectrum, [cA_n, cD_n, ..., cD_1], as one matrix product a batch."""

    name: ClassVar[str] = "dwt1d"
    wavelet: str = "db4"
    mode: str = "symmetric"
    levels: int | None = 3
    limits = {"mode": among(*MODES), "levels": NATURAL | NOTHING}

    def _check(self, cube: Cube) -> None:
        most = most_levels(cube.n_bands, len(filter_bank(self.wavelet)))
        if self.levels and self.levels > most:
            raise ValueError(f"{cube.n_bands} bands allow {most} levels at most")

    def _extract(self, cube: Cube) -> Feature:
        levels = self.levels or most_levels(cube.n_bands, len(filter_bank(self.wavelet)))
        matrix = transform_matrix(cube.n_bands, self.wavelet, self.mode, levels)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = matrix_of(batch.column(3)) @ matrix.T if len(batch) else np.zeros((0, len(matrix)))
                features = pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * len(matrix), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], features], ["image_id", "row", "col", "features"])

        data = cube.pixels.select("image_id", "row", "col", "spectrum").mapInArrow(run, "image_id string, row int, col int, features array<double>")
        return Feature(data, {"wavelet": self.wavelet, "mode": self.mode, "levels": levels, "n_features": len(matrix)})


def _cells(cube: Cube):
    return cube.pixels.select("image_id", "row", "col", F.col("spectrum").cast("array<double>").alias("values"))


@dataclass(frozen=True)
class DWT2DExtractor(Extractor):
    """The undecimated transform of every band plane: for band, for level, [cA, cH, cV, cD].

    Planes are padded below and to the right, by reflection, to a multiple of 2 ** levels, and wrap around.
    """

    name: ClassVar[str] = "dwt2d"
    wavelet: str = "haar"
    levels: int = 1
    limits = {"levels": NATURAL}

    def _check(self, cube: Cube) -> None:
        filter_bank(self.wavelet)

    def _extract(self, cube: Cube) -> Feature:
        wavelet, levels = self.wavelet, self.levels
        halo = stationary_reach(wavelet, levels)

        def kernel(tile: Tile) -> np.ndarray:
            bank = filter_bank(wavelet)
            low, high = bank.low, bank.high
            plane, out = tile.values, []
            for level in range(levels):
                rows = [along(plane, f, 1 << level, 0) for f in (low, high)]
                parts = [along(r, f, 1 << level, 1) for f in (low, high) for r in rows]
                out.append(np.stack([p[tile.rows, tile.cols] for p in parts], axis=-1))
                plane = parts[0]
            whole = np.stack(out, axis=-2)  # row, column, band, level, part
            return whole.reshape(*whole.shape[:2], -1)

        data = tiled(_cells(cube), cube.images(), "wrap", halo, kernel, multiple=1 << levels, gaps=True)
        return Feature(data, {"wavelet": wavelet, "levels": levels, "n_features": 4 * levels * cube.n_bands})


@dataclass(frozen=True)
class DWT3DExtractor(Extractor):
    """The undecimated transform over rows, columns and bands: for level, for aaa, aad, ..., ddd, all bands."""

    name: ClassVar[str] = "dwt3d"
    wavelet: str = "haar"
    levels: int = 1
    limits = {"levels": NATURAL}

    def _check(self, cube: Cube) -> None:
        filter_bank(self.wavelet)

    def _extract(self, cube: Cube) -> Feature:
        wavelet, levels, bands = self.wavelet, self.levels, cube.n_bands
        halo, more = stationary_reach(wavelet, levels), -bands % (1 << levels)

        def kernel(tile: Tile) -> np.ndarray:
            bank = filter_bank(wavelet)
            filters = {"a": bank.low, "d": bank.high}
            values, out = np.pad(tile.values, ((0, 0), (0, 0), (0, more)), mode="reflect" if bands > 1 else "edge"), []
            for level in range(levels):
                by_key = {}
                for key in product("ad", repeat=3):
                    part = values
                    for axis, letter in enumerate(key):
                        part = along(part, filters[letter], 1 << level, axis)
                    by_key[key] = part
                out += [by_key[key][tile.rows, tile.cols, :bands] for key in sorted(by_key)]
                values = by_key["a", "a", "a"]
            return np.concatenate(out, axis=2)

        data = tiled(_cells(cube), cube.images(), "wrap", halo, kernel, multiple=1 << levels, gaps=True)
        return Feature(data, {"wavelet": wavelet, "levels": levels, "n_features": 8 * levels * bands})
