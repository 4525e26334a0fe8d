"""Spectral indices: arithmetic on two bands of every pixel, in the scan's stage."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from prismloom.operators.base import LENGTH, Extractor, Feature, Limit
from prismloom.sources.cube import Cube

#: Fixed value: what keeps the denominators of NDVI and NDWI from 0.
EPSILON = 1e-6


def _index(cube: Cube, value: Column, bands: dict[str, int], **more) -> Feature:
    data = cube.pixels.select("image_id", "row", "col", F.array(value).alias("features"))
    used = {name.replace("idx", "wavelength"): cube.wavelengths[i] for name, i in bands.items()}
    return Feature(data, {**bands, "wavelength_used": used, **more})


def _ordered(low_name: str, low: float, high: float) -> None:
    if low >= high:
        warnings.warn(f"{low_name}_wavelength is not below nir_wavelength", stacklevel=3)


@dataclass(frozen=True)
class NDVIExtractor(Extractor):
    """(nir - red) / (nir + red + EPSILON)."""

    name: ClassVar[str] = "ndvi"
    red_wavelength: float = 660
    nir_wavelength: float = 850
    limits = {"red_wavelength": LENGTH, "nir_wavelength": LENGTH}

    def _check(self, cube: Cube) -> None:
        _ordered("red", self.red_wavelength, self.nir_wavelength)

    def _extract(self, cube: Cube) -> Feature:
        red, nir = cube.nearest_band(self.red_wavelength), cube.nearest_band(self.nir_wavelength)
        r, n = cube.value(red), cube.value(nir)
        return _index(cube, F.try_divide(n - r, n + r + EPSILON), {"red_idx": red, "nir_idx": nir})


@dataclass(frozen=True)
class NDWIExtractor(Extractor):
    """(green - nir) / (green + nir + EPSILON)."""

    name: ClassVar[str] = "ndwi"
    green_wavelength: float = 560
    nir_wavelength: float = 850
    limits = {"green_wavelength": LENGTH, "nir_wavelength": LENGTH}

    def _check(self, cube: Cube) -> None:
        _ordered("green", self.green_wavelength, self.nir_wavelength)

    def _extract(self, cube: Cube) -> Feature:
        green, nir = cube.nearest_band(self.green_wavelength), cube.nearest_band(self.nir_wavelength)
        g, n = cube.value(green), cube.value(nir)
        return _index(cube, F.try_divide(g - n, g + n + EPSILON), {"green_idx": green, "nir_idx": nir})


@dataclass(frozen=True)
class SAVIExtractor(Extractor):
    """(nir - red) * (1 + L) / (nir + red + L). A denominator of 0, possible with L = 0 only, gives NaN."""

    name: ClassVar[str] = "savi"
    red_wavelength: float = 660
    nir_wavelength: float = 850
    L: float = 0.5
    limits = {"red_wavelength": LENGTH, "nir_wavelength": LENGTH, "L": Limit(lambda v: 0 <= v <= 1, "within 0 and 1")}

    def _check(self, cube: Cube) -> None:
        _ordered("red", self.red_wavelength, self.nir_wavelength)

    def _extract(self, cube: Cube) -> Feature:
        red, nir = cube.nearest_band(self.red_wavelength), cube.nearest_band(self.nir_wavelength)
        r, n = cube.value(red), cube.value(nir)
        value = F.coalesce(F.try_divide((n - r) * (1 + self.L), n + r + self.L), F.lit(float("nan")))
        return _index(cube, value, {"red_idx": red, "nir_idx": nir}, brightness_correction=self.L)
