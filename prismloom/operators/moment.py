"""Moments of the neighbourhoods of every pixel: sums of a window times fixed weights."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from numpy.polynomial import legendre
from pyspark.sql import functions as F

from prismloom.functions.borders import Tile, tiled, weighted
from prismloom.operators.base import INDEX, NATURAL, WINDOW, Extractor, Feature, Input
from prismloom.operators.reduction import PCAExtractor
from prismloom.operators.texture import component_values, raw_bands
from prismloom.sources.cube import Cube


def orders(most: int) -> list[tuple[int, int]]:
    return [(p, q) for p in range(most + 1) for q in range(most + 1 - p)]


def geometric_kernels(size: int, most: int, normalize: bool) -> np.ndarray:
    """x ** p * y ** q, x over columns and y over rows."""
    at = np.linspace(-1, 1, size) if normalize else np.arange(size, dtype=np.float64)
    return np.stack([at[None, :] ** p * at[:, None] ** q for p, q in orders(most)])


def legendre_kernels(size: int, most: int) -> np.ndarray:
    """Products of Legendre polynomials over -1 to 1, scaled by half the root of (2p + 1)(2q + 1)."""
    at = np.linspace(-1, 1, size)
    value = [legendre.legval(at, np.eye(most + 1)[p]) for p in range(most + 1)]
    return np.stack([math.sqrt((2 * p + 1) * (2 * q + 1)) / 2 * value[p][None, :] * value[q][:, None] for p, q in orders(most)])


def zernike_orders(most: int) -> list[tuple[int, int]]:
    return [(p, q) for p in range(most + 1) for q in range(p + 1) if (p - q) % 2 == 0]


def zernike_kernels(size: int, most: int) -> np.ndarray:
    """Real and imaginary parts, one after the other, of (p + 1) / pi * R_pq(r) * exp(-i q angle) in the unit disk."""
    at = np.linspace(-1, 1, size)
    x, y = at[None, :], at[:, None]
    r, angle = np.hypot(x, y), np.arctan2(y, x)
    out = []
    for p, q in zernike_orders(most):
        radial = sum((-1) ** s * math.factorial(p - s) / (math.factorial(s) * math.factorial((p + q) // 2 - s) * math.factorial((p - q) // 2 - s)) * r ** (p - 2 * s) for s in range((p - q) // 2 + 1))
        whole = np.where(r <= 1, (p + 1) / math.pi * radial, 0) * np.exp(-1j * q * angle)
        out += [whole.real, whole.imag]
    return np.stack(out)


@dataclass(frozen=True)
class _Moments(Extractor):
    """Windows reach beyond the border by reflection. Features: for component, for window, for order."""

    n_components: int = 3
    max_order: int = 6
    window_sizes: tuple[int, ...] = (3, 9, 15)
    #: Bands themselves in place of components.
    bands: tuple[int, ...] | None = None

    limits = {"n_components": NATURAL, "max_order": INDEX, "window_sizes": WINDOW.many()}

    def _kernels(self, size: int) -> np.ndarray:
        raise NotImplementedError

    def _values(self, sums: np.ndarray) -> np.ndarray:
        return sums

    def _channels(self, cube: Cube):
        return raw_bands(cube, self.bands) if self.bands is not None else component_values(cube, self.n_components)

    def _moments(self, cube: Cube, channels) -> Feature:
        kernels = [self._kernels(w) for w in self.window_sizes]
        values = self._values

        def kernel(tile: Tile) -> np.ndarray:
            parts = [values(weighted(tile, k)) for k in kernels]  # row, column, channel, order
            whole = np.concatenate(parts, axis=3)
            return whole.reshape(*whole.shape[:2], -1)

        data = tiled(channels, cube.images(), "reflect", max(self.window_sizes) // 2, kernel)
        k = self.n_components if self.bands is None else len(self.bands)
        each = values(np.zeros((1, 1, 1, len(kernels[0])))).shape[3]
        return Feature(data, {"n_components": k, "window_sizes": list(self.window_sizes), "max_order": self.max_order, "n_moments_per_scale": each, "n_features": k * len(kernels) * each})

    def _extract(self, cube: Cube) -> Feature:
        return self._moments(cube, self._channels(cube))


@dataclass(frozen=True)
class GeometricMomentExtractor(_Moments):
    """m_pq = sum of x ** p * y ** q * value; coordinates within -1 and 1, or pixels from 0."""

    normalize_coords: bool = True

    def _kernels(self, size: int) -> np.ndarray:
        return geometric_kernels(size, self.max_order, self.normalize_coords)


@dataclass(frozen=True)
class LegendreMomentExtractor(_Moments):
    """Legendre moments of principal components, which another extractor of the plan may give."""

    @classmethod
    def inputs(cls) -> dict[str, Input]:
        return {"pca": Input(PCAExtractor, required=False)}

    @classmethod
    def input_default(cls, name: str) -> Extractor | None:
        return PCAExtractor(n_components=3)

    def _kernels(self, size: int) -> np.ndarray:
        return legendre_kernels(size, self.max_order)

    def _extract(self, cube: Cube, pca: Feature | None = None) -> Feature:
        if pca is None or self.bands is not None:
            return self._moments(cube, self._channels(cube))
        return self._moments(cube, pca.data.select("image_id", "row", "col", F.slice("features", 1, self.n_components).alias("values")))


@dataclass(frozen=True)
class ZernikeMomentExtractor(_Moments):
    """Magnitudes of Zernike moments over the unit disk, orders q of 0 or more."""

    def _kernels(self, size: int) -> np.ndarray:
        return zernike_kernels(size, self.max_order)

    def _values(self, sums: np.ndarray) -> np.ndarray:
        return np.hypot(sums[..., 0::2], sums[..., 1::2])
