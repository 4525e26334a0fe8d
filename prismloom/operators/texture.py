"""Texture: co-occurrence statistics, local binary patterns and Gabor filters, on tiles with a halo."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismloom.functions.borders import Tile, tiled, tiled_with_offsets, weighted
from prismloom.operators.base import ANY, INDEX, NATURAL, NOTHING, WINDOW, Extractor, Feature, Input, Limit, among
from prismloom.operators.reduction import PCAExtractor, pca
from prismloom.sources.cube import Cube
from prismloom.sources.storage import beside, written

#: Statistics of co-occurrence, in the order of the features.
HARALICK = ("asm", "contrast", "correlation", "variance", "idm", "sum_avg", "sum_var", "sum_entropy", "entropy", "diff_var", "diff_entropy", "imc1", "imc2")
EPS = 1e-12
#: Bins of the histogram that equalisation uses.
BINS = 256
#: Values of windows that are sorted at a time.
WINDOW_VALUES = 500_000
#: Beyond all codes of grey levels, for places of a window that hold none.
NO_CODE = 1 << 16


def raw_bands(cube: Cube, bands: Sequence[int] | None = None) -> DataFrame:
    """(image_id, row, col, values) of the bands themselves."""
    picked = F.col("spectrum") if bands is None else F.array(*(F.col("spectrum")[b] for b in bands))
    return cube.pixels.select("image_id", "row", "col", picked.cast("array<double>").alias("values"))


def component_values(cube: Cube, k: int) -> DataFrame:
    """(image_id, row, col, values) of the first principal components."""
    if k > cube.n_bands:
        raise ValueError(f"images of {cube.n_bands} bands don't have {k} components")
    return pca(cube, k).data.withColumnRenamed("features", "values")


def with_extremes(cells: DataFrame) -> DataFrame:
    """Adds lo and hi, arrays of each image's least and greatest value of each channel."""
    flat = cells.select("image_id", F.posexplode("values").alias("k", "v")).groupBy("image_id", "k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    ends = flat.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("k", "lo", "hi"))).alias("ends"))
    return beside(cells, written(ends, "extremes"), 1 << 14)


def quantised(cells: DataFrame, levels: int, equalize: bool) -> DataFrame:
    """Values as grey levels 0 to levels - 1: by the range of each image and channel, or by equalising its histogram."""
    ranged = with_extremes(cells)
    if not equalize:
        level = lambda v, e: F.floor(F.when(e["hi"] > e["lo"], (v - e["lo"]) / (e["hi"] - e["lo"])).otherwise(v) * (levels - 1))
        return ranged.select("image_id", "row", "col", F.zip_with("values", "ends", level).cast("array<double>").alias("values"))
    # The cumulated histogram at bin centres, joined to where a value lies between two of them.
    width = lambda e: F.when(e["hi"] > e["lo"], (e["hi"] - e["lo"]) / BINS).otherwise(F.lit(1.0))
    bin_of = lambda v, e: F.least(F.floor((v - e["lo"]) / width(e)), F.lit(BINS - 1)).cast("int")
    counts = ranged.select("image_id", F.posexplode(F.zip_with("values", "ends", bin_of)).alias("k", "bin")).groupBy("image_id", "k", "bin").count()
    per_channel = counts.groupBy("image_id", "k").agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("m"), F.sum("count").alias("n"))
    filled_in = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0)))
    running = F.aggregate(filled_in, F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<double>").alias("a")), lambda acc, c: F.struct((acc["s"] + c).alias("s"), F.concat(acc["a"], F.array((acc["s"] + c) / F.col("n"))).alias("a")), lambda acc: acc["a"])
    curves = per_channel.select("image_id", "k", running.alias("cdf")).groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "cdf"))), lambda s: s["cdf"]).alias("cdf"))

    def equal(v, e, cdf):
        at = (v - e["lo"]) / width(e) - 0.5
        low = F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(BINS - 1)).cast("int")
        high = F.least(low + 1, F.lit(BINS - 1))
        share = F.least(F.greatest(at - low, F.lit(0.0)), F.lit(1.0))
        return F.floor((cdf[low] + share * (cdf[high] - cdf[low])) * (levels - 1))

    zipped = F.transform(F.arrays_zip("values", "ends", "cdf"), lambda z: equal(z["values"], z["ends"], z["cdf"]))
    return beside(ranged, written(curves, "curves"), 1 << 18).select("image_id", "row", "col", zipped.cast("array<double>").alias("values"))


class Runs:
    """What occurs in each of many windows of equally many values, sorted, and how often: runs, not a cell for all that might occur."""

    def __init__(self, values: np.ndarray, there: np.ndarray | None = None):
        self.n, self.each = values.shape
        ordered = np.sort(values.astype(np.uint16) if there is None else np.where(there, values, NO_CODE), axis=1)
        new = np.ones(ordered.shape, dtype=bool)
        new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
        starts = np.flatnonzero(new)
        self.value = ordered.ravel()[starts].astype(np.int64)
        self.first = np.searchsorted(starts, np.arange(self.n) * self.each)
        self.window = np.repeat(np.arange(self.n), np.diff(np.append(self.first, len(starts))))
        count = np.diff(np.append(starts, ordered.size))
        self.share = count / self.each / (1 + EPS)
        if there is not None:  # what isn't there has no share
            gone = self.value == NO_CODE
            self.value[gone], self.share[gone] = 0, 0.0

    def sum(self, terms: np.ndarray) -> np.ndarray:
        """Per window, over what occurs in it."""
        return np.add.reduceat(terms, self.first)

    def mean(self, terms: np.ndarray) -> np.ndarray:
        return self.sum(terms * self.share)

    def entropy(self) -> np.ndarray:
        return -self.mean(np.log(self.share + EPS))


def haralick(i: np.ndarray, j: np.ndarray, levels: int, names: Sequence[str]) -> np.ndarray:
    """(window, statistic) of the co-occurrence of grey levels i and j, both (window, place).

    Work and memory follow the places of a window, whatever the number of levels. A level below 0 stands for none, and pairs with
    one don't count, though the window's size stays; of a window without pairs all is NaN.
    """
    there = (i >= 0) & (j >= 0)
    some = there.any(axis=1)
    there = None if there.all() else there
    pair, x, y, total, apart = (Runs(v, there) for v in (i * levels + j, i, j, i + j, np.abs(i - j)))
    a, b = pair.value // levels, pair.value % levels
    ux, uy = x.mean(x.value), y.mean(y.value)
    variance = x.mean((x.value - ux[x.window]) ** 2)
    sx, sy = np.sqrt(variance) + EPS, np.sqrt(y.mean((y.value - uy[y.window]) ** 2)) + EPS
    hx, hy, hxy, sum_entropy = x.entropy(), y.entropy(), pair.entropy(), total.entropy()
    found = {
        "asm": lambda: pair.mean(pair.share),
        "contrast": lambda: pair.mean((a - b) ** 2),
        "correlation": lambda: (pair.mean(a * b) - ux * uy) / (sx * sy + EPS),
        "variance": lambda: variance,
        "idm": lambda: pair.mean(1 / (1 + (a - b) ** 2)),
        "sum_avg": lambda: total.mean(total.value),
        "sum_var": lambda: total.mean((total.value - sum_entropy[total.window]) ** 2),
        "sum_entropy": lambda: sum_entropy,
        "entropy": lambda: hxy,
        "diff_var": lambda: apart.mean(apart.share) / levels - (apart.sum(apart.share) / levels) ** 2,
        "diff_entropy": lambda: apart.entropy(),
        "imc1": lambda: (hxy - (hx + hy)) / (np.maximum(hx, hy) + EPS),
        "imc2": lambda: np.sqrt(np.maximum(0, 1 - np.exp(-2 * (hx + hy - hxy)))),
    }
    out = np.stack([found[name]() for name in names], axis=1)
    out[~some] = np.nan
    return out


def pooled(every: np.ndarray, spread: bool) -> list[np.ndarray]:
    """The mean over the first axis, and the range on request, of what isn't NaN; NaN where all is."""
    gone = np.isnan(every)
    if not gone.any():
        return [every.mean(axis=0)] + ([every.max(axis=0) - every.min(axis=0)] if spread else [])
    n = (~gone).sum(axis=0)
    out = [np.where(n > 0, np.where(gone, 0.0, every).sum(axis=0) / np.maximum(n, 1), np.nan)]
    if spread:
        out.append(np.where(n > 0, np.where(gone, -np.inf, every).max(axis=0) - np.where(gone, np.inf, every).min(axis=0), np.nan))
    return out


def windowed_haralick(i: np.ndarray, j: np.ndarray, size: int, levels: int, names: Sequence[str]) -> np.ndarray:
    """(row, column, statistic) of windows about every pixel that has one; some rows of windows at a time."""
    view = lambda v: np.lib.stride_tricks.sliding_window_view(v, (size, size))
    left, right = view(i), view(j)
    h, w = left.shape[:2]
    step = max(1, WINDOW_VALUES // (w * size * size))
    flat = lambda v, lo: v[lo : lo + step].reshape(-1, size * size)
    return np.concatenate([haralick(flat(left, lo), flat(right, lo), levels, names) for lo in range(0, h, step)]).reshape(h, w, -1)


@dataclass(frozen=True)
class GLCMExtractor(Extractor):
    """Statistics of grey-level co-occurrence in a window about every pixel.

    Channels are principal components, or the bands themselves (``spectral_reduction=None``). Neighbours at
    an offset wrap around the image; windows repeat the edge. ``angle_pooling`` takes the mean over all
    offsets, sets them side by side ("concat"), or gives mean and range. Features: for window, for channel.
    Pairs with a place that has no pixel don't count, nor do offsets at which a window has no pair; without any it has NaN.
    """

    name: ClassVar[str] = "glcm"
    distances: tuple[int, ...] = (1,)
    angles: tuple[float, ...] = (0, math.pi / 4, math.pi / 2, 3 * math.pi / 4)
    levels: int = 16
    window_sizes: tuple[int, ...] = (7,)
    features: tuple[str, ...] = HARALICK
    equalize: bool = True
    spectral_reduction: str | None = "pca"
    n_components: int = 1
    angle_pooling: str = "mean"
    limits = {
        "distances": NATURAL.many(), "angles": ANY.many(), "levels": Limit(lambda v: v in range(2, 257), "an integer within 2 and 256"), "window_sizes": WINDOW.many(),
        "features": among(*HARALICK).many(), "spectral_reduction": among("pca", None), "n_components": NATURAL, "angle_pooling": among("mean", "concat", "mean+range"),
    }

    def _extract(self, cube: Cube) -> Feature:
        channels = component_values(cube, self.n_components) if self.spectral_reduction else raw_bands(cube)
        offsets = [(round(math.sin(a) * d), round(math.cos(a) * d)) for d in self.distances for a in self.angles]
        images = cube.images()
        levels, names, pooling, sizes = self.levels, tuple(self.features), self.angle_pooling, tuple(self.window_sizes)
        most = max(sizes) // 2

        def kernel(seen: list[np.ndarray]) -> np.ndarray:
            codes = [np.where(np.isnan(v), -1, np.clip(v, 0, levels - 1)).astype(np.int32) for v in seen]  # (row, column, channel), itself and at each offset
            out = []
            for size in sizes:
                cut = slice(most - size // 2, size // 2 - most or None)
                for c in range(codes[0].shape[2]):
                    own = codes[0][cut, cut, c]
                    by_offset = [windowed_haralick(own, other[cut, cut, c], size, levels, names) for other in codes[1:]]
                    if pooling == "concat":
                        out += by_offset
                    else:
                        out += pooled(np.stack(by_offset), pooling == "mean+range")
            return np.concatenate(out, axis=2)

        data = tiled_with_offsets(quantised(channels, levels, self.equalize), images, "repeat", most, offsets, kernel)
        each = len(sizes) * len(names) * {"mean": 1, "concat": len(offsets), "mean+range": 2}[pooling]
        k = self.n_components if self.spectral_reduction else cube.n_bands
        return Feature(data, {"n_components": k, "window_sizes": self.window_sizes, "distances": self.distances, "levels": levels, "angle_pooling": pooling, "n_features": each * k})


def binary_patterns(values: np.ndarray, center: np.ndarray, method: str) -> np.ndarray:
    """Codes from the values at the points (row, column, point) about centres."""
    n = values.shape[2]
    if method == "var":
        return values.var(axis=2)
    bits = (values >= center[:, :, None]).astype(np.int64)
    weights = 1 << np.arange(n, dtype=np.int64)
    if method == "default":
        return bits @ weights
    if method == "ror":
        return np.min([np.roll(bits, -s, axis=2) @ weights for s in range(n)], axis=0)
    ones, turns = bits.sum(axis=2), (bits[:, :, 1:] != bits[:, :, :-1]).sum(axis=2)
    if method == "uniform":
        turns = turns + (bits[:, :, 0] != bits[:, :, -1])
        return np.where(turns <= 2, ones, n + 1)
    first_one, first_zero = bits.argmax(axis=2), (1 - bits).argmax(axis=2)
    turned = np.where(first_one == 0, ones - first_zero, n - first_one)
    code = 1 + (ones - 1) * n + turned
    code = np.where(ones == 0, 0, np.where(ones == n, n * (n - 1) + 1, code))
    return np.where(turns <= 2, code, n * (n - 1) + 2)


@dataclass(frozen=True)
class LBPExtractor(Extractor):
    """Local binary patterns of principal components or bands, scaled to 0 to 255, at one or several radii.

    Points on the circle are interpolated between four pixels; beyond the image there is 0.
    """

    name: ClassVar[str] = "lbp"
    radius: int | tuple[int, ...] = 3
    n_points: int | tuple[int, ...] | None = None
    method: str = "ror"
    n_components: int = 3
    spectral_mode: str = "pca"
    band_indices: tuple[int, ...] | None = None
    limits = {
        "radius": NATURAL | NATURAL.many(), "n_points": NATURAL | NATURAL.many() | NOTHING, "method": among("default", "ror", "uniform", "nri_uniform", "var"),
        "spectral_mode": among("pca", "bands"), "n_components": NATURAL, "band_indices": INDEX.many() | NOTHING,
    }

    @classmethod
    def inputs(cls) -> dict[str, Input]:
        return {"pca": Input(PCAExtractor, required=False)}

    @classmethod
    def input_default(cls, name: str) -> Extractor | None:
        return PCAExtractor(n_components=3)

    def _scales(self) -> list[tuple[int, int]]:
        radii = [self.radius] if isinstance(self.radius, int) else list(self.radius)
        points = [8 * r for r in radii] if self.n_points is None else [self.n_points] if isinstance(self.n_points, int) else list(self.n_points)
        if len(points) != len(radii):
            raise ValueError("radius and n_points must be equally many")
        return list(zip(radii, points, strict=True))

    def _check(self, cube: Cube) -> None:
        self._scales()
        if self.spectral_mode == "bands" and not (self.band_indices and max(self.band_indices) < cube.n_bands):
            raise ValueError(f"band_indices must name some of the bands 0 to {cube.n_bands - 1}")
        if self.spectral_mode == "pca" and self.n_components > cube.n_bands:
            raise ValueError(f"images of {cube.n_bands} bands don't have {self.n_components} components")

    def _extract(self, cube: Cube, pca: Feature | None = None) -> Feature:
        if self.spectral_mode == "bands":
            channels, k = raw_bands(cube, self.band_indices), len(self.band_indices)
        elif pca is not None:
            channels, k = pca.data.select("image_id", "row", "col", F.slice("features", 1, self.n_components).alias("values")), self.n_components
        else:
            channels, k = component_values(cube, self.n_components), self.n_components
        scaled = F.zip_with("values", "ends", lambda v, e: F.floor(255 * (v - e["lo"]) / (e["hi"] - e["lo"] + 1e-8)).cast("double"))
        cells = with_extremes(channels).select("image_id", "row", "col", scaled.alias("values"))
        scales, method = self._scales(), self.method

        def kernel(tile: Tile) -> np.ndarray:
            h, w, n = tile.inner.shape
            out = []
            for c in range(n):
                plane = tile.values[:, :, c]
                for radius, points in scales:
                    samples = []
                    for p in range(points):
                        r = round(-radius * math.sin(2 * math.pi * p / points), 5)
                        q = round(radius * math.cos(2 * math.pi * p / points), 5)
                        r0, q0 = math.floor(r), math.floor(q)
                        at = lambda a, b, plane=plane: plane[tile.rows.start + a : tile.rows.stop + a, tile.cols.start + b : tile.cols.stop + b]
                        top = (1 - q + q0) * at(r0, q0) + (q - q0) * at(r0, q0 + 1)
                        low = (1 - q + q0) * at(r0 + 1, q0) + (q - q0) * at(r0 + 1, q0 + 1)
                        samples.append((1 - r + r0) * top + (r - r0) * low)
                    out.append(binary_patterns(np.stack(samples, axis=2), tile.inner[:, :, c], method))
            return np.stack(out, axis=2).astype(np.float64)

        data = tiled(cells, cube.images(), "none", max(r for r, _ in scales) + 1, kernel)
        return Feature(data, {"method": method, "radius": [r for r, _ in scales], "n_points": [p for _, p in scales], "spectral_mode": self.spectral_mode, "n_channels": k, "n_scales": len(scales), "n_features": k * len(scales)})


@dataclass(frozen=True)
class GaborExtractor(Extractor):
    """Gabor responses of every band, and on request differences of bands' responses (opponent features).

    Orientation 0 oscillates along rows. Beyond the border the edge repeats.
    """

    name: ClassVar[str] = "gabor"
    n_scales: int = 2
    n_orientations: int = 4
    use_opponent: bool = False
    sigmas_sq: tuple[float, ...] | None = None
    frequencies: tuple[float, ...] | None = None
    limits = {"n_scales": NATURAL, "n_orientations": NATURAL}

    #: Variances of the first two scales.
    FIRST_SIGMAS: ClassVar[tuple[float, ...]] = (1.97, 7.89)

    def filters(self) -> list[tuple[float, float, float]]:
        """(variance, frequency, angle), scale by scale."""
        sigmas = self.sigmas_sq or tuple(self.FIRST_SIGMAS[m] if m < 2 else 4.0**m for m in range(self.n_scales))
        frequencies = self.frequencies or tuple(0.5 / 2**m for m in range(self.n_scales))
        return [(s, f, math.pi * o / self.n_orientations) for s, f in zip(sigmas, frequencies, strict=True) for o in range(self.n_orientations)]

    @staticmethod
    def kernel(sigma_sq: float, frequency: float, theta: float) -> np.ndarray:
        half = math.ceil(4 * math.sqrt(sigma_sq))
        along = np.arange(-half, half + 1)
        x, y = along[:, None], along[None, :]
        turned = x * math.cos(theta) + y * math.sin(theta)
        return np.exp(-(x * x + y * y) / (2 * sigma_sq)) / (2 * math.pi * sigma_sq) * np.cos(2 * math.pi * frequency * turned)

    def _check(self, cube: Cube) -> None:
        for name in ("sigmas_sq", "frequencies"):
            value = getattr(self, name)
            if value is not None and (len(value) != self.n_scales or min(value) <= 0):
                raise ValueError(f"{name} must hold a positive number for each scale")
        if self.use_opponent and not 2 <= cube.n_bands <= 10:
            raise ValueError("opponent features are for 2 to 10 bands")

    def _extract(self, cube: Cube) -> Feature:
        kernels = [self.kernel(*f) for f in self.filters()]
        opponent, bands = self.use_opponent, cube.n_bands

        def kernel(tile: Tile) -> np.ndarray:
            out = np.empty((*tile.inner.shape, len(kernels)))
            for size in sorted({len(k) for k in kernels}):
                at = [i for i, k in enumerate(kernels) if len(k) == size]
                out[..., at] = weighted(tile, np.stack([kernels[i] for i in at]))
            parts = [out.reshape(*out.shape[:2], -1)]
            if opponent:
                parts += [out[:, :, i] - out[:, :, j] for i in range(bands) for j in range(i + 1, bands)]
            return np.concatenate(parts, axis=2)

        data = tiled(raw_bands(cube), cube.images(), "repeat", max(len(k) // 2 for k in kernels), kernel)
        single, pairs = bands * len(kernels), bands * (bands - 1) // 2 * len(kernels) * opponent
        return Feature(data, {"n_unichrome": single, "n_opponent": pairs, "n_features": single + pairs, "scales": self.n_scales, "orientations": self.n_orientations})
