"""Morphological profiles of principal components or bands."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from prismloom.functions.borders import Tile, tiled
from prismloom.operators.base import FLAG, NATURAL, Extractor, Feature, among
from prismloom.operators.reconstruction import geodesic
from prismloom.operators.texture import component_values, raw_bands
from prismloom.sources.cube import Cube

SHAPES = ("disk", "square", "diamond", "line")


def footprint(shape: str, radius: int) -> list[tuple[int, int]]:
    """(row, column) offsets of a structuring element; a line lies along the columns."""
    reach = range(-radius, radius + 1)
    inside = {
        "disk": lambda r, c: r * r + c * c <= radius * radius,
        "square": lambda r, c: True,
        "diamond": lambda r, c: abs(r) + abs(c) <= radius,
        "line": lambda r, c: r == 0,
    }[shape]
    return [(r, c) for r in reach for c in reach if inside(r, c)]


def _extreme(plane: np.ndarray, offsets: list[tuple[int, int]], pick: np.ufunc, neutral: float) -> np.ndarray:
    """Erosion (minimum) or dilation (maximum); beyond the plane there is the neutral value."""
    reach = max(max(abs(r), abs(c)) for r, c in offsets)
    wide = np.pad(plane, ((reach, reach), (reach, reach)), constant_values=neutral)
    h, w = plane.shape
    out = np.full_like(plane, neutral)
    for r, c in offsets:
        pick(out, wide[reach + r : reach + r + h, reach + c : reach + c + w], out=out)
    return out


def eroded(plane: np.ndarray, known: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    return _extreme(np.where(known, plane, np.inf), offsets, np.minimum, np.inf)


def dilated(plane: np.ndarray, known: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    return _extreme(np.where(known, plane, -np.inf), offsets, np.maximum, -np.inf)


@dataclass(frozen=True)
class MPExtractor(Extractor):
    """For each component and shape: openings from the largest radius to the smallest, the component, closings from the
    smallest to the largest. Pixels beyond the image don't count. By reconstruction, openings and closings keep whole
    structures (8-connected) that an erosion or dilation leaves a trace of."""

    n_components: int = 3
    radii: tuple[int, ...] = (2, 4, 6, 8)
    shapes: tuple[str, ...] = ("disk", "square", "diamond")
    use_reconstruction: bool = False
    #: Bands themselves in place of components.
    bands: tuple[int, ...] | None = None

    limits = {"n_components": NATURAL, "radii": NATURAL.many(), "shapes": among(*SHAPES).many(), "use_reconstruction": FLAG}

    def _extract(self, cube: Cube) -> Feature:
        channels = component_values(cube, self.n_components) if self.bands is None else raw_bands(cube, self.bands)
        k = self.n_components if self.bands is None else len(self.bands)
        radii, shapes, images = sorted(self.radii), self.shapes, cube.images()
        steps = [(s, r) for s in shapes for r in radii]
        reach = max(radii)

        def each(tile: Tile, use: Callable[[np.ndarray, np.ndarray, list[tuple[int, int]]], list[np.ndarray]]) -> np.ndarray:
            """use's planes for component, shape and radius, of the tile's inside."""
            out = [p[tile.rows, tile.cols] for c in range(k) for s, r in steps for p in use(tile.values[:, :, c], tile.known, footprint(s, r))]
            return np.stack(out, axis=2)

        if self.use_reconstruction:

            def start(tile: Tile) -> np.ndarray:
                marks = each(tile, lambda p, known, at: [eroded(p, known, at), -dilated(p, known, at)])
                inner = tile.inner
                return np.concatenate([marks, np.stack([inner, -inner], axis=3).reshape(*inner.shape[:2], 2 * k)], axis=2)

            first = tiled(channels, images, "none", reach, start).withColumnRenamed("features", "values")
            # Markers of a component come in pairs, under the component and under its negative.
            of = [2 * c + side for c in range(k) for _ in steps for side in (0, 1)]
            found = geodesic(first, images, of).withColumnRenamed("values", "p").join(channels, ["image_id", "row", "col"])
            pick = lambda c, i, closing: -F.col("p")[2 * (c * len(steps) + i) + 1] if closing else F.col("p")[2 * (c * len(steps) + i)]
            columns = []
            for c in range(k):
                for s in range(len(shapes)):
                    own = range(s * len(radii), (s + 1) * len(radii))
                    columns += [pick(c, i, False) for i in reversed(own)] + [F.col("values")[c]] + [pick(c, i, True) for i in own]
            data = found.select("image_id", "row", "col", F.array(*columns).alias("features"))
        else:

            def kernel(tile: Tile) -> np.ndarray:
                both = each(tile, lambda p, known, at: [dilated(eroded(p, known, at), known, at), eroded(dilated(p, known, at), known, at)])
                both = both.reshape(*both.shape[:2], k, len(shapes), len(radii), 2)
                own = np.broadcast_to(tile.inner[:, :, :, None, None], (*tile.inner.shape, len(shapes), 1))
                return np.concatenate([both[..., ::-1, 0], own, both[..., 1]], axis=-1).reshape(*tile.inner.shape[:2], -1)

            data = tiled(channels, images, "none", 2 * reach, kernel)
        return Feature(data, {"n_components": k, "shapes": list(shapes), "radii": radii, "use_reconstruction": self.use_reconstruction, "n_features": k * len(shapes) * (2 * len(radii) + 1)})
