"""What stands beyond the border of an image, and tiles of images with a halo.

A rule says which place a place beyond the border shows. ``tiled`` deals the pixels out to tiles, each
with the halo that its neighbourhoods reach into, so a task sees all it needs of its tile and no more;
a pixel travels (1 + 2 * halo / TILE) ** 2 times, not once for every neighbour.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismloom.sources.storage import beside

#: Rows and columns of a tile.
TILE = 64
RULES = ("reflect", "repeat", "wrap", "none")


def shown(place: Column, size: Column, rule: str, padded: Column | None = None) -> Column:
    """The place in 0 to size - 1 that a place shows: mirrored without the edge ("reflect") or with it
    ("repeat"), or from the other side ("wrap"). With ``padded``, an image of that size made by reflection wraps."""
    if padded is not None:
        return shown(F.pmod(place, padded), size, "reflect")
    if rule == "wrap":
        return F.pmod(place, size)
    if rule == "repeat":
        m = F.pmod(place, 2 * size)
        return F.least(m, 2 * size - 1 - m)
    if rule == "reflect":
        period = F.greatest(2 * (size - 1), F.lit(1))
        return F.when(size == 1, F.lit(0)).otherwise((size - 1) - F.abs((size - 1) - F.pmod(place, period)))
    return place


def _showing(at: Column, size: Column, rule: str, halo: int, padded: Column | None) -> Column:
    """All places from -halo to the size + halo - 1 that show a place."""
    own = F.array(at)
    if rule == "none" and padded is None or halo == 0 and padded is None:
        return own
    end = size + F.lit(halo) if padded is None else padded + F.lit(halo)
    beyond = F.concat(F.sequence(F.lit(-halo), F.lit(-1)) if halo else F.array().cast("array<int>"), F.when(end > size, F.sequence(size, end - 1)).otherwise(F.array().cast("array<int>")))
    return F.concat(own, F.filter(beyond, lambda p: shown(p, size, rule, padded) == at))


@dataclass
class Tile:
    """Values (row, column, channel) of a tile and its halo, which of them lie in the image or show it, and the tile within."""

    values: np.ndarray
    known: np.ndarray
    rows: slice
    cols: slice

    @property
    def inner(self) -> np.ndarray:
        return self.values[self.rows, self.cols]


_FEATURES = "image_id string, row int, col int, features array<double>"
_NONE = pa.schema([("image_id", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("features", pa.list_(pa.float64()))]).empty_table()


def _table(image: str, r0: int, c0: int, out: np.ndarray, there: np.ndarray) -> pa.Table:
    """(image_id, row, col, features) of a tile's (row, column, feature), of the places that are there."""
    rr, cc = np.nonzero(there)
    n = len(rr)
    features = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * out.shape[2], pa.array(out[rr, cc].reshape(-1).astype(np.float64)))
    return pa.Table.from_arrays([pa.array([image] * n, pa.string()), pa.array((rr + r0).astype(np.int32)), pa.array((cc + c0).astype(np.int32)), features], ["image_id", "row", "col", "features"])


def _places(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where each asked number stands among the known ones, which are in order; after the last if it isn't there."""
    at = np.searchsorted(known, asked)
    return np.where(known[np.minimum(at, len(known) - 1)] == asked, at, len(known))


def _shown_places(places: np.ndarray, size: int, rule: str) -> np.ndarray:
    """``shown`` for numpy, for the rules by which every place shows one."""
    if rule == "wrap":
        return places % size
    if rule == "repeat":
        m = places % (2 * size)
        return np.minimum(m, 2 * size - 1 - m)
    if size == 1:
        return np.zeros_like(places)
    return (size - 1) - np.abs((size - 1) - places % (2 * (size - 1)))


def tiled_with_offsets(cells: DataFrame, images: DataFrame, rule: str, halo: int, offsets: Sequence[tuple[int, int]], kernel: Callable[[list[np.ndarray]], np.ndarray], tile: int = TILE) -> DataFrame:
    """(image_id, row, col, features) as ``tiled`` gives, by a kernel that sees neighbours at offsets too.

    The kernel gets a list of (row, column, channel) values of the tile and its halo: of the places themselves, then of what lies at
    each (row, column) offset from the pixel that a place shows, where the image wraps around; NaN where the image has no pixel.
    A pixel goes once to every tile that asks for it.
    """
    rows = beside(cells, images, 64)
    for name, n, moves in (("row", F.col("height"), {0, *(d[0] for d in offsets)}), ("col", F.col("width"), {0, *(d[1] for d in offsets)})):
        last = F.floor((n - 1) / tile)
        asked = []
        for move in sorted(moves):
            places = _showing(F.pmod(F.col(name) - move, n), n, rule, halo, None).cast("array<int>")
            # No default arguments in these lambdas: Spark would take them for the index of an element.
            near = lambda p: F.sequence(F.greatest(F.floor((p - halo) / tile), F.lit(0)), F.least(F.greatest(F.floor((p + halo) / tile), F.lit(0)), last))  # noqa: B023, E731
            within = lambda p: F.filter(near(p), lambda t: (p >= t * tile - halo) & (p < F.least((t + 1) * tile, n) + halo))  # noqa: B023, E731
            asked.append(F.flatten(F.transform(F.filter(places, lambda p: p < n + halo), within)))  # noqa: B023
        rows = rows.withColumn(f"_{name}", F.explode(F.array_distinct(F.concat(*asked))))
    dealt = rows.select("image_id", F.col("_row").cast("int").alias("tr"), F.col("_col").cast("int").alias("tc"), "row", "col", "height", "width", "values")

    def run(table: pa.Table) -> pa.Table:
        one = lambda name: table.column(name)[0].as_py()
        height, width, r0, c0 = one("height"), one("width"), one("tr") * tile, one("tc") * tile
        at_row, row = np.unique(np.asarray(table.column("row")), return_inverse=True)
        at_col, col = np.unique(np.asarray(table.column("col")), return_inverse=True)
        flat = table.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(row), -1)
        # One row and column more, for places of which the tile has got no pixel.
        values, known = np.full((len(at_row) + 1, len(at_col) + 1, flat.shape[1]), np.nan), np.zeros((len(at_row) + 1, len(at_col) + 1), dtype=bool)
        values[row, col], known[row, col] = flat, True
        rr = _shown_places(np.arange(r0 - halo, min(r0 + tile, height) + halo), height, rule)
        cc = _shown_places(np.arange(c0 - halo, min(c0 + tile, width) + halo), width, rule)
        seen = [values[np.ix_(_places(at_row, (rr + dr) % height), _places(at_col, (cc + dc) % width))] for dr, dc in ((0, 0), *offsets)]
        there = known[np.ix_(_places(at_row, rr), _places(at_col, cc))][halo : len(rr) - halo, halo : len(cc) - halo]
        return _table(one("image_id"), r0, c0, kernel(seen), there) if there.any() else _NONE

    return dealt.groupBy("image_id", "tr", "tc").applyInArrow(run, _FEATURES)


def tiled(cells: DataFrame, images: DataFrame, rule: str, halo: int, kernel: Callable[[Tile], np.ndarray], multiple: int | None = None, tile: int = TILE, gaps: bool = False) -> DataFrame:
    """(image_id, row, col, features): the kernel's (row, column, feature) for every pixel of every tile.

    ``cells`` has (image_id, row, col, values array<double>), as many values everywhere; ``images`` has
    (image_id, height, width). Images are first padded by reflection to a multiple if one is given. Places without a pixel, as
    at the end of a last row that isn't full, hold 0 and aren't known; they have a row of their own only with ``gaps``.
    """
    size = {"row": F.col("height"), "col": F.col("width")}
    rows = beside(cells, images, 64)
    for name, n in size.items():
        padded = None if multiple is None else (F.ceil(n / multiple) * multiple).cast("int")
        places = _showing(F.col(name), n, rule, halo, padded).cast("array<int>")
        # No default arguments in these lambdas: Spark would take them for the index of an element.
        # The tiles whose halo a place falls into: those of its own block and of the neighbours within reach.
        last = F.floor((n - 1) / tile)
        near = lambda p: F.transform(F.sequence(F.greatest(F.floor((p - halo) / tile), F.lit(0)), F.least(F.greatest(F.floor((p + halo) / tile), F.lit(0)), last)), lambda t: F.struct(t.cast("int").alias("tile"), p.alias("place")))  # noqa: B023, E731
        both = F.filter(F.flatten(F.transform(F.filter(places, lambda p: p < n + halo), near)), lambda s: (s["place"] >= s["tile"] * tile - halo) & (s["place"] < (s["tile"] + 1) * tile + halo))
        rows = rows.withColumn(f"_{name}", F.explode(both))
    dealt = rows.select("image_id", F.col("_row.tile").alias("tr"), F.col("_col.tile").alias("tc"), F.col("_row.place").alias("r"), F.col("_col.place").alias("c"), "height", "width", "values")

    def run(table: pa.Table) -> pa.Table:
        one = lambda name: table.column(name)[0].as_py()
        r, c = np.asarray(table.column("r")), np.asarray(table.column("c"))
        r0, c0 = one("tr") * tile, one("tc") * tile
        h, w = min(tile, one("height") - r0), min(tile, one("width") - c0)
        flat = table.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(r), -1)
        values, known = np.zeros((h + 2 * halo, w + 2 * halo, flat.shape[1])), np.zeros((h + 2 * halo, w + 2 * halo), dtype=bool)
        inside = (r - r0 + halo < len(known)) & (c - c0 + halo < known.shape[1])
        r, c, flat = r[inside] - r0 + halo, c[inside] - c0 + halo, flat[inside]
        values[r, c], known[r, c] = flat, True
        there = np.ones((h, w), dtype=bool) if gaps else known[halo : halo + h, halo : halo + w]
        return _table(one("image_id"), r0, c0, kernel(Tile(values, known, slice(halo, halo + h), slice(halo, halo + w))), there) if there.any() else _NONE

    return dealt.groupBy("image_id", "tr", "tc").applyInArrow(run, _FEATURES)


def windows(tile: Tile, size: int, chunk: int = 16) -> Iterator[tuple[slice, np.ndarray]]:
    """For some rows of the tile at a time: those rows, and (row, column, channel, size * size) neighbourhoods."""
    half = size // 2
    around = tile.values[tile.rows.start - half : tile.rows.stop + half, tile.cols.start - half : tile.cols.stop + half]
    view = np.lib.stride_tricks.sliding_window_view(around, (size, size), axis=(0, 1))
    for lo in range(0, view.shape[0], chunk):
        part = view[lo : lo + chunk]
        yield slice(lo, lo + part.shape[0]), part.reshape(*part.shape[:3], size * size)


def weighted(tile: Tile, kernels: np.ndarray) -> np.ndarray:
    """(row, column, channel, kernel): sums of neighbourhoods times kernels (kernel, size, size)."""
    size = kernels.shape[1]
    flat = kernels.reshape(len(kernels), -1).T
    out = np.empty((*tile.inner.shape, len(kernels)))
    for rows, around in windows(tile, size):
        out[rows] = around @ flat
    return out
