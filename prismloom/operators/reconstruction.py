"""Reconstruction by dilation of large images, in as many stages as blocks double until one holds the image.

Tiles reconstruct what they hold. What else can change comes in over a border, and where it leads is told by a tree over the
border's pixels: between two of them the tree's weakest edge is the greatest level at which a path inside joins them. Four blocks
make a larger one: their trees and the pairs of pixels across their borders make a graph whose maximum spanning tree, brought down to
the pixels of the outer border, is the larger block's tree. Once a block holds the image, levels at its inner borders are final and go down
again, until every tile reconstructs once more from what its border has reached. Pixels are exchanged twice; all
else that moves are borders, whatever way a level takes through the image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismloom.functions.borders import TILE
from prismloom.sources.storage import written


def _near(line: np.ndarray) -> np.ndarray:
    """The greatest of each place and its two neighbours along the first axis."""
    out = line.copy()
    np.maximum(out[1:], line[:-1], out=out[1:])
    np.maximum(out[:-1], line[1:], out=out[:-1])
    return out


def reconstructed(marker: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The marker (row, column, ...) dilated by 3 x 3 within the mask until nothing changes, in sweeps to all four sides."""
    now = np.minimum(marker, mask)
    while True:
        before = now.copy()
        for turned in (False, True):
            level, most = (now.swapaxes(0, 1), mask.swapaxes(0, 1)) if turned else (now, mask)
            n = len(level)
            for order in (range(1, n), range(n - 2, -1, -1)):
                back = 1 if order.step < 0 else -1
                for r in order:
                    np.minimum(np.maximum(level[r], _near(level[r + back])), most[r], out=level[r])
        if np.array_equal(now, before):
            return now


def spanning_tree(n: int, left: np.ndarray, right: np.ndarray, level: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree over the kept of n nodes between any two of which the weakest edge is that of the graph's best path."""
    parent, stands = list(range(n)), [i if k else -1 for i, k in enumerate(kept.tolist())]
    out = []
    for e in np.argsort(-level, kind="stable").tolist():
        a, b = int(left[e]), int(right[e])
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a == b:
            continue
        parent[b] = a
        if stands[b] >= 0:
            if stands[a] >= 0:
                out.append((stands[a], stands[b], e))
            else:
                stands[a] = stands[b]
    edges = np.array(out, dtype=np.int64).reshape(-1, 3)
    return edges[:, 0], edges[:, 1], level[edges[:, 2]]


def spread(values: np.ndarray, left: np.ndarray, right: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Values (node, channel) raised to what reaches them along the trees."""
    near: list[list[tuple[int, float]]] = [[] for _ in range(len(values))]
    for a, b, x in zip(left.tolist(), right.tolist(), level.tolist(), strict=True):
        near[a].append((b, x))
        near[b].append((a, x))
    seen, order = [False] * len(values), []
    for start in range(len(values)):
        if seen[start]:
            continue
        seen[start] = True
        stack = [start]
        while stack:
            a = stack.pop()
            for b, x in near[a]:
                if not seen[b]:
                    seen[b] = True
                    order.append((a, b, x))
                    stack.append(b)
    out = values.copy()
    for a, b, x in reversed(order):
        np.maximum(out[a], np.minimum(out[b], x), out=out[a])
    for a, b, x in order:
        np.maximum(out[b], np.minimum(out[a], x), out=out[b])
    return out


class Trees:
    """A tree for each mask, over the same nodes."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.parts = parts

    def spread(self, values: np.ndarray, of: np.ndarray) -> np.ndarray:
        out = values.copy()
        for m, part in enumerate(self.parts):
            own = np.flatnonzero(of == m)
            if len(own):
                out[:, own] = spread(values[:, own], *part)
        return out

    def packed(self) -> bytes:
        sizes = np.array([len(p[0]) for p in self.parts], np.int64)
        return b"".join([np.int64(len(sizes)).tobytes(), sizes.tobytes(), *(x.astype(t).tobytes() for p in self.parts for x, t in zip(p, (np.int64, np.int64, np.float64), strict=True))])

    @classmethod
    def unpacked(cls, data: bytes) -> Trees:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes, at, parts = np.frombuffer(data, np.int64, n, 8), 8 * (n + 1), []
        for size in sizes.tolist():
            part = []
            for kind in (np.int64, np.int64, np.float64):
                part.append(np.frombuffer(data, kind, size, at))
                at += 8 * size
            parts.append(tuple(part))
        return cls(parts)


def _pixel_edges(h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(h * w).reshape(h, w)
    pairs = [(at[:, :-1], at[:, 1:]), (at[:-1], at[1:]), (at[:-1, :-1], at[1:, 1:]), (at[:-1, 1:], at[1:, :-1])]
    return tuple(np.concatenate([p[side].ravel() for p in pairs]) for side in (0, 1))


def _border_edges(place: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of different blocks that are neighbours of eight; place is row << 32 | column."""
    order = np.argsort(place)
    found = []
    for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)):
        other = place + (dr << 32) + dc
        at = np.minimum(np.searchsorted(place[order], other), len(place) - 1)
        hit = np.flatnonzero(place[order][at] == other)
        pair = order[at[hit]]
        across = block[hit] != block[pair]
        found.append((hit[across], pair[across]))
    return tuple(np.concatenate([f[side] for f in found]) for side in (0, 1))


_TILE = "image_id string, br int, bc int, height int, width int, marks binary, masks binary, "
_BLOCK = "nodes binary, levels binary, reached binary, tree binary"
_COLUMNS = ("nodes", "levels", "reached", "tree")


def _blob(values: np.ndarray, kind: type = np.float64) -> bytes:
    return np.ascontiguousarray(values, dtype=kind).tobytes()


def _outer(place: np.ndarray, r0: int, c0: int, h: int, w: int) -> np.ndarray:
    row, col = (place >> 32) - r0, (place & 0xFFFFFFFF) - c0
    return (row == 0) | (row == h - 1) | (col == 0) | (col == w - 1)


def geodesic(cells: DataFrame, images: DataFrame, of: Sequence[int], tile: int = TILE) -> DataFrame:
    """(image_id, row, col, values): each of the markers reconstructed under its mask (8-connected).

    ``cells`` has (image_id, row, col, values array<double>), the markers and then the masks; ``of`` tells the mask of each marker.
    Places without a pixel block the way; those beside one in its tile come back as -inf.
    """
    of, spark = np.asarray(of), cells.sparkSession
    n, m = len(of), int(max(of)) + 1
    numbers = lambda blob, *shape: np.frombuffer(blob, np.float64).reshape(*shape)
    arrow = spark.createDataFrame([], _TILE + _BLOCK).toArrow().schema

    def start(table: pa.Table) -> pa.Table:
        one = lambda name: table.column(name)[0].as_py()
        r0, c0 = one("br") * tile, one("bc") * tile
        row, col = np.asarray(table.column("row")) - r0, np.asarray(table.column("col")) - c0
        h, w = int(row.max()) + 1, int(col.max()) + 1
        values = np.full((h, w, n + m), -np.inf)  # nothing passes a place without a pixel
        values[row, col] = table.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(row), -1)
        masks = values[:, :, n:]
        marks = reconstructed(values[:, :, :n], masks[:, :, of])
        rr, cc = (x.ravel() for x in np.indices((h, w)))
        place = (rr + r0).astype(np.int64) << 32 | (cc + c0)
        outer = _outer(place, r0, c0, h, w)
        at, flat = np.cumsum(outer) - 1, masks.reshape(h * w, m)
        left, right = _pixel_edges(h, w)
        trees = []
        for k in range(m):
            a, b, level = spanning_tree(h * w, left, right, np.minimum(flat[left, k], flat[right, k]), outer)
            trees.append((at[a], at[b], level))
        row = {"image_id": one("image_id"), "br": one("br"), "bc": one("bc"), "height": h, "width": w, "marks": _blob(marks), "masks": _blob(masks)}
        row |= {"nodes": _blob(place[outer], np.int64), "levels": _blob(flat[outer]), "reached": _blob(marks.reshape(h * w, n)[outer]), "tree": Trees(trees).packed()}
        return pa.Table.from_pylist([row], schema=arrow)

    side = lambda name: F.floor(F.col(name) / tile).cast("int")
    tiles = written(cells.select("image_id", side("row").alias("br"), side("col").alias("bc"), "row", "col", "values").groupBy("image_id", "br", "bc").applyInArrow(start, _TILE + _BLOCK), "tiles")
    most = images.agg(F.max(F.greatest("height", "width"))).first()[0] or 0
    doublings = max(0, int(np.ceil(np.log2(max(1, -(-most // tile))))))

    #: Of each doubling: the blocks' inner nodes with what reached them and their tree, and for the next one the outer nodes.
    steps, now = [], tiles.select("image_id", "br", "bc", *_COLUMNS)
    kept = "image_id string, br int, bc int, inner binary, inner_reached binary, inner_tree binary, " + _BLOCK
    kept_arrow = spark.createDataFrame([], kept).toArrow().schema

    def merge(table: pa.Table, span: int) -> pa.Table:
        rows = table.to_pylist()
        nodes = [np.frombuffer(r["nodes"], np.int64) for r in rows]
        place, block = np.concatenate(nodes), np.repeat(np.arange(len(rows)), [len(x) for x in nodes])
        first = np.cumsum([0, *map(len, nodes)])
        levels, reached = (np.concatenate([numbers(r[c], -1, k) for r in rows]) for c, k in (("levels", m), ("reached", n)))
        left, right = _border_edges(place, block)
        r0, c0 = rows[0]["pr"] * span, rows[0]["pc"] * span
        outer = _outer(place, r0, c0, min(span, rows[0]["height"] - r0), min(span, rows[0]["width"] - c0))
        at, own = np.cumsum(outer) - 1, [Trees.unpacked(r["tree"]) for r in rows]
        inner, beyond, every = [], [], np.ones(len(place), dtype=bool)
        for k in range(m):
            a = np.concatenate([left, *(t.parts[k][0] + f for t, f in zip(own, first, strict=False))])
            b = np.concatenate([right, *(t.parts[k][1] + f for t, f in zip(own, first, strict=False))])
            level = np.concatenate([np.minimum(levels[left, k], levels[right, k]), *(t.parts[k][2] for t in own)])
            inner.append(spanning_tree(len(place), a, b, level, every))
            x, y, z = spanning_tree(len(place), *inner[k], outer)
            beyond.append((at[x], at[y], z))
        trees = Trees(inner)
        reached = trees.spread(reached, of)
        row = {"image_id": rows[0]["image_id"], "br": rows[0]["pr"], "bc": rows[0]["pc"], "inner": _blob(place, np.int64), "inner_reached": _blob(reached), "inner_tree": trees.packed()}
        row |= {"nodes": _blob(place[outer], np.int64), "levels": _blob(levels[outer]), "reached": _blob(reached[outer]), "tree": Trees(beyond).packed()}
        return pa.Table.from_pylist([row], schema=kept_arrow)

    def merging(span: int) -> Callable[[pa.Table], pa.Table]:
        return lambda table: merge(table, span)

    for d in range(1, doublings + 1):
        half = lambda name: F.floor(F.col(name) / 2).cast("int")
        four = now.join(images, "image_id").select("image_id", half("br").alias("pr"), half("bc").alias("pc"), "height", "width", *_COLUMNS).groupBy("image_id", "pr", "pc")
        steps.append(written(four.applyInArrow(merging(tile << d), kept), "blocks"))
        now = steps[-1].select("image_id", "br", "bc", *_COLUMNS)

    sent = "image_id string, br int, bc int, at binary, level binary"
    sent_arrow = spark.createDataFrame([], sent).toArrow().schema

    def handed(image: str, place: np.ndarray, reached: np.ndarray, span: int) -> pa.RecordBatch:
        """What a block's inner nodes have reached, for each of the blocks that they came from."""
        key = ((place >> 32) // span) << 32 | (place & 0xFFFFFFFF) // span
        rows = [{"image_id": image, "br": int(k >> 32), "bc": int(k & 0xFFFFFFFF), "at": _blob(place[key == k], np.int64), "level": _blob(reached[key == k])} for k in np.unique(key)]
        return pa.RecordBatch.from_pylist(rows, schema=sent_arrow)

    down = None
    for d in range(doublings, 0, -1):

        def lower(batches: Iterator[pa.RecordBatch], span: int = tile << d - 1) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    place, reached = np.frombuffer(r["inner"], np.int64), numbers(r["inner_reached"], -1, n)
                    if r.get("at") is not None:
                        reached = reached.copy()
                        order = np.argsort(place)
                        at = order[np.searchsorted(place[order], np.frombuffer(r["at"], np.int64))]
                        reached[at] = np.maximum(reached[at], numbers(r["level"], -1, n))
                        reached = Trees.unpacked(r["inner_tree"]).spread(reached, of)
                    yield handed(r["image_id"], place, reached, span)

        blocks = steps[d - 1].select("image_id", "br", "bc", "inner", "inner_reached", "inner_tree")
        blocks = blocks if down is None else blocks.join(down, ["image_id", "br", "bc"])
        down = written(blocks.mapInArrow(lower, sent), "down")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                h, w, r0, c0 = r["height"], r["width"], r["br"] * tile, r["bc"] * tile
                marks = numbers(r["marks"], h, w, n)
                if r.get("at") is not None:
                    place = np.frombuffer(r["at"], np.int64)
                    row, col, level = (place >> 32) - r0, (place & 0xFFFFFFFF) - c0, numbers(r["level"], -1, n)
                    if (level > marks[row, col]).any():
                        marks = marks.copy()
                        marks[row, col] = np.maximum(marks[row, col], level)
                        marks = reconstructed(marks, numbers(r["masks"], h, w, m)[:, :, of])
                rr, cc = np.indices((h, w))
                values = pa.ListArray.from_arrays(np.arange(h * w + 1, dtype=np.int32) * n, pa.array(marks.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([r["image_id"]] * (h * w)), pa.array((rr + r0).ravel().astype(np.int32)), pa.array((cc + c0).ravel().astype(np.int32)), values], ["image_id", "row", "col", "values"])

    last = tiles.select("image_id", "br", "bc", "height", "width", "marks", "masks")
    return (last if down is None else last.join(down, ["image_id", "br", "bc"])).mapInArrow(finish, "image_id string, row int, col int, values array<double>")
