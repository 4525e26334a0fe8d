"""Near duplicates among embeddings, by binary codes of randomly rotated vectors.

Equal vectors are one class. Classes are put into cells about centroids; one near a border is a guest in the
cells beyond it, so close pairs across the border meet. The inner product of a pair is
estimated from the one's code (the signs of its randomly rotated components) and the other's rotated
components, divided by the stored correction factor of the code, which makes the estimate unbiased. How
far it can be off is bounded with the confidence that EPSILON gives; only pairs that may reach the threshold within the
bound are computed exactly. Guests travel as codes first: a guest's vector follows only into cells where an estimate
says that it may be close to one at home. Cells are compared in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismloom.llm.components import components
from prismloom.llm.links import LINKS, SCHEMA, linked
from prismloom.llm.storage import table, written

THRESHOLD = 0.9
#: Classes in a cell on average, centroids at most; classes that centroids are fitted on at most, and their bytes.
CELL, MOST_CELLS, SAMPLE, SAMPLE_BYTES = 400, 4096, 20_000, 32 << 20
#: Standard deviations of the estimate that its bound allows for.
EPSILON = 5.0
#: Classes of a block whose vectors are compared; bytes of vectors at home, and codes of guests, that meet first.
BLOCK, HOME_BYTES, GUESTS = 256, 1 << 20, 16_384
#: Vectors whose cells are sought at a time.
_WIDE = 512


def margin_of(threshold: float) -> float:
    """Distance from the border of its cell up to which a vector is a guest beyond it.

    Two unit vectors at the threshold are at most sqrt(2 - 2 * threshold) apart, so the nearer one to a border
    between them lies within half of that, whatever the dimension; a little is added for rounding.
    """
    return float(np.sqrt(max(0.0, 2 - 2 * threshold)) / 2 + 1e-6)


@dataclass
class Index:
    """Centroids (unit vectors) and the rotation, for vectors of one dimension."""

    centroids: np.ndarray
    rotation: np.ndarray

    def cells(self, units: np.ndarray, margin: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each vector's home cell, and the cells where it is a guest."""
        homes, guests = np.zeros(len(units), dtype=np.int32), []
        for lo in range(0, len(units), _WIDE):
            part = units[lo : lo + _WIDE]
            dots = part @ self.centroids.T
            home, rows = dots.argmax(axis=1), np.arange(len(part))
            apart = np.sqrt(np.maximum(2 - 2 * (self.centroids[home] @ self.centroids.T), 1e-12))
            guest = (dots[rows, home][:, None] - dots) <= margin * apart
            guest[rows, home] = False
            homes[lo : lo + _WIDE] = home
            guests += [np.flatnonzero(g).astype(np.int32) for g in guest]
        return homes, guests

    def codes(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signs of the rotated components, packed, and each code's inner product with its vector."""
        turned = units @ self.rotation
        return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(units.shape[1])


def unit_rows(embeddings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat double components and their bounds, and which rows are comparable: finite, not null, not zero."""
    lists = embeddings.cast(pa.list_(pa.float64())) if not pa.types.is_list(embeddings.type) or embeddings.type.value_type != pa.float64() else embeddings
    out, good = [], np.zeros(len(lists), dtype=bool)
    for i, x in enumerate(lists):
        row = np.zeros(0)
        if x.is_valid and x.values.null_count == 0:
            row = x.values.to_numpy(zero_copy_only=False)
            scale = np.abs(row).max() if len(row) else 0.0
            if scale > 0 and np.isfinite(row).all():
                row = row / scale  # else squares of tiny or huge components leave the doubles
                row = row / np.sqrt(row @ row)
                good[i] = True
        out.append(row)
    return out, good


def keyed(vectors: DataFrame, id: str, embedding: str) -> DataFrame:
    """(row, id, node, unit): node is a digest of the components, null for what can't be compared; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, good = unit_rows(batch.column(2))
            data = [u.tobytes() if g else None for u, g in zip(units, good, strict=True)]
            nodes = [None if d is None else hashlib.md5(d).digest() for d in data]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(nodes, pa.binary()), pa.array(data, pa.binary())], ["row", "id", "node", "unit"])

    kind = vectors.schema[id].dataType.simpleString()
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.col(embedding).cast("array<double>").alias("embedding"))
    return written(rows.mapInArrow(run, f"row bigint, id {kind}, node binary, unit binary"), "vectors")


def fit(classes: DataFrame, size: int, n: int, cell: int = CELL, seed: int = 3) -> Index:
    """Centroids by spherical k-means on a sample, the classes of the least hashes; a random rotation.

    The sample has at most SAMPLE classes and SAMPLE_BYTES bytes, and at least one class a centroid.
    """
    most = max(2, min(SAMPLE, SAMPLE_BYTES // (8 * size)))
    k = max(1, min(MOST_CELLS, most, n // cell))
    rows = classes.where(F.octet_length("unit") == 8 * size).orderBy(F.xxhash64("node"), "node").select("unit").limit(most).collect()
    units = np.stack([np.frombuffer(r[0]) for r in rows])
    rng = np.random.default_rng(seed)
    centroids = units[rng.permutation(len(units))[:k]]
    for _ in range(6):
        home = np.concatenate([(units[i : i + _WIDE] @ centroids.T).argmax(axis=1) for i in range(0, len(units), _WIDE)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, units)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centroids)
    rotation, _ = np.linalg.qr(rng.standard_normal((size, size)))
    return Index(np.unique(centroids, axis=0), rotation)


def indexed(classes: DataFrame, indexes: dict[int, Index], margin: float) -> DataFrame:
    """Each class with its home, the cells where it is a guest, its code and correction factor; written once."""
    shared = classes.sparkSession.sparkContext.broadcast(indexes)  # at most MOST_CELLS vectors a dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column(1).to_pylist()
            sizes = np.array([len(u) // 8 for u in units])
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                block = np.stack([np.frombuffer(units[i]) for i in at])
                home, guests = shared.value[size].cells(block, margin)
                codes, factors = shared.value[size].codes(block)
                bounds = np.cumsum([0, *map(len, guests)])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(guests), pa.int32()))
                columns = [batch.column(c).take(pa.array(at)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(at), size), pa.int32()), pa.array(home, pa.int32()), lists, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(factors)], ["node", "unit", "n_rows", "size", "home", "guest", "code", "factor"])

    return written(classes.select("node", "unit", "n_rows").mapInArrow(run, "node binary, unit binary, n_rows bigint, size int, home int, guest array<int>, code binary, factor double"), "index")


def _close_guests(index: DataFrame, indexes: dict[int, Index], threshold: float, epsilon: float) -> DataFrame:
    """(node, guest): of each class that is a guest anywhere, the cells where an estimate with one at home may reach the threshold.

    Guests of a cell, as codes, meet blocks of those at home, as vectors. Both travel packed, a row a batch, cell and block.
    """
    spark = index.sparkSession
    places = lambda column, name: index.select("size", F.explode(column).alias("cell")).groupBy("size", "cell").agg(F.count("*").alias(name))
    both = places(F.array("home"), "homes").join(places("guest", "guests"), ["size", "cell"])
    rows = both.collect()  # at most MOST_CELLS a dimension
    parts = {}
    for r in rows:
        per_home = max(16, HOME_BYTES // (8 * r["size"]))
        parts[r["size"], r["cell"]] = -(-r["homes"] // per_home), -(-r["guests"] // GUESTS)
    shared = spark.sparkContext.broadcast((indexes, parts))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, parts = shared.value
        for batch in batches:
            names = ("node", "unit", "size", "home", "guest", "code", "factor")
            node, unit, size, home, guest, code, factor = (batch.column(batch.schema.names.index(n)) for n in names)
            node, unit, code = (np.array(c.to_pylist(), dtype=object) for c in (node, unit, code))
            size, home, factor = np.asarray(size), np.asarray(home), np.asarray(factor)
            salt = np.array([int.from_bytes(n[:4], "little") for n in node], dtype=np.int64)
            out = []
            for is_home, owner, cell in ((True, np.arange(len(batch)), home), (False, np.repeat(np.arange(len(batch)), np.asarray(guest.value_lengths())), np.asarray(guest.flatten()))):
                order = np.lexsort((cell, size[owner]))
                owner, cell = owner[order], cell[order]
                starts = np.flatnonzero((np.diff(cell, prepend=-1) != 0) | (np.diff(size[owner], prepend=-1) != 0))
                for a, b in pairwise([*starts.tolist(), len(cell)]):
                    key = int(size[owner[a]]), int(cell[a])
                    if key not in parts:  # nobody at home, or no guests
                        continue
                    own, n = owner[a:b], parts[key][0 if is_home else 1]
                    block = salt[own] % n
                    for part in np.unique(block).tolist():
                        at = own[block == part]
                        data = (b"".join(unit[at]), None, None, None) if is_home else (None, b"".join(node[at]), b"".join(code[at]), factor[at].tobytes())
                        for other in range(parts[key][1 if is_home else 0]):
                            out.append((*key, *((part, other) if is_home else (other, part)), *data))
            columns = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i < 4 else pa.binary()) for i, c in enumerate(columns)], ["size", "cell", "i", "j", "units", "nodes", "codes", "factors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes, _ = shared.value
        for batch in batches:
            for size, cell, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                joined = lambda name: b"".join(x for x in c.values.field(name).to_pylist() if x)  # noqa: B023, E731
                units, nodes = np.frombuffer(joined("units")).reshape(-1, size), joined("nodes")
                codes, factors = np.frombuffer(joined("codes"), np.uint8), np.frombuffer(joined("factors"))
                if not len(units) or not len(factors):
                    continue
                codes, close = codes.reshape(len(factors), -1), np.zeros(len(factors), dtype=bool)
                for lo in range(0, len(factors), 1024):
                    close[lo : lo + 1024] = may_reach(indexes[size], codes[lo : lo + 1024], factors[lo : lo + 1024], units, threshold, epsilon).any(axis=1)
                found = [nodes[16 * i : 16 * i + 16] for i in np.flatnonzero(close).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([cell] * len(found), pa.int32())], ["node", "cell"])

    packed = index.select("node", "unit", "size", "home", "guest", "code", "factor").mapInArrow(pack, "size int, cell int, i int, j int, units binary, nodes binary, codes binary, factors binary")
    met = packed.groupBy("size", "cell", "i", "j").agg(F.collect_list(F.struct("units", "nodes", "codes", "factors")).alias("c")).select("size", "cell", "c")
    return met.mapInArrow(run, "node binary, cell int").groupBy("node").agg(F.collect_set("cell").alias("guest"))


def _blocks(index: DataFrame, block: int) -> DataFrame:
    """Pairs of blocks of a cell's classes, home by home and home by guest."""
    placed = index.select("*", F.explode(F.concat(F.array("home"), "guest")).alias("cell"))
    counts = placed.groupBy("size", "cell").agg(F.count_if(F.col("home") == F.col("cell")).alias("homes"), F.count_if(F.col("home") != F.col("cell")).alias("guests"))
    parts = lambda n: F.greatest(F.ceil(F.col(n) / block), F.lit(1)).cast("int")
    rows = placed.join(counts, ["size", "cell"])
    at_home = F.col("home") == F.col("cell")
    own = F.when(at_home, F.pmod(F.xxhash64("node"), parts("homes"))).otherwise(F.pmod(F.xxhash64("node"), parts("guests"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), parts(n) - 1)
    # (kind, i, j): a home block meets the others once each, and all guest blocks; a guest block meets all home blocks.
    among = F.transform(upto("homes"), lambda o: F.struct(F.lit(0).alias("kind"), F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    hosts = F.when(F.col("guests") > 0, F.transform(upto("guests"), lambda o: F.struct(F.lit(1).alias("kind"), own.alias("i"), o.alias("j")))).otherwise(F.array().cast("array<struct<kind: int, i: int, j: int>>"))
    visits = F.transform(upto("homes"), lambda o: F.struct(F.lit(1).alias("kind"), o.alias("i"), own.alias("j")))
    rows = rows.select("size", "cell", "node", "n_rows", "home", "guest", "code", "factor", "unit", own.alias("own"), F.explode(F.when(at_home, F.concat(among, hosts)).otherwise(visits)).alias("pair"))
    return rows.groupBy("size", "cell", "pair").agg(F.collect_list(F.struct("node", "n_rows", "home", "guest", "code", "factor", "unit", "own")).alias("c")).where(F.size("c") > 1)


def may_reach(index: Index, codes: np.ndarray, factors: np.ndarray, others: np.ndarray, threshold: float, epsilon: float) -> np.ndarray:
    """Which pairs of coded and plain vectors may have the inner product, given the bound of the estimate.

    With f the code's factor, the estimate's error is at most b = sqrt((1 - f^2) / f^2 * (1 - s^2)) where s is the true
    product, and has a standard deviation of b / sqrt(d - 1); at s >= threshold no more than with s = threshold. So nothing
    is missed where epsilon^2 >= d - 1, that is in up to 26 dimensions with EPSILON.
    """
    size = others.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=size).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(size))
    estimate = signs @ (others @ index.rotation).T.astype(np.float32) / factors[:, None].astype(np.float32)
    off = np.sqrt(np.maximum(1 - factors**2, 0) / factors**2 * max(0.0, 1 - threshold**2)) * min(1.0, epsilon / np.sqrt(max(1, size - 1)))
    return estimate >= (threshold - off - 1e-5)[:, None]


def _compare(blocks: DataFrame, indexes: dict[int, Index], threshold: float, epsilon: float) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast(indexes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, cell, pair, c in zip(*batch.columns, strict=True):
                size, cell, pair, rows = size.as_py(), cell.as_py(), pair.as_py(), c.values
                index = shared.value[size]
                bytes_of = lambda name, kind: np.frombuffer(b"".join(rows.field(name).to_pylist()), dtype=kind).reshape(len(rows), -1)  # noqa: B023, E731
                units, codes, factors = bytes_of("unit", np.float64), bytes_of("code", np.uint8), np.asarray(rows.field("factor"))
                home, own = np.asarray(rows.field("home")), np.asarray(rows.field("own"))
                if pair["kind"]:
                    a, b = np.flatnonzero((home == cell) & (own == pair["i"])), np.flatnonzero((home != cell) & (own == pair["j"]))
                else:
                    a, b = np.flatnonzero(own == pair["i"]), np.flatnonzero(own == pair["j"])
                if not len(a) or not len(b):
                    continue
                maybe = may_reach(index, codes[a], factors[a], units[b], threshold, epsilon)
                if pair["kind"]:
                    # Two that are guests in each other's homes meet in both cells; the lower one counts them.
                    guests = rows.field("guest").take(pa.array(a))
                    visits = np.zeros((len(a), len(index.centroids)), dtype=bool)
                    visits[np.repeat(np.arange(len(a)), np.asarray(guests.value_lengths())), np.asarray(guests.flatten())] = True
                    maybe &= ~(visits[:, home[b]] & (home[b] < cell))
                elif pair["i"] == pair["j"]:
                    maybe &= np.tri(len(a), dtype=bool).T & ~np.eye(len(a), dtype=bool)
                left, right = np.nonzero(maybe)
                left, right = a[left], b[right]
                close = np.concatenate([np.einsum("ij,ij->i", units[left[i : i + 20_000]], units[right[i : i + 20_000]]) for i in range(0, len(left), 20_000)] or [np.zeros(0)]) >= threshold
                if close.any():
                    yield pa.RecordBatch.from_pylist(linked(rows.field("node").to_pylist(), np.asarray(rows.field("n_rows")), left[close], right[close]), schema=SCHEMA)

    return blocks.mapInArrow(run, LINKS)


def near_embeddings(vectors: DataFrame, *, id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, cell: int = CELL, margin: float | None = None, epsilon: float = EPSILON, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept), a row a vector.

    Links are pairs found with cosine at the threshold or above, in double precision; none below it. Unless a
    smaller ``margin`` is given, no pair is missed at a border of cells.
    Vectors that are null, zero or hold null or non-finite components, and vectors of different
    dimensions, don't link. ``component_id`` is the least id that links reach; a null id comes after all others. Repeated rows link like other equal
    vectors, and ``kept`` holds for rows whose id is the component's. Other columns are left out; an empty table gives no rows.
    """
    margin = margin_of(threshold) if margin is None else margin
    rows = keyed(vectors, id, embedding)
    place = F.struct(F.col("id").isNull().alias("last"), F.col("id"))
    classes = written(rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.count("*").alias("n_rows"), F.min(place).alias("first"), F.any_value("unit").alias("unit")), "classes")
    sizes = {r["size"]: r["n"] for r in classes.groupBy((F.octet_length("unit") / 8).cast("int").alias("size")).agg(F.count("*").alias("n")).collect()}
    indexes = {size: fit(classes, size, n, cell) for size, n in sizes.items()}
    index = indexed(classes, indexes, margin)
    guests = _close_guests(index, indexes, threshold, epsilon)
    placed = written(index.drop("guest").join(guests, "node", "left").withColumn("guest", F.coalesce("guest", F.array().cast("array<int>"))), "placed")
    links = written(_compare(_blocks(placed, block), indexes, threshold, epsilon), "links")
    named = written(components(links, "node", "hangs_on"), "components")
    least = named.join(classes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("least"))
    by_node = classes.select("node", "n_rows", "first").join(links.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(named.join(least, "component").select("node", "least"), "node", "left")
    by_node = by_node.select("node", (F.col("n_rows") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("least", "first")["id"].alias("least"))
    out = rows.select("id", "node").join(by_node, "node", "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_embedding_dedup": op4_embedding_dedup}
#: Brute force in SQL. On the tables of the SQL check the method finds all pairs.
ORACLE_SQL = {
    "op4_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
      WHERE e IS NOT NULL AND list_count(e) = len(e) AND len(list_filter(e, lambda x: NOT isfinite(x))) = 0 AND len(e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT v.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = v.vec_id) AS BIGINT) AS n_links, min(r.b) AS component_id, v.vec_id = min(r.b) AS kept
FROM v JOIN r ON r.a = v.vec_id GROUP BY v.vec_id"""
}
