"""Vector codes from codebooks of vector parts, by Lloyd's rounds with Elkan's bounds.

A vector of integers is cut into parts, and each part position has a codebook. Between rounds every row keeps, for
each of its parts, the entry it is assigned to, an upper bound of the distance to it, and a lower bound of the distance to
each entry (a byte each, rounded down). When entries move, upper bounds grow and lower bounds shrink by as much as they moved.
An entry is compared only if neither its lower bound nor half its distance from the assigned entry lies strictly above
the upper bound; what is compared is compared in integers, so ties fall to the lower index as without bounds.
Codebooks are the only thing that leaves the tasks: sums of components and counts by part and entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismloom.llm.storage import discard, table, written
from prismloom.llm.vectors import common_size, steps, usable, with_total

#: Parts of a vector, entries of a codebook, rounds.
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Share by which bounds are widened, which is beyond what rounding can do to them.
SLACK = 1e-9
#: Rows whose distances to all entries are found at a time.
_WIDE = 2048


@dataclass
class Bounds:
    """Of each row and part: the assigned entry, an upper bound, a scale and lower bounds in 255ths of it."""

    entry: np.ndarray
    upper: np.ndarray
    scale: np.ndarray
    lower: np.ndarray

    def floors(self, part: int) -> np.ndarray:
        return self.lower[:, part].astype(np.float64) * (self.scale[:, part] / 255)[:, None]

    def keep(self, part: int, lower: np.ndarray) -> None:
        most = lower.max(axis=1)
        self.scale[:, part] = most
        share = np.divide(lower, most[:, None], out=np.zeros_like(lower), where=most[:, None] > 0)
        self.lower[:, part] = np.floor(share * (255 * (1 - SLACK)))


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(row, entry): squared distances in integers."""
    return ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)


def all_compared(x: np.ndarray, books: np.ndarray) -> Bounds:
    """Assignments and bounds from all distances; x is (row, part, component), books (part, entry, component)."""
    n, parts, k = len(x), len(books), books.shape[1]
    out = Bounds(np.zeros((n, parts), np.uint8), np.zeros((n, parts)), np.zeros((n, parts)), np.zeros((n, parts, k), np.uint8))
    for p in range(parts):
        far = np.concatenate([squares(x[i : i + _WIDE, p], books[p]) for i in range(0, n, _WIDE)] or [np.zeros((0, k), np.int64)])
        out.entry[:, p] = far.argmin(axis=1)  # of equals the first
        lengths = np.sqrt(far)
        out.upper[:, p] = lengths.min(axis=1) * (1 + SLACK)
        out.keep(p, lengths * (1 - SLACK))
    return out


def moved(bounds: Bounds, x: np.ndarray, old: np.ndarray, books: np.ndarray) -> tuple[Bounds, int]:
    """Assignments and bounds after entries moved from ``old`` to ``books``, and the number of distances computed."""
    out, compared = Bounds(bounds.entry.copy(), bounds.upper.copy(), bounds.scale.copy(), bounds.lower.copy()), 0
    for p, (was, now) in enumerate(zip(old, books, strict=True)):
        shift = np.sqrt(((now - was) ** 2).sum(axis=1)) * (1 + SLACK)
        half = np.sqrt(squares(now, now)) * ((1 - SLACK) / 2)
        np.fill_diagonal(half, np.inf)
        entry = out.entry[:, p].astype(np.int64)
        upper = (out.upper[:, p] + shift[entry]) * (1 + SLACK)
        lower = np.maximum(bounds.floors(p) - shift, 0) * (1 - SLACK)
        rows = np.flatnonzero(upper >= half.min(axis=1)[entry])
        own = ((x[rows, p] - now[entry[rows]]) ** 2).sum(axis=1)
        compared += len(rows)
        upper[rows] = np.sqrt(own) * (1 + SLACK)
        lower[rows, entry[rows]] = np.sqrt(own) * (1 - SLACK)
        asked = (lower[rows] <= upper[rows, None]) & (half[entry[rows]] <= upper[rows, None])
        asked[np.arange(len(rows)), entry[rows]] = False
        at, other = np.nonzero(asked)
        far = ((x[rows[at], p] - now[other]) ** 2).sum(axis=1)
        compared += len(at)
        lower[rows[at], other] = np.sqrt(far) * (1 - SLACK)
        least = own.copy()
        np.minimum.at(least, at, far)
        best = np.where(own == least, entry[rows], len(now))
        tied = far == least[at]
        np.minimum.at(best, at[tied], other[tied])
        out.entry[rows, p] = best
        upper[rows] = np.sqrt(least) * (1 + SLACK)
        out.upper[:, p] = upper
        out.keep(p, lower)
    return out, compared


def replaced(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entries that are the floors of the means of what is assigned to them; unused ones stay."""
    used = counts > 0
    out = books.copy()
    out[used] = sums[used] // counts[used][:, None]
    return out


_STATE = "id {kind}, label {label}, x binary, entry binary, upper binary, scale binary, lower binary"
_NAMES = ["id", "label", "x", "entry", "upper", "scale", "lower"]


def _blobs(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows).reshape(len(rows), -1)
    data, width = flat.tobytes(), flat.shape[1] * flat.itemsize
    return pa.array([data[i : i + width] for i in range(0, len(data), width)] if width else [b""] * len(rows), pa.binary())


def _from_blobs(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), *shape)


def _state_batch(ids: pa.Array, labels: pa.Array, x: np.ndarray, b: Bounds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, labels, *map(_blobs, (x.astype(np.int32), b.entry, b.upper, b.scale, b.lower))], _NAMES)


def first_entries(rows: DataFrame, entries: int, parts: int) -> np.ndarray:
    """(part, entry, component): the parts of the vectors with the least ids, a null id last, of repeated ids the least vector."""
    ids = [r[0] for r in rows.select("id").distinct().orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()]
    chosen = F.col("id").isin([i for i in ids if i is not None]) | (F.col("id").isNull() if None in ids else F.lit(False))
    found = rows.where(chosen).groupBy("id").agg(F.min("vector").alias("vector")).orderBy(F.col("id").asc_nulls_last()).collect()
    return steps(pa.array([r["vector"] for r in found], pa.list_(pa.float64()))).reshape(len(found), parts, -1).transpose(1, 0, 2).copy()


def _sums(state: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of components (part, entry, component) and counts (part, entry) of what is assigned to each entry."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
        for batch in batches:
            x, entry = _from_blobs(batch.column(0), np.int32, parts * width).astype(np.int64), _from_blobs(batch.column(1), np.uint8, parts)
            place = (entry + np.arange(parts) * k).ravel()
            np.add.at(sums, place, x.reshape(-1, width))
            counts += np.bincount(place, minlength=parts * k)
        used = np.flatnonzero(counts)
        lists = pa.ListArray.from_arrays(np.arange(len(used) + 1, dtype=np.int32) * width, pa.array(sums[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), lists], ["place", "n", "part"])

    sent = state.select("x", "entry").mapInArrow(run, "place int, n bigint, part array<bigint>")
    total = sent.groupBy("place").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("part")[j]) for j in range(width))).alias("sums")).collect()  # parts * entries rows at most
    sums, counts = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
    for r in total:
        sums[r["place"]], counts[r["place"]] = r["sums"], r["n"]
    return sums.reshape(parts, k, width), counts.reshape(parts, k)


def compressed(vectors: DataFrame, *, id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id, code, error, label_error) of every usable vector, and the codebooks (part, entry, component).

    Vectors that are null, empty, or hold null or non-finite components are dropped. Components count in 256ths, rounded down; they
    must lie within 131072, and vectors must have one length, a multiple of ``parts``, or ValueError is raised. Codebooks begin with
    the ``entries`` least ids, fewer if there are fewer; of repeated ids the least vector begins, and every row is
    coded. ``error`` is the squared distance from the code's vector, ``label_error`` its sum over equal labels, nulls together.
    Other columns are left out, whatever their names; an empty table gives no rows. Between rounds the rows lie in the shared folder.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    rows = vectors.where(usable(F.col(embedding))).select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("vector"))
    size = common_size(rows, "vector")
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    kinds = {n: rows.schema[n].dataType.simpleString() for n in ("id", "label")}
    result = f"id {kinds['id']}, label {kinds['label']}, code string, error bigint"
    spark, width = rows.sparkSession, size // parts
    if not size:
        empty = spark.createDataFrame([], result).select(F.col("id").alias(id), "code", "error", F.col("error").alias("label_error"))
        return empty, np.zeros((parts, 0, 0), np.int64)
    books = first_entries(rows, entries, parts)
    schema = _STATE.format(kind=kinds["id"], label=kinds["label"])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = steps(batch.column(2)).reshape(len(batch), parts, width)
            yield _state_batch(batch.column(0), batch.column(1), x, all_compared(x, shared.value[1]))

    def bounds_of(batch: pa.RecordBatch) -> tuple[np.ndarray, Bounds]:
        k = shared.value[1].shape[1]
        x = _from_blobs(batch.column(2), np.int32, parts, width).astype(np.int64)
        return x, Bounds(_from_blobs(batch.column(3), np.uint8, parts), _from_blobs(batch.column(4), np.float64, parts), _from_blobs(batch.column(5), np.float64, parts), _from_blobs(batch.column(6), np.uint8, parts, k))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, bounds = bounds_of(batch)
            yield _state_batch(batch.column(0), batch.column(1), x, moved(bounds, x, *shared.value)[0])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, now = shared.value
            x, bounds = bounds_of(batch)
            entry = bounds.entry if old is None else moved(bounds, x, old, now)[0].entry
            near = now[np.arange(parts)[None, :], entry]
            error = ((x - near) ** 2).sum(axis=(1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([e.tobytes().hex() for e in np.ascontiguousarray(entry)], pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    shared = spark.sparkContext.broadcast((None, books))  # parts * entries vectors of a part, whatever the table
    state, old = written(rows.mapInArrow(start, schema), "bounds"), None
    for r in range(rounds):
        if r:
            shared, before = spark.sparkContext.broadcast((old, books)), state
            state = written(before.mapInArrow(again, schema), "bounds")
            discard(before)
        old, books = books, replaced(books, *_sums(state, books))
    shared = spark.sparkContext.broadcast((old, books))
    codes = written(state.mapInArrow(coded, result), "codes")
    discard(state)
    found = with_total(codes, "label", "error", "label_error", spread=("id", "code", "error"))
    return found.select(F.col("id").alias(id), "code", "error", "label_error"), books


def book_digest(books: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compressed(table(spark, sf_dir, "embeddings"))
    return found.withColumn("codebooks_sha256", F.lit(book_digest(books)))


def _sql(parts: int = PARTS, entries: int = ENTRIES, size: int = 64) -> str:
    """The same rounds with all distances."""
    width = size // parts
    square = " + ".join(f"(v[{i}] - c[{i}]) * (v[{i}] - c[{i}])" for i in range(1, width + 1))
    mean = ", ".join(f"(sum(v[{i}]) - ((sum(v[{i}]) % count(*)) + count(*)) % count(*)) // count(*)" for i in range(1, width + 1))
    rounds = ""
    for r in range(ROUNDS + 1):
        rounds += f""",
d{r} AS MATERIALIZED (SELECT id, b.p, min({{'d': {square}, 'e': e}}) AS m FROM parts b JOIN c{r} ON b.p = c{r}.p GROUP BY id, b.p)"""
        if r < ROUNDS:
            rounds += f""",
n{r} AS (SELECT b.p, m.e AS e, list_transform([{mean}], lambda x: CAST(x AS BIGINT)) AS c FROM parts b JOIN d{r} d ON d.id = b.id AND d.p = b.p GROUP BY b.p, m.e),
c{r + 1} AS MATERIALIZED (SELECT c{r}.p, c{r}.e, coalesce(n.c, c{r}.c) AS c FROM c{r} LEFT JOIN n{r} n ON n.p = c{r}.p AND n.e = c{r}.e)"""
    return f"""WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT id, p, x[p * {width} + 1:p * {width} + {width}] AS v FROM kept, (SELECT unnest(range(0, {parts})) AS p)),
c0 AS MATERIALIZED (SELECT p, id AS e, v AS c FROM parts WHERE id < {entries}){rounds},
coded AS (SELECT id, string_agg(printf('%02x', CAST(m.e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM d{ROUNDS} GROUP BY id),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS digest FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT digest FROM book) AS codebooks_sha256 FROM kept JOIN coded USING (id)"""


QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLE_SQL = {"op13_vector_codes": _sql()}
