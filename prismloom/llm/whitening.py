"""Whitening of vectors with an exact scatter matrix from residues.

Vectors count as integers. Every task reduces its distinct vectors modulo several primes and multiplies the residues as
matrices of doubles, in blocks small enough that no sum passes 2 ** 53; products are reduced and added modulo
each prime, and Spark adds up what tasks send: a row for each prime and component. From the sums modulo all
primes, the Chinese remainder theorem gives the exact scatter matrix, with the number of vectors and the sums of
components in its border, however many vectors there are and in whatever order they come. The covariance is that of
integers divided once, its eigenvectors those of one symmetric matrix in doubles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismloom.llm.storage import table, written
from prismloom.llm.vectors import common_size, steps, usable

#: Bits of a prime, and rows of a block: 2 ** (2 * 20 + 12) is below 2 ** 53.
PRIME_BITS, BLOCK = 20, 4096
COMPONENTS = 4
#: A component's variance counts as none below this share of the greatest for each dimension.
NONE = 1e-14


def primes(product: int) -> list[int]:
    """The greatest primes of PRIME_BITS bits, as many as it takes for their product to exceed a number."""
    found, whole, at = [], 1, (1 << PRIME_BITS) - 1
    while whole <= product:
        if all(at % d for d in range(3, isqrt(at) + 1, 2)):
            found.append(at)
            whole *= at
        at -= 2
    return found


def residue_scatter(x: np.ndarray, moduli: list[int]) -> np.ndarray:
    """(prime, i, j): sums of products of the columns of integers, modulo each prime."""
    out = np.zeros((len(moduli), x.shape[1], x.shape[1]), dtype=np.int64)
    for lo in range(0, len(x), BLOCK):
        for k, p in enumerate(moduli):
            r = np.mod(x[lo : lo + BLOCK], p).astype(np.float64)
            out[k] = (out[k] + np.mod(r.T @ r, p).astype(np.int64)) % p
    return out


def remaindered(residues: list[int], moduli: list[int]) -> int:
    """The number nearest to 0 with these residues."""
    whole, value = 1, 0
    for r, p in zip(residues, moduli, strict=True):
        value += whole * ((r - value) * pow(whole, -1, p) % p)
        whole *= p
    return value - whole if 2 * value > whole else value


@dataclass
class Whitening:
    """Exact number and sums of the fit list, and components with their scale and share of the variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    scales: np.ndarray
    shares: np.ndarray

    @classmethod
    def of(cls, scatter: list[list[int]], k: int = COMPONENTS) -> Whitening:
        """From the exact scatter of (1, components)."""
        n, sums = scatter[0][0], scatter[0][1:]
        # Quotients of integers are rounded once, however large the integers are.
        cov = np.array([[(n * m - sums[i] * sums[j]) / (n * n) for j, m in enumerate(line[1:])] for i, line in enumerate(scatter[1:])])
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(values, kind="stable")[::-1][:k]
        least = max(float(values.max()), 0.0) * NONE * len(values)
        there = values[order] > least
        scales = np.where(there, np.sqrt(np.where(there, values[order], 1.0)), np.nan)
        trace = float(np.trace(cov))
        return cls(n, sums, vectors[:, order].T.copy(), scales, np.where(there, values[order] / trace if trace > 0 else 0.0, 0.0))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """(row, component): centred integers on the components, in units of their deviation."""
        mean = np.array([s // self.n for s in self.sums])
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return ((x - mean) - rest) @ self.components.T / self.scales

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over components of (n * x - sums) ** 2, exactly."""
        n, within = self.n, sum(s * s for s in self.sums)
        most = int(np.abs(x).max(initial=0))
        fits = most * sum(map(abs, self.sums)) < 1 << 63
        along = x @ np.array(self.sums, dtype=np.int64 if fits else object)
        own = (x * x).sum(axis=1)  # at most 2 ** 50 a component
        return [n * n * a - 2 * n * b + within for a, b in zip(own.tolist(), along.tolist(), strict=True)]


def _int64(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int64).reshape(len(column), size)


def exact_scatter(distinct: DataFrame, size: int) -> list[list[int]]:
    """The scatter of (1, components) over integer vectors of a size, as blobs of 64-bit integers."""

    def greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64()), pa.array([int(np.abs(_int64(batch.column(0), size)).max(initial=0))], pa.int64())], ["n", "most"])

    n, most = distinct.select("x").mapInArrow(greatest, "n bigint, most bigint").agg(F.sum("n"), F.max("most")).first()
    moduli = primes(2 * (n or 0) * max(most or 0, 1) ** 2 + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((len(moduli), size + 1, size + 1), dtype=np.int64)
        for batch in batches:
            x = _int64(batch.column(0), size)
            own = (own + residue_scatter(np.hstack([np.ones((len(x), 1), np.int64), x]), moduli)) % np.array(moduli)[:, None, None]
        k, i = np.indices(own.shape[:2])
        lists = pa.ListArray.from_arrays(np.arange(k.size + 1, dtype=np.int32) * (size + 1), pa.array(own.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(k.ravel().astype(np.int32)), pa.array(i.ravel().astype(np.int32)), lists], ["k", "i", "part"])

    sent = distinct.select("x").mapInArrow(run, "k int, i int, part array<bigint>")
    total = sent.groupBy("k", "i").agg(F.array(*(F.sum(F.col("part")[j]) for j in range(size + 1))).alias("part")).collect()  # a row a prime and component
    residues = {(r["k"], r["i"]): r["part"] for r in total}
    return [[remaindered([residues[k, i][j] % p for k, p in enumerate(moduli)], moduli) for j in range(size + 1)] for i in range(size + 1)]


def _identity_error(distinct: DataFrame, size: int, model: Whitening) -> float | None:
    """The largest absolute entry of the covariance of the scores minus the identity, of the components that vary."""
    there = np.flatnonzero(~np.isnan(model.scales))
    if not len(there):
        return None
    k = len(there)

    def sums(centre: np.ndarray, powers: bool) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                w = model.scores(_int64(batch.column(0), size))[:, there] - centre
                found = (w.T @ w).ravel() if powers else w.sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([found], pa.list_(pa.float64()))], ["s"])

        width = k * k if powers else k
        return np.array(distinct.select("x").mapInArrow(run, "s array<double>").agg(*(F.sum(F.col("s")[i]) for i in range(width))).first(), dtype=np.float64) / model.n

    mean = sums(np.zeros(k), False)
    return float(np.abs(sums(mean, True).reshape(k, k) - np.eye(k)).max())


def whitened(vectors: DataFrame, *, id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error, deviation_exact), a row for each usable vector and component.

    Vectors that are null, empty, or hold null or non-finite components are dropped. Components count in 256ths, rounded down; they
    must lie within 131072, and vectors must have one length, or ValueError is raised. Covariances are over distinct integer vectors, so
    copies don't weigh; every row, copies too, has its rows of results. ``deviation`` is null where it passes 64 bits, which
    ``deviation_exact`` (38 digits) holds. A component without variance has null for ``whitened`` and 0 for
    ``explained``, and doesn't count in ``identity_error``, which is null if none has any. Vectors of fewer dimensions have fewer
    components. Other columns are left out, whatever their names; an empty table gives no rows.
    """
    rows = vectors.where(usable(F.col(embedding))).select(F.col(id).alias("id"), F.col(embedding).cast("array<double>").alias("vector"))
    size, spark = common_size(rows, "vector"), rows.sparkSession
    kind = rows.schema["id"].dataType.simpleString()
    result = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, deviation_exact decimal(38,0)"
    if not size:
        return spark.createDataFrame([], result + ", identity_error double").withColumnRenamed("id", id)

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in steps(batch.column(0))], pa.binary())], ["x"])

    distinct = written(rows.select("vector").mapInArrow(stepped, "x binary").distinct(), "distinct")
    model = Whitening.of(exact_scatter(distinct, size), components)
    error = _identity_error(distinct, size, model)
    shared, k = spark.sparkContext.broadcast(model), len(model.components)  # some vectors of one dimension
    arrow = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x = steps(batch.column(1))
            far = [d for d in model.deviations(x) for _ in range(k)]
            near = [d if d < 1 << 63 else None for d in far]
            at = pa.array(np.repeat(np.arange(len(batch)), k))
            scores = pa.array(model.scores(x).ravel(), from_pandas=True)  # NaN stands for none
            columns = [batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch))), pa.array([model.n] * len(far), pa.int64()), pa.array(near, pa.int64()), scores, pa.array(np.tile(model.shares, len(batch))), pa.array(far, arrow)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "deviation_exact"])

    found = rows.mapInArrow(run, result)
    return found.withColumn("identity_error", F.lit(error).cast("double")).withColumnRenamed("id", id)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}
#: Eigenvectors are beyond SQL; tests hold the result against numpy with whole integers.
ORACLE_SQL: dict[str, str] = {}
