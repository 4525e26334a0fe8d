"""Shards of near equal bytes, by histogram sort.

Rows are ordered by (hash of the text, hash of the id): equal texts stand together, yet a group of copies
of any size can be cut. Splitters of that order are sought by counting: every round counts, over all
partitions, the exact bytes between candidate boundaries; each splitter's bracket shrinks to the two
candidates about its target, and new candidates are spread between the smallest and the largest key seen
in it. When all splitters are within the tolerance, rows are exchanged once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismloom.llm.storage import table, written

SHARDS = 40
#: Bytes counted for a row besides its text.
ROW_BYTES = 16
#: Share of a shard's bytes by which a splitter may miss its target.
TOLERANCE = 0.0005
#: Candidates between the ends of a bracket, each round.
PROBES = 12
#: Bytes of a cell, the part of a shard that one task sorts; cells bound a task's memory at any shard size.
CELL_BYTES = 1 << 30
_SPAN = 1 << 64
_HALF = 1 << 63


@dataclass
class Bin:
    """What lies between two neighbouring candidates."""

    size: int = 0
    rows: int = 0
    least: int | None = None
    most: int | None = None


def _key(first: int, second: int) -> int:
    return (first + _HALF) * _SPAN + second + _HALF


def _columns(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([k // _SPAN - _HALF for k in keys], dtype=np.int64), np.array([k % _SPAN - _HALF for k in keys], dtype=np.int64)


def bins_of(first: np.ndarray, second: np.ndarray, at_first: np.ndarray, at_second: np.ndarray) -> np.ndarray:
    """For each key, how many of the sorted candidates are not above it."""
    low, high = np.searchsorted(at_first, first, side="left"), np.searchsorted(at_first, first, side="right")
    out, tied = low.copy(), np.flatnonzero(low < high)
    for lo in np.unique(low[tied]):
        rows = tied[low[tied] == lo]
        hi = high[rows[0]]
        out[rows] = lo + np.searchsorted(at_second[lo:hi], second[rows], side="right")
    return out


def histogram(keyed: DataFrame, probes: list[int]) -> list[Bin]:
    """Exact bytes, rows and extreme keys of the bins between candidates; a row a bin comes to the driver."""
    at = keyed.sparkSession.sparkContext.broadcast(_columns(probes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second, size = (np.asarray(c) for c in batch.columns)
            if not len(size):
                continue
            order = np.lexsort((second, first))
            first, second, size = first[order], second[order], size[order]
            bins = bins_of(first, second, *at.value)
            starts = np.flatnonzero(np.diff(bins, prepend=-1))
            ends = np.append(starts[1:], len(bins)) - 1
            columns = [bins[starts].astype(np.int64), np.add.reduceat(size, starts), ends - starts + 1, first[starts], second[starts], first[ends], second[ends]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["bin", "size", "n", "a1", "a2", "z1", "z2"])

    parts = keyed.select("k1", "k2", "size").mapInArrow(run, "bin bigint, size bigint, n bigint, a1 bigint, a2 bigint, z1 bigint, z2 bigint")
    found = parts.groupBy("bin").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.min(F.struct("a1", "a2")).alias("a"), F.max(F.struct("z1", "z2")).alias("z"))
    out = [Bin() for _ in range(len(probes) + 1)]
    for r in found.collect():
        out[r["bin"]] = Bin(r["size"], r["n"], _key(*r["a"]), _key(*r["z"]))
    return out


def splitters(keyed: DataFrame, targets: list[float], slack: float, probes: int = PROBES) -> list[int]:
    """For each target, ascending, a key with about so many bytes below it.

    A splitter is off by more than the slack only where one row alone is larger.
    """
    chosen: list[int | None] = [None] * len(targets)
    candidates: list[int] = [_SPAN * _SPAN * (j + 1) // (len(targets) * probes + 1) for j in range(len(targets) * probes)]
    while None in chosen:
        bins = histogram(keyed, candidates)
        below = np.cumsum([b.size for b in bins])  # of candidate i: below[i]
        brackets: set[tuple[int, int]] = set()
        for i, target in enumerate(targets):
            if chosen[i] is not None:
                continue
            at = min(int(np.searchsorted(below, target, side="right")), len(bins) - 1)  # the bin in which the target lies
            inside = bins[at]
            ends = [(0 if not at else candidates[at - 1], int(below[at]) - inside.size), (_SPAN * _SPAN - 1 if at == len(candidates) else candidates[at], int(below[at]))]
            if inside.least is not None and inside.least == inside.most:
                ends = [(inside.least, ends[0][1]), (inside.least + 1, ends[1][1])]
            key, size = min(ends, key=lambda e: abs(e[1] - target))
            if abs(size - target) <= slack or inside.least == inside.most:
                chosen[i] = key
            else:
                brackets.add((inside.least, inside.most))
        # The ends are candidates too, so the next bins lie within their brackets.
        candidates = sorted({x for least, most in brackets for x in (least, most, most + 1, *(least + (most - least) * (j + 1) // (probes + 1) for j in range(probes)))})
    return [int(c) for c in chosen]


def keyed(docs: DataFrame, id: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows with their order key, size and checksum, as a table that all rounds read."""
    body = F.coalesce(F.col(text), F.lit(""))
    # Rows alike in id and text are told apart by where they stand, so even they can be cut apart.
    rows = docs.withColumn("_at", F.monotonically_increasing_id())
    out = rows.select(F.col(id).alias("doc_id"), (F.octet_length(body) + F.lit(ROW_BYTES)).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("k1"), F.xxhash64(F.col(id), F.col("_at")).alias("k2"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(carry)))
    return written(out, "keyed")


def shard(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE, cell_bytes: int = CELL_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) and the columns to carry, a row for each.

    Law ``bytes``: each shard's bytes are within the tolerance of an equal share, or within the size of
    the one row that a boundary would have to cut. Slots count from 0 in each shard without gaps, in key
    order, so equal texts are neighbours. A null text has no bytes (and the empty text's checksum); null
    ids and repeated rows are placed like any others; an empty table gives no rows.
    """
    keys = keyed(docs, id, text, carry)
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    per_shard = max(1, -(-total // shards // cell_bytes))
    share = total / shards
    cuts = splitters(keys, [share * j for j in range(1, shards)], tolerance * share) if total else []
    if per_shard > 1:
        inner = splitters(keys, [share * (j + i / per_shard) for j in range(shards) for i in range(1, per_shard)], 0.1 * cell_bytes, 4)
    else:
        inner = []
    cells = sorted([*cuts, *inner])
    rows = [b.rows for b in histogram(keys, cells)]
    # A cell begins a shard where its lower boundary is one of the cuts; cuts at the same key leave shards empty.
    kinds = sorted([(c, 1) for c in cuts] + [(c, 0) for c in inner])
    shard_of, first_slot, now, slot = [], [], 0, 0
    for i, n in enumerate(rows):
        if i and kinds[i - 1][1]:
            now, slot = now + 1, 0
        shard_of.append(now)
        first_slot.append(slot)
        slot += n
    at = docs.sparkSession.sparkContext.broadcast((*_columns(cells), np.array(shard_of, dtype=np.int32), np.array(first_slot, dtype=np.int64)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, shard_of, first_slot = at.value
        for batch in batches:
            names = batch.schema.names
            cell = bins_of(np.asarray(batch.column(names.index("k1"))), np.asarray(batch.column(names.index("k2"))), first, second)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(shard_of[cell], pa.int32()), pa.array(first_slot[cell], pa.int64())], [*names, "cell", "shard", "start"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema), "cell int, shard int, start bigint"])
    in_order = F.row_number().over(Window.partitionBy("cell").orderBy("k1", "k2"))
    placed = keys.mapInArrow(place, schema).withColumn("slot", (F.col("start") + in_order - 1).cast("bigint"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *(F.col(f"_{i}").alias(c) for i, c in enumerate(carry)))


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """Writes the shards as folders of Parquet files, rows with their text in slot order within a cell."""
    shard(docs, carry=(how.get("text", "text"),), **how).write.partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


QUERIES = {"op6_sharding": op6_sharding}
ORACLE_SQL: dict[str, str] = {}
