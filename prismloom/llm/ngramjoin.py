"""Near duplicates: a join of documents on the Jaccard similarity of their five-word shingles.

Documents with the same set of shingles are one class, so copies cost one row. Classes whose MinHash values
agree on all hashes of a band meet in a bucket. Pairs in a bucket are compared in blocks, hash by hash: after
every few, those are dropped whose posterior probability of reaching the threshold, given the values that
agree so far, falls below a tolerance. What is left is verified exactly on the sets of shingles. A
pair counts in the first band that brings it together only. Pairs never become rows: a block gives
each of its classes the number of links found and the least class it hangs on, so a group of n near copies
costs rows in proportion to n and its blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismloom.llm.components import components
from prismloom.llm.links import LINKS, SCHEMA, linked
from prismloom.llm.storage import row_key, table, written
from prismloom.llm.words import mix, shingles, slices, words_of

SHINGLE, THRESHOLD = 5, 0.8
#: 25 bands of 5 hashes: a pair at the threshold meets with probability 0.99995.
BANDS, BAND_ROWS = 25, 5
#: Hashes compared between two looks at the posterior, and the probability under which a pair is dropped.
STEP, TOLERANCE = 25, 1e-6
#: Classes of a block, and bytes of their texts; a task compares two blocks at a time. A bucket of n classes takes
#: n * n / BLOCK rows, so blocks are as large as a task's memory bears.
BLOCK, BLOCK_BYTES = 640, 24 << 20
_HASHES = BANDS * BAND_ROWS
_rng = np.random.default_rng(77)
_FACTORS = _rng.integers(0, 1 << 31, _HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _rng.integers(0, 1 << 32, _HASHES, dtype=np.uint32)


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Of each text the sorted distinct shingle hashes; a text of fewer words is one shingle, one without words has none."""
    words = words_of(texts)
    hashes = words.hashes()
    grams, _ = shingles(hashes, words.first, shingle)
    out = []
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        n = hi - lo
        if n >= shingle:
            out.append(np.unique(grams[lo : hi - shingle + 1]))
        elif n:
            out.append(shingles(hashes[lo:hi], np.array([0, n]), n)[0][:1])
        else:
            out.append(hashes[:0])
    return out


def signature(grams: np.ndarray) -> np.ndarray:
    """MinHash values of a set."""
    low, out = (grams >> np.uint64(32)).astype(np.uint32), None
    for i in range(0, len(low), 4096):
        least = (_FACTORS[:, None] * low[None, i : i + 4096] + _TERMS[:, None]).min(axis=1)
        out = least if out is None else np.minimum(out, least)
    return out


@lru_cache
def least_agreeing(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(hashes compared, values that must agree by then) at each look.

    Of a value 8 bits are compared, so two values agree with probability p = s + (1 - s) / 256 at similarity
    s. With all p equally likely beforehand, m of n agreeing gives P(p >= t) = P(Binomial(n + 1, t) <= m).
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(STEP, _HASHES + 1, STEP):
        chance, m = (1 - t) ** (n + 1), 0
        while chance < tolerance:
            m += 1
            chance += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def surviving_pairs(bands: np.ndarray, values: np.ndarray, band: int, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the given ones that this band is the first to bring together and that pruning leaves."""
    # Only pairs of one bucket come here, so all share this band's value.
    for j in range(band):
        new = bands[left, j] != bands[right, j]
        left, right = left[new], right[new]
    agree, at = np.zeros(len(left), dtype=np.int32), 0
    for n, m in least_agreeing(threshold, tolerance):
        agree += (values[left, at:n] == values[right, at:n]).sum(axis=1, dtype=np.int32)
        keep = agree >= m
        left, right, agree, at = left[keep], right[keep], agree[keep], n
    return left, right


def jaccard(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact similarities of pairs of sets, by products of columns of their incidence matrix."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, code = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    both, width = np.zeros((len(sets), len(sets))), max(1, 4_000_000 // len(sets))
    for lo in range(0, int(code[-1]) + 1, width):
        a, b = np.searchsorted(code, [lo, lo + width])
        part = np.zeros((len(sets), min(width, int(code[-1]) + 1 - lo)), dtype=np.float32)
        part[owner[a:b], code[a:b] - lo] = 1
        both += part @ part.T
    common = both[left, right]
    return common / (sizes[left] + sizes[right] - common)


def signed(docs: DataFrame, id: str, text: str, shingle: int) -> DataFrame:
    """(row, id, text key, bytes, class, bands, values) of each document, written once.

    The class is a 128-bit sum over the set of shingles; a text without words has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            for piece in slices(batch, "text"):
                keys, bands, values = [], [], []
                known: dict[bytes, tuple] = {}
                for grams in shingle_sets(piece.column(4), shingle):
                    if not len(grams):
                        keys.append(None), bands.append(None), values.append(None)
                        continue
                    key = np.array([len(grams) + mix(grams).sum(), mix(grams ^ base).sum()], dtype=np.uint64).tobytes()
                    if key not in known:
                        mins = signature(grams)
                        run = np.zeros(BANDS, dtype=np.uint64)
                        for j in range(BAND_ROWS):
                            run = mix(run * base + mins[j::BAND_ROWS][:BANDS].astype(np.uint64) + np.uint64(1))
                        known[key] = run.view(np.int64).tobytes(), mix(mins.astype(np.uint64)).astype(np.uint8).tobytes()
                    keys.append(key), bands.append(known[key][0]), values.append(known[key][1])
                yield pa.RecordBatch.from_arrays([*piece.columns[:4], pa.array(keys, pa.binary()), pa.array(bands, pa.binary()), pa.array(values, pa.binary())], ["row", "id", "body", "bytes", "class", "bands", "mins"])

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("body"), F.octet_length(text).cast("bigint").alias("bytes"), F.col(text).alias("text"))
    return written(rows.mapInArrow(run, f"row bigint, id {kind}, body binary, bytes bigint, class binary, bands binary, mins binary"), "signed")


def _groups(classes: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """Blocks of the classes that meet in a band's bucket, in pairs: arrays of at most two blocks' classes.

    Buckets with the same classes as an earlier band's are left out: all their pairs met there.
    """
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.hex(F.substring(F.col("bands"), i * 8 + 1, 8)))).alias("band", "key")
    met = classes.select("class", "bytes", at).select("class", "bytes", "band", F.conv("key", 16, -10).cast("bigint").alias("key"))
    buckets = met.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("bytes").alias("total"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y")).where("n > 1")
    buckets = buckets.groupBy("n", "x", "y").agg(F.min(F.struct("band", "key", "total")).alias("b")).select("b.band", "b.key", "b.total", "n")
    inside = written(met.drop("bytes").join(buckets, ["band", "key"]), "met")
    blocks = F.greatest(F.ceil(F.col("n") / block), F.least(F.col("n"), F.ceil(F.col("total") / block_bytes))).cast("int")
    inside = inside.withColumn("own", F.pmod(F.xxhash64("class", "band"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = inside.join(classes.select("class", "n_docs", "bands", "mins"), "class")
    pair = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    return rows.groupBy("band", "key", *pair).agg(F.collect_list(F.struct(F.col("own"), "class", "n_docs", "bands", "mins")).alias("c")).where(F.size("c") > 1)


def _prune(groups: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(group, members, left, right): pairs that pruning leaves, as places in the members."""
    member = pa.struct([("pos", pa.int32()), ("class", pa.binary()), ("n_docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for band, key, i, j, c in zip(*(batch.column(n) for n in ("band", "key", "i", "j", "c")), strict=True):
                all_of = c.values
                own = np.asarray(all_of.field("own"))
                keys = all_of.field("class").to_pylist()
                stack = lambda name, kind: np.frombuffer(b"".join(all_of.field(name).to_pylist()), dtype=kind).reshape(len(own), -1)  # noqa: B023, E731
                i, j = i.as_py(), j.as_py()
                if i == j:
                    left, right = np.triu_indices(len(own), 1)
                else:
                    left, right = (x.ravel() for x in np.meshgrid(np.flatnonzero(own == i), np.flatnonzero(own == j), indexing="ij"))
                left, right = surviving_pairs(stack("bands", np.int64), stack("mins", np.uint8), band.as_py(), left, right, threshold, tolerance)
                if not len(left):
                    continue
                used, both = np.unique(np.concatenate([left, right]), return_inverse=True)
                n_docs = np.asarray(all_of.field("n_docs"))
                out.append({"group": f"{band}.{key}.{i}.{j}", "members": [{"pos": p, "class": keys[u], "n_docs": int(n_docs[u])} for p, u in enumerate(used.tolist())], "left": both[: len(left)].tolist(), "right": both[len(left) :].tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("group", pa.string()), ("members", pa.list_(member)), ("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32()))])
    return groups.mapInArrow(run, "group string, members array<struct<pos: int, class: binary, n_docs: bigint>>, left array<int>, right array<int>")


def _verify(found: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(class, n, hangs_on): exact links of the pairs left, summed by class within a group.

    ``hangs_on`` is the least class that a class reaches through links within the group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for members, left, right, texts in zip(*(batch.column(n) for n in ("members", "left", "right", "texts")), strict=True):
                at = np.argsort(np.asarray(texts.values.field("pos")))
                sets = shingle_sets(texts.values.field("text").take(pa.array(at)), shingle)
                left, right = np.asarray(left.values), np.asarray(right.values)
                close = jaccard(sets, left, right) >= threshold
                left, right = left[close], right[close]
                if not len(left):
                    continue
                own = members.values
                out += linked(own.field("class").to_pylist(), np.asarray(own.field("n_docs")), left, right)
            yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    needed = found.select("group", F.explode("members").alias("m")).select("group", "m.pos", "m.class")
    gathered = needed.join(texts, "class").groupBy("group").agg(F.collect_list(F.struct("pos", "text")).alias("texts"))
    return found.join(gathered, "group").select("members", "left", "right", "texts").mapInArrow(run, LINKS).withColumnRenamed("node", "class")


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, body, n_links, class_id, kept), a row a document.

    ``n_links`` counts the other documents at the threshold or above, copies included. ``class_id`` is the
    least id reachable by links, and one document of each class is kept: the one with that id, of several
    the first read. A null id comes after all others. Null texts and texts without words link with
    nothing; fewer words than a shingle count as one shingle. ``body`` is the MD5 digest of the text.
    Other columns, whatever their names, are left out; an empty table gives no rows.
    """
    rows = signed(docs, id, text, shingle)
    place = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("row"))
    whole = rows.where(F.col("class").isNotNull())
    classes = written(whole.groupBy("class").agg(F.count("*").alias("n_docs"), F.min(place).alias("first"), F.min("body").alias("body"), F.max("bytes").alias("bytes"), F.any_value("bands").alias("bands"), F.any_value("mins").alias("mins")), "classes")
    found = written(_prune(_groups(classes, block, block_bytes), threshold, tolerance), "pairs")
    wanted = found.select(F.explode("members.class").alias("class")).distinct().join(classes.select("class", "body"), "class")
    bodies = docs.select(F.unhex(F.md5(F.col(text).cast("binary"))).alias("body"), F.col(text).alias("text")).where("text IS NOT NULL")
    # Copies of a text meet in partial aggregates before the shuffle.
    texts = bodies.join(wanted, "body").groupBy("class").agg(F.any_value("text").alias("text"))
    links = written(_verify(found, texts, shingle, threshold), "links")
    named = components(links, "class", "hangs_on").withColumnRenamed("node", "class")
    named = written(named, "components")
    least = named.join(classes.select("class", "first"), "class").groupBy("component").agg(F.min("first").alias("least"))
    by_class = classes.select("class", "n_docs", "first").join(links.groupBy("class").agg(F.sum("n").alias("n")), "class", "left").join(named.join(least, "component").select("class", "least"), "class", "left")
    by_class = by_class.select("class", (F.col("n_docs") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("least", "first").alias("least"))
    out = rows.select("row", "id", "body", "class").join(by_class, "class", "left")
    alone: Column = F.col("least").isNull()
    return out.select(F.col("id").alias(id), "body", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(alone, F.col("id")).otherwise(F.col("least.id")).alias("class_id"), (alone | (F.col("least.row") == F.col("row"))).alias("kept"))


def deduplicated(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, with all their columns.

    Documents without words are all kept; of rows alike in id and text one stays.
    """
    own = [f"_{i}" for i in range(len(docs.columns))]
    at_id, at_text = own[docs.columns.index(id)], own[docs.columns.index(text)]
    rows = docs.toDF(*own)
    found = near_duplicates(rows.select(F.col(at_id).alias("id"), F.col(at_text).alias("text")), id="id", **how)
    body = lambda c: F.unhex(F.md5(c.cast("binary")))
    kept = found.where("kept").select(row_key(F.col("id"), F.hex("body")).alias("key"))
    keyed = rows.withColumn("key", row_key(F.col(at_id), F.hex(body(F.col(at_text)))))
    # The window needs no exchange of its own: the join has brought rows of a key together.
    numbered = keyed.join(kept, "key", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("key")))
    wordless = ~F.coalesce(F.col(at_text).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), F.lit(False))
    return numbered.where((F.col("n") == 1) | wordless).select(*own).toDF(*docs.columns)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("body")


QUERIES = {"op10_ngram_join": op10_ngram_join}
ORACLE_SQL = {}
