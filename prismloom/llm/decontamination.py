"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item becomes windows of 13 consecutive words (an item of fewer words is one window).
A window is the set of its five-word shingles with their places. To hold a window, a document must
hold all its shingles, so by the prefix principle it is enough to look for one: the one that is rarest
in the documents, which keeps candidates few. Candidates then pass length and positional bounds (the
window must fit into the document at the place that the shingle's offset gives), and at last the words
themselves are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismloom.llm.storage import cut, table
from prismloom.llm.words import shingles, slices, words_of

#: Words of a window, words of a shingle.
WINDOW, SHINGLE = 13, 5
#: Shingles of the benchmark that one pass over the documents looks for; a larger benchmark takes
#: more passes, a block of its windows each, so the broadcast stays within 16 MB at any size.
MAX_INDEX = 2_000_000
#: Bytes of windows, or of their items, that are broadcast at most; beyond, tasks that a frequent one is dealt to.
MOST_BROADCAST, SLOTS = 64 << 20, 16


def item_windows(items: DataFrame, text: str, window: int, shingle: int) -> DataFrame:
    """(item, win, n, k, words, shingles): the windows of every item, with hashes of their shingles. ``win`` tells windows apart by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(batch.column(1))
            hashes, rows = words.hashes(), []
            by_size = {}
            for item, lo, hi in zip(batch.column(0).to_pylist(), words.first[:-1], words.first[1:], strict=True):
                n = min(window, int(hi - lo))
                if item is None or not n:
                    continue
                k = min(shingle, n)
                if k not in by_size:
                    by_size[k] = shingles(hashes, words.first, k)[0].view(np.int64)
                rows += [(item, n, k, words.text(lo + w, lo + w + n), by_size[k][lo + w : lo + w + n - k + 1].tolist()) for w in range(int(hi - lo) - n + 1)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    schema = pa.schema([("item", pa.string()), ("n", pa.int32()), ("k", pa.int32()), ("words", pa.string()), ("shingles", pa.list_(pa.int64()))])
    found = items.select(F.col("item").cast("string"), F.col(text)).mapInArrow(run, "item string, n int, k int, words string, shingles array<bigint>")
    return found.withColumn("win", F.unhex(F.sha2("words", 256)))


def _found(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted wanted ones."""
    if not len(wanted):
        return np.zeros(len(values), dtype=bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def shingle_counts(docs: DataFrame, text: str, sizes: list[int], wanted) -> DataFrame:
    """(shingle, n): how often each wanted shingle occurs in the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = []
            for piece in slices(batch, text):
                words = words_of(piece.column(0))
                hashes = words.hashes()
                for k in sizes:
                    grams, whole = shingles(hashes, words.first, k)
                    grams = grams.view(np.int64)[whole]
                    seen.append(grams[_found(grams, wanted.value)])
            found, n = np.unique(np.concatenate(seen or [np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["shingle", "n"])

    return docs.select(text).mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))


def shingle_places(docs: DataFrame, keys: list[str], text: str, sizes: list[int], window: int, wanted, heads: bool) -> DataFrame:
    """Each document with its number of words and the places of the wanted shingles.

    A place has the words about it, as far as a window with the shingle could reach. With ``heads`` each document has one
    more place without a shingle before its others.
    """
    head = [dict.fromkeys(("shingle", "pos", "lo", "near"))] if heads else []
    place = pa.struct([("shingle", pa.int64()), ("pos", pa.int32()), ("lo", pa.int32()), ("near", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text):
                words = words_of(piece.column(len(keys)))
                hashes, found = words.hashes(), [[*head] for _ in range(len(piece))]
                for k in sizes:
                    grams, whole = shingles(hashes, words.first, k)
                    grams = grams.view(np.int64)
                    at = np.flatnonzero(whole & _found(grams, wanted.value))
                    for i, doc in zip(at.tolist(), (np.searchsorted(words.first, at, side="right") - 1).tolist(), strict=True):
                        first, last = int(words.first[doc]), int(words.first[doc + 1])
                        lo, hi = max(first, i - window + 1), min(last, i + window)
                        found[doc].append({"shingle": int(grams[i]), "pos": i - first, "lo": lo - first, "near": words.text(lo, hi)})
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(keys)], pa.array(words.counts(), pa.int64()), pa.array(found, pa.list_(place))], [*keys, "n_words", "places"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n_words bigint, places array<struct<shingle: bigint, pos: int, lo: int, near: string>>"
    return docs.select(*keys, text).mapInArrow(run, schema)


def covered(spans: Column) -> Column:
    """Of an array of (start, end) structs, how many places lie in one or more of them."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["end"]))).cast("bigint").alias("n"), F.greatest(a["end"], x["end"]).alias("end"))
    return F.aggregate(F.array_sort(spans), start, step, lambda a: a["n"])


def beside(rows: DataFrame, small: DataFrame, key: str, most: int) -> DataFrame:
    """Rows left joined by key to a checkpointed table, whose bytes are counted: up to ``most`` it is broadcast.

    Beyond that both are exchanged; rows of a frequent key are dealt to SLOTS tasks by their uid, those without a key to all tasks.
    """
    sizes = [F.octet_length(F.col(c)) if t in ("string", "binary") else F.lit(8) for c, t in small.dtypes]
    size = small.agg(F.coalesce(F.sum(F.lit(32) + sum(sizes, F.lit(0))), F.lit(0)).alias("n")).first()["n"]
    if size <= most:
        return rows.join(F.broadcast(small), key, "left")
    by = F.xxhash64("uid")
    dealt = rows.withColumn("_slot", F.when(F.col(key).isNull(), by).otherwise(F.pmod(by, F.lit(SLOTS))))
    spread = small.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1)))).withColumn("_slot", F.col("_slot").cast("bigint"))
    return dealt.join(spread, [key, "_slot"], "left").drop("_slot")


def distinct_windows(items: DataFrame, item: str, text: str, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(win, n, k, words, shingles, owners) of each window once, and (owners, item): the items of windows with that mark.

    Windows that the same items have share the mark, made of the number of the items and two sums of their hashes; so
    a passage of many items meets documents once, and its items a document once, not once for each word of it.
    """
    every = item_windows(items.select(F.col(item).alias("item"), F.col(text).alias("body")), "body", window, shingle)
    every = cut(every.dropDuplicates(["item", "win"]))
    mark = F.concat_ws(":", F.count("*"), F.bit_xor(F.xxhash64("item")), F.bit_xor(F.xxhash64("item", F.lit(1))))
    marks = cut(every.groupBy("win").agg(mark.alias("owners")))
    windows = cut(every.drop("item").dropDuplicates(["win"]).join(marks, "win"))
    return windows, cut(every.select("win", "item").join(marks, "win").select("owners", "item").distinct())


def decontaminate(docs: DataFrame, items: DataFrame, *, keys: list[str], text: str = "text", item: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE, max_index: int = MAX_INDEX, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Each document's keys, with n_words, n_hit, n_items, items and contaminated.

    ``n_hit`` counts words inside any occurrence of a window, ``items`` are the ids (as sorted strings)
    of the items with a window in the document, and a document is contaminated if a twentieth of its
    words or more are hit. Null and empty texts have no words and hold nothing; items without words, or
    with a null id, have no windows; rows with the same id are one item; repeated documents each give a row, and items with the same text
    are all reported. Other columns, whatever their names, are ignored; an empty benchmark or an empty
    table of documents gives zero counts or no rows. Very long texts are one row each; their words, hashes and places are
    held by one task at a time.
    """
    spark = docs.sparkSession
    own = [f"key_{i}" for i in range(len(keys))]
    docs = docs.select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), F.col(text).alias("body"))
    # Rows are told apart by what they hold, so that each pass, and a task that runs again, names them alike.
    part = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit("+"), c.cast("string")), F.lit("-"))
    docs = docs.withColumn("uid", F.unhex(F.md5(F.concat(*(part(F.col(c)) for c in (*own, "body"))).cast("binary"))))
    windows, owners = distinct_windows(items, item, text, window, shingle)
    summary = windows.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0)).alias("n"), F.collect_set("k").alias("sizes")).first()
    sizes, blocks = sorted(summary["sizes"]), max(1, -(-summary["n"] // max_index))
    carried, hits = [*own, "uid"], []
    for block in range(blocks):
        some = windows.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == block) if blocks > 1 else windows
        grams = some.select("win", F.posexplode("shingles").alias("offset", "shingle"))
        index = lambda df: np.sort(np.array([r[0] for r in df.select("shingle").distinct().collect()], dtype=np.int64))  # noqa: E731  a block's, about max_index
        wanted = spark.sparkContext.broadcast(index(grams))
        counts = shingle_counts(docs, "body", sizes, wanted)
        # An inner join: a window with a shingle that no document has occurs nowhere.
        rarest = grams.join(counts, "shingle").groupBy("win").agg(F.count("*").alias("present"), F.min_by(F.struct("offset", "shingle"), F.struct("n", "shingle", "offset")).alias("r"))
        prefix = cut(some.join(rarest, "win").where(F.col("present") == F.size("shingles")).select("n", "words", "owners", "r.offset", "r.shingle"))
        places = shingle_places(docs, carried, "body", sizes, window, spark.sparkContext.broadcast(index(prefix)), heads=block == 0)
        places = places.select(*carried, "n_words", F.explode("places").alias("p")).select(*carried, "n_words", "p.*")
        start = F.col("pos") - F.col("offset")
        fits = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
        same = F.array_join(F.slice(F.split("near", " "), F.greatest(start - F.col("lo"), F.lit(0)) + 1, F.col("n")), " ") == F.col("words")
        hit = F.when(F.col("words").isNotNull() & fits & same, F.struct(start.alias("start"), (start + F.col("n")).alias("end")))
        found = beside(places, prefix, "shingle", most_broadcast)
        hits.append(found.select(*carried, "n_words", F.col("pos").isNull().alias("head"), hit.alias("span"), F.when(hit.isNotNull(), F.col("owners")).alias("owners")).where("head OR span IS NOT NULL"))
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    alike = [*(F.any_value(o).alias(o) for o in own), F.any_value("n_words").alias("n_words")]
    by_doc = found.groupBy("uid").agg(*alike, F.count_if("head").alias("copies"), covered(F.collect_set("span")).alias("n_hit"), F.collect_set("owners").alias("all"))
    by_doc = beside(by_doc.withColumn("owners", F.explode_outer("all")).drop("all"), owners, "owners", most_broadcast)
    by_doc = by_doc.groupBy("uid").agg(*alike, F.any_value("copies").alias("copies"), F.any_value("n_hit").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    rows = by_doc.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*(F.col(o).alias(k) for k, o in zip(keys, own, strict=True)), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keys=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op1_decontamination": op1_decontamination}

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = {
    "op1_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
b2 AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b2)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT uid, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
          FROM (SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT uid, g.n, i, item FROM grams g JOIN win USING (n, k)),
hit_words AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY uid),
hit_items AS (SELECT uid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (uid) LEFT JOIN hit_items USING (uid)"""
}
