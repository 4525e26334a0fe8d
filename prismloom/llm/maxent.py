"""A maximum-entropy language model with hashed n-gram and skip features and a class-factored softmax.

Texts are cut into tokens once: blocks of documents are written with their tokens as numbers into a list of the block's
distinct tokens, so what is counted and looked up is a row for each block and distinct token. The probability of a token is
that of its class, given what stands before it, times its own within the class. The classes' softmax
has a bias, and weights for hashes of the token before, of the one before that (a skip), and of both. Frequent tokens are classes of
their own; others fall into classes by their last characters, so tokens that were never seen have a class too. Within a class
probabilities are those of counts, with one unseen token.

Weights are trained in rounds: tasks work out gradients over their blocks for the documents of a round, as observed and
expected numbers, Spark adds them up by feature, and the driver, which holds nothing but the weights, takes a step. Each training document
belongs to one round. Scoring works in numpy batches of tokens.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismloom.llm.storage import table, tidied, written
from prismloom.llm.words import mix, slices

#: Bytes of text in a block, at least; a document is in one block.
BLOCK_BYTES = 6_000_000
#: Classes of single tokens, classes by last characters; buckets of features; rounds.
SINGLE, BY_ENDING, BUCKETS, ROUNDS = 16, 16, 4096, 4
#: Added to counts; added to the bound of the curvature of a weight; longest step of a weight; features of a token besides the bias.
ADDED, DAMPING, LONGEST, FEATURES = 0.1, 10.0, 2.0, 3
#: The token after a text; no word can be it.
END = "\n"
#: Tokens whose classes are scored at a time.
_WIDE = 16_384


def is_held_out(id: Column) -> Column:
    return F.crc32(id.cast("string").cast("binary")) % 10 == 0


def packed(codes: np.ndarray) -> bytes:
    """Numbers below 2 ** 31, all low bytes first, then the next; the high ones, mostly 0, take next to nothing once compressed."""
    return codes.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel().astype(np.int64)


def tokenized(batches: Iterator[pa.RecordBatch], block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """(id, held_out, round, text) to a row a block: ids, held_out, rounds, sizes in tokens, codes, tokens, and each one's count in training."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids, held, rounds, codes, n_bytes = [], [], [], [], 0

    def block() -> pa.RecordBatch:
        flat = np.concatenate(codes)
        sizes = np.array([len(c) for c in codes], np.int32)
        train = np.bincount(flat[np.repeat(~np.array(held), sizes)], minlength=len(numbers))
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        words = pa.array(list(numbers), pa.binary()).cast(pa.string())
        lists = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array([i.as_py() for i in ids], ids[0].type))
        return pa.RecordBatch.from_arrays([own, one(held, pa.bool_()), one(rounds, pa.int32()), one(sizes, pa.int32()), pa.array([packed(flat)], pa.binary()), lists, one(train, pa.int64())], ["ids", "held", "rounds", "sizes", "codes", "tokens", "train"])

    for batch in batches:
        for piece in slices(batch, "text"):
            for i, h, r, text in zip(piece.column(0), piece.column(1).to_pylist(), piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True):
                raw = (text or "").encode()
                # Bytes fold and split as ASCII does: A-Z, and space, tab, line feed, vertical tab, form feed and return.
                words = raw.lower().split()
                words.append(END.encode())
                codes.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                ids.append(i)
                held.append(h)
                rounds.append(r)
                n_bytes += len(raw) + 64
                if n_bytes >= block_bytes:
                    yield block()
                    numbers, ids, held, rounds, codes, n_bytes = defaultdict(count().__next__), [], [], [], [], 0
    if ids:
        yield block()


def endings(tokens: list[str]) -> np.ndarray:
    """A class in 0 to BY_ENDING - 1 by a token's last two characters."""
    return np.fromiter((zlib.crc32(t[-2:].encode()) for t in tokens), np.int64, len(tokens)) % BY_ENDING


def classes(tokens: list[str], single: dict[str, int]) -> np.ndarray:
    """Each token's class: the end of texts and frequent tokens first, then by endings."""
    found = endings(tokens) + len(single)
    for i, t in enumerate(tokens):
        if t in single:
            found[i] = single[t]
    return found


def token_hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))


def features(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(token, feature): buckets of the token before, of the one before that, and of both; 0 stands for what is before a text."""
    before = np.concatenate([[np.uint64(0)], hashes[:-1]])
    before[first] = 0
    skipped = np.concatenate([[np.uint64(0)], before[:-1]])
    skipped[first] = 0
    k = np.uint64
    mixed = np.stack([mix(before + k(1)), mix(skipped + k(2)), mix(mix(before + k(3)) + skipped)], axis=1)
    return (mixed % k(BUCKETS)).astype(np.int64)


def scores_of(buckets: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(token, class): scores of the classes, of which the greatest is 0."""
    scores = weights[buckets[:, 0]]
    for f in range(1, buckets.shape[1]):
        scores += weights[buckets[:, f]]
    scores += bias
    scores -= scores.max(axis=1, keepdims=True)
    return scores


def probabilities(buckets: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(token, class): the softmax."""
    p = scores_of(buckets, weights, bias)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p


def log_probability(buckets: np.ndarray, own: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each token's own class."""
    scores = scores_of(buckets, weights, bias)
    at = scores[np.arange(len(own)), own].astype(np.float64)
    np.exp(scores, out=scores)
    return at - np.log(scores.sum(axis=1, dtype=np.float64))


class Model:
    """Classes of tokens, their sums, and the weights."""

    def __init__(self, single: dict[str, int], n: int, distinct: int):
        self.single, self.n, self.distinct = single, n, distinct
        self.size = len(single) + BY_ENDING
        self.class_n, self.class_distinct = np.zeros(self.size), np.zeros(self.size)
        self.weights = np.zeros((BUCKETS, self.size), np.float32)

    @property
    def bias(self) -> np.ndarray:
        """Logarithms of the classes' shares, unseen tokens counted in."""
        own = self.class_n + ADDED * (self.class_distinct + 1)
        return np.log(own / own.sum()).astype(np.float32)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADDED) / (self.n + ADDED * (self.distinct + 1)))

    def within(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 of a token's probability within its class."""
        return np.log10((counts + ADDED) / (self.class_n[classes] + ADDED * (self.class_distinct[classes] + 1)))

    def step(self, observed: np.ndarray, expected: np.ndarray) -> None:
        """Weights climb by the gradient over a bound of the curvature, which the features of a token share.

        The gradient is what is observed minus what is expected; p * (1 - p), the curvature of a token, is at most p.
        """
        self.weights += np.clip((observed - expected) / (FEATURES * (expected + DAMPING)), -LONGEST, LONGEST).astype(np.float32)


def _block(sizes: pa.Scalar, codes: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(sizes.values).astype(np.int64), unpacked(codes.as_py())


def _gradients(blocks: DataFrame, shared, round: int) -> DataFrame:
    """(bucket, part): observed and expected numbers of tokens of each class with a feature, in a round's training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k, bias, any_row = model.size, model.bias, False
        observed, expected = np.zeros(BUCKETS * k), np.zeros((BUCKETS, k))
        for batch in batches:
            for held, rounds, sizes, codes, tokens in zip(*batch.columns, strict=True):
                sizes, codes = _block(sizes, codes)
                chosen = ~np.asarray(held.values) & (np.asarray(rounds.values) == round)
                codes, sizes = codes[np.repeat(chosen, sizes)], sizes[chosen]
                if not len(sizes):
                    continue
                any_row = True
                used, at = np.unique(codes, return_inverse=True)
                words = tokens.values.take(pa.array(used)).to_pylist()
                own, buckets = classes(words, model.single)[at], features(token_hashes(words)[at], np.cumsum(sizes) - sizes)
                for f in range(FEATURES):
                    observed += np.bincount(buckets[:, f] * k + own, minlength=BUCKETS * k)
                small = buckets.astype(np.uint16)  # sorted by radix
                for lo in range(0, len(own), _WIDE):
                    p = probabilities(buckets[lo : lo + _WIDE], model.weights, bias)
                    for f in range(FEATURES):
                        b = small[lo : lo + _WIDE, f]
                        order = np.argsort(b, kind="stable")
                        b = b[order]
                        starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
                        expected[b[starts]] += np.add.reduceat(p[order], starts, axis=0)
        if any_row:
            touched = np.flatnonzero(expected.any(axis=1))
            both = np.hstack([observed.reshape(BUCKETS, k), expected])[touched]
            lists = pa.ListArray.from_arrays(np.arange(len(touched) + 1, dtype=np.int32) * (2 * k), pa.array(both.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(touched.astype(np.int32)), lists], ["bucket", "part"])

    return blocks.select("held", "rounds", "sizes", "codes", "tokens").mapInArrow(run, "bucket int, part array<double>")


def _class_sums(vocabulary: DataFrame, model: Model) -> DataFrame:
    """(class, n, distinct): a row a class and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, distinct = np.zeros(model.size, np.int64), np.zeros(model.size, np.int64)
        for batch in batches:
            own = classes(batch.column(0).to_pylist(), model.single)
            np.add.at(n, own, np.asarray(batch.column(1)))
            distinct += np.bincount(own, minlength=model.size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(model.size, dtype=np.int32)), pa.array(n), pa.array(distinct)], ["class", "n", "distinct"])

    return vocabulary.select("token", "c").mapInArrow(run, "class int, n bigint, distinct bigint").groupBy("class").agg(F.sum("n").alias("n"), F.sum("distinct").alias("distinct"))


def blocks_of(docs: DataFrame, id: str, text: str, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of all documents, written once, with a number each."""
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.coalesce(is_held_out(F.col(id)), F.lit(False)).alias("held_out"), F.pmod(F.xxhash64(F.col(id), F.lit(7)), F.lit(rounds)).cast("int").alias("round"), F.col(text).alias("text"))
    schema = f"ids array<{kind}>, held array<boolean>, rounds array<int>, sizes array<int>, codes binary, tokens array<string>, train array<bigint>"
    return written(rows.mapInArrow(lambda batches: tokenized(batches, block_bytes), schema).withColumn("block", F.monotonically_increasing_id()), "blocks")


def trained(blocks: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model, and the counts (token, c) of all tokens in training."""
    counted = blocks.select(F.explode(F.arrays_zip("tokens", "train")).alias("t")).where("t.train > 0").groupBy(F.col("t.tokens").alias("token")).agg(F.sum("t.train").alias("c"))
    vocabulary = written(counted, "vocabulary")
    n, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = vocabulary.where(F.col("token") != END).orderBy(F.desc("c"), "token").limit(SINGLE - 1).collect()
    model = Model({END: 0} | {r["token"]: i for i, r in enumerate(frequent, 1)}, n, distinct)
    for r in _class_sums(vocabulary, model).collect():  # a row a class
        model.class_n[r["class"]], model.class_distinct[r["class"]] = r["n"], r["distinct"]
    for round in range(rounds if n else 0):
        shared = blocks.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights a class
        sent = _gradients(blocks, shared, round)
        with tidied(blocks.sparkSession):
            total = sent.groupBy("bucket").agg(F.array(*(F.sum(F.col("part")[j]) for j in range(2 * model.size))).alias("part")).collect()  # a row a bucket
        both = np.zeros((BUCKETS, 2 * model.size))
        for r in total:
            both[r["bucket"]] = r["part"]
        model.step(both[:, : model.size], both[:, model.size :])
        shared.unpersist()
    return model, vocabulary


def scored(docs: DataFrame, *, id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row a document.

    Learns from documents whose crc32(id as text) mod 10 isn't 0, and those with a null id, with all their tokens, whatever their length; repeated rows
    count as often as they stand there. ``base_score`` and ``score`` are log10 probabilities of the text by counts of
    tokens and by the model. A null text is an empty one, of which only the end counts. Other columns are left out, whatever their names; an
    empty table gives no rows. Where there is nothing to learn from, all tokens are unknown and ``train_tokens`` is 0.
    """
    blocks = blocks_of(docs, id, text, rounds, block_bytes)
    kind = docs.schema[id].dataType.simpleString()
    model, vocabulary = trained(blocks, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    asked = blocks.select("block", F.posexplode("tokens").alias("at", "token"))
    known = asked.join(vocabulary, "token").groupBy("block").agg(F.collect_list("at").alias("at"), F.collect_list("c").alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        bias = model.bias
        for batch in batches:
            for ids, held, sizes, codes, tokens, at, c in zip(*batch.columns, strict=True):
                sizes, codes = _block(sizes, codes)
                words = tokens.values.to_pylist()
                counts = np.zeros(len(words))
                if at.is_valid:
                    counts[np.asarray(at.values)] = np.asarray(c.values)
                own, first = classes(words, model.single), np.cumsum(sizes) - sizes
                base, within = model.base(counts), model.within(counts, own)
                buckets, per_token = features(token_hashes(words)[codes], first), within[codes]
                own = own[codes]
                for lo in range(0, len(codes), _WIDE):
                    per_token[lo : lo + _WIDE] += log_probability(buckets[lo : lo + _WIDE], own[lo : lo + _WIDE], model.weights, bias) / np.log(10)
                per_doc = lambda values: np.add.reduceat(values, first)  # noqa: B023, E731
                columns = [ids.values, held.values, pa.array(sizes), pa.array(per_doc((counts > 0)[codes].astype(np.int64))), pa.array(np.full(len(sizes), model.n)), pa.array(per_doc(base[codes])), pa.array(per_doc(per_token))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    joined = blocks.join(known, "block", "left").select("ids", "held", "sizes", "codes", "tokens", "at", "c")
    found = joined.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return found.withColumnRenamed("id", id)


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))


QUERIES = {"op12_lm_scoring": op12_lm_scoring}
#: Training is beyond SQL; tests hold counts and base scores against plain Python, and the model against its own law.
ORACLE_SQL: dict[str, str] = {}
