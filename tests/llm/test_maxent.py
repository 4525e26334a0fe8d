"""Language-model scoring: counts and base scores against plain Python, the model against its own law."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismloom.llm import maxent


def tokens_of(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", folded), maxent.END]


def expected(docs):
    """(n_tokens, n_known, N, base_score) by (id, text)."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(t for i, text in docs if not held(i) for t in tokens_of(text))
    n, v = sum(counts.values()), len(counts)
    base = lambda t: math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1)))
    return [(i, held(i), len(w := tokens_of(text)), sum(t in counts for t in w), n, math.fsum(map(base, w))) for i, text in docs]


def draw(rng, n, i):
    """Chains of words in which each depends on the one before, in one of two languages."""
    words = [f"{'ab'[i % 2]}{rng.integers(40)}{'xyz'[int(rng.integers(3))]}"]
    for _ in range(n):
        last = words[-1]
        words.append(f"{last[0]}{rng.integers(40)}{'xyz'[('xyz'.index(last[-1]) + 1) % 3]}")
    return " ".join(words)


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(4)
    found = [(i, draw(rng, int(rng.integers(1, 200)), i)) for i in range(600)]
    odd = ["", None, " \t\n\x0b\x0c\r ", "A B ÄZ  x\x1cy", "The THE the\nthe", "x" * 50_000, "\x85 \x1f\x00"]
    found += [(1000 + k, t) for k, t in enumerate(odd)] + [(None, "The end"), (3, found[3][1]), (20, None), (20, draw(rng, 30_000, 0))]
    return found


@pytest.mark.parametrize("parts, block_bytes", [(1, 1 << 30), (5, 3000), (9, 1)])
def test_counts_and_base_scores(spark, docs, parts, block_bytes):
    table = spark.createDataFrame([(i, t, "c", "h") for i, t in docs], "doc_id bigint, text string, codes string, held string").repartition(parts)
    got = [tuple(r)[:6] for r in maxent.scored(table, rounds=1, block_bytes=block_bytes).collect()]
    key = lambda r: (r[0] is None, r[0], r[2:])
    for g, w in zip(sorted(got, key=key), sorted(expected(docs), key=key), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-10)


def test_probabilities_sum_to_one(spark, docs):
    """Over all tokens and an unseen one of each class, whatever stands before."""
    blocks = maxent.blocks_of(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text")
    model, vocabulary = maxent.trained(blocks)
    known = {r["token"]: r["c"] for r in vocabulary.collect()}
    tokens, counts = list(known), np.array(list(known.values()), float)
    own = maxent.classes(tokens, model.single)
    unseen = model.within(np.zeros(model.size), np.arange(model.size))
    within = np.bincount(own, 10 ** model.within(counts, own), model.size) + 10**unseen
    np.testing.assert_allclose(within, 1, rtol=1e-9)
    hashes = maxent.token_hashes(tokens)
    buckets = maxent.features(hashes, np.array([0]))
    shares = maxent.probabilities(buckets, model.weights, model.bias)
    np.testing.assert_allclose(shares.sum(axis=1), 1, rtol=1e-5)
    np.testing.assert_allclose(maxent.log_probability(buckets, own, model.weights, model.bias), np.log(shares[np.arange(len(own)), own]), atol=1e-4)
    assert np.abs(model.weights).max() > 0.1


def test_learns_what_stands_before(spark, docs):
    """On held-out texts the model beats counts alone, and a further round doesn't harm."""
    table = spark.createDataFrame([d for d in docs if d[0] is not None and d[0] < 600], "doc_id bigint, text string")
    better = []
    for rounds in (0, 2, 4):
        found = maxent.scored(table, rounds=rounds) if rounds else maxent.scored(table, rounds=4).withColumn("score", F.col("base_score"))
        better.append(found.where("held_out").agg(F.sum("score") / F.sum("n_tokens")).first()[0])
    assert better[0] + 0.1 < better[1] and better[1] - 0.05 < better[2]


def test_blocks_change_nothing_much(spark, docs):
    """Blocks and partitions change sums in their last digits only."""
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    runs = [sorted((str(r[0]), r[2], r[6]) for r in maxent.scored(table.repartition(p), block_bytes=b).collect()) for p, b in ((1, 1 << 30), (6, 5000))]
    assert all(a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-4) for a, b in zip(*runs, strict=True))


def test_odd_tables(spark):
    make = lambda rows: maxent.scored(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert make([]) == []
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = make([(only_held, "a b a")])
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (True, 4, 0, 0, 0.0) and r["score"] < 0
    (r,) = make([(1, None)])
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (1, 1, 1) and r["score"] < 0
