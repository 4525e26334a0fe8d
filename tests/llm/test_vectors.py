"""Vector codes and whitening against brute force in whole integers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismloom.llm import codebooks, whitening
from prismloom.llm.storage import tidied, written
from prismloom.llm.vectors import with_total

NAN, INF = float("nan"), float("inf")


def lloyd(ids, x, parts, entries, rounds):
    """Codes, errors and codebooks by all distances in Python."""
    order = sorted(set(ids), key=lambda i: (i is None, i))[:entries]
    width = x.shape[1] // parts
    first = [min(tuple(v) for i, v in zip(ids, x.tolist(), strict=True) if i == o) for o in order]
    codes, errors, books = np.zeros((len(x), parts), int), np.zeros(len(x), int), []
    for p in range(parts):
        book = [list(v[p * width : p * width + width]) for v in first]
        own = x[:, p * width : p * width + width].tolist()
        for r in range(rounds + 1):
            far = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in book] for v in own]
            at = [d.index(min(d)) for d in far]
            if r < rounds:
                for e in range(len(book)):
                    mine = [v for v, a in zip(own, at, strict=True) if a == e]
                    if mine:
                        book[e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        codes[:, p], errors[:] = at, errors + [min(d) for d in far]
        books.append(book)
    return ["".join(f"{e:02x}" for e in c) for c in codes.tolist()], errors.tolist(), np.array(books)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, x string, code string")


@pytest.mark.parametrize("seed, n, size, parts, entries, spread", [(1, 300, 8, 4, 16, 0.4), (2, 90, 6, 2, 64, 3.0), (3, 40, 4, 4, 64, 0.02), (4, 500, 12, 3, 5, 0.1)])
def test_codes_against_all_distances(spark, seed, n, size, parts, entries, spread):
    """Few distinct values make many ties; fewer vectors than entries make short codebooks."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, size)) * spread
    v[n // 2 :: 3] = v[0]
    ids = [int(i) if i != 7 else None for i in rng.permutation(n)]
    ids[5] = ids[6]
    labels = [None if i % 3 == 0 else i % 4 for i in range(n)]
    rows = [(i, e.tolist(), lab, "a", "b") for i, e, lab in zip(ids, v, labels, strict=True)]
    bad = [(900, None, 1, "", ""), (901, [NAN] * size, 1, "", ""), (902, [INF] * size, 1, "", ""), (903, [None] * size, 1, "", ""), (904, [], 1, "", "")]
    x = np.floor(v * 256).astype(int)
    for rounds in (1, 2, 4):
        codes, errors, books = lloyd(ids, x, parts, entries, rounds)
        found, own = codebooks.compressed(table(spark, rows + bad).repartition(3), parts=parts, entries=entries, rounds=rounds)
        assert (own == books).all()
        total = {lab: sum(e for e, o in zip(errors, labels, strict=True) if o == lab) for lab in set(labels)}
        want = sorted((str(i), c, e, total[lab]) for i, c, e, lab in zip(ids, codes, errors, labels, strict=True))
        assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in found.collect()) == want


def test_bounds_prune_and_hold():
    """Bounds lie on their sides of the distances after every round, and most distances aren't computed."""
    rng = np.random.default_rng(5)
    x = np.floor(256 * (rng.normal(size=(2000, 1, 4)) * 0.05 + rng.integers(0, 16, (2000, 1, 1)))).astype(np.int64)
    books = x[:64, 0][None].copy()
    bounds = codebooks.all_compared(x, books)
    for _ in range(3):
        entry = bounds.entry[:, 0].astype(int)
        sums = np.zeros((1, 64, 4), np.int64)
        np.add.at(sums[0], entry, x[:, 0])
        old, books = books, codebooks.replaced(books, sums, np.bincount(entry, minlength=64)[None])
        bounds, compared = codebooks.moved(bounds, x, old, books)
        far = np.sqrt(codebooks.squares(x[:, 0], books[0]))
        assert (bounds.entry[:, 0] == (far**2).round().argmin(axis=1)).all()
        assert (bounds.upper[:, 0] >= far.min(axis=1)).all() and (bounds.floors(0) <= far).all()
        assert compared < 0.3 * far.size


def test_codes_of_odd_tables(spark):
    found, books = codebooks.compressed(table(spark, []))
    assert found.columns == ["vec_id", "code", "error", "label_error"] and found.count() == 0 and books.size == 0
    found, _ = codebooks.compressed(table(spark, [(1, [0.5] * 16, 1, "", "")] * 3))
    assert [tuple(r) for r in found.collect()] == [(1, "00" * 16, 0, 0)] * 3
    with pytest.raises(ValueError):
        codebooks.compressed(table(spark, [(1, [0.5] * 16, 1, "", ""), (2, [0.5] * 32, 1, "", "")]))
    with pytest.raises(ValueError):
        codebooks.compressed(table(spark, [(1, [0.5] * 15, 1, "", "")]))
    with pytest.raises(Exception, match="within"):
        codebooks.compressed(table(spark, [(1, [1e9] * 16, 1, "", "")]))[0].collect()


def test_totals_of_uneven_keys(spark):
    """A key with a third of the rows is no row of the join that shuffles by key."""
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.col("id")).otherwise(F.lit(-1)).alias("k"), F.lit(2).alias("v"))
    found = {tuple(r) for r in with_total(rows, "k", "v", "t", spread=("id",)).groupBy("t").count().collect()}
    assert found == {(20_000, 20_000), (2, 10_000)}


def exact(x):
    """n, sums, and the covariance of distinct integer vectors as fractions."""
    fit = [list(map(int, v)) for v in sorted(set(map(tuple, x.tolist())))]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    d = range(len(sums))
    return n, sums, [[Fraction(sum(v[i] * v[j] for v in fit) * n - sums[i] * sums[j], n * n) for j in d] for i in d], fit


@pytest.mark.parametrize("seed, n, size, scale", [(1, 200, 8, 1.0), (2, 150, 5, 0.01), (3, 60, 3, 20_000.0), (4, 40, 64, 0.3)])
def test_whitening_against_fractions(spark, seed, n, size, scale):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, size)) @ rng.normal(size=(size, size)) * scale / 9 + scale
    v = np.clip(v, -131_000, 131_000)
    v[n // 2 :] = v[: n - n // 2]
    rows = [(int(i), e.tolist(), 1, "a", "b") for i, e in enumerate(v)] + [(900, None, 1, "", ""), (901, [NAN] * size, 1, "", ""), (902, [None] * size, 1, "", ""), (903, [], 1, "", "")]
    got = whitening.whitened(table(spark, rows).repartition(4)).collect()
    x = np.floor(v * 256).astype(np.int64)
    count, sums, cov, fit = exact(x)
    k = min(4, size)
    assert len(got) == n * k
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in line] for line in cov]))
    scores = np.zeros((n, k))
    for r in got:
        i, c = r["vec_id"], r["component"] - 1
        far = sum((count * int(a) - s) ** 2 for a, s in zip(x[i], sums, strict=True))
        assert r["n"] == count and int(r["deviation_exact"]) == far and r["deviation"] == (far if far < 1 << 63 else None)
        assert math.isclose(r["explained"], values[-1 - c] / values.sum(), rel_tol=1e-6) and r["identity_error"] < 1e-6
        scores[i, c] = r["whitened"]
    mean = np.array([float(Fraction(s, count)) for s in sums])
    for c in range(k):
        want = (x - mean) @ vectors[:, -1 - c] / np.sqrt(values[-1 - c])
        sign = np.sign(want[np.abs(want).argmax()] * scores[np.abs(want).argmax(), c])
        np.testing.assert_allclose(scores[:, c], sign * want, rtol=1e-5, atol=1e-6)


def test_scatter_from_residues():
    """Beyond 64 bits too, and whatever the sign."""
    rng = np.random.default_rng(3)
    x = rng.integers(-(1 << 40), 1 << 40, (9000, 3))
    want = [[sum(a * b for a, b in zip(x[:, i].tolist(), x[:, j].tolist(), strict=True)) for j in range(3)] for i in range(3)]
    assert max(map(abs, want[0])) > 1 << 63
    moduli = whitening.primes(2 * 9000 * (1 << 80))
    assert len(set(moduli)) == len(moduli) > 4 and all(p < 1 << whitening.PRIME_BITS for p in moduli)
    halves = [whitening.residue_scatter(part, moduli) for part in (x[:5000], x[5000:])]
    assert [[whitening.remaindered([int(h0 + h1) for h0, h1 in zip(halves[0][:, i, j], halves[1][:, i, j], strict=True)], moduli) for j in range(3)] for i in range(3)] == want


def test_whitening_of_odd_tables(spark):
    assert whitening.whitened(table(spark, [])).count() == 0
    one = whitening.whitened(table(spark, [(1, [0.5, 0.25], 1, "", "")] * 2)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)] * 2
    flat = whitening.whitened(table(spark, [(i, [i / 4, 1.0, i / 2], 1, "", "") for i in range(9)])).collect()
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: True, 3: True} and flat[0]["identity_error"] < 1e-9


def test_tidied_restores_the_setting(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), tidied(spark):
        assert spark.conf.get(key) == "true"
        raise ZeroDivisionError
    assert spark.conf.get(key) == was
    table = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    assert table.count() == 7 and table.join(table, "k").count() == 7 and spark.conf.get(key) == was
