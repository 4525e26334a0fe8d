"""Spectral reductions: principal, noise-ordered and independent components, and projection pursuit.

Pixels are never gathered: tasks sum Gram matrices of their pixels, Spark adds them up by image, and the
eigenvectors of each image's matrix (bands by bands) are found where its row is. Models are DataFrames with a row an
image, and are joined to the pixels that they project.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismloom.functions.borders import TILE
from prismloom.operators.base import FLAG, INDEX, NATURAL, NOTHING, Extractor, Feature, among
from prismloom.sources.cube import Cube
from prismloom.sources.storage import beside, small_batches, written


def matrix_of(lists: pa.Array) -> np.ndarray:
    """(row, component) of a list column whose lists are equally long."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def finite(spectrum: Column) -> Column:
    return F.forall(spectrum, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def gram(cells: DataFrame, values: str, n: int) -> DataFrame:
    """(image_id, gram): sums of products of (1, values) with itself, a row an image.

    Tasks send one matrix a batch and image, not pixels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            names = batch.column(0).dictionary_encode()
            code, x = np.asarray(names.indices), matrix_of(batch.column(1))
            x = np.hstack([np.ones((len(x), 1)), x])
            for k, name in enumerate(names.dictionary.to_pylist()):
                own = x[code == k]
                sums = own.T @ own
                yield pa.RecordBatch.from_arrays([pa.array([name] * (n + 1)), pa.array(np.arange(n + 1), pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], ["image_id", "i", "part"])

    parts = cells.select("image_id", F.col(values).cast("array<double>")).mapInArrow(run, _PARTS)
    return _added(parts, n)


_PARTS = "image_id string, i int, part array<double>"


def _added(parts: DataFrame, n: int) -> DataFrame:
    """(image_id, gram) from rows of matrices that tasks sent."""
    sums = parts.groupBy("image_id", "i").agg(F.array(*(F.sum(F.col("part")[j]) for j in range(n + 1))).alias("sums"))
    return sums.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "sums"))), lambda s: s["sums"]).alias("gram"))


def scatter(cube: Cube, finite_only: bool = False) -> DataFrame:
    """The Gram matrix of the pixels, or of those with finite spectra; all operators on the cube share one."""
    pixels = cube.pixels.where(finite(F.col("spectrum"))) if finite_only else cube.pixels
    return cube.once("finite_gram" if finite_only else "gram", lambda: gram(pixels, "spectrum", cube.n_bands))


def moments(sums: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Number, mean and sample covariance."""
    n, mean = sums[0, 0], sums[0, 1:] / sums[0, 0]
    return n, mean, (sums[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1)


def by_image(models: DataFrame, schema: str, fit: Callable[..., dict]) -> DataFrame:
    """fit(columns of a row as arrays) for each image's row; keys of the dict as in the schema, after image_id."""
    arrow = models.sparkSession.createDataFrame([], f"image_id string, {schema}").toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                name = row.pop("image_id")
                found = fit(**{k: np.array(v) for k, v in row.items()})
                rows.append({"image_id": name} | {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in found.items()})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return models.mapInArrow(run, f"image_id string, {schema}")


def signed(components: np.ndarray) -> np.ndarray:
    """Rows turned so that the loading of greatest absolute value is positive."""
    at = np.abs(components).argmax(axis=1)
    return components * np.sign(components[np.arange(len(components)), at])[:, None]


def principal(sums: np.ndarray, k: int | None) -> dict:
    """Mean, components (by falling variance) and variances."""
    n, mean, cov = moments(sums)
    variance, vectors = np.linalg.eigh(cov)
    order = np.argsort(variance)[::-1]
    kept = order[: min(int(n), len(order), k or len(order))]
    variance = np.maximum(variance, 0)
    ratio = variance[kept] / max(variance.sum(), 1e-300)
    return {"mean": mean, "components": signed(vectors[:, kept].T), "explained_variance": variance[kept], "explained_variance_ratio": ratio, "cumulative_variance_ratio": np.cumsum(ratio)}


#: Bytes that a model counts for before it is broadcast: components of some hundred bands.
MODEL_BYTES = 1 << 18
PCA_MODEL = "mean array<double>, components array<array<double>>, explained_variance array<double>, explained_variance_ratio array<double>, cumulative_variance_ratio array<double>"


def projected(pixels: DataFrame, model: DataFrame, spectrum: str = "spectrum") -> DataFrame:
    """(image_id, row, col, features): scores of the pixels on the model's components."""
    centered = F.zip_with(F.col(spectrum).cast("array<double>"), "mean", lambda x, m: x - m)
    scores = F.transform(F.array(centered), lambda c: F.transform("components", lambda w: dot(w, c)))[0]
    chosen = model.select("image_id", "mean", "components")
    return beside(pixels, chosen, MODEL_BYTES).select("image_id", "row", "col", scores.alias("features"))


def pca(cube: Cube, k: int | None, whiten: bool = False, valid_only: bool = False) -> Feature:
    """Scores (image_id, row, col, features) and the model."""
    pixels = cube.pixels.where(finite(F.col("spectrum"))) if valid_only else cube.pixels
    fitted = by_image(scatter(cube, valid_only), PCA_MODEL, lambda gram: principal(gram, k))
    used = fitted
    if whiten:
        scale = F.zip_with("components", "explained_variance", lambda c, v: F.transform(c, lambda x: F.coalesce(F.try_divide(x, F.sqrt(v)), F.lit(0.0))))
        used = fitted.withColumn("components", scale)
    return Feature(projected(pixels, used), {"n_components": min(k or cube.n_bands, cube.n_bands)}, fitted)


@dataclass(frozen=True)
class PCAExtractor(Extractor):
    """Scores on the first principal components; whitened ones have unit variance.

    Components are turned so that their greatest loading is positive. ``random_state`` is kept for
    configurations; eigenvectors are exact.
    """

    name: ClassVar[str] = "pca"
    n_components: int = 5
    whiten: bool = False
    random_state: int | None = 42
    limits = {"n_components": NATURAL, "whiten": FLAG}

    def _extract(self, cube: Cube) -> Feature:
        return pca(cube, self.n_components, self.whiten)


def noise_scatter(cube: Cube, tile: int = TILE) -> DataFrame:
    """(image_id, gram): sums of products of (1, differences of neighbours below and to the right) with itself.

    Pixels are dealt to tiles, those at a lower or right edge to the next tile too, in one exchange; tiles send matrices.
    """
    n = cube.n_bands

    def run(table: pa.Table) -> pa.Table:
        row, col = (np.asarray(table.column(c)) for c in ("row", "col"))
        row, col = row - row.min(), col - col.min()
        x = np.full((row.max() + 1, col.max() + 1, n), np.nan)
        there, lent = np.zeros(x.shape[:2], dtype=bool), np.zeros(x.shape[:2], dtype=bool)
        x[row, col] = matrix_of(table.column("spectrum").combine_chunks())
        there[row, col], lent[row, col] = True, np.asarray(table.column("lent"))
        sums = np.zeros((n + 1, n + 1))
        for down, right in ((1, 0), (0, 1)):
            h, w = x.shape[0] - down, x.shape[1] - right
            both = there[:h, :w] & there[down:, right:] & ~lent[down:, right:]
            d = (x[down:, right:] - x[:h, :w])[both]
            d = np.hstack([np.ones((len(d), 1)), d])
            sums += d.T @ d
        lists = pa.array(list(sums), pa.list_(pa.float64()))
        return pa.Table.from_arrays([pa.array(table.column("image_id")[:1].to_pylist() * (n + 1), pa.string()), pa.array(np.arange(n + 1), pa.int32()), lists], ["image_id", "i", "part"])

    side = lambda name: F.floor(F.col(name) / tile).cast("int")
    place = lambda r, c, lent: F.struct(r.alias("tr"), c.alias("tc"), F.lit(lent).alias("lent"))
    at_edge = lambda name: F.col(name) % tile == tile - 1
    own = place(side("row"), side("col"), False)
    below, beside_ = F.when(at_edge("row"), place(side("row") + 1, side("col"), True)), F.when(at_edge("col"), place(side("row"), side("col") + 1, True))
    dealt = cube.pixels.select("image_id", "row", "col", F.col("spectrum").cast("array<double>").alias("spectrum"), F.explode(F.array_compact(F.array(own, below, beside_))).alias("t"))
    parts = dealt.select("image_id", "t.tr", "t.tc", "row", "col", "spectrum", "t.lent").groupBy("image_id", "tr", "tc").applyInArrow(run, _PARTS)
    return cube.once("noise_gram", lambda: _added(parts, n))


def noise_ordered(gram: np.ndarray, noise: np.ndarray, k: int) -> dict:
    """Components by falling signal to noise."""
    _, mean, cov = moments(gram)
    own = moments(noise)[2] / 2 + 1e-8 * np.eye(len(mean))
    values, vectors = np.linalg.eigh(own)
    if (values < 0).any():
        warnings.warn(f"{int((values < 0).sum())} eigenvalues of the noise are below 0 and count as 1e-12", stacklevel=2)
    values = np.maximum(values, 1e-12)
    whitening = vectors @ np.diag(values**-0.5) @ vectors.T
    snr, turned = np.linalg.eigh(whitening.T @ cov @ whitening)
    order = np.argsort(snr)[::-1]
    snr, turned = snr[order], turned[:, order]
    total = snr.sum()
    ratio = snr / total if total > 0 else np.zeros_like(snr)
    projection = signed((whitening @ turned)[:, : min(k, len(snr))].T)
    kept = len(projection)
    return {"mean": mean, "components": projection, "noise_eigenvalues": values, "whitening_matrix": whitening, "snr_eigenvalues": snr[:kept], "snr_estimates": np.maximum(snr[:kept] - 1, 0), "snr_ratio": ratio[:kept], "cumulative_snr_ratio": np.cumsum(ratio[:kept])}


@dataclass(frozen=True)
class MNFExtractor(Extractor):
    """Minimum noise fraction: principal components after whitening the noise, which neighbours' differences show."""

    name: ClassVar[str] = "mnf"
    n_components: int = 5
    limits = {"n_components": NATURAL}

    def _check(self, cube: Cube) -> None:
        if not cube.images().where("height < 2 OR width < 2").isEmpty():
            raise ValueError("differences of neighbours ask for images of 2 x 2 pixels at least")

    def _extract(self, cube: Cube) -> Feature:
        both = scatter(cube).join(noise_scatter(cube).withColumnRenamed("gram", "noise"), "image_id")
        k = self.n_components
        schema = "mean array<double>, components array<array<double>>, noise_eigenvalues array<double>, whitening_matrix array<array<double>>, snr_eigenvalues array<double>, snr_estimates array<double>, snr_ratio array<double>, cumulative_snr_ratio array<double>"
        model = by_image(both, schema, lambda gram, noise: noise_ordered(gram, noise, k))
        return Feature(projected(cube.pixels, model), {"n_features": min(k, cube.n_bands)}, model)


def decorrelated(w: np.ndarray) -> np.ndarray:
    """The nearest matrix with orthonormal rows."""
    values, vectors = np.linalg.eigh(w @ w.T)
    return vectors @ np.diag(np.maximum(values, 1e-300) ** -0.5) @ vectors.T @ w


@dataclass(frozen=True)
class ICAExtractor(Extractor):
    """Independent components by fixed-point iteration with tanh and symmetric decorrelation.

    An iteration is one aggregation over the whitened pixels of all images; images that have converged
    keep their matrix. Pixels with components that aren't finite are left out of the fit and have features of 0.
    """

    name: ClassVar[str] = "ica"
    n_components: int = 5
    whiten: str | bool = "unit-variance"
    random_state: int | None = 42
    tolerance: float = 1e-4
    most_rounds: int = 200
    limits = {"n_components": NATURAL, "whiten": among("unit-variance", "arbitrary-variance", False)}

    def _check(self, cube: Cube) -> None:
        if self.whiten is False:
            warnings.warn("components of data that aren't whitened may be unstable", stacklevel=3)

    def _extract(self, cube: Cube) -> Feature:
        k = min(self.n_components, cube.n_bands) if self.whiten else cube.n_bands
        whiten, seed = self.whiten, self.random_state

        def start(gram: np.ndarray) -> dict:
            n, mean, cov = moments(gram)
            values, vectors = np.linalg.eigh(cov * (n - 1))
            order = np.argsort(values)[::-1][:k]
            turned = vectors[:, order] * np.where(vectors[0, order] < 0, -1, 1)
            scale = (turned / np.sqrt(np.maximum(values[order], 1e-300))).T * np.sqrt(n) if whiten else np.eye(len(mean))
            w = decorrelated(np.random.RandomState(seed).normal(size=(k, k)))
            return {"n": n, "mean": mean, "components": scale, "w": w, "rounds": 0, "done": False}

        pixels = cube.pixels.where(finite(F.col("spectrum")))
        schema = "n double, mean array<double>, components array<array<double>>, w array<array<double>>, rounds int, done boolean"
        state = written(by_image(scatter(cube, finite_only=True), schema, start), "ica")
        white = written(projected(pixels, state), "white")

        def step(**row: np.ndarray) -> dict:
            w, g = row["w"], row["g"].reshape(k, k)
            new = decorrelated(g - row["slope"][:, None] * w)
            moved = float(np.abs(np.abs((new * w).sum(axis=1)) - 1).max())
            return {"n": float(row["n"]), "mean": row["mean"], "components": row["components"], "w": new, "rounds": int(row["rounds"]) + 1, "done": moved < self.tolerance}

        for _ in range(self.most_rounds):
            todo = state.where("NOT done")
            if todo.isEmpty():
                break
            z = F.col("features")
            g = F.transform("w", lambda w: F.tanh(dot(w, z)))
            scored = beside(white, todo.select("image_id", "w"), MODEL_BYTES).select("image_id", z.alias("z"), g.alias("g"))
            means = scored.groupBy("image_id").agg(F.array(*(F.avg(F.col("g")[i] * F.col("z")[j]) for i in range(k) for j in range(k))).alias("g"), F.array(*(F.avg(1 - F.col("g")[i] * F.col("g")[i]) for i in range(k))).alias("slope"))
            state = written(by_image(todo.drop("done").join(means, "image_id"), schema, step).unionByName(state.where("done")), "ica")

        def finish(**row: np.ndarray) -> dict:
            # Whitened scores have unit variance, so rows of w of unit length give components of unit variance.
            norm = np.linalg.norm(row["w"], axis=1, keepdims=True) if whiten == "unit-variance" else 1.0
            unmix = (row["w"] / norm) @ row["components"] if whiten else row["w"]
            mixing = np.linalg.pinv(unmix)
            n, _, cov = moments(row["gram"])
            # Mean square of what the components leave of centred spectra, from their covariance: no second look at the pixels.
            left = np.eye(len(cov)) - mixing @ unmix
            error = float(np.trace(left @ cov @ left.T)) * (n - 1) / (n * len(cov))
            return {"mean": row["mean"], "components": unmix, "mixing_matrix": mixing, "n_iter": int(row["rounds"]), "reconstruction_error": error}

        schema = "mean array<double>, components array<array<double>>, mixing_matrix array<array<double>>, n_iter int, reconstruction_error double"
        model = by_image(state.drop("n", "done").join(scatter(cube, finite_only=True), "image_id"), schema, finish)
        found = projected(pixels, model)
        every = cube.pixels.select("image_id", "row", "col").join(found, ["image_id", "row", "col"], "left")
        zeros = F.array_repeat(F.lit(0.0), k)
        return Feature(every.select("image_id", "row", "col", F.coalesce("features", zeros).alias("features")), {"n_components": k}, model)


#: Share of a bin that scores may lie below its border and still count in it.
EDGE = 1e-7


def divergence(counts: np.ndarray, limit: float) -> float:
    """Symmetric Kullback-Leibler divergence of a histogram over -limit to limit from the standard normal distribution."""
    width = 2 * limit / len(counts)
    centers = -limit + width * (np.arange(len(counts)) + 0.5)
    p = counts / max(counts.sum(), 1)
    q = np.exp(-0.5 * centers**2)
    q = q / q.sum()
    p, q = np.maximum(p, 1e-10), np.maximum(q, 1e-10)
    return float(((p - q) * np.log(p / q)).sum())


#: Pixels of a block whose scores a task holds at a time.
SCORED = 512


def block_scores(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, Iterator[np.ndarray]]]:
    """For each row (image_id, x, c, ...), a block of pixels and its candidates: its number, the candidates, and the pixels' scores, some pixels at a time."""
    for i in range(len(batch)):
        x, candidates = matrix_of(batch.column(1)[i].values), batch.column(2)[i].values
        vectors = matrix_of(candidates.field("vector")).T
        yield i, candidates.field("candidate"), (x[lo : lo + SCORED] @ vectors for lo in range(0, len(x), SCORED))


@dataclass(frozen=True)
class PPExtractor(Extractor):
    """Projection pursuit: of directions through pixels, those whose scores are least like a normal distribution.

    Pixels are whitened by principal components (by default as many as hold 0.99 of the variance). For each
    projection the candidates of an image, ``sample_size`` at most, are scored over all its pixels: tasks send moments, then
    histograms, of their blocks of pixels, of which they hold a few at a time. The best direction is taken out of the pixels before the next. Sums over pixels
    differ in their last digits with the order of the pixels; scores within EDGE of a border between bins count as
    above it, and divergences are compared to 9 decimals, so that this doesn't choose the direction.
    """

    name: ClassVar[str] = "pp"
    n_projections: int = 10
    n_bins: int = 128
    pca_components: int | None = None
    sample_size: int = 1000
    random_state: int | None = 42
    block: int = 4096
    limits = {"n_projections": NATURAL, "n_bins": NATURAL, "pca_components": NATURAL | NOTHING, "sample_size": NATURAL, "random_state": INDEX | NOTHING}

    def _check(self, cube: Cube) -> None:
        if not cube.images().join(scatter(cube, finite_only=True), "image_id", "left_anti").isEmpty():
            raise ValueError("an image has no pixel whose components are all finite")

    def _sphered(self, cube: Cube) -> tuple[DataFrame, DataFrame]:
        k = self.pca_components

        def fit(gram: np.ndarray) -> dict:
            found = principal(gram, k)
            size = k or int((found["cumulative_variance_ratio"] >= 0.99).argmax()) + 1
            scale = np.sqrt(np.maximum(found["explained_variance"][:size], 1e-300))
            return {"mean": found["mean"], "components": found["components"][:size] / scale[:, None]}

        pixels = cube.pixels.where(finite(F.col("spectrum")))
        model = written(by_image(scatter(cube, finite_only=True), "mean array<double>, components array<array<double>>", fit), "sphere")
        return written(projected(pixels, model), "sphered"), model

    def _scored(self, blocks: DataFrame, candidates: DataFrame) -> DataFrame:
        """(image_id, candidate, vector, score) of every candidate."""
        bins = self.n_bins
        small_batches(blocks.sparkSession)
        gathered = candidates.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("candidate", "vector"))).alias("c"))
        pair = beside(blocks, gathered, self.sample_size << 10, deal=("part",))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, names, scores in block_scores(batch):
                    n, s1, s2, lo, hi = 0.0, 0.0, 0.0, np.inf, -np.inf
                    for s in scores:
                        n, s1, s2, lo, hi = n + len(s), s1 + s.sum(axis=0), s2 + (s * s).sum(axis=0), np.minimum(lo, s.min(axis=0)), np.maximum(hi, s.max(axis=0))
                    yield pa.RecordBatch.from_pydict({"image_id": [batch.column(0)[at].as_py()] * len(names), "candidate": names, "n": pa.array([n] * len(names)), "s1": s1, "s2": s2, "lo": lo, "hi": hi})

        first = pair.select("image_id", "x", "c").mapInArrow(sums, "image_id string, candidate bigint, n double, s1 double, s2 double, lo double, hi double")
        spread = first.groupBy("image_id", "candidate").agg(*(F.sum(c).alias(c) for c in ("n", "s1", "s2")), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        mean = F.col("s1") / F.col("n")
        spread = spread.withColumns({"mean": mean, "sd": F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0))) + 1e-10})
        limit = F.greatest(F.lit(4.0), F.greatest(F.abs(F.col("lo") - F.col("mean")), F.abs(F.col("hi") - F.col("mean"))) / F.col("sd") + 0.5)
        spread = spread.select("image_id", "candidate", "mean", "sd", limit.alias("limit"))
        table = spread.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("candidate", "mean", "sd", "limit"))).alias("m"))

        def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, names, scores in block_scores(batch):
                    mean, sd, limit = (np.asarray(batch.column(3)[at].values.field(c)) for c in ("mean", "sd", "limit"))
                    own = np.zeros(len(names) * bins, dtype=np.int64)
                    for s in scores:
                        place = ((s - mean) / sd + limit) * (bins / (2 * limit))
                        code = np.clip(np.floor(place + EDGE), 0, bins - 1).astype(np.int64) + np.arange(len(names)) * bins
                        own += np.bincount(code.ravel(), minlength=len(own))
                    lists = pa.ListArray.from_arrays(np.arange(len(names) + 1, dtype=np.int32) * bins, pa.array(own))
                    yield pa.RecordBatch.from_pydict({"image_id": [batch.column(0)[at].as_py()] * len(names), "candidate": names, "counts": lists})

        parts = beside(pair, written(table, "spread"), self.sample_size << 6, deal=("part",)).select("image_id", "x", "c", "m").mapInArrow(counts, "image_id string, candidate bigint, counts array<bigint>")
        histogram = parts.groupBy("image_id", "candidate").agg(F.array(*(F.sum(F.col("counts")[i]) for i in range(bins))).alias("counts")).join(spread, ["image_id", "candidate"])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [divergence(np.asarray(c.values), l.as_py()) for c, l in zip(batch.column(2), batch.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64())], ["image_id", "candidate", "score"])

        scored = histogram.select("image_id", "candidate", "counts", "limit").mapInArrow(score, "image_id string, candidate bigint, score double")
        return scored.join(candidates, ["image_id", "candidate"])

    def _extract(self, cube: Cube) -> Feature:
        white, model = self._sphered(cube)
        place = F.col("row").cast("bigint") * 1_000_000_000 + F.col("col")
        drawn = F.row_number().over(Window.partitionBy("image_id").orderBy(F.xxhash64("row", "col", F.lit(self.random_state or 0)), "row", "col"))
        # The sample is bounded for each image, and tasks send no more than it to the exchange; scores count every pixel.
        sample = white.select("image_id", "row", "col").withColumn("drawn", drawn).where(F.col("drawn") <= self.sample_size).select("image_id", "row", "col", F.lit(True).alias("is_candidate"))
        marked = white.join(sample, ["image_id", "row", "col"], "left").select("image_id", place.alias("candidate"), "row", "col", "features", F.coalesce("is_candidate", F.lit(False)).alias("is_candidate"))
        left = written(marked, "pursuit")
        vectors = None
        for p in range(self.n_projections):
            norm = F.sqrt(dot(F.col("features"), F.col("features")))
            sample = left.where("is_candidate").withColumn("norm", norm).where("norm >= 1e-10")
            candidates = written(sample.select("image_id", "candidate", F.transform("features", lambda x: x / F.col("norm")).alias("vector")), "candidates")
            scored = self._scored(self._blocks(left), candidates)
            best = written(scored.groupBy("image_id").agg(F.max_by(F.struct("candidate", "vector", "score"), F.struct(F.round("score", 9), -F.col("candidate"))).alias("b")).select("image_id", F.lit(p).alias("p"), "b.*"), "best")
            vectors = best if vectors is None else vectors.unionByName(best)
            if p + 1 < self.n_projections:
                along = F.zip_with("features", "vector", lambda x, v: x - F.col("d") * v)
                deflated = beside(left, best.select("image_id", "vector"), MODEL_BYTES).withColumn("d", dot(F.col("features"), F.col("vector")))
                left = written(deflated.select("image_id", "candidate", "row", "col", along.alias("features"), "is_candidate"), "pursuit")
        found = vectors.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("p", "candidate", "vector", "score"))).alias("v"))
        found = found.select("image_id", F.transform("v", lambda v: v["vector"]).alias("projection_vectors"), F.transform("v", lambda v: v["score"]).alias("divergence_scores"), F.transform("v", lambda v: v["candidate"]).alias("selected_pixels")).join(model, "image_id")
        scores = F.transform("projection_vectors", lambda v: dot(v, F.col("features")))
        own = beside(white, found.select("image_id", "projection_vectors"), MODEL_BYTES).select("image_id", "row", "col", scores.alias("features"))
        every = cube.pixels.select("image_id", "row", "col").join(own, ["image_id", "row", "col"], "left")
        zeros = F.array_repeat(F.lit(0.0), self.n_projections)
        return Feature(every.select("image_id", "row", "col", F.coalesce("features", zeros).alias("features")), {"n_features": self.n_projections}, found)

    def _blocks(self, pixels: DataFrame) -> DataFrame:
        """(image_id, x): blocks of about ``block`` pixels of an image."""
        counts = written(pixels.groupBy("image_id").agg(F.ceil(F.count("*") / self.block).cast("int").alias("parts")), "counts")
        return beside(pixels, counts, 64).groupBy("image_id", F.pmod(F.xxhash64("candidate"), F.col("parts")).alias("part")).agg(F.collect_list("features").alias("x"))
