"""The queries of the hyperspectral operators and the SQL that they are held against.

All run over every pixel of the embeddings raster. Queries named ``..._rgb`` take its false-colour image
where SQL can follow; those without take principal components or all bands, with the operators' own parameters, but that
``ica`` and ``pp`` look for three components and three projections.
"""

from __future__ import annotations

import uuid

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismloom.operators.base import Extractor
from prismloom.operators.moment import GeometricMomentExtractor, LegendreMomentExtractor, ZernikeMomentExtractor
from prismloom.operators.morphology import MPExtractor
from prismloom.operators.reduction import ICAExtractor, MNFExtractor, PCAExtractor, PPExtractor, by_image, gram, moments, noise_scatter, scatter
from prismloom.operators.spectral import NDVIExtractor, NDWIExtractor, SAVIExtractor
from prismloom.operators.texture import GaborExtractor, GLCMExtractor, LBPExtractor
from prismloom.operators.wavelet import DWT1DExtractor, DWT2DExtractor, DWT3DExtractor
from prismloom.plans import oracle
from prismloom.plans.space import FeatureSpace
from prismloom.sources.cube import BANDS, Cube, embeddings_cube
from prismloom.sources.cubefiles import read_array_cube, write_cube
from prismloom.sources.storage import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded, with -0.0 as 0.0."""
    return F.round(value, digits) + F.lit(0.0)


def long(features: DataFrame, digits: int = 6) -> DataFrame:
    """(row, col, k, value): a row for each feature."""
    return features.select("row", "col", F.posexplode("features").alias("k", "value")).select("row", "col", "k", rounded(F.col("value"), digits).alias("value"))


def _of(extractor: Extractor, rgb: bool = False, digits: int = 6) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        cube = embeddings_cube(spark, sf_dir)
        return long(extractor.extract(cube.pseudo_rgb() if rgb else cube).data, digits)

    return query


def _texture(extractor: Extractor) -> Query:
    """Features of the false-colour image; a pixel without neighbours has none."""
    query = _of(extractor, rgb=True, digits=5)
    return lambda spark, sf_dir: query(spark, sf_dir).where(~F.isnan("value"))


def _index(extractor: Extractor) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return extractor.extract(embeddings_cube(spark, sf_dir)).data.select("row", "col", rounded(F.col("features")[0]).alias("value"))

    return query


def _cube(use: Callable[[Cube], DataFrame]) -> Query:
    return lambda spark, sf_dir: use(embeddings_cube(spark, sf_dir))


def _spectra(cube: Cube) -> DataFrame:
    return long(cube.pixels.withColumnRenamed("spectrum", "features").withColumn("features", F.col("features").cast("array<double>")))


def _masked(cube: Cube) -> DataFrame:
    """Pixels on odd columns are taken as invalid; NaN shows as null."""
    marked = Cube(cube.pixels.withColumn("valid", F.col("col") % 2 == 0), cube.wavelengths).masked()
    return _spectra(marked).withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def _array_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube written as blocks of arrays and read back through the data source."""
    path = f"{shared_dir(spark).rstrip('/')}/prismloom/cube-{uuid.uuid4().hex}"
    write_cube(embeddings_cube(spark, sf_dir), path)
    return _spectra(read_array_cube(spark, path))


def _matrix(matrices: DataFrame, scale: float, less: int = 1) -> DataFrame:
    """(i, j, value) of the covariance of each image, by the number of pixels less 1 or 0."""

    def scaled(gram: np.ndarray) -> dict:
        n, _, cov = moments(gram)
        return {"cov": cov * scale * (n - 1) / (n - less)}

    found = by_image(matrices, "cov array<array<double>>", scaled)
    rows = found.select(F.posexplode("cov").alias("i", "line"))
    return rows.select("i", F.posexplode("line").alias("j", "value")).select("i", "j", rounded(F.col("value"), 8).alias("value"))


def _covariance(extractor: Extractor, n: int, noise: bool = False, less: int = 1) -> Query:
    """(i, j, value) of the features' covariance, or of half that of their neighbours' differences."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = extractor.extract(embeddings_cube(spark, sf_dir)).data
        if not noise:
            rows = _matrix(gram(found, "features", n), 1.0, less)
        else:
            pixels = found.select("image_id", "row", "col", F.col("features").alias("spectrum"), F.lit(True).alias("valid"))
            rows = _matrix(noise_scatter(Cube(pixels, tuple(range(1, n + 1)))), 0.5)
        return rows.withColumn("value", rounded(F.col("value"), 4))

    return query


def _spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the first three powers of the variances of all principal components' scores."""
    found = PCAExtractor(n_components=BANDS).extract(embeddings_cube(spark, sf_dir)).data
    variances = found.select(F.posexplode("features").alias("k", "v")).groupBy("k").agg(F.var_samp("v").alias("v"))
    sums = variances.agg(*(F.sum(F.pow("v", F.lit(p))).alias(f"p{p}") for p in (1, 2, 3)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(p).alias("power"), rounded(F.col(f"p{p}"), d).alias("value")) for p, d in ((1, 6), (2, 8), (3, 9))))).alias("s")).select("s.*")


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan in which two extractors share principal components."""
    cube = embeddings_cube(spark, sf_dir)
    space = FeatureSpace.from_list([NDVIExtractor(), PCAExtractor(n_components=3), LBPExtractor(n_components=3), LegendreMomentExtractor(max_order=2, window_sizes=(3,))])
    found = space.extract(cube).table()
    return found.select("extractor", "row", "col", F.posexplode("features").alias("k", "value")).withColumn("value", rounded(F.col("value"), 4))


#: Parameters of the queries that SQL follows.
ORDER, SIZES, RADII = 6, (3, 9, 15), (1, 2)


def queries() -> dict[str, Query]:
    moments_rgb = {"bands": (0, 1, 2), "max_order": ORDER, "window_sizes": SIZES}
    return {
        "ndvi": _index(NDVIExtractor()),
        "ndwi": _index(NDWIExtractor()),
        "savi": _index(SAVIExtractor()),
        "hsi_describe": _cube(lambda c: c.describe().select("height", "width", "bands", "wavelength_min", "wavelength_max", "valid_pixels", "total_pixels")),
        "hsi_crop": _cube(lambda c: _spectra(c.crop(slice(2, -3), slice(None, None, 2)))),
        "hsi_crop_center": _cube(lambda c: _spectra(c.crop_center(10))),
        "hsi_pseudo_rgb": _cube(lambda c: _spectra(c.pseudo_rgb())),
        "hsi_stretched": _cube(lambda c: _spectra(c.pseudo_rgb().stretched())),
        "hsi_masked": _cube(_masked),
        "hsi_band": _cube(lambda c: c.band(10).select("row", "col", rounded(F.col("value")).alias("value"))),
        "hsi_array_files": _array_files,
        "hsi_pixel": _cube(lambda c: c.pixel(3, 4).select(F.posexplode("spectrum").alias("k", "v")).select("k", rounded(F.col("v").cast("double")).alias("value"))),
        "band_cov": _cube(lambda c: _matrix(scatter(c), 1.0)),
        "noise_cov": _cube(lambda c: _matrix(noise_scatter(c), 0.5)),
        "pca": _of(PCAExtractor()),
        "pca_whitened": _of(PCAExtractor(whiten=True)),
        "mnf": _of(MNFExtractor()),
        "ica": _of(ICAExtractor(n_components=3), digits=3),
        "pp": _of(PPExtractor(n_projections=3), digits=3),
        "pca_spectrum": _spectrum,
        "pca_whitened_cov": _covariance(PCAExtractor(whiten=True), 5),
        "mnf_noise_cov": _covariance(MNFExtractor(), 5, noise=True),
        "ica_cov": _covariance(ICAExtractor(n_components=3), 3, less=0),
        "pp_cov": _covariance(PPExtractor(n_projections=3), 3),
        "dwt1d": _of(DWT1DExtractor()),
        "dwt1d_sym5_smooth": _of(DWT1DExtractor("sym5", "smooth", 2)),
        "dwt1d_coif2_antireflect": _of(DWT1DExtractor("coif2", "antireflect", 2)),
        "dwt1d_bior44_periodization": _of(DWT1DExtractor("bior4.4", "periodization", 2)),
        "dwt2d": _of(DWT2DExtractor()),
        "dwt2d_sym5": _of(DWT2DExtractor("sym5", 2)),
        "dwt3d": _of(DWT3DExtractor()),
        "dwt3d_rbio22": _of(DWT3DExtractor("rbio2.2")),
        "glcm": _of(GLCMExtractor(), digits=5),
        "glcm_rgb": _texture(GLCMExtractor(equalize=False, spectral_reduction=None)),
        "glcm_rgb_equalized": _texture(GLCMExtractor(spectral_reduction=None)),
        "lbp": _of(LBPExtractor()),
        "lbp_rgb": _of(LBPExtractor(radius=1, n_points=4, method="default", spectral_mode="bands", band_indices=(0, 1, 2)), rgb=True),
        "lbp_rgb_ror": _of(LBPExtractor(spectral_mode="bands", band_indices=(0, 1, 2)), rgb=True),
        "gabor": _of(GaborExtractor()),
        "gabor_rgb": _of(GaborExtractor(), rgb=True),
        "gabor_opponent_rgb": _of(GaborExtractor(use_opponent=True), rgb=True),
        "mp": _of(MPExtractor()),
        "mp_reconstruction": _of(MPExtractor(use_reconstruction=True)),
        "mp_rgb": _of(MPExtractor(bands=(0, 1, 2), radii=RADII, shapes=("square",)), rgb=True),
        "mp_rgb_shapes": _of(MPExtractor(bands=(0, 1, 2), radii=(1, 3), shapes=("disk", "diamond", "line")), rgb=True),
        "mp_rgb_reconstruction": _of(MPExtractor(bands=(0, 1, 2), radii=RADII, shapes=("square", "disk"), use_reconstruction=True), rgb=True),
        "geometric_moment": _of(GeometricMomentExtractor()),
        "legendre_moment": _of(LegendreMomentExtractor()),
        "zernike_moment": _of(ZernikeMomentExtractor()),
        "geometric_moment_rgb": _of(GeometricMomentExtractor(**moments_rgb), rgb=True),
        "legendre_moment_rgb": _of(LegendreMomentExtractor(**moments_rgb), rgb=True),
        "zernike_moment_rgb": _of(ZernikeMomentExtractor(**moments_rgb), rgb=True),
        "feature_space": _plan,
    }


def _hsi(where: str = "true", row: str = "row", col: str = "col", bands: str = f"range(0, {BANDS})", value: str = "CAST(s[b + 1] AS DOUBLE)") -> str:
    return f"""WITH {oracle.PIXELS}, p AS (SELECT *, unnest({bands}) AS b, unnest(range(0, len({bands}))) AS k FROM px)
SELECT CAST({row} AS INTEGER) AS row, CAST({col} AS INTEGER) AS col, CAST(k AS INTEGER) AS k, {oracle.rounded(value)} AS value FROM p, dims WHERE {where}"""


def oracle_sql() -> dict[str, str]:
    red, nir, green = oracle.band(27), oracle.band(47), oracle.band(17)
    middle = "((h - 10) // 2)", "((w - 10) // 2)"
    return {
        "ndvi": oracle.index(f"({nir} - {red}) / ({nir} + {red} + 1e-6)"),
        "ndwi": oracle.index(f"({green} - {nir}) / ({green} + {nir} + 1e-6)"),
        "savi": oracle.index(f"({nir} - {red}) * 1.5 / ({nir} + {red} + 0.5)"),
        "hsi_describe": f"WITH {oracle.PIXELS} SELECT h AS height, w AS width, {BANDS} AS bands, 400.0::DOUBLE AS wavelength_min, 1000.0::DOUBLE AS wavelength_max, count(*) AS valid_pixels, count(*) AS total_pixels FROM px, dims GROUP BY h, w",
        "hsi_crop": _hsi("row >= 2 AND row < h - 3 AND col % 2 = 0", "row - 2", "col // 2"),
        "hsi_array_files": _hsi(),
        "hsi_crop_center": _hsi(f"row >= {middle[0]} AND row < {middle[0]} + 10 AND col >= {middle[1]} AND col < {middle[1]} + 10", f"row - {middle[0]}", f"col - {middle[1]}"),
        "hsi_pseudo_rgb": _hsi(bands=str(list(oracle.RGB))),
        "hsi_stretched": f"""WITH {oracle.CELLS}, e AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM cells)
SELECT row, col, CAST(c AS INTEGER) AS k, {oracle.rounded("CAST(CAST((least(greatest(v, lo), hi) - lo) / (hi - lo + 1e-9) AS FLOAT) AS DOUBLE)")} AS value FROM cells, e""",
        "hsi_masked": _hsi(value="CASE WHEN col % 2 = 0 THEN CAST(s[b + 1] AS DOUBLE) END"),
        "hsi_band": oracle.index(oracle.band(10)),
        "hsi_pixel": f"WITH {oracle.PIXELS}, p AS (SELECT unnest(range(0, {BANDS})) AS k, unnest(s) AS v FROM px WHERE row = 3 AND col = 4) SELECT CAST(k AS INTEGER) AS k, {oracle.rounded('CAST(v AS DOUBLE)')} AS value FROM p",
        "band_cov": oracle.covariance(),
        "noise_cov": oracle.noise_covariance(),
        "pca_spectrum": oracle.spectrum(),
        "pca_whitened_cov": oracle.identity(5),
        "mnf_noise_cov": oracle.identity(5),
        "ica_cov": oracle.identity(3),
        "pp_cov": oracle.identity(3),
        "dwt1d": oracle.dwt1d(),
        "dwt1d_sym5_smooth": oracle.dwt1d_by_extension("sym5", "smooth", 2),
        "dwt1d_coif2_antireflect": oracle.dwt1d_by_extension("coif2", "antireflect", 2),
        "dwt1d_bior44_periodization": oracle.dwt1d_by_extension("bior4.4", "periodization", 2),
        "dwt2d": oracle.undecimated("haar", 1, False),
        "dwt2d_sym5": oracle.undecimated("sym5", 2, False),
        "dwt3d": oracle.undecimated("haar", 1, True),
        "dwt3d_rbio22": oracle.undecimated("rbio2.2", 1, True),
        "glcm_rgb": oracle.glcm(),
        "glcm_rgb_equalized": oracle.glcm(equalize=True),
        "lbp_rgb": oracle.lbp(),
        "lbp_rgb_ror": oracle.lbp_turned(),
        "gabor": oracle.gabor(range(BANDS)),
        "gabor_rgb": oracle.gabor(),
        "gabor_opponent_rgb": oracle.gabor(opponent=True),
        "mp_rgb": oracle.morphology(RADII),
        "mp_rgb_shapes": oracle.morphology((1, 3), ("disk", "diamond", "line")),
        "mp_rgb_reconstruction": oracle.morphology(RADII, ("square", "disk"), reconstruct=True),
        "geometric_moment_rgb": oracle.geometric(ORDER, SIZES),
        "legendre_moment_rgb": oracle.legendre(ORDER, SIZES),
        "zernike_moment_rgb": oracle.zernike(ORDER, SIZES),
    }
