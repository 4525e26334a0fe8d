"""Operators against fixed values for drawn images, and percentiles against numpy."""

import numpy as np
import pytest
from test_operators import cube_of, draw, image

from prismloom.operators.moment import GeometricMomentExtractor, LegendreMomentExtractor, ZernikeMomentExtractor
from prismloom.operators.morphology import MPExtractor
from prismloom.operators.reduction import ICAExtractor, MNFExtractor, PCAExtractor, PPExtractor
from prismloom.operators.wavelet import DWT1DExtractor, DWT2DExtractor
from prismloom.sources.cube import percentiles

# Expected features of images drawn by RandomState(42).
# The first row of pixels.
PCA_ROW = [[0.2774842, 0.46440527, 0.06909234], [0.644388, -0.6134839, -0.01987338], [0.16158254, 0.12348851, -0.1538901], [0.22280443, -0.24693222, -0.18409398], [0.40811694, 0.4917808, -0.13342306]]
ICA_ROW = [[0.28009173, -0.8886466, -1.18073642], [-0.99395734, -1.47108257, 1.66003823], [-0.43766952, -0.32563734, -0.43849036], [-0.82276291, -0.35997638, 0.53501362], [-0.32476985, -1.07117653, -1.39925683]]
MNF_ROW = [[0.16387971, -3.07541917, -1.66650856], [-0.81401273, -0.81344, 0.33103433], [-0.40692347, 0.41655914, 0.29755285], [1.17871348, 0.1943873, -0.26803931], [3.42934909, -1.99904697, 0.10944771]]
MNF_SNR = [2.40086154, 1.59773334, 1.17495214]
PP_ROW = [[-0.79909122, 0.20852612, 0.03628006], [1.96342134, -0.2751492, 1.53290534], [0.18659377, 0.77047849, 1.17713058], [0.92933339, 0.55912536, 0.60846531], [0.15774821, 1.43000901, -2.0064218]]
MP_ROW = [[-0.11318319, 0.46192884, 0.46192884, -0.18764016, -0.11295304, 0.4068605], [-0.11318319, 0.1809916, 0.45977724, -0.18764016, 0.471562, 0.471562]]
# The first pixel; of moments the first component.
DWT1D_PIXEL = [1.3279533, 0.61813641, -0.0026990175, -0.30612329, -0.40741667, 0.094282389, 0.00001706183, -0.57140774]
DWT2D_PIXEL = [0.9637817, -0.4332471, 0.02261129, 0.19593434]
GEOMETRIC_PIXEL = [1.99521767, 0.0, 0.42895742, 0.0, 0.0, 1.45023517]
LEGENDRE_PIXEL = [0.997608833, 0.0, -0.395977124, 0.0, 0.0, 1.31675774]
ZERNIKE_PIXEL = [0.58370347, 0.0, 1.22115461, 0.975248418]


@pytest.fixture(scope="module")
def drawn(spark):
    return cube_of(spark, draw(5, 5, 8))


def turned(found, wanted):
    """The features, each turned to the sign of the wanted ones: signs of components are free."""
    return found * np.where((found * np.asarray(wanted)).sum(axis=0) < 0, -1, 1)


def test_pca(drawn):
    # The second and third variance are nearly equal (0.1344 and 0.1342), so solvers differ in the fourth decimal.
    np.testing.assert_allclose(image(PCAExtractor(n_components=3).extract(drawn))[0], PCA_ROW, atol=5e-4)


def test_ica(drawn):
    np.testing.assert_allclose(image(ICAExtractor(n_components=3).extract(drawn))[0], ICA_ROW, atol=1e-4)


def test_mnf(drawn):
    found = MNFExtractor(n_components=3).extract(drawn)
    np.testing.assert_allclose(turned(image(found)[0], MNF_ROW), MNF_ROW, atol=1e-4)
    np.testing.assert_allclose(found.model.collect()[0]["snr_eigenvalues"], MNF_SNR, rtol=1e-5)


def test_pp(drawn):
    np.testing.assert_allclose(image(PPExtractor(n_projections=3).extract(drawn))[0], PP_ROW, atol=1e-4)


def test_mp(spark):
    found = image(MPExtractor(n_components=2, radii=(2,), shapes=("disk",)).extract(cube_of(spark, draw(8, 8, 5))))
    np.testing.assert_allclose(found[0, :2], MP_ROW, atol=1e-5)


def test_wavelets(spark, drawn):
    np.testing.assert_allclose(image(DWT1DExtractor(wavelet="haar", levels=2).extract(drawn))[0, 0], DWT1D_PIXEL, atol=1e-6)
    planes = image(DWT2DExtractor(wavelet="haar", levels=1).extract(cube_of(spark, draw(4, 4, 5))))
    np.testing.assert_allclose(planes[0, 0, : len(DWT2D_PIXEL)], DWT2D_PIXEL, atol=1e-6)


@pytest.mark.parametrize(("extractor", "wanted"), [(GeometricMomentExtractor, GEOMETRIC_PIXEL), (LegendreMomentExtractor, LEGENDRE_PIXEL), (ZernikeMomentExtractor, ZERNIKE_PIXEL)])
def test_moments(drawn, extractor, wanted):
    found = image(extractor(n_components=2, max_order=2, window_sizes=(3,)).extract(drawn))
    np.testing.assert_allclose(found[0, 0, : len(wanted)], wanted, atol=1e-4)


def test_percentiles(spark):
    rng = np.random.RandomState(0)
    cases = {"drawn": rng.rand(5001), "ties": np.array([3.0, 3.0, 7.0]), "one": np.array([1.5]), "far": np.r_[rng.rand(50), 1e300, -1e300], "few": rng.randint(0, 4, 200).astype(float)}
    rows = [(k, float(x)) for k, v in cases.items() for x in v] + [("drawn", None), ("none", None)]
    shares = (0.0, 0.02, 0.5, 0.98, 1.0)
    found = {r["image_id"]: r["p"] for r in percentiles(spark.createDataFrame(rows, "image_id string, v double"), shares).collect()}
    assert found.keys() == cases.keys()
    for name, values in cases.items():
        np.testing.assert_allclose(found[name], np.quantile(values, shares), rtol=1e-12)


def test_percentiles_of_values_without_end(spark):
    rows = [("i", v) for v in (float("inf"), float("-inf"), 1.0, float("nan"), 2.0)]
    found = percentiles(spark.createDataFrame(rows, "image_id string, v double"), (0.0, 0.25, 0.5, 0.75, 1.0)).collect()
    np.testing.assert_equal(found[0]["p"], [float("-inf"), 1.0, 2.0, float("inf"), float("nan")])


def test_percentiles_beside_an_outlier(spark):
    """An outlier by hundreds of orders of magnitude leaves a million values in one bin, which is looked into again, not put in order."""
    rows = spark.range(1_000_000).selectExpr("'i' AS image_id", "IF(id = 7, 1e300D, (id * 7919 % 1000003) / 1000003D) AS v").repartition(6)
    values = np.array([1e300 if i == 7 else (i * 7919 % 1000003) / 1000003 for i in range(1_000_000)])
    shares = (0.02, 0.5, 0.98)
    for few in (4096, 8):
        found = percentiles(rows, shares, few).first()["p"]
        np.testing.assert_allclose(found, np.quantile(values, shares), rtol=1e-12)


def test_percentiles_of_all_magnitudes(spark):
    """Rounds go on until few values are left, at whatever scale they lie; each looks 4096 times closer."""
    rng = np.random.RandomState(2)
    values = np.r_[10.0 ** rng.uniform(-12, 12, 4000), -(10.0 ** rng.uniform(-12, 12, 4000)), 0.0, np.full(50, 1e-5)]
    rows = spark.createDataFrame([("i", float(x)) for x in values], "image_id string, v double")
    shares = (0.0, 0.1, 0.3, 0.5, 0.77, 1.0)
    np.testing.assert_allclose(percentiles(rows, shares, 16).first()["p"], np.quantile(values, shares), rtol=1e-12)
