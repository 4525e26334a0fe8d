"""Operators against plain numpy and against what must hold of their results."""

import math
import tracemalloc
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismloom.functions.filters import filter_bank, names
from prismloom.functions.wavelets import MODES, most_levels, step_matrices, transform_matrix
from prismloom.operators.moment import GeometricMomentExtractor, LegendreMomentExtractor, ZernikeMomentExtractor, geometric_kernels, orders, zernike_kernels, zernike_orders
from prismloom.operators.morphology import MPExtractor, dilated, eroded, footprint
from prismloom.operators.reconstruction import geodesic, reconstructed
from prismloom.operators import reduction
from prismloom.operators.reduction import EDGE, ICAExtractor, MNFExtractor, PCAExtractor, PPExtractor, divergence
from prismloom.operators.spectral import NDVIExtractor, NDWIExtractor, SAVIExtractor
from prismloom.operators.texture import HARALICK, GaborExtractor, GLCMExtractor, LBPExtractor, haralick, quantised, raw_bands
from prismloom.operators.wavelet import DWT1DExtractor, DWT2DExtractor, DWT3DExtractor
from prismloom.sources.cube import embeddings_cube, from_arrays
from prismloom.sources.storage import beside


def draw(h, w, b, seed=42):
    return np.random.RandomState(seed).rand(h, w, b).astype(np.float32)


def cube_of(spark, array, lo=400, hi=900):
    return from_arrays(spark, {"a": array}, np.linspace(lo, hi, array.shape[2]))


def image(feature, name="a"):
    rows = feature.data.where(f"image_id = '{name}'").collect()
    h, w = max(r["row"] for r in rows) + 1, max(r["col"] for r in rows) + 1
    out = np.full((h, w, len(rows[0]["features"])), np.nan)
    for r in rows:
        out[r["row"], r["col"]] = r["features"]
    assert len(rows) == h * w and not np.isnan(out).any()
    return out


def test_indices(spark):
    a = draw(4, 5, 8)
    cube = cube_of(spark, a)
    near = lambda w: int(np.abs(np.linspace(400, 900, 8) - w).argmin())
    r, n, g = (a[:, :, near(w)].astype(float) for w in (660, 850, 560))
    np.testing.assert_allclose(image(NDVIExtractor().extract(cube))[:, :, 0], (n - r) / (n + r + 1e-6))
    np.testing.assert_allclose(image(NDWIExtractor().extract(cube))[:, :, 0], (g - n) / (g + n + 1e-6))
    np.testing.assert_allclose(image(SAVIExtractor(L=0.25).extract(cube))[:, :, 0], (n - r) * 1.25 / (n + r + 0.25))
    with pytest.raises(ValueError):
        NDVIExtractor(red_wavelength=-1).extract(cube)
    with pytest.raises(ValueError):
        SAVIExtractor(L=2).extract(cube)
    with pytest.warns(UserWarning):
        NDVIExtractor(red_wavelength=860, nir_wavelength=600).extract(cube)


def test_savi_of_zeros_is_nan(spark):
    cube = cube_of(spark, np.zeros((2, 2, 8), dtype=np.float32))
    assert all(math.isnan(r["features"][0]) for r in SAVIExtractor(L=0).extract(cube).data.collect())


def test_pca_of_several_images(spark):
    arrays = {"a": draw(6, 7, 5), "b": draw(4, 9, 5, 3)}
    cube = from_arrays(spark, arrays, np.linspace(400, 900, 5))
    for whiten in (False, True):
        found = PCAExtractor(n_components=3, whiten=whiten).extract(cube)
        for name, a in arrays.items():
            x = a.reshape(-1, 5).astype(float)
            x = x - x.mean(axis=0)
            _, s, vt = np.linalg.svd(x, full_matrices=False)
            signs = np.sign(vt[np.arange(5), np.abs(vt).argmax(axis=1)])
            want = (x @ (vt * signs[:, None]).T)[:, :3]
            if whiten:
                want = want / (s[:3] / np.sqrt(len(x) - 1))
            np.testing.assert_allclose(image(found, name).reshape(-1, 3), want, atol=1e-6)
    model = found.model.where("image_id = 'a'").first()
    assert np.all(np.diff(model["explained_variance"]) <= 0)
    np.testing.assert_allclose(np.array(model["components"]) @ np.array(model["components"]).T, np.eye(3), atol=1e-9)


def test_mnf_whitens_noise(spark):
    a = draw(5, 5, 8)
    found = MNFExtractor(n_components=4).extract(cube_of(spark, a))
    x = a.astype(float)
    diffs = np.concatenate([np.diff(x, axis=0).reshape(-1, 8), np.diff(x, axis=1).reshape(-1, 8)])
    noise = np.cov(diffs.T) / 2 + 1e-8 * np.eye(8)
    w = np.array(found.model.first()["whitening_matrix"])
    np.testing.assert_allclose(w @ noise @ w, np.eye(8), atol=1e-6)
    scores = image(found).reshape(-1, 4)
    np.testing.assert_allclose(np.cov(scores.T), np.diag(found.model.first()["snr_eigenvalues"]), atol=1e-6)


def test_ica_unmixes(spark):
    rng = np.random.RandomState(0)
    sources = np.stack([np.sign(rng.rand(400) - 0.5) + 0.05 * rng.rand(400), rng.laplace(size=400)], axis=1)
    a = (sources @ rng.rand(2, 4) + 3).reshape(20, 20, 4).astype(np.float32)
    found = ICAExtractor(n_components=2).extract(cube_of(spark, a))
    got = image(found).reshape(-1, 2)
    corr = np.abs(np.corrcoef(got.T, sources.T)[:2, 2:])
    assert (corr.max(axis=1) > 0.97).all()
    np.testing.assert_allclose(got.std(axis=0), 1, atol=1e-2)


@pytest.mark.parametrize("parts, block", [(1, 4096), (7, 4), (3, 9)])
def test_pp_against_numpy(spark, parts, block):
    """Whatever the order and the blocks of pixels."""
    a = draw(5, 5, 8)
    cube = cube_of(spark, a)
    cube = replace(cube, pixels=cube.pixels.repartition(parts))
    found = PPExtractor(n_projections=2, n_bins=32, pca_components=4, block=block).extract(cube)
    x = a.reshape(-1, 8).astype(float)
    x = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    white = x @ vt[:4].T / (s[:4] / np.sqrt(len(x) - 1))
    left, got = white.copy(), image(found).reshape(-1, 2)
    for p in range(2):
        best = None
        for v in left[np.linalg.norm(left, axis=1) >= 1e-10]:
            v = v / np.linalg.norm(v)
            u = left @ v
            u = (u - u.mean()) / (u.std() + 1e-10)
            limit = max(4.0, np.abs(u).max() + 0.5)
            code = np.clip(np.floor((u + limit) * (32 / (2 * limit)) + EDGE), 0, 31).astype(int)
            score = divergence(np.bincount(code, minlength=32), limit)
            if best is None or round(score, 9) > round(best[0], 9):
                best = (score, v)
        np.testing.assert_allclose(found.model.first()["divergence_scores"][p], best[0], rtol=1e-6)
        np.testing.assert_allclose(got[:, p], white @ best[1], atol=1e-6)
        left = left - np.outer(left @ best[1], best[1])


# The first taps of published analysis filters.
ANALYSIS = {
    "db2": [-0.12940952255092145, 0.22414386804185735, 0.836516303737469, 0.48296291314469025],
    "sym4": [-0.07576571478927333, -0.02963552764599851, 0.49761866763201545, 0.8037387518059161],
    "sym5": [0.027333068345077982, 0.029519490925774643, -0.039134249302383094, 0.1993975339773936],
    "sym7": [0.002681814568257878, -0.0010473848886829163, -0.01263630340325193, 0.03051551316596357],
    "sym13": [6.820325263075319e-05, -3.573862364868901e-05, -0.0011360634389281183, -0.0001709428585302221],
    "sym20": [3.695537474835221e-07, -1.9015675890554106e-07, -7.919361411976999e-06, 3.025666062736966e-06],
    "coif1": [-0.01565572813546454, -0.0727326195128539, 0.38486484686420286, 0.8525720202122554, 0.3378976624578092, -0.0727326195128539],
    "coif3": [-3.459977283621256e-05, -7.098330313814114e-05, 0.0004662169601128863, 0.0011175187708906016],
    "bior1.3": [-0.08838834764831845, 0.08838834764831845, 0.7071067811865476, 0.7071067811865476, 0.08838834764831845, -0.08838834764831845],
    "bior2.2": [0.0, -0.1767766952966369, 0.3535533905932738, 1.0606601717798214, 0.3535533905932738, -0.1767766952966369],
    "rbio2.2": [0.0, 0.0, 0.3535533905932738, 0.7071067811865476, 0.3535533905932738, 0.0],
    "bior4.4": [0.0, 0.03782845550726404, -0.023849465019556843, -0.11062440441843718, 0.37740285561283066, 0.8526986790088938],
    "bior5.5": [0.0, 0.0, 0.03968708834740544, 0.007948108637240322, -0.05446378846823691, 0.34560528195603346, 0.7366601814282105],
    "bior6.8": [0.0, 0.0019088317364812906, -0.0019142861290887667, -0.016990639867602342, 0.01193456527972926, 0.04973290349094079],
    "dmey": [0.0, -1.009999956941423e-12, 8.519459636796214e-09],
}


@pytest.mark.parametrize("wavelet", ANALYSIS)
def test_published_filters(wavelet):
    np.testing.assert_allclose(filter_bank(wavelet).low[: len(ANALYSIS[wavelet])], ANALYSIS[wavelet], rtol=1e-7, atol=1e-12)


def vanishing(taps, about=0.0):
    """How many moments from the 0th on are nothing, beside their sums of absolute terms."""
    at = (np.arange(len(taps)) - about).astype(np.longdouble)
    n = 0
    while n < 40:
        terms = taps * at**n
        if abs(terms.sum()) > 1e-9 * np.abs(terms).sum():
            return n
        n += 1
    return n


@pytest.mark.parametrize("wavelet", names())
def test_every_bank(wavelet):
    """Perfect reconstruction from even shifts, moments, and a transform that inverts."""
    bank = filter_bank(wavelet)
    n, close = len(bank), 3e-3 if wavelet == "dmey" else 1e-12
    assert n % 2 == 0 and len(bank.back) == len(bank.high) == n
    shifted = lambda a, b, m: sum(a[i] * b[n - 1 - i - 2 * m] for i in range(n) if 0 <= n - 1 - i - 2 * m < n)
    for m in range(-(n // 2) + 1, n // 2):
        assert abs(shifted(bank.low, bank.back, m) - (m == 0)) < close and abs(shifted(bank.high, bank.back_high, m) - (m == 0)) < close
        assert abs(shifted(bank.low, bank.back_high, m)) < close and abs(shifted(bank.high, bank.back, m)) < close
    np.testing.assert_allclose([bank.low.sum(), bank.back.sum()], math.sqrt(2), rtol=1e-12)
    family = wavelet.rstrip("0123456789.")
    order = [int(x) for x in wavelet[len(family) :].split(".") if x] or [1]
    if family in ("db", "sym") and order[0] <= 12:
        assert vanishing(bank.high) >= order[0]
    if family == "coif" and order[0] <= 4:
        middle = (np.arange(n) * bank.low).sum() / math.sqrt(2)
        moments = [(bank.low * (np.arange(n) - middle) ** k).sum() for k in range(1, 2 * order[0])]
        assert vanishing(bank.high) >= 2 * order[0] and abs(middle - round(middle)) < 1e-9 and np.abs(moments).max() < 1e-6
    if family == "bior":
        assert vanishing(bank.high) >= order[0] - (wavelet == "bior5.5") and vanishing(bank.back_high) >= order[1] - (wavelet == "bior5.5")
    if wavelet != "dmey":  # what a periodic transform loses nothing of, the synthesis gives back
        low, high = step_matrices(2 * n, wavelet, "periodization")
        assert np.linalg.matrix_rank(np.vstack([low, high])) == 2 * n
        if family in ("haar", "db", "sym", "coif"):
            np.testing.assert_allclose(np.vstack([low, high]) @ np.vstack([low, high]).T, np.eye(2 * n), atol=1e-12)


def extended(x, left, right, mode):
    kinds = {"symmetric": "symmetric", "reflect": "reflect", "periodic": "wrap", "zero": "constant", "constant": "edge"}
    if mode in kinds:
        return np.pad(x, (left, right), mode=kinds[mode])
    if mode in ("antireflect", "antisymmetric"):
        return np.pad(x, (left, right), mode=mode.removeprefix("anti"), reflect_type="odd") if mode == "antireflect" else np.concatenate([_turned(x, left)[::-1], x, _turned(x[::-1], right)])
    if mode == "smooth":
        return np.concatenate([x[0] + (x[0] - x[1]) * np.arange(left, 0, -1), x, x[-1] + (x[-1] - x[-2]) * np.arange(1, right + 1)])
    even = np.append(x, x[-1]) if len(x) % 2 else x
    return np.pad(even, (left, right), mode="wrap")


def _turned(x, n):
    """What stands before x, from its start outwards: backwards with the sign turned, then as it is, and so on."""
    return np.resize(np.concatenate([-x, x[::-1]]), n)


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("wavelet, n", [("haar", 7), ("sym5", 12), ("sym5", 5), ("bior2.6", 9), ("coif2", 4), ("dmey", 21), ("db3", 2)])
def test_modes(mode, wavelet, n):
    """One level against an extended signal filtered in full."""
    bank, x = filter_bank(wavelet), np.random.RandomState(n).rand(n)
    taps = len(bank)
    wide = extended(x, taps, taps + n % 2, mode)
    start = taps + (taps // 2 if mode == "periodization" else 1)
    size = -(-n // 2) if mode == "periodization" else (n + taps - 1) // 2
    for matrix, f in zip(step_matrices(n, wavelet, mode), (bank.low, bank.high), strict=True):
        want = np.convolve(wide, f)[start : start + 2 * size : 2][:size]
        np.testing.assert_allclose(matrix @ x, want, atol=1e-12)


@pytest.mark.parametrize("wavelet, mode", [("haar", "symmetric"), ("haar", "periodic"), ("db4", "symmetric"), ("db4", "zero"), ("sym5", "constant"), ("bior3.3", "smooth"), ("rbio1.5", "antireflect"), ("coif1", "periodization")])
def test_dwt1d_of_families_and_modes(spark, wavelet, mode):
    a = draw(3, 4, 50)
    levels = most_levels(50, len(filter_bank(wavelet)))
    got = image(DWT1DExtractor(wavelet, mode, None).extract(cube_of(spark, a)))
    np.testing.assert_allclose(got, a.astype(float) @ transform_matrix(50, wavelet, mode, levels).T, atol=1e-9)


@pytest.mark.parametrize("wavelet", ["db4", "sym5", "bior2.4", "coif1"])
def test_undecimated_of_families(spark, wavelet):
    """Filters wrap around the image; an image of two tiles shows no seam."""
    a = draw(66, 8, 4)
    bank, x = filter_bank(wavelet), a.astype(float)
    n = len(bank)
    along = lambda v, f, axis: sum(t * np.roll(v, j - n // 2, axis) for j, t in enumerate(f))
    two, three = [], []
    for f in (bank.low, bank.high):
        two += [along(along(x, g, 0), f, 1) for g in (bank.low, bank.high)]
        three += [along(along(along(x, f, 0), g, 1), h, 2) for g in (bank.low, bank.high) for h in (bank.low, bank.high)]
    np.testing.assert_allclose(image(DWT2DExtractor(wavelet).extract(cube_of(spark, a))), np.stack(two, axis=3).reshape(66, 8, -1), atol=1e-9)
    np.testing.assert_allclose(image(DWT3DExtractor(wavelet).extract(cube_of(spark, a))), np.concatenate(three, axis=2), atol=1e-9)


def test_wavelet_limits(spark):
    assert transform_matrix(64, "db4", "symmetric", 3).shape == (84, 64) and len(names()) == 1 + 38 + 19 + 17 + 30 + 1
    for bad in ("no such", "sym1", "db39", "bior2.3", "mexh"):
        with pytest.raises(ValueError):
            filter_bank(bad)
    with pytest.raises(ValueError):
        DWT1DExtractor("haar", "no such", 1).extract(cube_of(spark, draw(2, 2, 8)))


def test_dwt1d_haar(spark):
    a = draw(2, 3, 8)
    got = image(DWT1DExtractor("haar", "symmetric", 2).extract(cube_of(spark, a)))
    x, r = a.astype(float), math.sqrt(2)
    low, d1 = (x[..., ::2] + x[..., 1::2]) / r, (x[..., ::2] - x[..., 1::2]) / r
    want = np.concatenate([(low[..., ::2] + low[..., 1::2]) / r, (low[..., ::2] - low[..., 1::2]) / r, d1], axis=2)
    np.testing.assert_allclose(got, want, atol=1e-6)
    with pytest.raises(ValueError):
        DWT1DExtractor("haar", "symmetric", 9).extract(cube_of(spark, a))


@pytest.mark.parametrize("levels", [1, 2])
def test_dwt2d_and_3d_haar(spark, levels):
    a = draw(5, 6, 3)
    more = [-n % (1 << levels) for n in a.shape]
    x2 = np.pad(a.astype(float), ((0, more[0]), (0, more[1]), (0, 0)), mode="reflect")
    x3 = np.pad(a.astype(float), [(0, m) for m in more], mode="reflect")
    step = lambda x, axis, s, sign: (x + sign * np.roll(x, -s, axis)) / math.sqrt(2)
    two, three, p, q = [], [], x2, x3
    for level in range(levels):
        s = 1 << level
        lo, hi = step(p, 0, s, 1), step(p, 0, s, -1)
        two.append(np.stack([step(lo, 1, s, 1), step(hi, 1, s, 1), step(lo, 1, s, -1), step(hi, 1, s, -1)], axis=3))
        p = two[-1][..., 0]
        for k0 in (1, -1):
            for k1 in (1, -1):
                for k2 in (1, -1):
                    three.append(step(step(step(q, 0, s, k0), 1, s, k1), 2, s, k2))
        q = three[-8]
    want2 = np.stack(two, axis=3)[:5, :6].reshape(5, 6, -1)
    want3 = np.concatenate([t[:5, :6, :3] for t in three], axis=2)
    np.testing.assert_allclose(image(DWT2DExtractor("haar", levels).extract(cube_of(spark, a))), want2, atol=1e-6)
    np.testing.assert_allclose(image(DWT3DExtractor("haar", levels).extract(cube_of(spark, a))), want3, atol=1e-6)


def test_tiles_don_t_show(spark):
    """An image of several tiles gives what one padded array gives."""
    a = draw(70, 131, 2)
    cube = cube_of(spark, a)
    for mode, extractor, size, kernels in (("reflect", GeometricMomentExtractor(bands=(0, 1), max_order=1, window_sizes=(9,)), 9, geometric_kernels(9, 1, True)), ("symmetric", GaborExtractor(n_scales=1, n_orientations=2), 13, np.stack([GaborExtractor.kernel(*f) for f in GaborExtractor(n_scales=1, n_orientations=2).filters()]))):
        h = size // 2
        wide = np.pad(a.astype(float), ((h, h), (h, h), (0, 0)), mode=mode)
        view = np.lib.stride_tricks.sliding_window_view(wide, (size, size), axis=(0, 1))
        want = np.einsum("rcbij,kij->rcbk", view, kernels).reshape(70, 131, -1)
        np.testing.assert_allclose(image(extractor.extract(cube)), want, atol=1e-6)


def test_moments(spark):
    a = draw(5, 5, 4)
    cube = cube_of(spark, a)
    got = image(GeometricMomentExtractor(bands=(1,), max_order=1, window_sizes=(3,), normalize_coords=False).extract(cube))
    wide = np.pad(a[:, :, 1].astype(float), 1, mode="reflect")
    np.testing.assert_allclose(got[2, 2, 0], wide[2:5, 2:5].sum(), rtol=1e-6)
    assert got.shape[2] == len(orders(1)) == 3
    flat = cube_of(spark, np.full((1, 1, 4), 3, dtype=np.float32))
    np.testing.assert_allclose(image(LegendreMomentExtractor(bands=(0,), max_order=0, window_sizes=(5,)).extract(flat))[0, 0, 0], 25 * 3 / 2)
    patch = draw(9, 9, 1)[:, :, 0]
    sums = lambda p: np.hypot(*[(zernike_kernels(9, 4)[i::2] * p).sum(axis=(1, 2)) for i in (0, 1)])
    np.testing.assert_allclose(sums(patch), sums(np.rot90(patch)), atol=1e-9)
    assert image(ZernikeMomentExtractor(n_components=2, max_order=4, window_sizes=(3,)).extract(cube)).shape[2] == 2 * len(zernike_orders(4))
    with pytest.raises(ValueError):
        GeometricMomentExtractor(window_sizes=(4,)).extract(cube)


def test_morphology(spark):
    a = draw(9, 11, 3)
    found = MPExtractor(n_components=2, radii=(2, 1), shapes=("disk", "line")).extract(cube_of(spark, a))
    got = image(found).reshape(9, 11, 2, 2, 5)
    pcs = image(PCAExtractor(n_components=2).extract(cube_of(spark, a)))
    known = np.ones((9, 11), dtype=bool)
    for c in range(2):
        for s, shape in enumerate(("disk", "line")):
            p = pcs[:, :, c]
            opened = {r: dilated(eroded(p, known, footprint(shape, r)), known, footprint(shape, r)) for r in (1, 2)}
            np.testing.assert_allclose(got[:, :, c, s, 0], opened[2], atol=1e-9)
            np.testing.assert_allclose(got[:, :, c, s, 1], opened[1], atol=1e-9)
            np.testing.assert_allclose(got[:, :, c, s, 2], p, atol=1e-9)
            assert (got[:, :, c, s, 1] <= p + 1e-9).all() and (got[:, :, c, s, 3] >= p - 1e-9).all() and (got[:, :, c, s, 4] >= got[:, :, c, s, 3] - 1e-9).all()


def test_reconstruction_crosses_tiles(spark):
    """A long bright line over three tiles comes back whole; a dot goes."""
    a = np.zeros((10, 150, 1), dtype=np.float32)
    a[4:7, 3:148] = 1
    a[1, 1] = 1
    got = image(MPExtractor(bands=(0,), radii=(1,), shapes=("square",), use_reconstruction=True).extract(cube_of(spark, a)))
    want = a[:, :, 0].copy()
    want[1, 1] = 0
    np.testing.assert_allclose(got[:, :, 0], want)
    marker = np.zeros((3, 3))
    marker[0, 0] = 1
    np.testing.assert_allclose(reconstructed(marker, np.eye(3)), np.eye(3))


def test_glcm(spark):
    a = draw(8, 9, 1)
    found = GLCMExtractor(distances=(1,), angles=(0,), levels=4, window_sizes=(3,), equalize=False, spectral_reduction=None).extract(cube_of(spark, a))
    got = image(found)
    x = a[:, :, 0].astype(float)
    q = np.floor((x - x.min()) / (x.max() - x.min()) * 3).astype(int)
    codes = np.pad(q * 4 + np.roll(q, -1, axis=1), 1, mode="symmetric")
    p = np.bincount(codes[2:5, 3:6].ravel(), minlength=16).reshape(4, 4) / 9
    i, j = np.indices((4, 4))
    np.testing.assert_allclose(got[2, 3, 0], (p * p).sum(), rtol=1e-6)
    np.testing.assert_allclose(got[2, 3, 1], ((i - j) ** 2 * p).sum(), rtol=1e-6)
    assert got.shape[2] == len(HARALICK) and np.isfinite(got).all()
    even = np.full((1, 4, 4), 1 / 16)
    i, j = (v.reshape(1, -1) for v in np.indices((4, 4)))
    np.testing.assert_allclose(haralick(i, j, 4, ["entropy", "asm", "correlation"])[0], [math.log(16), 1 / 16, 0], atol=1e-6)
    both = GLCMExtractor(levels=8, window_sizes=(3,), features=("asm", "entropy"), angle_pooling="mean+range", n_components=2).extract(cube_of(spark, draw(8, 9, 5)))
    assert image(both).shape[2] == 8 == both.metadata["n_features"]
    several = GLCMExtractor(levels=8, window_sizes=(3, 5), features=("asm", "entropy"), angle_pooling="mean+range", n_components=2).extract(cube_of(spark, draw(8, 9, 5)))
    alone = GLCMExtractor(levels=8, window_sizes=(5,), features=("asm", "entropy"), angle_pooling="mean+range", n_components=2).extract(cube_of(spark, draw(8, 9, 5)))
    assert several.metadata["n_features"] == 16
    np.testing.assert_allclose(image(several), np.concatenate([image(both), image(alone)], axis=2), atol=1e-9)
    with pytest.raises(ValueError):
        GLCMExtractor(features=("nothing",)).extract(cube_of(spark, a))


@pytest.mark.parametrize("method", ["default", "ror", "uniform", "nri_uniform", "var"])
def test_lbp(spark, method):
    a = draw(6, 7, 3)
    found = LBPExtractor(radius=(1, 2), n_points=(4, 8), method=method, spectral_mode="bands", band_indices=(0, 2)).extract(cube_of(spark, a))
    got = image(found)
    assert got.shape[2] == 4
    if method == "default":
        x = a[:, :, 0].astype(float)
        q = np.pad(np.floor(255 * (x - x.min()) / (x.max() - x.min() + 1e-8)), 1)
        c = q[1:-1, 1:-1]
        want = 1 * (q[1:-1, 2:] >= c) + 2 * (q[:-2, 1:-1] >= c) + 4 * (q[1:-1, :-2] >= c) + 8 * (q[2:, 1:-1] >= c)
        np.testing.assert_array_equal(got[:, :, 0], want)
    if method == "uniform":
        assert got[:, :, 0].max() <= 5


def test_gabor_axes(spark):
    """Orientation 0 answers to what changes along rows."""
    t = np.arange(50)
    by_row = np.repeat(np.sin(2 * np.pi * 0.45 * t)[:, None], 50, axis=1)
    a = np.stack([by_row, by_row.T], axis=2).astype(np.float32)
    got = image(GaborExtractor(n_scales=1, n_orientations=2).extract(cube_of(spark, a)))
    energy = (got[15:35, 15:35] ** 2).mean(axis=(0, 1))
    assert energy[0] > 10 * energy[1] and energy[3] > 10 * energy[2]
    assert [len(GaborExtractor.kernel(*f)) for f in GaborExtractor().filters()] == [13] * 4 + [25] * 4
    with pytest.raises(ValueError):
        GaborExtractor(use_opponent=True).extract(cube_of(spark, draw(3, 3, 12)))


def dense_haralick(p):
    """All statistics of one matrix of co-occurrence probabilities, from its cells."""
    n, eps = len(p), 1e-12
    i, j = np.indices(p.shape)
    px, py, k = p.sum(axis=1), p.sum(axis=0), np.arange(n)
    total = np.bincount((i + j).ravel(), p.ravel(), 2 * n - 1)
    apart = np.bincount(np.abs(i - j).ravel(), p.ravel(), n)
    entropy = lambda q: -(q * np.log(q + eps)).sum()
    ux, uy = px @ k, py @ k
    vx, vy = px @ (k - ux) ** 2, py @ (k - uy) ** 2
    hx, hy, hxy, se, ks = entropy(px), entropy(py), entropy(p), entropy(total), np.arange(2 * n - 1)
    correlation = ((i * j * p).sum() - ux * uy) / ((math.sqrt(vx) + eps) * (math.sqrt(vy) + eps) + eps)
    return [(p * p).sum(), ((i - j) ** 2 * p).sum(), correlation, vx, (p / (1 + (i - j) ** 2)).sum(), total @ ks, total @ (ks - se) ** 2, se, hxy, apart.var(), entropy(apart), (hxy - hx - hy) / (max(hx, hy) + eps), math.sqrt(max(0, 1 - math.exp(-2 * (hx + hy - hxy))))]


@pytest.mark.parametrize("h, w, levels, size, distance, angle", [(5, 6, 4, 3, 1, 0), (4, 3, 16, 7, 1, 3 * math.pi / 4), (70, 9, 256, 5, 3, math.pi / 2), (9, 67, 7, 3, 66, 0), (66, 66, 5, 3, 65, math.pi / 4)])
def test_glcm_against_matrices(spark, h, w, levels, size, distance, angle):
    """Whatever the tiles; offsets wrap around the image and windows repeat its edge."""
    a = np.random.RandomState(h).rand(h, w, 1).astype(np.float32)
    found = GLCMExtractor(distances=(distance,), angles=(angle,), levels=levels, window_sizes=(size,), equalize=False, spectral_reduction=None)
    x = a[:, :, 0].astype(float)
    q = np.floor((x - x.min()) / (x.max() - x.min()) * (levels - 1)).astype(int)
    offset = round(math.sin(angle) * distance), round(math.cos(angle) * distance)
    code = np.pad(q * levels + np.roll(q, (-offset[0], -offset[1]), (0, 1)), size // 2, mode="symmetric")
    got, at = image(found.extract(cube_of(spark, a))), np.random.RandomState(1)
    for r, c in [(0, 0), (h - 1, w - 1), *((at.randint(h), at.randint(w)) for _ in range(40))]:
        p = np.bincount(code[r : r + size, c : c + size].ravel(), minlength=levels * levels).reshape(levels, levels) / (size * size)
        np.testing.assert_allclose(got[r, c], dense_haralick(p / (p.sum() + 1e-12)), rtol=1e-6, atol=1e-7)


def test_glcm_memory_of_a_tile():
    """With 256 levels and windows of 15 a tile takes some tens of megabytes, not 65,536 cells a pixel."""
    import tracemalloc

    from prismloom.operators.texture import windowed_haralick

    q = np.random.RandomState(0).randint(0, 256, (2, 64 + 14, 64 + 14))
    tracemalloc.start()
    windowed_haralick(q[0], q[1], 15, 256, HARALICK)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6


def dilated_within(marker, mask):
    """Reconstruction by single steps."""
    square = footprint("square", 1)
    while True:
        new = np.minimum(dilated(marker, np.ones(marker.shape, dtype=bool), square), mask)
        if np.array_equal(new, marker):
            return new
        marker = new


def spiral(h, w):
    """A mask on which a level has to wind through all tiles."""
    mask = np.zeros((h, w))
    for r in range(0, h, 4):
        mask[r] = 1 - r / 1000
        mask[r : r + 5, w - 1 if r % 8 == 0 else 0] = 1 - r / 1000
    return mask


@pytest.mark.parametrize("h, w, tile", [(1, 1, 4), (9, 7, 4), (33, 18, 4), (64, 64, 8), (40, 3, 8), (5, 41, 2)])
def test_geodesic_against_single_steps(spark, h, w, tile):
    """Winding paths, plateaus and noise, two images at once, one of them smaller than a tile."""
    rng = np.random.RandomState(h + w)
    images, want = {}, {}
    for name, (a, b) in {"a": (h, w), "b": (min(h, 3), min(w, 2))}.items():
        masks = np.stack([rng.rand(a, b), spiral(a, b), np.round(rng.rand(a, b) * 3)], axis=2)
        marks = np.stack([np.minimum(masks[..., m], np.where(rng.rand(a, b) < 0.05, masks[..., m], -1)) for m in (0, 1, 1, 2)], axis=2)
        marks[0, 0, 1] = masks[0, 0, 1]
        images[name] = np.concatenate([marks, masks], axis=2)
        want[name] = np.stack([dilated_within(marks[..., i], masks[..., m]) for i, m in enumerate((0, 1, 1, 2))], axis=2)
    rows = [(name, r, c, x[r, c].tolist()) for name, x in images.items() for r in range(x.shape[0]) for c in range(x.shape[1])]
    cells = spark.createDataFrame(rows, "image_id string, row int, col int, values array<double>").repartition(5)
    sizes = cells.groupBy("image_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    got = {name: np.full(x.shape, np.nan) for name, x in want.items()}
    found = geodesic(cells, sizes, (0, 1, 1, 2), tile).collect()
    assert len(found) == len(rows)
    for r in found:
        got[r["image_id"]][r["row"], r["col"]] = r["values"]
    for name in want:
        np.testing.assert_array_equal(got[name], want[name])


def test_noise_of_tiles_and_holes(spark):
    """Differences across tiles count once; a missing pixel has none."""
    a = draw(9, 7, 3).astype(float)
    cube = cube_of(spark, a)
    x = a.astype(np.float32).astype(float)
    for tile in (64, 4, 2, 1):
        found = np.array(reduction.noise_scatter(replace(cube), tile).first()["gram"])
        d = np.concatenate([np.diff(x, axis=0).reshape(-1, 3), np.diff(x, axis=1).reshape(-1, 3)])
        d = np.hstack([np.ones((len(d), 1)), d])
        np.testing.assert_allclose(found, d.T @ d, atol=1e-9)
    holed = replace(cube, pixels=cube.pixels.where("NOT (row = 3 AND col = 3)"))
    assert reduction.noise_scatter(holed, 4).first()["gram"][0][0] == 8 * 7 + 9 * 6 - 4


def test_mnf_asks_for_neighbours(spark):
    for shape in ((1, 5), (5, 1)):
        with pytest.raises(ValueError, match="2 x 2"):
            MNFExtractor().extract(cube_of(spark, draw(*shape, 4)))
    gram = np.diag([5.0, 1.0, 1.0, 1.0])
    with pytest.warns(UserWarning, match="below 0"):
        reduction.noise_ordered(gram, np.diag([5.0, -1.0, 1.0, 1.0]), 2)


def test_pp_asks_for_finite_pixels(spark):
    a = draw(3, 3, 4)
    a[:, :, 1] = np.nan
    with pytest.raises(ValueError, match="finite"):
        PPExtractor().extract(cube_of(spark, a))


@pytest.mark.parametrize("whiten", ["unit-variance", "arbitrary-variance"])
def test_ica_reconstruction_error(spark, whiten):
    a = draw(9, 8, 6)
    a[2, 3, 1] = np.inf
    found = ICAExtractor(n_components=3, whiten=whiten, most_rounds=20).extract(cube_of(spark, a))
    model = found.model.first()
    x = a.reshape(-1, 6).astype(float)
    x = x[np.isfinite(x).all(axis=1)]
    centred = x - x.mean(axis=0)
    back = centred @ np.array(model["components"]).T @ np.array(model["mixing_matrix"]).T
    np.testing.assert_allclose(model["reconstruction_error"], np.mean((centred - back) ** 2), rtol=1e-9)
    assert 0 < model["reconstruction_error"] < centred.var()


def test_one_gram_for_all(spark, monkeypatch):
    """Five extractors with components of their own sum one Gram matrix, and using their features sums none again."""
    asked = []
    monkeypatch.setattr(reduction, "gram", lambda *a, real=reduction.gram: asked.append(a) or real(*a))
    cube = cube_of(spark, draw(6, 6, 5))
    found = [e.extract(cube) for e in (PCAExtractor(2), PCAExtractor(3, whiten=True), MPExtractor(n_components=1, radii=(1,)), GLCMExtractor(window_sizes=(3,)), GeometricMomentExtractor(window_sizes=(3,)), MNFExtractor())]
    assert len(asked) == 1
    for f in found:
        assert f.data.count() == 36
        plan = f.data._jdf.queryExecution().executedPlan().toString()
        assert "gram" not in plan or "MapInArrow" in plan
    assert len(asked) == 1
    PCAExtractor(2).extract(replace(cube, pixels=cube.pixels.where("row < 5")))
    assert len(asked) == 2


def test_models_beside_pixels(spark):
    """Broadcast or dealt to slots, with the same rows, and by a hash of the key in either case."""
    rows = spark.range(500).selectExpr("concat('i', id % 3) AS image_id", "int(id) AS row", "int(id % 7) AS col")
    models = spark.createDataFrame([("i0", 1.0), ("i1", 2.0)], "image_id string, m double")
    near, dealt = beside(rows, models, 100), beside(rows, models, 100, most=0)
    assert sorted(near.collect()) == sorted(dealt.collect()) and near.count() == 334
    cube = embeddings_cube(spark, "/root/testdata/sf0.001")
    for data in (PCAExtractor().extract(cube).data, MNFExtractor().extract(cube).data, cube.pseudo_rgb().stretched().pixels, DWT2DExtractor().extract(cube).data):
        assert "NestedLoop" not in data._jdf.queryExecution().executedPlan().toString()


H, W, LAST = 67, 6, 4


def short_cube(spark, bands=1):
    """An image of 67 x 6 whose last row has four pixels, as a table has whose number of rows 6 doesn't divide; more than a tile high."""
    a = draw(H, W, bands)
    cube = cube_of(spark, a)
    there = np.ones((H, W), dtype=bool)
    there[-1, LAST:] = False
    return replace(cube, pixels=cube.pixels.where((F.col("row") < H - 1) | (F.col("col") < LAST))), a.astype(float), there


def short_image(feature, there):
    """Features by place, NaN elsewhere; there must be a row for each pixel and none besides."""
    rows = feature.data.collect()
    assert sorted((r["row"], r["col"]) for r in rows) == sorted(zip(*(x.tolist() for x in np.nonzero(there)), strict=True))
    out = np.full((*there.shape, len(rows[0]["features"])), np.nan)
    for r in rows:
        out[r["row"], r["col"]] = r["features"]
    return out


def windowed_pairs(q, there, r, c, dr, dc):
    """Pairs of levels in the 3 x 3 window, the edge repeated and neighbours wrapped around, where both are there."""
    found = {}
    for y in range(r - 1, r + 2):
        for x in range(c - 1, c + 2):
            a = (min(max(y, 0), H - 1), min(max(x, 0), W - 1))
            b = ((a[0] + dr) % H, (a[1] + dc) % W)
            if there[a] and there[b]:
                found[q[a], q[b]] = found.get((q[a], q[b]), 0) + 1 / 9
    return found


def check_short_glcm(spark, equalize):
    cube, _, there = short_cube(spark)
    q = np.full(there.shape, -1)
    for row in quantised(raw_bands(cube), 4, equalize).collect():
        q[row["row"], row["col"]] = row["values"][0]
    got = short_image(GLCMExtractor(angles=(0, math.pi / 2), levels=4, window_sizes=(3,), equalize=equalize, spectral_reduction=None, features=("asm", "contrast")).extract(cube), there)
    for r, c in zip(*np.nonzero(there), strict=True):
        pairs = [windowed_pairs(q, there, r, c, *d) for d in ((0, 1), (1, 0))]
        np.testing.assert_allclose(got[r, c], [np.mean([sum(v * v for v in p.values()) for p in pairs]), np.mean([sum((i - j) ** 2 * v for (i, j), v in p.items()) for p in pairs])], rtol=1e-9)


def test_glcm_of_a_last_row_that_is_not_full(spark):
    check_short_glcm(spark, False)
    # A window's pairs with places that hold nothing don't count; without any pair it has no statistics.
    i, j = np.array([[1, -1, 2], [-1, 1, -1]]), np.array([[0, 2, 2], [3, -1, -1]])
    got = haralick(i, j, 256, ("asm", "contrast"))
    np.testing.assert_allclose(got, [[2 / 9, 1 / 3], [np.nan, np.nan]])


def test_equalised_glcm_of_a_last_row_that_is_not_full(spark):
    check_short_glcm(spark, True)


def test_lbp_and_gabor_of_a_last_row_that_is_not_full(spark):
    """Places without a pixel hold 0 and have no row."""
    cube, a, there = short_cube(spark)
    got = short_image(LBPExtractor(radius=1, n_points=4, method="default", spectral_mode="bands", band_indices=(0,)).extract(cube), there)
    x, lo, hi = a[:, :, 0], a[there].min(), a[there].max()
    q = np.pad(np.where(there, np.floor(255 * (x - lo) / (hi - lo + 1e-8)), 0), 1)
    c = q[1:-1, 1:-1]
    want = 1 * (q[1:-1, 2:] >= c) + 2 * (q[:-2, 1:-1] >= c) + 4 * (q[1:-1, :-2] >= c) + 8 * (q[2:, 1:-1] >= c)
    np.testing.assert_array_equal(got[there][:, 0], want[there])
    short_image(GaborExtractor().extract(cube), there)


@pytest.mark.parametrize("shapes", [("square",), ("disk", "diamond", "line")])
def test_profiles_of_a_last_row_that_is_not_full(spark, shapes):
    cube, a, there = short_cube(spark)
    got = short_image(MPExtractor(bands=(0,), radii=(2,), shapes=shapes).extract(cube), there)
    for s, shape in enumerate(shapes):
        at = footprint(shape, 2)
        opened, closed = dilated(eroded(a[:, :, 0], there, at), there, at), eroded(dilated(a[:, :, 0], there, at), there, at)
        np.testing.assert_allclose(got[there][:, 3 * s : 3 * s + 3], np.stack([opened, a[:, :, 0], closed], axis=2)[there])


def test_reconstruction_of_a_last_row_that_is_not_full(spark):
    """Nothing goes through places without a pixel: the dark end of the last row doesn't reach the dark pixel past them."""
    cube, a, there = short_cube(spark)
    a[:] = 1
    a[-1], a[-2, -1] = 0, 0.25
    flat = spark.createDataFrame([(r, c, float(a[r, c, 0])) for r, c in zip(*(x.tolist() for x in np.nonzero(there)), strict=True)], "row int, col int, v double")
    cube = replace(cube, pixels=cube.pixels.drop("spectrum").join(flat, ["row", "col"]).withColumn("spectrum", F.array(F.col("v").cast("float"))))
    got = short_image(MPExtractor(bands=(0,), radii=(1,), shapes=("line",), use_reconstruction=True).extract(cube), there)
    x, at = a[:, :, 0], footprint("line", 1)
    opened = dilated_within(np.where(there, eroded(x, there, at), -np.inf), np.where(there, x, -np.inf))
    closed = -dilated_within(np.where(there, -dilated(x, there, at), -np.inf), np.where(there, -x, -np.inf))
    assert closed[-2, -1] == 1 and closed[-1, 0] == 0
    np.testing.assert_allclose(got[there], np.stack([opened, x, closed], axis=2)[there])


def test_pursuit_s_tasks_hold_few_blocks(spark):
    """Batches of blocks stay small, and so does what a task takes of one, however many pixels an image has."""
    rng, k = np.random.RandomState(3), 40
    x, c = rng.rand(4 * 4096, k), rng.rand(1000, k)
    lists = lambda a: pa.ListArray.from_arrays(np.arange(len(a) + 1, dtype=np.int32) * k, pa.array(a.ravel()))
    blocks = pa.ListArray.from_arrays(np.arange(5, dtype=np.int32) * 4096, lists(x))
    one = pa.StructArray.from_arrays([pa.array(np.arange(1000)), lists(c)], ["candidate", "vector"])
    every = pa.ListArray.from_arrays(np.arange(5, dtype=np.int32) * 1000, pa.concat_arrays([one] * 4))
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 4), blocks, every], ["image_id", "x", "c"])
    tracemalloc.start()
    for i, names, scores in reduction.block_scores(batch):
        np.testing.assert_allclose(np.concatenate([s[:, :3].copy() for s in scores]), x[4096 * i : 4096 * (i + 1)] @ c[:3].T)
        assert names.to_pylist() == list(range(1000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    PPExtractor(n_projections=1, pca_components=2).extract(cube_of(spark, draw(4, 4, 4)))
    sizes = spark.range(0, 64, 1, 1).select(F.array_repeat(F.col("id").cast("double"), 1 << 16).alias("x")).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in batches), "n bigint")
    assert sizes.agg(F.max("n")).first()[0] <= 17
