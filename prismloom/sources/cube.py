"""Hyperspectral images as DataFrames of pixels, a row for each image, row and column."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismloom.sources.storage import MOST_BROADCAST, beside, written

PIXELS = "image_id string, row int, col int, spectrum array<float>, valid boolean"
#: Nanometres by which the nearest band may be off before a warning.
FAR_BAND = 50.0


@dataclass(frozen=True)
class Cube:
    """Images with the same bands: pixels (image_id, row, col, spectrum, valid), wavelengths in nanometres, metadata."""

    pixels: DataFrame
    wavelengths: tuple[float, ...]
    metadata: Mapping[str, object] = field(default_factory=dict)
    #: What several operators ask of the same pixels, worked out once; a changed cube begins anew.
    known: dict[str, DataFrame] = field(default_factory=dict, init=False, repr=False, compare=False)

    def __post_init__(self):
        missing = {"image_id", "row", "col", "spectrum", "valid"} - set(self.pixels.columns)
        if missing:
            raise ValueError(f"pixels have no {', '.join(sorted(missing))}")
        if not self.wavelengths:
            raise ValueError("wavelengths are missing")

    @property
    def n_bands(self) -> int:
        return len(self.wavelengths)

    def once(self, name: str, work: Callable[[], DataFrame]) -> DataFrame:
        """A small table about the pixels, written the first time that it is asked for."""
        if name not in self.known:
            self.known[name] = written(work(), name)
        return self.known[name]

    def images(self) -> DataFrame:
        """(image_id, height, width)."""
        return self.once("images", lambda: self.pixels.groupBy("image_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width")))

    def nearest_band(self, wavelength: float) -> int:
        """The band whose wavelength is nearest, of several the first; warns if it is far off."""
        if wavelength <= 0:
            raise ValueError("a wavelength must be positive")
        apart = np.abs(np.asarray(self.wavelengths, dtype=np.float64) - wavelength)
        at = int(apart.argmin())
        if apart[at] > FAR_BAND:
            warnings.warn(f"the band nearest to {wavelength} nm is {apart[at]:.1f} nm off", stacklevel=2)
        return at

    def band_indices(self) -> list[int]:
        return list(range(self.n_bands))

    def _band_exists(self, band: int) -> None:
        if not 0 <= band < self.n_bands:
            raise IndexError(f"band {band} is not within 0 to {self.n_bands - 1}")

    def value(self, band: int) -> Column:
        self._band_exists(band)
        return F.col("spectrum")[band].cast("double")

    def band(self, band: int) -> DataFrame:
        """(image_id, row, col, value) of a band."""
        return self.pixels.select("image_id", "row", "col", self.value(band).alias("value"))

    def pixel(self, row: int, col: int) -> DataFrame:
        """(image_id, spectrum) at a place in every image."""
        found = self.pixels.where((F.col("row") == row) & (F.col("col") == col)).select("image_id", "spectrum")
        if row < 0 or col < 0 or found.isEmpty():
            raise IndexError(f"no image has a pixel ({row}, {col})")
        return found

    def masked(self) -> Cube:
        """Pixels that aren't valid have NaN in all bands."""
        none = F.array_repeat(F.lit(float("nan")).cast("float"), self.n_bands)
        return replace(self, pixels=self.pixels.withColumn("spectrum", F.when(F.col("valid"), F.col("spectrum")).otherwise(none)))

    def describe(self) -> DataFrame:
        """A row an image: height, width, bands, least and greatest wavelength, valid and total pixels."""
        sized = self.pixels.groupBy("image_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"), F.count_if("valid").alias("valid_pixels"), F.count("*").alias("total_pixels"))
        extra = {"bands": F.lit(self.n_bands), "wavelength_min": F.lit(float(min(self.wavelengths))), "wavelength_max": F.lit(float(max(self.wavelengths)))}
        return sized.withColumns(extra).select("image_id", "height", "width", *extra, "valid_pixels", "total_pixels")

    def select_bands(self, bands: Sequence[int]) -> Cube:
        for b in bands:
            self._band_exists(b)
        return replace(self, pixels=self.pixels.withColumn("spectrum", F.array(*(F.col("spectrum")[b] for b in bands))), wavelengths=tuple(self.wavelengths[b] for b in bands))

    def pseudo_rgb(self, red: float = 650, green: float = 550, blue: float = 450) -> Cube:
        return self.select_bands([self.nearest_band(w) for w in (red, green, blue)])

    def stretched(self, low: float = 0.02, high: float = 0.98) -> Cube:
        """Reflectance clipped to two percentiles of each image and scaled to 0 to 1, as for display."""
        ends = percentiles(self.pixels.select("image_id", F.explode(F.col("spectrum").cast("array<double>")).alias("v")), (low, high))
        scaled = lambda x: (F.least(F.greatest(x.cast("double"), F.col("p")[0]), F.col("p")[1]) - F.col("p")[0]) / (F.col("p")[1] - F.col("p")[0] + 1e-9)
        pixels = beside(self.pixels, ends, 64).withColumn("spectrum", F.transform("spectrum", lambda x: scaled(x).cast("float")))
        return replace(self, pixels=pixels.drop("p"))

    def crop(self, rows: slice | None = None, cols: slice | None = None) -> Cube:
        """Rows and columns by Python slices (negative ends and steps too), renumbered from 0; no slice changes nothing."""
        if rows is None and cols is None:
            return self
        pixels = beside(self.pixels, self.images(), 64)
        for name, size, part in (("row", "height", rows), ("col", "width", cols)):
            if part is not None:
                inside, place = _sliced(F.col(name), F.col(size), part)
                pixels = pixels.where(inside).withColumn(name, place.cast("int"))
        return replace(self, pixels=pixels.drop("height", "width"))

    def crop_center(self, size: int | None = None) -> Cube:
        """The square of the size in the middle of each image; an image no larger than it stays whole."""
        if size is None:
            return self
        pixels = beside(self.pixels, self.images(), 64)
        whole = (F.lit(size) >= F.col("height")) & (F.lit(size) >= F.col("width"))
        low = {n: F.floor((F.col(s) - size) / 2) for n, s in (("row", "height"), ("col", "width"))}
        # A side shorter than the size has a negative start, which counts from its end, as slices do.
        start = {n: F.when(low[n] < 0, F.greatest(low[n] + F.col(s), F.lit(0))).otherwise(low[n]) for n, s in (("row", "height"), ("col", "width"))}
        stop = {n: F.when(low[n] + size < 0, low[n] + size + F.col(s)).otherwise(low[n] + size) for n, s in (("row", "height"), ("col", "width"))}
        inside = whole
        cut = (F.col("row") >= start["row"]) & (F.col("row") < stop["row"]) & (F.col("col") >= start["col"]) & (F.col("col") < stop["col"])
        pixels = pixels.where(inside | cut)
        moved = {n: F.when(whole, F.col(n)).otherwise(F.col(n) - start[n]).cast("int") for n in ("row", "col")}
        return replace(self, pixels=pixels.withColumns(moved).drop("height", "width"))


#: Bins of a look at the values in which a rank lies; values that are put in order instead of being looked at again.
BINS, FEW = 4096, 4096


def percentiles(values: DataFrame, shares: Sequence[float], few: int = FEW) -> DataFrame:
    """(image_id, p): exact percentiles of the values v of each image, interpolated; nulls don't count, NaN is greatest.

    Every round counts, for each sought rank, the values between the bounds it is known to lie within, by bins; the bin that
    holds the rank gives the next bounds, its own least and greatest value, so a far outlier costs a round and no more.
    A rank is found when its bounds meet, or when so few values lie between that they are put in order.
    """
    values = values.where("v IS NOT NULL")
    finite = lambda v: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    spread = values.groupBy("image_id").agg(F.count("*").alias("n"), F.count_if(F.col("v") == float("-inf")).alias("low"), F.count(finite(F.col("v"))).alias("k"), F.count_if(F.isnan("v")).alias("nan"), F.min(finite(F.col("v"))).alias("lo"), F.max(finite(F.col("v"))).alias("hi"))
    spread = written(spread, "spread")
    rank = lambda p, up: (F.ceil if up else F.floor)(F.lit(float(p)) * (F.col("n") - 1))
    sought = spread.select("*", F.explode(F.array_distinct(F.array(*(rank(p, up) for p in shares for up in (False, True))))).alias("rank"))
    inner = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("k"))
    beyond = F.when(F.col("rank") < F.col("low"), F.lit(float("-inf"))).when(F.col("rank") >= F.col("n") - F.col("nan"), F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    # (image_id, rank, before, lo, hi, k): k values between lo and hi come after as many as before.
    open_ = written(sought.where(inner & (F.col("lo") < F.col("hi"))).select("image_id", "rank", F.col("low").alias("before"), "lo", "hi", "k"), "ranks")
    found = sought.where(~(inner & (F.col("lo") < F.col("hi")))).select("image_id", "rank", F.when(inner, F.col("lo")).otherwise(beyond).alias("v"))
    upto = lambda keys, by: F.coalesce(F.sum("count").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("count"))
    while not open_.isEmpty():
        # A few rows an image: each rank travels with its bounds to all values.
        bounds = open_.groupBy("image_id").agg(F.collect_list(F.struct("rank", "before", "lo", "hi", "k")).alias("b"))
        near = values.join(F.broadcast(bounds) if bounds.count() * 1024 <= MOST_BROADCAST else bounds, "image_id").select("image_id", "v", F.explode(F.filter("b", lambda b: (F.col("v") >= b["lo"]) & (F.col("v") <= b["hi"]))).alias("b")).select("image_id", "v", "b.*")
        bin_ = F.when(F.col("k") > few, F.coalesce(F.least(F.floor(F.try_divide(F.col("v") / BINS - F.col("lo") / BINS, F.col("hi") / BINS - F.col("lo") / BINS) * BINS), F.lit(BINS - 1)), F.lit(0)))
        # Where few values are left, each is a bin of its own.
        counts = near.withColumn("bin", bin_).withColumn("own", F.when(F.col("bin").isNull(), F.col("v"))).groupBy("image_id", "rank", "bin", "own").agg(F.count("*").alias("count"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.any_value("before").alias("start"))
        placed = counts.withColumn("before", F.col("start") + upto(["image_id", "rank"], "lo"))
        now = written(placed.where(held).select("image_id", "rank", "before", "lo", "hi", F.col("count").alias("k")), "ranks")
        found = found.unionByName(now.where("lo = hi").select("image_id", "rank", F.col("lo").alias("v")))
        open_ = now.where("lo < hi")
    at = found.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at")).join(spread.select("image_id", "n"), "image_id")
    part = lambda p: F.lit(float(p)) * (F.col("n") - 1) - rank(p, False)
    low, high = (lambda p: F.col("at")[rank(p, False)]), (lambda p: F.col("at")[rank(p, True)])
    ends = F.array(*(F.when(part(p) == 0, low(p)).otherwise(low(p) * (1 - part(p)) + high(p) * part(p)) for p in shares))
    return written(at.select("image_id", ends.alias("p")), "percentiles")


def _sliced(at: Column, size: Column, part: slice) -> tuple[Column, Column]:
    """Whether a place lies in a slice of so many places, and its number there."""
    step = 1 if part.step is None else int(part.step)
    if step == 0:
        raise ValueError("slice step cannot be zero")
    low, high = (0, size) if step > 0 else (-1, size - 1)

    def end(value: int | None, default: Column) -> Column:
        if value is None:
            return default
        moved = F.lit(int(value)) + (size if value < 0 else F.lit(0))
        return F.least(F.greatest(moved, F.lit(low)), high if isinstance(high, Column) else F.lit(high))

    start = end(part.start, F.lit(0) if step > 0 else size - 1)
    stop = end(part.stop, size if step > 0 else F.lit(-1))
    inside = (at >= start) & (at < stop) if step > 0 else (at <= start) & (at > stop)
    off = (at - start) if step > 0 else (start - at)
    return inside & (off % abs(step) == 0), F.floor(off / abs(step))


def from_arrays(spark: SparkSession, images: Mapping[str, np.ndarray], wavelengths: Sequence[float], masks: Mapping[str, np.ndarray] | None = None, metadata: Mapping[str, object] | None = None) -> Cube:
    """Images given as arrays (row, column, band); for tests and small files."""
    rows: list[pa.RecordBatch] = []
    for name, array in images.items():
        array = np.asarray(array)
        if array.ndim != 3:
            raise ValueError("reflectance must have three dimensions")
        if array.shape[2] != len(wavelengths):
            raise ValueError(f"{array.shape[2]} bands but {len(wavelengths)} wavelengths")
        mask = np.ones(array.shape[:2], dtype=bool) if masks is None or name not in masks else np.asarray(masks[name], dtype=bool)
        if mask.shape != array.shape[:2]:
            raise ValueError("the mask must have the image's height and width")
        r, c = np.indices(mask.shape)
        flat = pa.array(array.astype(np.float32).ravel())
        offsets = pa.array(np.arange(mask.size + 1, dtype=np.int32) * array.shape[2])
        rows.append(pa.RecordBatch.from_arrays([pa.array([name] * mask.size), pa.array(r.ravel().astype(np.int32)), pa.array(c.ravel().astype(np.int32)), pa.ListArray.from_arrays(offsets, flat), pa.array(mask.ravel())], ["image_id", "row", "col", "spectrum", "valid"]))
    pixels = spark.createDataFrame(pa.Table.from_batches(rows)).select(*(F.col(n).cast(t) for n, t in (x.split(" ", 1) for x in PIXELS.split(", "))))
    return Cube(pixels, tuple(float(np.float32(w)) for w in wavelengths), metadata or {})


def read_cube(spark: SparkSession, path: str) -> Cube:
    """A cube that ``write_cube`` wrote."""
    bands = spark.read.parquet(f"{path}/bands").orderBy("band").collect()  # some hundreds
    return Cube(spark.read.parquet(f"{path}/pixels"), tuple(r["wavelength"] for r in bands))


def write_cube(cube: Cube, path: str) -> None:
    """Two tables: pixels, in folders by image so one image can be read alone, and bands."""
    cube.pixels.write.partitionBy("image_id").parquet(f"{path}/pixels")
    spark = cube.pixels.sparkSession
    spark.createDataFrame([(i, float(w)) for i, w in enumerate(cube.wavelengths)], "band int, wavelength double").coalesce(1).write.parquet(f"{path}/bands")


#: The raster of the embeddings table: pixels in a row, bands.
WIDTH, BANDS = 25, 64


def embeddings_cube(spark: SparkSession, sf_dir: str) -> Cube:
    """The embeddings table as one image: 25 pixels a row, reflectance 0.5 + 0.5 * component, 400 to 1000 nm."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    place = {"row": F.floor(F.col("vec_id") / WIDTH).cast("int"), "col": (F.col("vec_id") % WIDTH).cast("int")}
    # Told from the row, not a constant, so joins by image stay joins by a key.
    name = F.when(F.col("vec_id").isNotNull(), F.lit("embeddings"))
    pixels = vectors.select(name.alias("image_id"), place["row"].alias("row"), place["col"].alias("col"), F.transform("embedding", lambda x: F.lit(0.5).cast("float") + F.lit(0.5).cast("float") * x).alias("spectrum"), F.lit(True).alias("valid"))
    return Cube(pixels, tuple(400 + 600 * b / (BANDS - 1) for b in range(BANDS)), {"source": "embeddings"})
