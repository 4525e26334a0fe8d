"""Features of single pixels over a stream of pixels; what needs a whole image runs on complete images only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismloom.operators.base import Extractor
from prismloom.operators.spectral import NDVIExtractor, NDWIExtractor, SAVIExtractor
from prismloom.operators.wavelet import DWT1DExtractor
from prismloom.sources.cube import Cube

#: Extractors without state: each pixel's features come from its own spectrum.
ROWWISE = (NDVIExtractor, NDWIExtractor, SAVIExtractor, DWT1DExtractor)


def indices_of(stream: DataFrame, wavelengths: Sequence[float], extractors: Sequence[Extractor]) -> DataFrame:
    """(image_id, extractor, row, col, features) of a stream or table of pixels."""
    if not extractors:
        raise ValueError("there are no extractors")
    for e in extractors:
        if not isinstance(e, ROWWISE):
            raise ValueError(f"{e.feature_name()} needs whole images")
    cube = Cube(stream, tuple(wavelengths))
    parts = [e.extract(cube).data.select("image_id", F.lit(e.feature_name()).alias("extractor"), "row", "col", "features") for e in extractors]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
