"""Plans of extractors: a registry of classes, a graph of who feeds whom, and lazy results."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismloom.operators.base import Extractor, Feature
from prismloom.operators.moment import GeometricMomentExtractor, LegendreMomentExtractor, ZernikeMomentExtractor
from prismloom.operators.morphology import MPExtractor
from prismloom.operators.reduction import ICAExtractor, MNFExtractor, PCAExtractor, PPExtractor
from prismloom.operators.spectral import NDVIExtractor, NDWIExtractor, SAVIExtractor
from prismloom.operators.texture import GaborExtractor, GLCMExtractor, LBPExtractor
from prismloom.operators.wavelet import DWT1DExtractor, DWT2DExtractor, DWT3DExtractor
from prismloom.sources.cube import Cube


class Registry:
    """Extractor classes by name."""

    def __init__(self):
        self._classes: dict[str, type[Extractor]] = {}

    def register(self, cls: type[Extractor], name: str | None = None) -> None:
        if not (isinstance(cls, type) and issubclass(cls, Extractor)):
            raise TypeError(f"{cls!r} is not an extractor class")
        name = name or cls.__name__
        if name in self._classes:
            raise ValueError(f"{name} is registered already")
        self._classes[name] = cls

    def get(self, name: str) -> type[Extractor]:
        if name not in self._classes:
            raise ValueError(f"no extractor is named {name}; there are {', '.join(self.names())}")
        return self._classes[name]

    def unregister(self, name: str) -> None:
        self.get(name)
        del self._classes[name]

    def clear(self) -> None:
        self._classes.clear()

    def names(self) -> list[str]:
        return sorted(self._classes)

    def __contains__(self, name: str) -> bool:
        return name in self._classes

    def __len__(self) -> int:
        return len(self._classes)

    def __iter__(self) -> Iterator[str]:
        return iter(self.names())


registry = Registry()
for _cls in (NDVIExtractor, NDWIExtractor, SAVIExtractor, PCAExtractor, ICAExtractor, MNFExtractor, PPExtractor, DWT1DExtractor, DWT2DExtractor, DWT3DExtractor, GLCMExtractor, LBPExtractor, GaborExtractor, MPExtractor, GeometricMomentExtractor, LegendreMomentExtractor, ZernikeMomentExtractor):
    registry.register(_cls)


@dataclass(frozen=True)
class FeatureSpace:
    """Extractors by name, each with the names of those that give its inputs."""

    nodes: Mapping[str, tuple[Extractor, Mapping[str, str]]] = field(default_factory=dict)

    def __post_init__(self):
        for name, (extractor, given) in self.nodes.items():
            wanted = extractor.inputs()
            for input_name, source in given.items():
                if input_name not in wanted:
                    raise ValueError(f"{name} has no input {input_name}")
                if source not in self.nodes:
                    raise ValueError(f"{name} needs {source}, which isn't there")
                if not isinstance(self.nodes[source][0], wanted[input_name].source):
                    raise TypeError(f"{name} needs a {wanted[input_name].source.__name__} as {input_name}, not {source}")
            for input_name, need in wanted.items():
                if need.required and input_name not in given:
                    raise ValueError(f"{name} lacks its input {input_name}")
        self.order()

    @classmethod
    def from_list(cls, extractors: list[Extractor]) -> FeatureSpace:
        """Inputs are given by the one extractor of the class that they need."""
        by_name: dict[str, Extractor] = {}
        for e in extractors:
            if e.feature_name() in by_name:
                raise ValueError(f"there are two extractors named {e.feature_name()}")
            by_name[e.feature_name()] = e
        nodes = {}
        for name, e in by_name.items():
            given = {}
            for input_name, need in e.inputs().items():
                found = [n for n, other in by_name.items() if n != name and isinstance(other, need.source)]
                if len(found) > 1:
                    raise ValueError(f"Ambiguous dependency: {name} could take {input_name} from {', '.join(found)}")
                if found:
                    given[input_name] = found[0]
            nodes[name] = (e, given)
        return cls(nodes)

    def order(self) -> list[str]:
        try:
            return list(TopologicalSorter({n: sorted(set(g.values())) for n, (_, g) in self.nodes.items()}).static_order())
        except CycleError as error:
            raise ValueError(f"the extractors form a cycle: {' -> '.join(error.args[1])}") from error

    def layers(self) -> list[list[str]]:
        """Names of extractors that may be worked out together, after all before them."""
        sorter = TopologicalSorter({n: set(g.values()) for n, (_, g) in self.nodes.items()})
        sorter.prepare()
        out = []
        while sorter.is_active():
            ready = sorted(sorter.get_ready())
            out.append(ready)
            sorter.done(*ready)
        return out

    def ancestors(self, name: str) -> set[str]:
        direct = set(self.nodes[name][1].values())
        return direct.union(*(self.ancestors(d) for d in direct))

    def descendants(self, name: str) -> set[str]:
        return {n for n in self.nodes if name in self.ancestors(n)}

    def extractors(self) -> dict[str, Extractor]:
        return {n: e for n, (e, _) in self.nodes.items()}

    def extract(self, cube: Cube) -> FeatureCollection:
        """Lazy features of all extractors. An optional input that nothing gives comes from its default extractor, made once."""
        found: dict[str, Feature] = {}
        defaults: dict[Extractor, Feature] = {}
        for name in self.order():
            extractor, given = self.nodes[name]
            inputs = {i: found[source] for i, source in given.items()}
            for i in extractor.inputs().keys() - inputs.keys():
                default = extractor.input_default(i)
                if default is not None:
                    if default not in defaults:
                        defaults[default] = default.extract(cube)
                    inputs[i] = defaults[default]
            found[name] = extractor.extract(cube, **inputs)
        return FeatureCollection(found, self)

    def save_config(self, path: str) -> None:
        """The space as a configuration (.yaml, .yml or .json) with the default runner."""
        from prismloom.plans.config import Config  # which itself builds spaces

        Config(self).save(path)


@dataclass(frozen=True)
class FeatureCollection(Mapping):
    """Features by extractor; read-only."""

    features: Mapping[str, Feature]
    space: FeatureSpace

    def __getitem__(self, name: str) -> Feature:
        return self.features[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.features)

    def __len__(self) -> int:
        return len(self.features)

    def table(self) -> DataFrame:
        """(image_id, extractor, row, col, features) of all."""
        if not self.features:
            raise ValueError("there are no features")
        parts = [f.data.select("image_id", F.lit(n).alias("extractor"), "row", "col", "features") for n, f in self.features.items()]
        return reduce(DataFrame.unionByName, parts)

    def stacked(self) -> DataFrame:
        """(image_id, row, col) and one array column for each extractor."""
        long = self.table()
        return long.groupBy("image_id", "row", "col").pivot("extractor", list(self.features)).agg(F.any_value("features"))

    def metadata(self) -> dict[str, dict]:
        return {n: dict(f.metadata) for n, f in self.features.items()}

    def describe(self) -> list[dict]:
        return [{"feature_name": n, "extractor": type(self.space.nodes[n][0]).__name__, "inputs": dict(self.space.nodes[n][1]), "metadata": dict(f.metadata)} for n, f in self.features.items()]

    def save(self, path: str) -> None:
        """Features in folders by extractor and image, models in a folder each, and a table of metadata."""
        self.table().write.partitionBy("extractor", "image_id").parquet(f"{path}/features")
        for n, f in self.features.items():
            if f.model is not None:
                f.model.write.parquet(f"{path}/models/{n}")
        rows = [(d["feature_name"], d["extractor"], json.dumps(d["inputs"]), json.dumps(d["metadata"], default=str)) for d in self.describe()]
        spark = next(iter(self.features.values())).data.sparkSession
        spark.createDataFrame(rows, "feature_name string, extractor string, inputs string, metadata string").coalesce(1).write.parquet(f"{path}/metadata")
