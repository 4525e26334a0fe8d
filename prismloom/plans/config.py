"""Plans as YAML or JSON files."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from prismloom.plans.space import FeatureCollection, FeatureSpace, registry
from prismloom.sources.cube import Cube

#: Names of runners in configurations. Spark schedules all of them; they choose a local master.
RUNNERS = {"sequential": (), "local": ("num_workers",), "dask-threads": ("num_threads",), "dask-processes": ("num_workers", "threads_per_worker", "memory_limit")}


@dataclass(frozen=True)
class Runner:
    """How many threads a local session gets; on a cluster its master decides."""

    type: str = "sequential"
    params: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if self.type not in RUNNERS:
            raise ValueError(f"runner type must be one of {', '.join(RUNNERS)}")
        unknown = set(self.params) - set(RUNNERS[self.type])
        if unknown:
            raise ValueError(f"runner {self.type} has no {', '.join(sorted(unknown))}")

    def master(self) -> str:
        threads = int(self.params.get("num_threads") or self.params.get("num_workers") or 0) * int(self.params.get("threads_per_worker") or 1)
        return "local[1]" if self.type == "sequential" else f"local[{threads or '*'}]"

    def session(self) -> SparkSession:
        """The session that is running, or else a local one."""
        return SparkSession.getActiveSession() or SparkSession.builder.master(self.master()).getOrCreate()


@dataclass(frozen=True)
class Config:
    space: FeatureSpace
    runner: Runner = field(default_factory=Runner)

    def extract(self, cube: Cube) -> FeatureCollection:
        return self.space.extract(cube)

    def as_dict(self) -> dict[str, Any]:
        plain = lambda v: [plain(x) for x in v] if isinstance(v, (list, tuple)) else v
        nodes = {n: {"extractor": type(e).__name__, "params": {k: plain(v) for k, v in e.params().items()}} | ({"inputs": dict(given)} if given else {}) for n, (e, given) in self.space.nodes.items()}
        return {"pipeline": nodes, "runner": {"type": self.runner.type, "params": dict(self.runner.params)}}

    def save(self, path: str) -> None:
        suffix = os.path.splitext(path)[1].lower()
        if suffix not in (".yaml", ".yml", ".json"):
            raise ValueError("a configuration ends in .yaml, .yml or .json")
        with open(path, "w", encoding="utf-8") as file:
            if suffix == ".json":
                json.dump(self.as_dict(), file, indent=2)
            else:
                import yaml

                yaml.safe_dump(self.as_dict(), file, sort_keys=False)


def from_dict(spec: Any) -> Config:
    """A checked configuration. Inputs that aren't named are given by the one extractor of the class needed."""
    if not isinstance(spec, dict) or not isinstance(spec.get("pipeline"), dict) or not spec["pipeline"]:
        raise ValueError("a configuration needs a pipeline with entries")
    built, named = {}, {}
    for name, entry in spec["pipeline"].items():
        if not isinstance(entry, dict) or "extractor" not in entry:
            raise ValueError(f"{name} names no extractor")
        params = entry.get("params") or {}
        if not isinstance(params, dict):
            raise ValueError(f"params of {name} must be a mapping")
        cls = registry.get(str(entry["extractor"]))
        try:
            built[name] = cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in params.items()})
        except TypeError as error:
            raise ValueError(f"params of {name}: {error}") from error
        named[name] = entry.get("inputs")
    nodes = {}
    for name, e in built.items():
        given = dict(named[name] or {})
        if named[name] is None:
            for input_name, need in e.inputs().items():
                found = [n for n, other in built.items() if n != name and isinstance(other, need.source)]
                if len(found) == 1:
                    given[input_name] = found[0]
        nodes[name] = (e, given)
    runner = spec.get("runner") or {}
    if not isinstance(runner, dict) or not isinstance(runner.get("params") or {}, dict):
        raise ValueError("runner must be a mapping with type and params")
    return Config(FeatureSpace(nodes), Runner(runner.get("type", "sequential"), dict(runner.get("params") or {})))


def from_json(text: str) -> Config:
    try:
        return from_dict(json.loads(text))
    except json.JSONDecodeError as error:
        raise ValueError(f"not JSON: {error}") from error


def load(path: str) -> Config:
    """A configuration from a .yaml, .yml or .json file."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if path.lower().endswith(".json"):
        return from_json(text)
    if not path.lower().endswith((".yaml", ".yml")):
        raise ValueError("a configuration ends in .yaml, .yml or .json")
    import yaml

    try:
        return from_dict(yaml.safe_load(text))
    except yaml.YAMLError as error:
        raise ValueError(f"not YAML: {error}") from error
