"""What all extractors have in common: parameters with declared limits, inputs, a name, and a lazy result."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields
from typing import Any, ClassVar

from pyspark.sql import DataFrame

from prismloom.sources.cube import Cube


@dataclass(frozen=True)
class Feature:
    """Lazy features (image_id, row, col, features array<double>), a lazy model (a row an image) and metadata."""

    data: DataFrame
    metadata: Mapping[str, Any] = field(default_factory=dict)
    model: DataFrame | None = None


@dataclass(frozen=True)
class Input:
    """An input of an extractor: the class that gives it, and whether it must be there."""

    source: type
    required: bool = True


@dataclass(frozen=True)
class Limit:
    """What a parameter must be: a test of its value, and how to say it."""

    holds: Callable[[Any], bool]
    says: str

    def many(self) -> Limit:
        """A list of such values, one at least."""
        return Limit(lambda v: isinstance(v, (list, tuple)) and len(v) > 0 and all(map(self.holds, v)), f"a list of values that are {self.says}")

    def __or__(self, other: Limit) -> Limit:
        return Limit(lambda v: self.holds(v) or other.holds(v), f"{self.says}, or {other.says}")


def _is(kind: type, value: Any) -> bool:
    return type(value) is kind or isinstance(value, kind) and not isinstance(value, bool)


def among(*values: Any) -> Limit:
    return Limit(lambda v: any(type(v) is type(x) and v == x for x in values), "one of " + ", ".join(map(repr, values)))


NATURAL = Limit(lambda v: _is(int, v) and v > 0, "an integer above 0")
INDEX = Limit(lambda v: _is(int, v) and v >= 0, "an integer from 0 on")
WINDOW = Limit(lambda v: _is(int, v) and v > 2 and v % 2 == 1, "an odd integer above 2")
LENGTH = Limit(lambda v: (_is(int, v) or _is(float, v)) and v > 0, "a number above 0")
ANY = Limit(lambda v: True, "anything")
NOTHING, FLAG = among(None), among(True, False)


class Extractor:
    """Subclasses are frozen dataclasses of parameters, with ``_extract``, ``limits`` and, for what concerns the images, ``_check``."""

    name: ClassVar[str | None] = None
    limits: ClassVar[Mapping[str, Limit]] = {}

    def extract(self, cube: Cube, **inputs: Feature) -> Feature:
        broken = [f"{name} must be {limit.says}" for name, limit in self.limits.items() if not limit.holds(getattr(self, name))]
        if broken:
            raise ValueError("; ".join(broken))
        self._check(cube)
        return self._extract(cube, **inputs)

    def _check(self, cube: Cube) -> None:
        """Raises ValueError if the cube doesn't suit the parameters."""

    def _extract(self, cube: Cube, **inputs: Feature) -> Feature:
        raise NotImplementedError

    @classmethod
    def inputs(cls) -> dict[str, Input]:
        return {}

    @classmethod
    def input_default(cls, name: str) -> Extractor | None:
        """The extractor that gives an optional input which nothing else gives."""
        return None

    @classmethod
    def feature_name(cls) -> str:
        """The class name without Extractor, in lower case, an underscore before every further capital."""
        if cls.name:
            return cls.name
        bare = re.sub(r"(Feature)?Extractor$", "", cls.__name__)
        return re.sub(r"(?<!^)(?=[A-Z])", "_", bare).lower()

    def params(self) -> dict[str, Any]:
        return {f.name: getattr(self, f.name) for f in fields(self)}
