"""Models: which rules hold for which fields."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..errors import ConfigError


@dataclass
class Dive:
    """Rules for each element of an array (or each key or value of a map)."""

    rules: str = ""
    nested: Model | None = None
    dive: Dive | MapDive | None = None


@dataclass
class MapDive:
    """Rules for the keys and the values of a map."""

    keys: Dive
    values: Dive


@dataclass
class Field:
    """``optional``: only null is absent.  ``kind``: overrides the kind that the type gives (``uint``, ``array``...)."""

    rules: str = ""
    nested: Model | None = None
    dive: Dive | MapDive | None = None
    optional: bool = False
    kind: str = ""


@dataclass
class Model:
    """A record's rules.  ``checks``: functions of a field accessor that give (field, rule, failing column, params)."""

    name: str
    fields: dict[str, Field | str]
    checks: list[Callable] = field(default_factory=list)

    def __post_init__(self):
        self.fields = {k: Field(v) if isinstance(v, str) else v for k, v in self.fields.items()}


def _dive(spec) -> Dive | MapDive:
    if isinstance(spec, str):
        return Dive(spec)
    if "keys" in spec or "values" in spec:
        if set(spec) != {"keys", "values"}:
            raise ConfigError("dive into a map needs keys and values")
        return MapDive(_dive(spec["keys"]), _dive(spec["values"]))
    return Dive(spec.get("rules", ""), None, _dive(spec["dive"]) if "dive" in spec else None)


def model_of(schema: T.StructType, name: str) -> Model:
    """The model that column metadata describe: keys ``rules``, ``nested``, ``dive``, ``optional`` and ``kind``."""
    fields = {}
    for f in schema.fields:
        m = f.metadata or {}
        if not {"rules", "nested", "dive"} & set(m):
            continue
        made = Field(m.get("rules", ""), optional=bool(m.get("optional")), kind=m.get("kind", ""))
        if m.get("nested"):
            if not isinstance(f.dataType, T.StructType):
                raise ConfigError(f"{f.name}: nested needs a struct")
            made.nested = model_of(f.dataType, f.name)
        if "dive" in m:
            made.dive = _dive(m["dive"])
            element = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else None
            if isinstance(made.dive, Dive) and isinstance(element, T.StructType):
                made.dive.nested = model_of(element, f.name)
        fields[f.name] = made
    return Model(name, fields)
