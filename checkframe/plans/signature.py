"""Shapes of rule parameters and their binding."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import InvalidParam
from .expressions import Call


@dataclass(frozen=True)
class Signature:
    """``shape``: none, text, list, named or pairs; ``field``: the parameter names other fields."""

    shape: str = "none"
    name: str = ""
    optional: bool = False
    names: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    field: bool = False

    def bind(self, call: Call) -> dict:
        """Parameter values by name: str, list of str or list of pairs."""
        positional, named = list(call.positional), dict(call.named)

        def bad(why: str):
            return InvalidParam(f"{call.name}: {why}")

        if self.shape == "none":
            if positional or named:
                raise bad("takes no parameters")
            return {}
        if self.shape == "text":
            if set(named) - {self.name} or len(positional) + len(named) > 1:
                raise bad(f"takes one parameter, {self.name}")
            values = positional or list(named.values())
            if not values:
                if self.optional:
                    return {}
                raise bad(f"needs {self.name}")
            if not isinstance(values[0], str):
                raise bad(f"{self.name} is one value")
            return {self.name: values[0]}
        if self.shape == "list":
            if set(named) - {self.name}:
                raise bad(f"takes a list, {self.name}")
            values = positional or named.get(self.name, [])
            values = [values] if isinstance(values, str) else list(values)
            if not values and not self.optional:
                raise bad(f"needs {self.name}")
            return {self.name: values} if values else {}
        if self.shape == "named":
            if positional:
                raise bad("takes named parameters")
            if set(named) - set(self.names):
                raise bad(f"unknown parameters {sorted(set(named) - set(self.names))}")
            if not named or set(self.required) - set(named):
                raise bad(f"needs {' and '.join(self.required) or ' or '.join(self.names)}")
            if not all(isinstance(v, str) for v in named.values()):
                raise bad("each parameter is one value")
            return dict(sorted(named.items()))
        if named:
            pairs = [(k, v) for k, v in call.named if isinstance(v, str)]
            if len(pairs) != len(call.named):
                raise bad("each condition has one value")
        else:
            if not positional or len(positional) % 2:
                raise bad("takes field and value pairs")
            pairs = list(zip(positional[::2], positional[1::2], strict=True))
        return {self.name: pairs}


def none() -> Signature:
    return Signature()


def text(name: str, optional: bool = False) -> Signature:
    return Signature("text", name, optional)


def values(name: str = "values", optional: bool = False) -> Signature:
    return Signature("list", name, optional)


def named(names: tuple[str, ...], required: tuple[str, ...] = ()) -> Signature:
    return Signature("named", names=names, required=required)


def target() -> Signature:
    return Signature("text", "compare", field=True)


def targets() -> Signature:
    return Signature("list", "fields", field=True)


def conditions() -> Signature:
    return Signature("pairs", "conditions", field=True)
