"""Values of a user's own types, seen as a kind that rules know."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import types as T

from ..errors import ConfigError


@dataclass(frozen=True)
class Adapter:
    """``matches``: a type, or a test of one.  ``convert`` gives the value that rules see, of the type ``dtype``; null stays null."""

    matches: T.DataType | Callable[[T.DataType], bool]
    convert: Callable[[Column], Column]
    dtype: T.DataType
    kind: str = ""

    def takes(self, dtype: T.DataType) -> bool:
        if isinstance(self.matches, T.DataType):
            # whether parts may be null says nothing of what a value is
            return self.matches.simpleString() == dtype.simpleString() and type(self.matches) is type(dtype)
        return self.matches(dtype)


class Adapters:
    """In the order they were added; the last one that takes a type is used."""

    def __init__(self):
        self.known: list[Adapter] = []

    def add(self, adapter: Adapter) -> None:
        if adapter.takes(adapter.dtype):
            raise ConfigError("an adapter's result would be adapted again")
        self.known.append(adapter)

    def see(self, column: Column, dtype: T.DataType) -> tuple[Column, T.DataType, str]:
        for adapter in reversed(self.known):
            if adapter.takes(dtype):
                return adapter.convert(column), adapter.dtype, adapter.kind
        return column, dtype, ""
