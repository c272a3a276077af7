"""Which fields a run covers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnknownField

_PART = re.compile(r'\.?[^.\[\]]+|\[(?:"(?:\\.|[^"\\])*"|[^\]]*)\]')


def parts(path: str) -> tuple[str, ...]:
    """``a.b[0]["k"]`` as its parts; marks inside quoted keys are part of the key."""
    return tuple(p.lstrip(".") for p in _PART.findall(path))


def _element(part: str) -> bool:
    return part.startswith("[")


def _same(static: str, asked: str) -> bool:
    """Model paths write any element as ``[]``."""
    return static == asked or (static == "[]" and _element(asked))


def _starts(path: tuple[str, ...], head: tuple[str, ...]) -> bool:
    return len(head) <= len(path) and all(_same(a, b) or _same(b, a) for a, b in zip(path, head, strict=False))


def element_of(column: Column, dtype: T.DataType, place: str) -> tuple[Column, Column, Column] | None:
    """Whether a collection has the element at ``[0]`` or ``["key"]``, its key or index, and the element; None if it cannot have it."""
    try:
        (key,) = json.loads(place)
    except ValueError:
        return None
    if isinstance(dtype, T.ArrayType):
        if not isinstance(key, int) or isinstance(key, bool) or key < 0:
            return None
        return F.coalesce(F.size(column) > key, F.lit(False)), F.lit(key), F.get(column, F.lit(key))
    if isinstance(dtype, T.MapType) and not isinstance(key, list | dict):
        wanted = F.lit(key).try_cast(dtype.keyType)
        return F.coalesce(F.map_contains_key(column, wanted), F.lit(False)), wanted, F.try_element_at(column, wanted)
    return None


def meets(column: Column, dtype: T.DataType, rest: tuple[str, ...]) -> Column:
    """Whether the rest of a selector leads to something in a value."""
    if not rest:
        return F.lit(True)
    here, rest = rest[0], rest[1:]
    if not _element(here):
        if isinstance(dtype, T.StructType) and here in dtype.fieldNames():
            return column.isNotNull() & meets(column.getField(here), dtype[here].dataType, rest)
        return F.lit(False)
    if here in ("[]", "[*]"):
        items, of = (F.map_values(column), dtype.valueType) if isinstance(dtype, T.MapType) else (column, dtype.elementType)
        return F.coalesce(F.exists(items, lambda x: meets(x, of, rest)), F.lit(False))
    found = element_of(column, dtype, here)
    if found is None:
        return F.lit(False)
    return found[0] & meets(found[2], dtype.valueType if isinstance(dtype, T.MapType) else dtype.elementType, rest)


class Selection:
    """All fields unless narrowed; paths leave out the type's name."""

    def __init__(self, mode: str = "all", paths: Iterable[str] = (), keep: Callable[[str], bool] | None = None, elements: Callable[[Column], Column] | None = None):
        self.mode, self.keep, self.elements = mode, keep, elements
        self.paths = [parts(p) for p in paths]
        self.met: set[int] = set()

    def key(self) -> tuple:
        """What selections that cover the same have in common; functions count by identity."""
        return (self.mode, tuple(self.paths), id(self.keep), id(self.elements))

    def _visit(self, path: tuple[str, ...]) -> None:
        for i, p in enumerate(self.paths):
            if _starts(path, p):
                self.met.add(i)

    def reports(self, path: str) -> bool:
        """Whether errors at this model path are reported."""
        p = parts(path)
        self._visit(p)
        if self.mode == "partial":
            return any(_starts(p, s) for s in self.paths)
        if self.mode == "except":
            return not any(_starts(p, s) and not self.indices(p, s) for s in self.paths)
        if self.mode == "filter":
            return all(self.keep("".join(x if _element(x) or not i else "." + x for i, x in enumerate(p[: k + 1]))) for k in range(len(p)))
        return True

    @staticmethod
    def indices(path: tuple[str, ...], asked: tuple[str, ...]) -> list[tuple[int, str]]:
        """Places where the selector names one element of what the model path leaves open."""
        return [(i, b) for i, (a, b) in enumerate(zip(path, asked, strict=False)) if a == "[]" and b not in ("[]", "[*]")]

    def element_tests(self, path: str) -> list[list[tuple[int, str]]]:
        """For every selector that covers the path, the elements it is bound to (none: all)."""
        p = parts(path)
        return [self.indices(p, s) for s in self.paths if _starts(p, s)]

    def asked(self, path: str) -> list[str] | None:
        """The elements of a collection that the selectors name; None if some selector takes them all."""
        p, out = parts(path), []
        for s in self.paths:
            if len(s) <= len(p):
                if _starts(p, s):
                    return None
            elif _starts(s, p):
                if not _element(s[len(p)]) or s[len(p)] in ("[]", "[*]"):
                    return None
                out.append(s[len(p)])
        return list(dict.fromkeys(out))

    def places_matter(self, path: str) -> bool:
        """Whether what is reported inside a collection depends on where in it an element stands."""
        p = parts(path)
        named = any(len(s) > len(p) and _starts(s, p) and _element(s[len(p)]) and s[len(p)] not in ("[]", "[*]") for s in self.paths)
        return self.elements is not None or self.mode in ("partial", "except") and named

    def element_paths(self) -> list[tuple[str, ...]]:
        """Selectors that name single elements, which only the data can tell to be there."""
        return [s for s in self.paths if any(_element(x) and x not in ("[]", "[*]") for x in s)]

    def kept_elements(self, path: str, places: dict[int, Column]) -> Column:
        """Whether ``elements`` keeps the first element on the path and everything from there on."""
        p, out, at = parts(path), F.lit(True), F.lit("")
        for i, part in enumerate(p):
            at = F.concat(at, places.get(i, F.lit("." + part if i else part)))
            if i >= min(places):
                out = out & F.coalesce(self.elements(at), F.lit(False))
        return out

    def enters(self, path: str) -> bool:
        """Whether something at or below the path may be reported."""
        p = parts(path)
        if self.mode == "partial":
            return any(_starts(p, s) or _starts(s, p) for s in self.paths)
        return self.mode != "except" or self.reports(path) or any(_starts(s, p) for s in self.paths)

    def finish(self) -> None:
        """Every selector has to name something of the model."""
        missed = [p for i, p in enumerate(self.paths) if i not in self.met]
        if missed:
            raise UnknownField(", ".join(".".join(p) for p in missed))
