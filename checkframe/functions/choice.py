"""Choices and uniqueness in collections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, UnknownField
from ..plans import signature as S
from ..plans.kinds import Value, kind_of, literal, number
from .rule import Rule, never


def _listed(v: Value, p: dict, rule: str) -> Column | None:
    if v.kind == "string":
        return v.column.isin(*p["values"])
    if v.kind in ("int", "uint"):
        return reduce(lambda a, b: a | b, [v.column == literal(number(x, v.kind, rule), v) for x in p["values"]])
    return None


def _one(v: Value, p: dict) -> Column:
    found = _listed(v, p, "oneof")
    return never() if found is None else found


def _none(v: Value, p: dict) -> Column:
    found = _listed(v, p, "noneof")
    return never() if found is None else ~found


def _listed_ci(v: Value, p: dict) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(v.column) == F.lower(F.lit(x)) for x in p["values"]])


def _at(dtype: T.DataType, item: Column, path: str) -> tuple[Column, T.DataType]:
    for part in path.split("."):
        if not isinstance(dtype, T.StructType) or part not in dtype.fieldNames():
            raise UnknownField(f"unique: no field {path!r} in the elements")
        item, dtype = item.getField(part), dtype[part].dataType
    if kind_of(dtype) in ("vec", "map", "other"):
        raise ConfigError(f"unique: {path!r} is not a plain value")
    return item, dtype


def _distinct(items: Column) -> Column:
    """No plain value twice: Spark counts these in a hash set."""
    return F.size(F.array_distinct(items)) == F.size(items)


def _distinct_keys(keys: Column) -> Column:
    """No struct twice: equal ones are neighbours once they are sorted, whatever hashes would collide."""

    def neighbours(ordered: Column) -> Column:
        rest = F.greatest(F.size(ordered) - 1, F.lit(0))
        same = F.zip_with(F.slice(ordered, F.lit(1), rest), F.slice(ordered, F.lit(2), rest), lambda a, b: a.eqNullSafe(b))
        return ~F.exists(same, lambda x: x)

    # an array of one is walked, so that what is sorted has a name and is sorted once
    return F.element_at(F.transform(F.array(F.sort_array(keys)), neighbours), 1)


def _has_nan(x: Column, dtype: T.DataType) -> Column:
    return F.coalesce(F.isnan(x), F.lit(False)) if isinstance(dtype, T.FloatType | T.DoubleType) else F.lit(False)


def _zero(x: Column, dtype: T.DataType) -> Column:
    """Negative zero as zero."""
    return x + F.lit(0.0) if isinstance(dtype, T.FloatType | T.DoubleType) else x


def _unique(v: Value, p: dict) -> Column:
    if isinstance(v.dtype, T.MapType):
        items, of = F.map_values(v.column), v.dtype.valueType
    elif isinstance(v.dtype, T.ArrayType):
        items, of = v.column, v.dtype.elementType
    else:
        return never()
    paths = p.get("fields")
    if not paths:
        if kind_of(of) in ("vec", "map", "other"):
            raise ConfigError("unique: elements are not plain values")
        return _distinct(F.transform(F.filter(items, lambda x: ~_has_nan(x, of)), lambda x: _zero(x, of)))
    parts = [_at(of, F.col("_"), path)[1] for path in paths]

    def nan(x: Column) -> Column:
        return reduce(lambda a, b: a | b, [_has_nan(_at(of, x, path)[0], t) for path, t in zip(paths, parts, strict=True)])

    def key(x: Column) -> list[Column]:
        return [_zero(*_at(of, x, path)).alias(f"k{i}") for i, path in enumerate(paths)]

    # an element that is not there has no key
    kept = F.filter(items, lambda x: x.isNotNull() & ~nan(x))
    if len(paths) == 1:
        return _distinct(F.transform(kept, lambda x: key(x)[0]))
    return _distinct_keys(F.transform(kept, lambda x: F.struct(*key(x))))


RULES = (
    Rule("unique", _unique, S.values("fields", optional=True)),
    Rule("oneof", _one, S.values()),
    Rule("noneof", _none, S.values()),
    Rule("oneofci", lambda v, p: _listed_ci(v, p) if v.kind == "string" else never(), S.values()),
    Rule("noneofci", lambda v, p: ~_listed_ci(v, p) if v.kind == "string" else never(), S.values()),
)
