"""Comparison with another field of the same row."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import signature as S
from ..plans.kinds import COLLECTIONS, NUMBERS, Value
from .rule import Rule, never

_ORDER = {"gt_field": operator.gt, "gte_field": operator.ge, "lt_field": operator.lt, "lte_field": operator.le}


def _alike(a: Value, b: Value) -> bool:
    return a.kind == b.kind and (a.kind in COLLECTIONS or a.dtype == b.dtype)


def _equal(a: Value, b: Value) -> Column:
    if a.kind in COLLECTIONS:
        return F.size(a.column) == F.size(b.column)
    return (a.column == b.column) & a.not_nan() & b.not_nan()


def _check(name: str):
    def check(v: Value, p: dict) -> Column:
        other = v.siblings(p["compare"])
        if name in ("fieldcontains", "fieldexcludes"):
            texts = v.kind == "string" and other.kind == "string"
            if name == "fieldcontains":
                return F.contains(v.column, other.column) if texts else never()
            return F.coalesce(~F.contains(v.column, other.column), F.lit(True)) if texts else F.lit(v.kind == "string")
        if not _alike(v, other) or v.kind == "other":
            return never()
        there = v.column.isNotNull() & other.column.isNotNull()
        if name == "eq_field":
            return there & _equal(v, other)
        if name == "ne_field":
            return there & ~_equal(v, other)
        if v.kind == "bool":
            return never()
        if v.kind == "time":
            return there & _ORDER[name](v.column, other.column)
        return there & _ORDER[name](v.measure(), other.measure()) & (v.not_nan() & other.not_nan() if v.kind in NUMBERS else F.lit(True))

    return check


RULES = tuple(Rule(name, _check(name), S.target()) for name in ("eq_field", "ne_field", "gt_field", "gte_field", "lt_field", "lte_field", "fieldcontains", "fieldexcludes"))
