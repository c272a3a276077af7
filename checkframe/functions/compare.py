"""Sizes and literal comparison."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidParam
from ..plans import signature as S
from ..plans.kinds import NUMBERS, Value, limit, number
from .rule import Rule, text_only

ORDER = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


def at_least(v: Value, text: str, rule: str) -> Column:
    return (v.measure() >= limit(v, text, rule)) & v.not_nan()


def at_most(v: Value, text: str, rule: str) -> Column:
    return (v.measure() <= limit(v, text, rule)) & v.not_nan()


def _length(v: Value, p: dict) -> Column:
    bounds = {k: number(t, "uint" if v.kind not in NUMBERS else v.kind, "length") for k, t in p.items()}
    if "exact" in p:
        if len(p) > 1:
            raise InvalidParam("length: exact stands alone")
        return (v.measure() == limit(v, p["exact"], "length")) & v.not_nan()
    if "min" in bounds and "max" in bounds and bounds["min"] > bounds["max"]:
        raise InvalidParam("length: min is above max")
    out = F.lit(True)
    if "min" in p:
        out &= at_least(v, p["min"], "length")
    if "max" in p:
        out &= at_most(v, p["max"], "length")
    return out


def _range(v: Value, p: dict) -> Column:
    return _length(v, p)


def equals(v: Value, text: str, rule: str) -> Column:
    if v.kind == "string":
        return v.column == F.lit(text)
    if v.kind == "bool":
        if text not in ("true", "false"):
            raise InvalidParam(f"{rule}: {text!r} is not true or false")
        return v.column == F.lit(text == "true")
    if v.kind == "time":
        raise InvalidParam(f"{rule}: a time is not compared with a literal")
    return (v.measure() == limit(v, text, rule)) & v.not_nan()


def _given(rule: str, p: dict) -> str:
    if "value" not in p:
        raise InvalidParam(f"{rule}: needs value")
    return p["value"]


def _order(name: str):
    def check(v: Value, p: dict) -> Column:
        if v.kind == "time":
            if "value" in p:
                raise InvalidParam(f"{name}: a time is compared with now and takes no value")
            return ORDER[name](v.column, F.current_timestamp())
        return ORDER[name](v.measure(), limit(v, _given(name, p), name)) & v.not_nan()

    return check


RULES = (
    Rule("length", _length, S.named(("min", "max", "exact"))),
    Rule("min", lambda v, p: at_least(v, p["min"], "min"), S.text("min")),
    Rule("max", lambda v, p: at_most(v, p["max"], "max"), S.text("max")),
    Rule("range", _range, S.named(("min", "max"), ("min", "max"))),
    Rule("eq", lambda v, p: equals(v, _given("eq", p), "eq"), S.text("value", optional=True)),
    Rule("ne", lambda v, p: ~equals(v, _given("ne", p), "ne"), S.text("value", optional=True)),
    Rule("eq_ignore_case", text_only(lambda c, p: F.lower(c) == F.lower(F.lit(p["value"]))), S.text("value")),
    Rule("ne_ignore_case", text_only(lambda c, p: F.lower(c) != F.lower(F.lit(p["value"]))), S.text("value")),
    *(Rule(name, _order(name), S.text("value", optional=True)) for name in ORDER),
)
