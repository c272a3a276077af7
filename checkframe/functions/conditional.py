"""Presence that depends on other fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidParam
from ..plans import signature as S
from ..plans.kinds import NUMBERS, Value, literal, number
from .rule import Rule


def _matches(v: Value, name: str, text: str) -> Column:
    other = v.siblings(name)
    if text == "null":
        return other.column.isNull()
    if other.kind == "string":
        test = other.column == F.lit(text)
    elif other.kind == "bool":
        if text not in ("true", "false"):
            raise InvalidParam(f"condition on {name}: {text!r} is not true or false")
        test = other.column == F.lit(text == "true")
    elif other.kind in NUMBERS:
        test = (other.column == literal(number(text, other.kind, f"condition on {name}"), other)) & other.not_nan()
    else:
        raise InvalidParam(f"condition on {name}: a {other.kind} is not compared")
    return F.coalesce(test, F.lit(False))


def _rule(name: str, *, pairs: bool, every: bool, holds: bool, wants: bool):
    """Where the condition is met, presence must be ``wants``.

    The condition: all (``every``) or any of the pairs match, or of the fields are
    present; with ``holds`` false it is the fields' absence, or for pairs that none match.
    """

    def check(v: Value, p: dict) -> Column:
        if pairs:
            tests = [_matches(v, f, t) for f, t in p["conditions"]]
            met = reduce(lambda a, b: a & b, tests) if every else reduce(lambda a, b: a | b, tests)
            met = met if holds else ~met
        else:
            tests = [v.siblings(f).present() if holds else ~v.siblings(f).present() for f in p["fields"]]
            met = reduce(lambda a, b: a & b, tests) if every else reduce(lambda a, b: a | b, tests)
        return ~met | (v.present() if wants else ~v.present())

    return Rule(name, check, S.conditions() if pairs else S.targets(), sees_null=True)


RULES = (
    _rule("required_if", pairs=True, every=True, holds=True, wants=True),
    _rule("required_unless", pairs=True, every=False, holds=False, wants=True),
    _rule("skip_unless", pairs=True, every=True, holds=True, wants=True),
    _rule("required_with", pairs=False, every=False, holds=True, wants=True),
    _rule("required_with_all", pairs=False, every=True, holds=True, wants=True),
    _rule("required_without", pairs=False, every=False, holds=False, wants=True),
    _rule("required_without_all", pairs=False, every=True, holds=False, wants=True),
    _rule("excluded_if", pairs=True, every=True, holds=True, wants=False),
    _rule("excluded_unless", pairs=True, every=False, holds=False, wants=False),
    _rule("excluded_with", pairs=False, every=False, holds=True, wants=False),
    _rule("excluded_with_all", pairs=False, every=True, holds=True, wants=False),
    _rule("excluded_without", pairs=False, every=False, holds=False, wants=False),
    _rule("excluded_without_all", pairs=False, every=True, holds=False, wants=False),
)
