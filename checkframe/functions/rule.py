"""What a rule is."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.kinds import Value
from ..plans.signature import Signature, none


@dataclass(frozen=True)
class Rule:
    """``check(value, params)`` gives the predicate; it may raise ``InvalidParam`` while the plan is built.

    ``null`` results count as failures.  A null value passes unless ``sees_null``.
    """

    name: str
    check: Callable[[Value, dict], Column]
    signature: Signature = none()
    sees_null: bool = False

    def passes(self, value: Value, params: dict) -> Column:
        ok = F.coalesce(self.check(value, params), F.lit(False))
        return ok if self.sees_null else value.column.isNull() | ok


def never() -> Column:
    return F.lit(False)


def text_only(test: Callable[..., Column]) -> Callable[[Value, dict], Column]:
    """A check on strings; other kinds fail."""
    return lambda v, p: test(v.column, p) if v.kind == "string" else never()
