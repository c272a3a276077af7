"""Kinds of values, presence and measures as columns."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidParam

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def kind_of(dtype: T.DataType) -> str:
    """``string bool int float time vec map other``; unsigned and array kinds are declared by metadata."""
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, INTEGERS) or isinstance(dtype, T.DecimalType) and dtype.scale == 0:
        return "int"
    if isinstance(dtype, T.FloatType | T.DoubleType | T.DecimalType):
        return "float"
    if isinstance(dtype, T.TimestampType | T.TimestampNTZType | T.DateType):
        return "time"
    if isinstance(dtype, T.ArrayType):
        return "vec"
    if isinstance(dtype, T.MapType):
        return "map"
    return "other"


NUMBERS = ("int", "uint", "float")
COLLECTIONS = ("vec", "array", "slice", "map")


@dataclass
class Value:
    """A column with what is known of it when the plan is built."""

    column: Column
    dtype: T.DataType
    kind: str = ""
    #: ``Option`` semantics: only null is absent
    optional: bool = False
    #: looks up a sibling (or dotted path below one); None where fields are out of reach
    siblings: object = field(default=None, repr=False)

    def __post_init__(self):
        self.kind = self.kind or kind_of(self.dtype)

    def present(self) -> Column:
        """True where the value is there and, unless it is optional, not the zero value of its type."""
        c = self.column
        if self.optional or self.kind in ("time", "other"):
            return c.isNotNull()
        if self.kind == "string":
            test = c != ""
        elif self.kind == "bool":
            test = c
        elif self.kind in NUMBERS:
            test = c != 0
        else:
            test = F.size(c) > 0
        return F.coalesce(test, F.lit(False))

    def measure(self) -> Column | None:
        """What size rules compare: characters, items or the number itself."""
        if self.kind == "string":
            return F.length(self.column)
        if self.kind in COLLECTIONS:
            return F.size(self.column)
        if self.kind in NUMBERS:
            return self.column
        return None

    def not_nan(self) -> Column:
        return ~F.isnan(self.column) if isinstance(self.dtype, T.FloatType | T.DoubleType) else F.lit(True)


#: Whole numbers that a rule may name: those of 128 bits.
BOUNDS = {"int": (-(2**127), 2**127 - 1), "uint": (0, 2**128 - 1)}

_INT = re.compile(r"[+-]?[0-9]+\Z")
_UINT = re.compile(r"\+?[0-9]+\Z")
_FLOAT = re.compile(r"[+-]?(?:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\Z", re.I)


def number(text: str, kind: str, rule: str) -> Decimal | float:
    """A literal of the value's own number type."""
    if kind == "float" and _FLOAT.match(text):
        return float(text)
    if kind == "int" and _INT.match(text) or kind == "uint" and _UINT.match(text):
        out = int(text)
        if BOUNDS[kind][0] <= out <= BOUNDS[kind][1]:
            return Decimal(text)
    raise InvalidParam(f"{rule}: {text!r} is not {'a float' if kind == 'float' else 'an ' + kind}")


def limit(value: Value, text: str, rule: str) -> Column:
    """A bound for ``value.measure()``: counts are unsigned, numbers are of the value's type."""
    if value.kind in NUMBERS:
        return literal(number(text, value.kind, rule), value)
    if value.kind == "string" or value.kind in COLLECTIONS:
        return _whole(number(text, "uint", rule))
    raise InvalidParam(f"{rule}: a {value.kind} has no size")


def literal(x: Decimal | float, value: Value) -> Column:
    if isinstance(x, float):
        # a bound for a 32-bit float is rounded to one first
        return F.lit(x).cast("float").cast("double") if isinstance(value.dtype, T.FloatType) else F.lit(x)
    return _whole(x)


def _whole(x: Decimal) -> Column:
    """A whole number; no column holds one of more than 38 digits, so any of these compares like an infinity."""
    n = int(x)  # exact, where sums and signs of Decimals are rounded to their context
    if abs(n) < 2**63:
        return F.lit(n)
    return F.lit(x) if abs(n) < 10**38 else F.lit(math.copysign(math.inf, n))
