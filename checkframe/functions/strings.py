"""Text rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidParam
from ..plans import signature as S
from ..plans.kinds import NUMBERS
from .rule import Rule, never, text_only


def _any_of(c: Column, chars: str) -> Column:
    if not chars:
        return F.lit(False)
    return c.rlike("[" + "".join(f"\\x{{{ord(x):x}}}" for x in chars) + "]")


def _first(p: dict) -> str:
    return p["value"][:1]


def _value(name: str, test) -> Rule:
    return Rule(name, text_only(test), S.text("value"))


def _whole(name: str, pattern: str) -> Rule:
    return Rule(name, text_only(lambda c, p: c.rlike(rf"^(?:{pattern})\z")))


def _or_number(name: str, pattern: str) -> Rule:
    return Rule(name, lambda v, p: F.lit(True) if v.kind in NUMBERS else v.column.rlike(pattern) if v.kind == "string" else never())


def _boolean(v, p) -> Column:
    if v.kind == "bool":
        return F.lit(True)
    return v.column.isin("1", "t", "T", "true", "TRUE", "True", "0", "f", "F", "false", "FALSE", "False") if v.kind == "string" else never()


RULES = (
    _value("contains", lambda c, p: F.contains(c, F.lit(p["value"]))),
    _value("containsany", lambda c, p: _any_of(c, p["value"])),
    _value("containsrune", lambda c, p: F.contains(c, F.lit(_first(p))) if _first(p) else never()),
    _value("excludes", lambda c, p: ~F.contains(c, F.lit(p["value"]))),
    _value("excludesall", lambda c, p: ~_any_of(c, p["value"])),
    _value("excludesrune", lambda c, p: ~F.contains(c, F.lit(_first(p))) if _first(p) else never()),
    _value("startswith", lambda c, p: c.startswith(p["value"])),
    _value("endswith", lambda c, p: c.endswith(p["value"])),
    _value("startsnotwith", lambda c, p: ~c.startswith(p["value"])),
    _value("endsnotwith", lambda c, p: ~c.endswith(p["value"])),
    Rule("ascii", text_only(lambda c, p: F.octet_length(c) == F.length(c))),
    _whole("printascii", r"[\x20-\x7e]*"),
    Rule("multibyte", text_only(lambda c, p: (c == "") | (F.octet_length(c) != F.length(c)))),
    _whole("alpha", "[A-Za-z]+"),
    _whole("alphaspace", "[A-Za-z ]+"),
    _whole("alphaunicode", r"\p{L}+"),
    _whole("alphanum", "[A-Za-z0-9]+"),
    _whole("alphanumspace", "[A-Za-z0-9 ]+"),
    _whole("alphanumunicode", r"[\p{L}\p{N}]+"),
    _or_number("numeric", r"^[-+]?[0-9]+(?:\.[0-9]+)?\z"),
    _or_number("number", r"^[0-9]+\z"),
    Rule("lowercase", text_only(lambda c, p: (c != "") & (c == F.lower(c)))),
    Rule("uppercase", text_only(lambda c, p: (c != "") & (c == F.upper(c)))),
    Rule("boolean", _boolean),
)


def user_pattern(pattern: str) -> str:
    """A user's pattern in the regex dialect of Spark, with the same errors for what the rule language lacks.

    No look-around and no back-references; ``$`` is the very end of the text and
    ``\\s \\d \\w`` are Unicode classes.
    """
    if re.search(r"(?<!\\)(?:\\\\)*\(\?(?:[=!]|<[=!])", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise InvalidParam(f"regex: look-around and back-references are not supported: {pattern!r}")
    try:
        re.compile(re.sub(r"\\[pP]\{[^}]*\}|\\[pP][A-Z]", "x", pattern.replace(r"\z", r"\Z").replace("(?U)", "")))
    except re.error as e:
        raise InvalidParam(f"regex: {e}: {pattern!r}") from e
    out, i, in_class = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[":
            in_class += 1
        elif c == "]" and in_class:
            in_class -= 1
        out.append(r"\z" if c == "$" and not in_class else r"[^\n]" if c == "." and not in_class else c)
        i += 1
    return "(?U)" + "".join(out)
