"""The rule expression language: ``a,b(x,k=v),c=1 2,d|e``."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from ..errors import InvalidExpression

NAME = re.compile(r"[A-Za-z0-9_-]+\Z")


@dataclass(frozen=True)
class Call:
    """One rule with its raw parameters; named values may be lists."""

    name: str
    positional: tuple[str, ...] = ()
    named: tuple[tuple[str, str | tuple[str, ...]], ...] = ()


@dataclass(frozen=True)
class AnyOf:
    """Alternatives of an OR group."""

    calls: tuple[Call, ...] = field(default_factory=tuple)


Step = Call | AnyOf


def _split(text: str, delimiter: str) -> list[str]:
    """Parts at delimiters outside quotes and parentheses."""
    parts, start, depth, quote, i = [], 0, 0, None, 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = None
        elif c in "\"'" and _opens(text, i):
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise InvalidExpression(f"unbalanced ')' in {text!r}")
        elif c == delimiter and depth == 0:
            parts.append(text[start:i])
            start = i + 1
        i += 1
    if quote or depth:
        raise InvalidExpression(f"unfinished quote or parenthesis in {text!r}")
    return [*parts, text[start:]]


def _opens(text: str, i: int) -> bool:
    """A quote counts only where a value begins."""
    before = text[:i].rstrip(" ")
    return not before or before[-1] in "(,=|" or text[i - 1] == " "


def _value(text: str) -> str:
    text = text.strip()
    if text[:1] in ("'", '"'):
        if len(text) < 2 or text[-1] != text[0]:
            raise InvalidExpression(f"a quote must hold the whole value: {text!r}")
        return re.sub(r"\\(.)", r"\1", text[1:-1], flags=re.S)
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _words(text: str) -> list[str]:
    out, i = [], 0
    for m in re.finditer(r"\s*(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|\S+)", text):
        out.append(_value(m[1]))
        i = m.end()
    if text[i:].strip():
        raise InvalidExpression(f"bad value list: {text!r}")
    return out


def _call(text: str) -> Call:
    text = text.strip()
    m = re.match(r"([A-Za-z0-9_-]+)\s*", text)
    if not m:
        raise InvalidExpression(f"not a rule: {text!r}")
    name, rest = m[1], text[m.end() :]
    if not rest:
        return Call(name)
    if rest[0] == "=":
        values = _words(rest[1:])
        if not values:
            raise InvalidExpression(f"missing value: {text!r}")
        return Call(name, tuple(values))
    if rest[0] != "(" or rest[-1] != ")":
        raise InvalidExpression(f"bad parameters: {text!r}")
    inside = rest[1:-1]
    if not inside.strip():
        raise InvalidExpression(f"empty parameters: {text!r}")
    positional, named = [], []
    for part in _split(inside, ","):
        key = re.match(r"\s*([A-Za-z0-9_.\[\]-]+)\s*=(.*)\Z", part, re.S)
        if key:
            named.append((key[1], _value(key[2])))
        elif not part.strip():
            raise InvalidExpression(f"empty parameter: {text!r}")
        else:
            positional.append(_value(part))
    if positional and named:
        raise InvalidExpression(f"positional and named parameters together: {text!r}")
    return Call(name, tuple(positional), tuple(named))


@lru_cache(maxsize=4096)
def parse(text: str) -> tuple[Step, ...]:
    """Steps of an expression; every failing step is reported, in this order."""
    steps: list[Step] = []
    for part in _split(text, ","):
        if not part.strip():
            raise InvalidExpression(f"empty rule in {text!r}")
        calls = []
        for one in _split(part, "|"):
            if not one.strip():
                raise InvalidExpression(f"empty alternative in {text!r}")
            calls.append(_call(one))
        steps.append(calls[0] if len(calls) == 1 else AnyOf(tuple(calls)))
    return tuple(steps)
