"""Locales, catalogues and the renderer of failure rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidLocale
from ..plans.kinds import COLLECTIONS
from . import messages

_PLACES = ("namespace", "struct_namespace", "struct_field", "rule", "reason", "kind")


@dataclass
class Locale:
    """Templates by rule and labels by field; a template is a text or a function of the failure's columns."""

    name: str
    rules: dict[str, str | Callable[[dict[str, Column]], Column]] = field(default_factory=dict)
    fields: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def _of(name: str, data: object) -> Locale:
        if not isinstance(data, dict) or set(data) - {"rules", "fields"}:
            raise InvalidLocale("a locale has rules and fields only")
        for part in data.values():
            if not isinstance(part, dict) or not all(isinstance(k, str) and isinstance(v, str) for k, v in part.items()):
                raise InvalidLocale("rules and fields are texts by name")
        return Locale(name, dict(data.get("rules", {})), dict(data.get("fields", {})))

    @classmethod
    def from_json(cls, name: str, text: str) -> Locale:
        try:
            return cls._of(name, json.loads(text))
        except json.JSONDecodeError as e:
            raise InvalidLocale(str(e)) from e

    @classmethod
    def from_yaml(cls, name: str, text: str) -> Locale:
        import yaml

        try:
            return cls._of(name, yaml.safe_load(text))
        except yaml.YAMLError as e:
            raise InvalidLocale(str(e)) from e

    def rule(self, name: str, template) -> Locale:
        self.rules[name] = template
        return self

    def label(self, name: str, text: str) -> Locale:
        self.fields[name] = text
        return self

    def merged(self, over: Locale) -> Locale:
        """This locale with the entries of another put over its own."""
        return Locale(self.name, self.rules | over.rules, self.fields | over.fields)


def _param(name: str) -> Column:
    return F.get(F.filter("params", lambda p: p["name"] == name), 0)["text"]


def _template(text: str, known: dict[str, Column]) -> Column:
    """One pass over the template; a place that a failure lacks stays as it is written."""
    out, at = [], 0
    for m in re.finditer(r"\{([^{}]*)\}", text):
        out.append(F.lit(text[at : m.start()]))
        name = m[1]
        out.append(known[name] if name in known else F.coalesce(_param(name), F.lit(m[0])))
        at = m.end()
    out.append(F.lit(text[at:]))
    return F.concat(*out)


def _by_kind(texts: tuple[str, str, str], known: dict[str, Column]) -> Column:
    kind = known["kind"]
    return F.when(kind == "string", _template(texts[0], known)).when(kind.isin(*COLLECTIONS), _template(texts[1], known)).otherwise(_template(texts[2], known))


def _sized(sizes: dict) -> dict[str, Callable]:
    def length(known):
        low, high = _param("min").isNotNull(), _param("max").isNotNull()
        return F.when(_param("exact").isNotNull(), _by_kind(sizes["exact"], known)).when(low & high, _by_kind(sizes["between"], known)).when(low, _by_kind(sizes["min"], known)).when(high, _by_kind(sizes["max"], known)).otherwise(default_text())

    out = {name: (lambda known, name=name: _by_kind(sizes[name], known)) for name in ("min", "max", "gt", "gte", "lt", "lte")}
    return out | {"length": length, "range": lambda known: _by_kind(sizes["between"], known)}


def english() -> Locale:
    return Locale("en", messages.EN | _sized(messages.SIZES_EN))


def simplified_chinese() -> Locale:
    return Locale("zh-CN", messages.ZH_CN | _sized(messages.SIZES_ZH_CN))


def default_text() -> Column:
    return F.concat("namespace", F.lit(" failed "), "rule")


@dataclass
class Translator:
    """Renders failures; without a locale every text is the default one."""

    locale: Locale | None

    def render(self, failures: DataFrame) -> DataFrame:
        """``failures`` with the display name in ``field`` and the message in ``text``; nothing is joined or collected."""
        if self.locale is None:
            return failures.withColumn("text", default_text())
        shown = reduce(lambda c, kv: c.when(F.col("field") == kv[0], kv[1]), self.locale.fields.items(), F.when(F.lit(False), "")).otherwise(F.col("field"))
        known = {n: F.col(n) for n in _PLACES} | {"field": shown}
        made = {name: t(known) if callable(t) else _template(t, known) for name, t in self.locale.rules.items()}
        by_reason = reduce(lambda c, kv: c.when(F.col("reason") == kv[0], kv[1]), made.items(), F.when(F.lit(False), F.lit("")))
        text = reduce(lambda c, kv: c.when(F.col("rule") == kv[0], kv[1]), made.items(), F.when(F.lit(False), F.lit(""))).otherwise(by_reason.otherwise(default_text()))
        return failures.withColumn("text", text).withColumn("field", shown)


class Catalog:
    """Locales by name, with a fallback."""

    def __init__(self, fallback: str = "en"):
        self.locales = {"en": english(), "zh-CN": simplified_chinese()}
        self.fallback = fallback

    def use_locale(self, locale: Locale) -> Catalog:
        """Add a locale; entries for a known name go over those it has."""
        held = self.locales.get(locale.name)
        self.locales[locale.name] = held.merged(locale) if held else locale
        return self

    def locale(self, name: str) -> Translator:
        return Translator(self.locales.get(name) or self.locales.get(self.fallback))
