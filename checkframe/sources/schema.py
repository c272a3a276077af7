"""Dynamic schemas (YAML or JSON text) over JSON objects, held as VARIANT, and over typed rows."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FIELD_ERROR, ConfigError, InvalidSchema, UnknownField
from ..plans.compiler import Errors, Failure, Group, Path, error
from ..plans.expressions import Call, Step, parse
from ..plans.kinds import Value
from ..plans.registry import Registry
from .nodes import KIND, JsonNode, Naming, RowNode

TYPES = tuple(KIND)
#: Of keys that stand twice in an object the last counts; read where text is parsed.
_REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"

@dataclass
class FieldDef:
    type: str | None = None
    steps: tuple[Step, ...] = ()
    fields: dict[str, FieldDef] = field(default_factory=dict)


def _text(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str | int | float):
        return str(value)
    raise InvalidSchema(f"not a parameter: {value!r}")


def _steps(spec) -> tuple[Step, ...]:
    if isinstance(spec, str):
        return parse(spec)
    if not isinstance(spec, list):
        raise InvalidSchema("rules are a text or a list")
    out: list[Step] = []
    for one in spec:
        if isinstance(one, str):
            out += parse(one)
        elif isinstance(one, dict) and len(one) == 1:
            ((name, value),) = one.items()
            if value is None:
                out.append(Call(name))
            elif isinstance(value, list):
                if not value:
                    raise InvalidSchema(f"{name}: an empty list")
                out.append(Call(name, tuple(map(_text, value))))
            elif isinstance(value, dict):
                out.append(Call(name, (), tuple((k, tuple(map(_text, v)) if isinstance(v, list) else _text(v)) for k, v in value.items())))
            else:
                out.append(Call(name, (_text(value),)))
        else:
            raise InvalidSchema("a rule is a text or an object with one key")
    return tuple(out)


def _field(name: str, spec) -> FieldDef:
    if not isinstance(spec, dict):
        raise InvalidSchema(f"{name}: not an object")
    unknown = set(spec) - {"type", "rules", "fields"}
    if unknown:
        raise InvalidSchema(f"{name}: unknown keys {sorted(unknown)}")
    kind = spec.get("type")
    if kind is not None and kind not in TYPES:
        raise InvalidSchema(f"{name}: unknown type {kind!r}")
    if "fields" in spec:
        kind = kind or "object"
        if kind not in ("array", "object"):
            raise InvalidSchema(f"{name}: a {kind} has no fields")
        if not isinstance(spec["fields"], dict):
            raise InvalidSchema(f"{name}: fields are an object")
    return FieldDef(kind, _steps(spec["rules"]) if "rules" in spec else (), {k: _field(f"{name}.{k}", v) for k, v in sorted(spec.get("fields", {}).items())})


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for as long as a plan is built; the user's own comes back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class _Shared:
    """Columns that are used many times and computed once; each level reads those before it."""

    def __init__(self):
        self.levels: dict[int, list[tuple[str, Column]]] = {}

    def keep(self, column: Column, level: int) -> Column:
        own = self.levels.setdefault(level, [])
        own.append((f"_read_{level}_{len(own)}", column))
        return F.col(own[-1][0])


class Schema:
    """A strict schema: ``fields`` by name, each with ``type``, ``rules`` and ``fields``."""

    def __init__(self, data):
        if not isinstance(data, dict) or set(data) != {"fields"} or not isinstance(data["fields"], dict):
            raise InvalidSchema("a schema has fields only")
        self.fields = {k: _field(k, v) for k, v in sorted(data["fields"].items())}

    @classmethod
    def from_json(cls, text: str) -> Schema:
        try:
            return cls(json.loads(text))
        except json.JSONDecodeError as e:
            raise InvalidSchema(str(e)) from e

    @classmethod
    def from_yaml(cls, text: str) -> Schema:
        import yaml

        try:
            return cls(yaml.safe_load(text))
        except yaml.YAMLError as e:
            raise InvalidSchema(str(e)) from e

    def annotate(self, registry: Registry, df: DataFrame, text: Column, name: str) -> DataFrame:
        """``df`` with the errors of JSON text as ``name``; text that is no object gives one ``type`` error at ``$value``.

        The text is parsed once, and each value is read once, in projections of their own.
        """
        shared = _Shared()
        root = JsonNode(shared.keep(F.try_parse_json(text), 0))
        inner = Errors()
        self._object(registry, root, self.fields, Path(), inner, shared, 1)
        wrong = Errors()
        wrong.add(F.lit(True), self._type_error(root, Path(("$value",)), "$value", "object"))
        is_object = F.coalesce(root.fits("object"), F.lit(False))
        errors = F.when(is_object, inner.column()).otherwise(wrong.column())
        given = [df[c] for c in df.columns]
        with _setting(df.sparkSession, _REPEATED_KEYS, "true"):
            for level in sorted(shared.levels):
                df = df.select("*", *(c.alias(k) for k, c in shared.levels[level]))
        return df.select(*given, errors.alias(name))

    def annotate_rows(self, registry: Registry, df: DataFrame, name: str, rename: dict[str, str], flatten: Iterable[str]) -> DataFrame:
        """``df`` with the errors of its typed rows as ``name``; columns are checked as they are, without JSON text."""
        root = RowNode(F.lit(True), df.schema, Naming.of(df.schema, rename, flatten), given={c: df[c] for c in df.columns})
        errors = Errors()
        self._object(registry, root, self.fields, Path(), errors)
        return df.withColumn(name, errors.column())

    def _type_error(self, node: JsonNode | RowNode, path: Path, name, expected: str) -> Column:
        made = error(Failure(F.lit(True), "type", "type", {"expected": expected}), path, name, "")
        return made.withField("kind", node.kind())

    def _object(self, registry: Registry, root: JsonNode | RowNode, fields: dict[str, FieldDef], path: Path, errors: Errors, shared: _Shared | None = None, level: int = 0) -> None:
        """Errors of an object's fields; ``shared`` keeps what is read of them, but not inside arrays."""

        def sibling(asked: str) -> Value:
            node, defs, found = root, fields, None
            for step in [asked] if asked in fields else asked.split("."):
                if step not in defs:
                    raise UnknownField(asked)
                found = defs[step]
                parent, node, defs = node, node.child(step), found.fields if found.type == "object" else {}
            return parent.value(step, found.type or "string", found.fields)

        for name, spec in fields.items():
            node = root.child(name)
            if shared is not None:
                node = JsonNode(shared.keep(node.v, level))

            def value(kind: str, name=name, spec=spec) -> Value:
                found = root.value(name, kind, spec.fields, siblings=sibling)
                if shared is not None:
                    found.column = shared.keep(found.column, level)
                return found

            self._one(registry, node, value, spec, path.child(name), name, errors, shared, level + 1)

    def _one(self, registry: Registry, node: JsonNode | RowNode, value, spec: FieldDef, path: Path, name, errors: Errors, shared: _Shared | None, level: int) -> None:
        registry.check_names(spec.steps)
        there = node.there()
        if spec.type is None:
            if spec.steps:
                errors.extend(self._untyped(registry, node, value, spec, path, name))
            return
        fits = ~there | F.coalesce(node.fits(spec.type), F.lit(False))
        errors.add(~fits, self._type_error(node, path, name, spec.type))
        typed = value(spec.type)
        failures, _ = Group(registry, typed).run(spec.steps)
        for f in failures:
            errors.add(fits & f.when, error(f, path, name, KIND[spec.type]))
        if spec.type == "object" and spec.fields:
            inner = Errors()
            self._object(registry, node, spec.fields, path, inner, shared, level)
            errors.extend(F.when(there & fits, inner.column()))
        elif spec.type == "array" and spec.fields:

            def item(x: JsonNode | RowNode, i: Column) -> Column:
                place = F.concat(F.lit("["), i.cast("string"), F.lit("]"))
                inner = Errors()
                self._object(registry, x, spec.fields, path.at(place), inner)
                wrong = Errors()
                wrong.add(F.lit(True), self._type_error(x, path.at(place), F.concat(F.lit(name), place), "object"))
                return F.when(F.coalesce(x.there() & x.fits("object"), F.lit(False)), inner.column()).otherwise(wrong.column())

            found = node.each(item)
            if found is not None:
                errors.extend(F.when(there & fits, F.flatten(found)))

    def _untyped(self, registry: Registry, node: JsonNode | RowNode, value, spec: FieldDef, path: Path, name) -> Column:
        """Rules by the token that a row holds; parameters that do not fit it fail the query there, as configuration errors."""
        kind, out = node.kind(), None
        for schema_type, token in KIND.items():
            if token not in node.tokens():
                continue
            try:
                failures, _ = Group(registry, value(schema_type)).run(spec.steps)
                errors = Errors()
                for f in failures:
                    errors.add(f.when, error(f, path, name, token))
                branch = errors.column()
            except UnknownField:
                raise
            except ConfigError as e:
                branch = F.raise_error(F.lit(f"{name}: {e}")).cast(f"array<{FIELD_ERROR.simpleString()}>")
            test = kind == token
            out = F.when(test, branch) if out is None else out.when(test, branch)
        absent = Errors()
        for f in Group(registry, value("string")).run(spec.steps)[0]:
            absent.add(f.when, error(f, path, name, "option"))
        return absent.column() if out is None else out.otherwise(absent.column())
