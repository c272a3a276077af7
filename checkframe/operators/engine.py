"""The checker: entry points that compile rules into columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, UnknownField, ValidationFailed
from ..functions.rule import Rule
from ..plans.adapters import Adapter, Adapters
from ..plans.cache import PlanCache
from ..plans.compiler import Errors, Failure, Group, Path, error
from ..plans.expressions import AnyOf, parse
from ..plans.kinds import Value, kind_of
from ..plans.registry import Registry
from ..plans.selection import Selection, element_of, meets, parts
from .model import Dive, MapDive, Model, model_of

ERRORS = "_errors"


@dataclass
class Result:
    """A validated DataFrame: the input's columns and ``_errors``.  Works the same on streams."""

    annotated: DataFrame
    #: rows in which each selector of single elements met one, counted as the data pass by
    observation: Observation | None = None
    selectors: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [c for c in self.annotated.columns if c != ERRORS]

    def failures(self, *keys: str) -> DataFrame:
        """One row an error, with the given columns of its record."""
        # not ``inline``: Spark would add a filter on the errors' size and build them twice
        found = self.annotated.select(*keys, F.explode_outer(ERRORS).alias("_error"))
        return found.where(F.col("_error").isNotNull()).select(*keys, "_error.*")

    @property
    def valid(self) -> DataFrame:
        return self.annotated.where(F.size(ERRORS) == 0).select(*self.columns)

    @property
    def invalid(self) -> DataFrame:
        return self.annotated.where(F.size(ERRORS) > 0).select(*self.columns)

    def summary(self) -> DataFrame:
        """Errors counted by place and rule; the places are the model's, without element numbers."""
        place = F.regexp_replace("namespace", r'\[(?:"(?:\\.|[^"\\])*"|[0-9]+)\]', "[]")
        return self.failures().groupBy(place.alias("namespace"), "rule").agg(F.count("*").alias("errors"))

    def raise_if_failed(self, limit: int = 20) -> None:
        """Raise ``ValidationFailed`` with the first failures, at most ``limit``."""
        found = self.failures().limit(limit).collect()
        if found:
            raise ValidationFailed(found)
        self.raise_if_unmatched()

    def unmatched(self) -> list[str]:
        """Selectors that named elements no row had.

        Ask after an action on ``annotated``, or what is made of it, that saw all rows; it runs no
        job.  Streams are not counted.
        """
        if self.observation is None:
            return []
        seen = self.observation.get
        return [s for i, s in enumerate(self.selectors) if not seen[f"met_{i}"]]

    def raise_if_unmatched(self) -> None:
        missed = self.unmatched()
        if missed:
            raise UnknownField(", ".join(missed))


class _Walk:
    """Builds the errors of a model, with its selection."""

    def __init__(self, registry: Registry, selection: Selection, adapters: Adapters):
        self.registry, self.selection, self.adapters = registry, selection, adapters

    def _value(self, column: Column, dtype: T.DataType, kind: str = "", optional: bool = False, sibling: Callable | None = None) -> Value:
        column, dtype, seen = self.adapters.see(column, dtype)
        return Value(column, dtype, kind or seen, optional, sibling)

    def model(self, model: Model, get: Callable[[str], Column], schema: T.StructType, path: Path, static: str, tests: tuple, errors: Errors) -> None:
        for name in model.fields:
            if name not in schema.fieldNames():
                raise UnknownField(f"{model.name}.{name}")

        def sibling(asked: str) -> Value:
            steps = asked.split(".")
            if asked in schema.fieldNames():
                steps = [asked]
            column, dtype, spec = None, schema, model
            for step in steps:
                if not isinstance(dtype, T.StructType) or step not in dtype.fieldNames():
                    raise UnknownField(f"{model.name}.{asked}")
                column = get(step) if column is None else column.getField(step)
                dtype = dtype[step].dataType
                found = spec.fields.get(step) if spec is not None else None
                spec = found.nested if found is not None else None
            return self._value(column, dtype, found.kind if found else "", found.optional if found else False)

        for name, spec in model.fields.items():
            here = f"{static}.{name}" if static else name
            if not self.selection.enters(here):
                continue
            dtype = schema[name].dataType
            value = self._value(get(name), dtype, spec.kind, spec.optional, sibling)
            self.value(value, spec, path.child(name), here, name, tests, errors)
        for check in model.checks:
            for name, rule, fails, params in check(lambda n: sibling(n).column):
                if name.split(".")[0] not in schema.fieldNames():
                    raise UnknownField(f"{model.name}.{name}")
                here = f"{static}.{name}" if static else name
                if self.selection.reports(here):
                    when = F.coalesce(fails, F.lit(False))
                    errors.add(self._bound(here, tests, when), error(Failure(when, rule, rule, params or {}), path.child(name), name, kind_of(sibling(name).dtype)))

    def value(self, value: Value, spec, path: Path, static: str, name: Column | str, tests: tuple, errors: Errors) -> None:
        """Rules of a value, then what is inside it."""
        guard = None
        if spec.rules:
            steps = parse(spec.rules)
            self.registry.check_names(steps)
            if isinstance(value.dtype, T.StructType) and spec.nested is not None and not getattr(spec, "optional", False):
                # a plain nested record is there by its type
                steps = tuple(s for s in steps if isinstance(s, AnyOf) or s.name != "required")
            failures, guard = Group(self.registry, value).run(steps)
            if self.selection.reports(static):
                for f in failures:
                    errors.add(self._bound(static, tests, f.when), error(f, path, name, value.kind))
        if spec.nested is not None:
            if not isinstance(value.dtype, T.StructType):
                raise ConfigError(f"{static}: nested needs a struct")
            inner = Errors()
            self.model(spec.nested, value.column.getField, value.dtype, path, static, tests, inner)
            failed = inner.failed()
            errors.extend(F.when(value.column.isNotNull(), inner.column()), None if failed is None else F.coalesce(value.column.isNotNull() & failed, F.lit(False)))
        if spec.dive is not None:
            errors.extend(*self.dive(value, spec.dive, path, static, tests))

    def dive(self, value: Value, dive: Dive | MapDive, path: Path, static: str, tests: tuple) -> tuple[Column, Column | None]:
        """Errors of the elements, and whether any element fails, which is asked first."""
        if isinstance(dive, MapDive):
            if not isinstance(value.dtype, T.MapType):
                raise ConfigError(f"{static}: keys and values need a map")

            def entry(e: Column) -> Errors:
                place = F.concat(F.lit("["), F.regexp_replace(F.to_json(F.array(e["key"])), r"^\[|\]$", ""), F.lit("]"))
                out = Errors()
                own = (*tests, (len(parts(static)), place))
                for column, dtype, spec in ((e["key"], value.dtype.keyType, dive.keys), (e["value"], value.dtype.valueType, dive.values)):
                    self.element(column, dtype, spec, path.at(place), static + "[]", F.concat(F.lit(static.rsplit(".", 1)[-1]), place), own, out)
                return out

            entries = F.map_entries(value.column)
            return self._named(value, static, lambda k, v, place: entry(F.struct(k.alias("key"), v.alias("value")))) or self._guarded(static, entries, lambda e: entry(e).column(), entry)
        if not isinstance(value.dtype, T.ArrayType):
            raise ConfigError(f"{static}: dive needs an array or a map")

        def item(x: Column, i: Column) -> Errors:
            place = F.concat(F.lit("["), i.cast("string"), F.lit("]"))
            out = Errors()
            own = (*tests, (len(parts(static)), place))
            self.element(x, value.dtype.elementType, dive, path.at(place), static + "[]", F.concat(F.lit(static.rsplit(".", 1)[-1]), place), own, out)
            return out

        return self._named(value, static, lambda i, x, place: item(x, i)) or self._guarded(static, value.column, lambda x, i: item(x, i).column(), lambda x: item(x, F.lit(0)))

    def _named(self, value: Value, static: str, errors_of: Callable[[Column, Column, str], Errors]) -> tuple[Column, Column | None] | None:
        """Errors of the elements that selectors name, each taken from its place; None if all are to be walked."""
        asked = self.selection.asked(static) if self.selection.mode == "partial" else None
        if asked is None:
            return None
        out = Errors()
        for place in asked:
            found = element_of(value.column, value.dtype, place)
            if found is not None:
                there, key, element = found
                own = errors_of(key, element, place)
                failed = own.failed()
                out.extend(F.when(there, own.column()), None if failed is None else there & failed)
        return out.column(), out.failed()

    def _guarded(self, static: str, array: Column, errors_of: Callable, item: Callable[[Column], Errors]) -> tuple[Column, Column | None]:
        every = F.flatten(F.transform(array, errors_of))
        known = []

        def fails(x: Column) -> Column:
            known.append(item(x).failed())
            return F.lit(True) if known[-1] is None else known[-1]

        if self.selection.places_matter(static):
            return every, None
        failed = F.coalesce(F.exists(array, fails), F.lit(False))
        return (every, None) if known[-1] is None else (F.when(failed, every), failed)

    def element(self, column: Column, dtype: T.DataType, spec: Dive, path: Path, static: str, name: Column, tests: tuple, errors: Errors) -> None:
        if not self.selection.enters(static):
            return
        for step in parse(spec.rules) if spec.rules else ():
            for call in step.calls if isinstance(step, AnyOf) else (step,):
                rule = self.registry.rules.get(call.name)
                if rule is not None and (rule.signature.field or rule.name == "unique" and (call.positional or call.named)):
                    raise ConfigError(f"{static}: {call.name} has no fields inside a dive")
        self.value(self._value(column, dtype), spec, path, static, name, tests, errors)

    def _bound(self, static: str, tests: tuple, when: Column) -> Column:
        """Narrow to the elements that selectors name, or that the filter of elements keeps."""
        if self.selection.elements is not None and tests:
            return when & self.selection.kept_elements(static, dict(tests))
        if self.selection.mode not in ("partial", "except") or not tests:
            return when
        places = dict(tests)
        covers = []
        for bound in self.selection.element_tests(static):
            test = F.lit(True)
            for i, asked in bound:
                test = test & (places[i] == F.lit(asked))
            covers.append(test)
        covered = F.lit(False)
        for test in covers:
            covered = covered | test
        return when & (covered if self.selection.mode == "partial" else ~covered)


class Checker:
    """Rules, aliases and entry points; configuration mistakes raise here, before any job."""

    def __init__(self, schema=None):
        self.registry = Registry()
        self.schema = schema
        self.adapters = Adapters()
        self.plans = PlanCache()
        #: grows with every rule, alias and adapter, so that older plans are not used again
        self.version = 0

    def with_schema(self, schema) -> Checker:
        """This checker with a dynamic schema (``sources.schema.Schema``)."""
        self.schema = schema
        return self

    def rule(self, rule: Rule) -> Checker:
        self.registry.add_rule(rule)
        self.version += 1
        return self

    def alias(self, name: str, expression: str) -> Checker:
        self.registry.add_alias(name, expression)
        self.version += 1
        return self

    def adapter(self, matches: T.DataType | Callable[[T.DataType], bool], convert: Callable[[Column], Column], dtype: T.DataType, kind: str = "") -> Checker:
        """Let rules see values of a type of the user's own as what ``convert`` makes of them."""
        self.adapters.add(Adapter(matches, convert, dtype, kind))
        self.version += 1
        return self

    def _run(self, df: DataFrame, model: Model | str, selection: Selection) -> Result:
        model = model_of(df.schema, model) if isinstance(model, str) else model
        for name in model.fields:  # a name that stands for several columns cannot be checked
            if df.columns.count(name) > 1:
                raise ConfigError(f"{name}: {df.columns.count(name)} columns have this name")

        def compiled() -> tuple[Column, Model, Selection]:
            errors = Errors()
            _Walk(self.registry, selection, self.adapters).model(model, lambda n: F.col("`" + n.replace("`", "``") + "`"), df.schema, Path((model.name,)), "", (), errors)
            selection.finish()
            # what the key names by identity has to stay alive with it
            return errors.column(), model, selection

        key = (id(df.sparkSession._jvm), self.version, df.schema.json(), repr(model), selection.key())
        checked = df.withColumn(ERRORS, self.plans.get(key, compiled)[0])
        paths = () if df.isStreaming else selection.element_paths()
        if not paths:
            return Result(checked)
        seen = Observation()
        met = [F.count_if(meets(df[p[0]], df.schema[p[0]].dataType, p[1:])).alias(f"met_{i}") for i, p in enumerate(paths)]
        return Result(checked.observe(seen, *met), seen, tuple("".join(x if x.startswith("[") or not i else f".{x}" for i, x in enumerate(p)) for p in paths))

    def validate(self, df: DataFrame, model: Model | str) -> Result:
        """Every rule of the model; a text is the type name of a model in the columns' metadata."""
        return self._run(df, model, Selection())

    def partial(self, df: DataFrame, model: Model | str, fields: Iterable[str]) -> Result:
        """Only the given fields and what is inside them."""
        return self._run(df, model, Selection("partial", fields))

    def excluding(self, df: DataFrame, model: Model | str, fields: Iterable[str]) -> Result:
        """All but the given fields and what is inside them."""
        return self._run(df, model, Selection("except", fields))

    def filter(self, df: DataFrame, model: Model | str, keep: Callable[[str], bool], elements: Callable[[Column], Column] | None = None) -> Result:
        """Fields whose path, and every path above it, the function keeps; elements are ``[]`` to it.

        ``elements`` is asked, as a column, for the places that rows have: ``lines[0]``, ``lines[0].quantity``.
        """
        return self._run(df, model, Selection("filter", keep=keep, elements=elements))

    def value(self, column: Column, expression: str, dtype: T.DataType, *, optional: bool = False, kind: str = "") -> Column:
        """Errors of one value, at ``$value``."""
        steps = parse(expression)
        self.registry.check_names(steps)
        value = Value(column, dtype, kind, optional)
        failures, _ = Group(self.registry, value).run(steps)
        errors = Errors()
        for f in failures:
            errors.add(f.when, error(f, Path(("$value",)), "$value", value.kind))
        return errors.column()

    def passes(self, column: Column, expression: str, dtype: T.DataType, *, optional: bool = False, kind: str = "") -> Column:
        """True where one value has no error."""
        return F.size(self.value(column, expression, dtype, optional=optional, kind=kind)) == 0

    def validate_json(self, df: DataFrame, column: str) -> Result:
        """The schema over JSON text in a column."""
        if self.schema is None:
            raise ConfigError("no schema")
        return Result(self.schema.annotate(self.registry, df, df[column], ERRORS))

    def validate_rows(self, df: DataFrame, *, rename: dict[str, str] | None = None, flatten: Iterable[str] = ()) -> Result:
        """The schema over typed columns, seen as the object they make.

        ``rename`` gives fields, by path, another name in that object; the fields of a struct in
        ``flatten`` join those of its parent.  NaN and the infinities count as null, dates and times
        as texts, binary values as arrays of numbers.
        """
        if self.schema is None:
            raise ConfigError("no schema")
        return Result(self.schema.annotate_rows(self.registry, df, ERRORS, rename or {}, flatten))
