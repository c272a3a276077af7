"""Steps of an expression as guarded failures.

A guard column runs along the steps: ``omitempty`` closes it on an absent value, and
no later step of the field reports anything.  Each failing step gives one error.
Everything that depends on types and parameters alone is settled here, before a job
starts, whatever the data hold.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FIELD_ERROR, InvalidExpression, MissingFieldContext
from .expressions import AnyOf, Call, Step
from .kinds import Value
from .registry import Registry


@dataclass
class Failure:
    """One possible error: where it holds, and what it says."""

    when: Column
    rule: str
    reason: str
    params: dict = field(default_factory=dict)


def _true() -> Column:
    return F.lit(True)


class Group:
    """Compiles the steps of one field."""

    def __init__(self, registry: Registry, value: Value):
        self.registry, self.value = registry, value

    def _check(self, call: Call) -> tuple[Column, dict]:
        rule = self.registry.rules[call.name]
        params = rule.signature.bind(call)
        if rule.signature.field and self.value.siblings is None:
            raise MissingFieldContext(f"{call.name} needs other fields")
        return rule.passes(self.value, params), params

    def run(self, steps: tuple[Step, ...], guard: Column | None = None, shown: str | None = None) -> tuple[list[Failure], Column]:
        """Failures in order, and the guard after the last step."""
        guard = _true() if guard is None else guard
        out: list[Failure] = []
        for step in steps:
            if isinstance(step, AnyOf):
                passed, stopped = self._any(step)
                names = "|".join(c.name for c in step.calls)
                out.append(Failure(guard & ~passed & ~stopped, shown or names, names))
                guard = guard & ~stopped
            elif step.name == "omitempty":
                self._bare(step)
                guard = guard & self.value.present()
            elif step.name in self.registry.aliases:
                inner, guard = self.run(self.registry.aliases[step.name], guard, shown or step.name)
                out += inner
            else:
                passed, params = self._check(step)
                out.append(Failure(guard & ~passed, shown or step.name, step.name, params))
        return out, guard

    def _bare(self, call: Call) -> None:
        if call.positional or call.named:
            raise InvalidExpression("omitempty takes no parameters")

    def _any(self, group: AnyOf) -> tuple[Column, Column]:
        """Whether an alternative passes, and whether one stops the field before any passes."""
        passed, stopped = F.lit(False), F.lit(False)
        for call in group.calls:
            if call.name == "omitempty":
                self._bare(call)
                there = self.value.present()
                ok, stop = there, ~there
            elif call.name in self.registry.aliases:
                failures, after = self.run(self.registry.aliases[call.name])
                failed = F.lit(False)
                for f in failures:
                    failed = failed | f.when
                # a stop without errors stops the field; with errors it is a failed alternative
                stop, ok = ~after & ~failed, after & ~failed
            else:
                ok, stop = self._check(call)[0], F.lit(False)
            stopped = stopped | (~passed & stop)
            passed = passed | (ok & ~stopped)
        return passed, stopped


def params_column(params: dict) -> Column:
    """Bound parameters, by name: text, list (joined by commas) or pairs."""
    parts = []
    for name, value in sorted(params.items()):
        if isinstance(value, str):
            shape, text = "text", value
        elif value and isinstance(value[0], tuple):
            shape, text = "pairs", ",".join(f"{k}={v}" for k, v in value)
        else:
            shape, text = "list", ",".join(value)
        parts.append(F.struct(F.lit(name).alias("name"), F.lit(shape).alias("shape"), F.lit(text).alias("text")))
    return F.array(*parts) if parts else F.array().cast(FIELD_ERROR["params"].dataType)


@dataclass(frozen=True)
class Path:
    """A place in a record; parts are text or, for places found in the data, columns."""

    parts: tuple = ()

    def child(self, name: str) -> Path:
        return Path((*self.parts, "." + name if self.parts else name))

    def at(self, suffix: Column) -> Path:
        return Path((*self.parts, suffix))

    def column(self) -> Column:
        columns = [p if isinstance(p, Column) else F.lit(p) for p in self.parts]
        return columns[0] if len(columns) == 1 else F.concat(*columns)


def error(failure: Failure, path: Path, name: Column | str, kind: str) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    where = path.column()
    made = {"namespace": where, "struct_namespace": where, "field": name, "struct_field": name, "kind": F.lit(kind), "rule": F.lit(failure.rule), "reason": F.lit(failure.reason), "params": params_column(failure.params)}
    return F.struct(*[c.alias(k) for k, c in made.items()])


class Errors:
    """Collects possible errors in order and turns them into one array column."""

    def __init__(self):
        self.parts: list[tuple[Column, Column] | Column] = []
        #: tests of all parts; None once a part came without one
        self.tests: list[Column] | None = []

    def add(self, when: Column, what: Column) -> None:
        self.parts.append((when, what))
        if self.tests is not None:
            self.tests.append(when)

    def extend(self, array: Column, failed: Column | None = None) -> None:
        """An array of errors; ``failed`` tells, more cheaply, whether it holds any."""
        self.parts.append(array)
        self.tests = None if failed is None or self.tests is None else [*self.tests, failed]

    def failed(self) -> Column | None:
        """Whether any error holds, if all parts can tell."""
        if self.tests is None:
            return None
        out = F.lit(False)
        for test in self.tests:
            out = out | test
        return out

    def column(self) -> Column:
        """Records, and elements, that pass everything pay for the tests only."""
        empty = F.array().cast("array<" + FIELD_ERROR.simpleString() + ">")
        arrays, singles = [], []

        def flush():
            if singles:
                arrays.append(F.array_compact(F.array(*[F.when(w, e) for w, e in singles])))
                singles.clear()

        for part in self.parts:
            if isinstance(part, tuple):
                singles.append(part)
            else:
                flush()
                arrays.append(F.coalesce(part, empty))
        flush()
        if not arrays:
            return empty
        out = arrays[0] if len(arrays) == 1 else F.concat(*arrays)
        return out if self.tests is None else F.when(self.failed(), out).otherwise(empty)
