"""Configuration errors (raised on the driver) and the structure of failures (data)."""

from __future__ import annotations

from pyspark.sql import types as T


class ConfigError(ValueError):
    """A mistake in rules, schemas or selectors, found before any job starts."""


class UnknownRule(ConfigError): ...


class UnknownField(ConfigError): ...


class InvalidParam(ConfigError): ...


class InvalidExpression(ConfigError): ...


class DuplicateRule(ConfigError): ...


class ReservedName(ConfigError): ...


class RecursiveAlias(ConfigError): ...


class MissingFieldContext(ConfigError): ...


class InvalidSchema(ConfigError): ...


class InvalidLocale(ConfigError): ...


class ValidationFailed(Exception):
    """Raised by ``Result.raise_if_failed``; holds a bounded list of failures."""

    def __init__(self, failures: list):
        super().__init__("; ".join(f"field '{f['namespace']}' failed on '{f['rule']}' rule" for f in failures))
        self.failures = failures


PARAM = T.StructType().add("name", T.StringType()).add("shape", T.StringType()).add("text", T.StringType())
FIELD_ERROR = T.StructType()
for _name in ("namespace", "struct_namespace", "field", "struct_field", "kind", "rule", "reason"):
    FIELD_ERROR = FIELD_ERROR.add(_name, T.StringType())
FIELD_ERROR = FIELD_ERROR.add("params", T.ArrayType(PARAM))
