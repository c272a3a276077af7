"""Registered queries of the validation engine, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import flows, rule_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return rule_queries.queries() | flows.queries()


def oracle_sql() -> dict[str, str]:
    return rule_queries.oracle_sql() | flows.oracle_sql()
