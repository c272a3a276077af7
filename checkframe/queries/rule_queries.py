"""One query a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import Field, Model, Checker
from ..operators.engine import ERRORS
from .rule_cases import TEXT


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _text_query(expression: str, samples: tuple[str, ...]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.element_at(F.array(*map(F.lit, samples)), (F.col("c_custkey") % len(samples) + 1).cast("int")).alias("v"))
        return rows.select("k", "v", Checker().passes(F.col("v"), expression, T.StringType()).alias("ok"))

    return run


def _text_sql(samples: tuple[str, ...], predicate: str) -> str:
    values = ", ".join("'" + s.replace("'", "''") + "'" for s in samples)
    return f"SELECT k, v, CAST({predicate.replace('{v}', 'v')} AS BOOLEAN) AS ok FROM (SELECT c_custkey AS k, list_extract([{values}], CAST(1 + c_custkey % {len(samples)} AS BIGINT)) AS v FROM customer)"


#: Rules on other fields: orders with two nullable texts and a number that may be zero.
_ORDERS = """SELECT o_orderkey AS k,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '' ELSE o_orderstatus END AS a,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN '' WHEN o_orderkey % 7 = 2 THEN o_orderstatus ELSE substr(o_orderpriority, 3) END AS b,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS BIGINT) ELSE o_custkey % 4 END AS c FROM orders"""
_A, _B, _C = "coalesce(a <> '', false)", "coalesce(b <> '', false)", "coalesce(c <> 0, false)"
_C1, _BH = "coalesce(c = 1, false)", "coalesce(b = 'HIGH', false)"
CONDITIONAL = {
    "required_if": ("required_if(c=1,b=HIGH)", f"NOT ({_C1} AND {_BH}) OR {_A}"),
    "required_unless": ("required_unless(c=1,b=HIGH)", f"{_C1} OR {_BH} OR {_A}"),
    "skip_unless": ("skip_unless(c=null)", f"c IS NOT NULL OR {_A}"),
    "required_with": ("required_with(b,c)", f"NOT ({_B} OR {_C}) OR {_A}"),
    "required_with_all": ("required_with_all(b,c)", f"NOT ({_B} AND {_C}) OR {_A}"),
    "required_without": ("required_without(b,c)", f"NOT (NOT {_B} OR NOT {_C}) OR {_A}"),
    "required_without_all": ("required_without_all(b,c)", f"NOT (NOT {_B} AND NOT {_C}) OR {_A}"),
    "excluded_if": ("excluded_if(c=1,b=HIGH)", f"NOT ({_C1} AND {_BH}) OR NOT {_A}"),
    "excluded_unless": ("excluded_unless(c=1,b=HIGH)", f"{_C1} OR {_BH} OR NOT {_A}"),
    "excluded_with": ("excluded_with(b,c)", f"NOT ({_B} OR {_C}) OR NOT {_A}"),
    "excluded_with_all": ("excluded_with_all(b,c)", f"NOT ({_B} AND {_C}) OR NOT {_A}"),
    "excluded_without": ("excluded_without(b,c)", f"NOT (NOT {_B} OR NOT {_C}) OR NOT {_A}"),
    "excluded_without_all": ("excluded_without_all(b,c)", f"NOT (NOT {_B} AND NOT {_C}) OR NOT {_A}"),
    "eq_field": ("eq_field=b", "a IS NULL OR coalesce(a = b, false)"),
    "ne_field": ("ne_field=b", "a IS NULL OR coalesce(a <> b, false)"),
    "fieldcontains": ("fieldcontains=b", "a IS NULL OR coalesce(contains(a, b), false)"),
    "fieldexcludes": ("fieldexcludes=b", "a IS NULL OR coalesce(NOT contains(a, b), true)"),
    "gt_field": ("gt_field=b", "a IS NULL OR coalesce(length(a) > length(b), false)"),
    "gte_field": ("gte_field=b", "a IS NULL OR coalesce(length(a) >= length(b), false)"),
    "lt_field": ("lt_field=b", "a IS NULL OR coalesce(length(a) < length(b), false)"),
    "lte_field": ("lte_field=b", "a IS NULL OR coalesce(length(a) <= length(b), false)"),
}


def _conditional_query(expression: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.sql(_ORDERS.replace("FROM orders", "FROM {orders}"), orders=_read(spark, sf_dir, "orders"))
        found = Checker().validate(rows, Model("Order", {"a": expression})).annotated
        return found.select("k", "a", "b", "c", (F.size(ERRORS) == 0).alias("ok"))

    return run


#: Rules on numbers, times and collections: (table, key, model field, rules, predicate).
TYPED = {
    "number_length": ("customer", "c_custkey", "c_nationkey", "length(min=5,max=10)", "c_nationkey BETWEEN 5 AND 10"),
    "number_range": ("customer", "c_custkey", "c_acctbal", "range(min=0,max=5000.5)", "c_acctbal BETWEEN 0 AND 5000.5"),
    "number_min": ("customer", "c_custkey", "c_acctbal", "min=0", "c_acctbal >= 0"),
    "number_max": ("part", "p_partkey", "p_size", "max=25", "p_size <= 25"),
    "number_eq": ("part", "p_partkey", "p_size", "eq=7", "p_size = 7"),
    "number_ne": ("part", "p_partkey", "p_size", "ne=7", "p_size <> 7"),
    "number_gt": ("lineitem", "l_orderkey", "l_discount", "gt=0.05", "l_discount > 0.05"),
    "number_gte": ("lineitem", "l_orderkey", "l_quantity", "gte=25", "l_quantity >= 25"),
    "number_lt": ("lineitem", "l_orderkey", "l_tax", "lt=0.04", "l_tax < 0.04"),
    "number_lte": ("lineitem", "l_orderkey", "l_linenumber", "lte=3", "l_linenumber <= 3"),
    "number_oneof": ("customer", "c_custkey", "c_nationkey", "oneof(1,3,5,7)", "c_nationkey IN (1, 3, 5, 7)"),
    "number_noneof": ("customer", "c_custkey", "c_nationkey", "noneof(1,3,5,7)", "c_nationkey NOT IN (1, 3, 5, 7)"),
    "number_required": ("customer", "c_custkey", "c_nationkey", "required", "c_nationkey <> 0"),
    "number_isdefault": ("labels", "doc_id", "toxic", "isdefault", "toxic = 0"),
    "number_latitude": ("customer", "c_custkey", "c_acctbal", "latitude", "abs(c_acctbal) <= 90"),
    "number_luhn": ("orders", "o_orderkey", "o_orderkey", "luhn_checksum", None),
    "time_lt_now": ("orders", "o_orderkey", "o_orderdate", "lt", "true"),
    "time_gt_now": ("orders", "o_orderkey", "o_orderdate", "gt", "false"),
    "collection_length": ("embeddings", "vec_id", "embedding", "length(exact=64)", "len(embedding) = 64"),
    "collection_unique": ("embeddings", "vec_id", "embedding", "unique", "len(list_distinct(embedding)) = len(embedding)"),
    "documents_ascii": ("documents", "doc_id", "text", "ascii", "strlen(text) = length(text)"),
    "documents_length": ("documents", "doc_id", "text", "length(min=100,max=5000)", "length(text) BETWEEN 100 AND 5000"),
    "pages_html": ("pages", "page_id", "html", "html", "regexp_matches(html, '</?[a-zA-Z]+[^\\n]*>')"),
    "pages_http": ("pages", "page_id", "url", "http", "regexp_full_match(url, '(?i:https?)://[A-Za-z0-9.-]+(:[0-9]+)?([/?#][^ ]*)?')"),
    "events_json": ("events", "event_id", "props", "json", "json_valid(props)"),
}
#: Luhn's sum over the digits of a key, for the key's own query.
TYPED["number_luhn"] = (*TYPED["number_luhn"][:4], "o_orderkey >= 10 AND list_sum(list_transform(range(1, length(CAST(o_orderkey AS VARCHAR)) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(CAST(o_orderkey AS VARCHAR)), i, 1) AS BIGINT) ELSE (CAST(substr(reverse(CAST(o_orderkey AS VARCHAR)), i, 1) AS BIGINT) * 2) // 10 + (CAST(substr(reverse(CAST(o_orderkey AS VARCHAR)), i, 1) AS BIGINT) * 2) % 10 END)) % 10 = 0")


def _typed_query(table: str, key: str, column: str, rules: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = Checker().validate(_read(spark, sf_dir, table), Model(table, {column: Field(rules)})).annotated
        return found.select(F.col(key).cast("long").alias("k"), (F.size(ERRORS) == 0).alias("ok"))

    return run


def queries() -> dict:
    out = {f"rule_{name}": _text_query(expression, samples) for name, (expression, samples, _) in TEXT.items()}
    out |= {f"rule_{name}": _conditional_query(expression) for name, (expression, _) in CONDITIONAL.items()}
    return out | {f"typed_{name}": _typed_query(*spec[:4]) for name, spec in TYPED.items()}


def oracle_sql() -> dict[str, str]:
    out = {f"rule_{name}": _text_sql(samples, predicate) for name, (_, samples, predicate) in TEXT.items()}
    out |= {f"rule_{name}": f"SELECT k, a, b, c, {predicate} AS ok FROM ({_ORDERS})" for name, (_, predicate) in CONDITIONAL.items()}
    return out | {f"typed_{name}": f"SELECT CAST({key} AS BIGINT) AS k, CAST({predicate} AS BOOLEAN) AS ok FROM {table}" for name, (table, key, _, _, predicate) in TYPED.items() if predicate}
