"""Queries of flows: models, traversal, schemas, selection, messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rule import Rule
from ..i18n import Catalog, Locale
from ..operators import Checker, Dive, Field, MapDive, Model
from ..operators.engine import ERRORS
from ..plans.signature import Signature, target
from ..sources import Schema

CUSTOMER = Model("Customer", {"c_name": "required,startswith=Customer#,length(exact=18)", "c_acctbal": "gte=0", "c_mktsegment": "oneof(BUILDING,MACHINERY)"})
ORDER = Model("Order", {"status": "oneof(F,O)", "customer": Field(nested=Model("Customer", {"name": "endswith=7", "balance": "gt=100"})), "lines": Field("unique=part,length(max=5)", dive=Dive(nested=Model("Line", {"quantity": "lte=40", "flag": "oneof(N,A)"}))), "marks": Field(dive=MapDive(Dive("ne=size"), Dive("min=2")))})


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def summary_by_rule(spark, sf_dir):
    return Checker().validate(_read(spark, sf_dir, "customer"), CUSTOMER).summary()


def customer_failures(spark, sf_dir):
    return Checker().validate(_read(spark, sf_dir, "customer"), CUSTOMER).failures("c_custkey").select("c_custkey", "namespace", "field", "kind", "rule", "reason")


def customer_valid(spark, sf_dir):
    return Checker().validate(_read(spark, sf_dir, "customer"), CUSTOMER).valid.select("c_custkey")


def _orders(spark, sf_dir) -> DataFrame:
    """Orders with their customer as a struct, lines as an array and a small map."""
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag")))).alias("lines"))
    customer = _read(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).alias("customer"))
    rows = _read(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    marks = F.create_map(F.lit("size"), F.substring(F.col("o_orderpriority"), 1, 1), F.lit("status"), F.concat("o_orderstatus", F.lit("!")))
    return rows.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), "customer", "lines", marks.alias("marks"))


def _places(found: DataFrame) -> DataFrame:
    return found.select("k", "namespace", "rule")


def nested_orders(spark, sf_dir):
    return _places(Checker().validate(_orders(spark, sf_dir), ORDER).failures("k"))


def partial_orders(spark, sf_dir):
    return _places(Checker().partial(_orders(spark, sf_dir), ORDER, ["customer.name", "lines[0].quantity"]).failures("k"))


def except_orders(spark, sf_dir):
    return _places(Checker().excluding(_orders(spark, sf_dir), ORDER, ["lines", 'marks["size"]']).failures("k"))


def filter_orders(spark, sf_dir):
    return _places(Checker().filter(_orders(spark, sf_dir), ORDER, lambda path: not path.startswith("customer") and path != "status").failures("k"))


def filter_elements(spark, sf_dir):
    """A filter that looks at single elements of an array."""
    found = Checker().filter(_orders(spark, sf_dir), ORDER, lambda path: path.startswith("lines"), lambda place: ~place.startswith("lines[0]") & (place != "lines[1].flag"))
    return _places(found.failures("k"))


_LINES = "SELECT l_orderkey AS k, l_partkey AS part, l_quantity AS quantity, l_returnflag AS flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) - 1 AS i FROM lineitem"
_STATUS = "SELECT o_orderkey AS k, 'Order.status' AS namespace, 'oneof' AS rule FROM orders WHERE o_orderstatus NOT IN ('F', 'O')"
_NAME = "SELECT o_orderkey AS k, 'Order.customer.name' AS namespace, 'endswith' AS rule FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name NOT LIKE '%7'"
_BALANCE = "SELECT o_orderkey, 'Order.customer.balance', 'gt' FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT c_acctbal > 100"
_UNIQUE = "SELECT l_orderkey, 'Order.lines', 'unique' FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey HAVING count(*) <> count(DISTINCT l_partkey)"
_MANY = "SELECT l_orderkey, 'Order.lines', 'length' FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey HAVING count(*) > 5"
_QUANTITY = f"SELECT k, 'Order.lines[' || i || '].quantity' AS namespace, 'lte' AS rule FROM ({_LINES}) JOIN orders ON k = o_orderkey WHERE quantity > 40"
_FLAG = f"SELECT k, 'Order.lines[' || i || '].flag', 'oneof' FROM ({_LINES}) JOIN orders ON k = o_orderkey WHERE flag NOT IN ('N', 'A')"
_SIZE_KEY = "SELECT o_orderkey, 'Order.marks[\"size\"]', 'ne' FROM orders"
_SIZE = "SELECT o_orderkey, 'Order.marks[\"size\"]', 'min' FROM orders"


def omitempty_flow(spark, sf_dir):
    rows = _flow_rows(spark, sf_dir)
    return _places(Checker().alias("opt_short", "omitempty,max=4").validate(rows, Model("T", {"v": "opt_short,min=3,startswith=F|startswith=O"})).failures("k"))


def _flow_rows(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.expr("CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN o_orderstatus WHEN o_orderkey % 4 = 2 THEN o_orderstatus || 'xx' ELSE o_orderpriority END").alias("v"))


_FLOW = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN o_orderstatus WHEN o_orderkey % 4 = 2 THEN o_orderstatus || 'xx' ELSE o_orderpriority END AS v FROM orders"


def or_group(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer")
    found = Checker().validate(rows, Model("Customer", {"c_mktsegment": "eq=BUILDING|startswith=M|endswith=E"}))
    return found.failures("c_custkey").select("c_custkey", "rule", "reason", F.size("params").cast("long").alias("n_params"))


def dive_embeddings_range(spark, sf_dir):
    found = Checker().validate(_read(spark, sf_dir, "embeddings"), Model("E", {"embedding": Field(dive=Dive("range(min=-0.3,max=0.3)"))}))
    return found.failures("vec_id").select("vec_id", "namespace", "rule")


SCHEMA = {"fields": {"k": {"type": "uint", "rules": "range(min=10,max=90)"}, "missing": {"type": "string", "rules": "required"}}}


def schema_events_props(spark, sf_dir):
    found = Checker(Schema(SCHEMA)).validate_json(_read(spark, sf_dir, "events"), "props")
    return found.failures("event_id").select("event_id", "namespace", "kind", "rule")


ROWS = {"fields": {"c_acctbal": {"type": "float", "rules": "gte=0"}, "c_custkey": {"type": "int"}, "c_mktsegment": {"type": "string", "rules": [{"oneof": ["BUILDING", "MACHINERY"]}]}}}


def schema_customer_rows(spark, sf_dir):
    found = Checker(Schema(ROWS)).validate_rows(_read(spark, sf_dir, "customer"))
    return found.failures("c_custkey").select("c_custkey", "namespace", "kind", "rule")


def _messages(name: str):
    def run(spark, sf_dir):
        catalog = Catalog().use_locale(Locale("en", {}, {"c_acctbal": "Balance"}))
        found = Checker().validate(_read(spark, sf_dir, "customer"), CUSTOMER).failures("c_custkey")
        return catalog.locale(name).render(found).select("c_custkey", "field", "rule", "text")

    return run


def struct_check(spark, sf_dir):
    def check(get):
        wrong = (get("l_discount") > get("l_tax")) & (get("l_quantity") > 45)
        return [("l_discount", "pair", wrong, {}), ("l_tax", "pair", wrong, {})]

    model = Model("Line", {"l_quantity": "gt=0"}, [check])
    return Checker().validate(_read(spark, sf_dir, "lineitem"), model).failures("l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "namespace", "rule")


def custom_rule(spark, sf_dir):
    even = Rule("even", lambda v, p: v.column % 2 == 0)
    model = Model("Part", {"p_size": "even,gt=4"})
    return Checker().rule(even).validate(_read(spark, sf_dir, "part"), model).failures("p_partkey").select("p_partkey", "rule")


def field_ship_after_order(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    found = Checker().validate(rows, Model("Line", {"l_shipdate": "gt_field=o_orderdate", "l_discount": "lte_field=l_tax"}))
    return found.failures("l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "field", "rule")


TALK = """{"fields": {
  "meta": {"type": "object", "fields": {"turns": {"type": "int", "rules": "lte=4"}, "first": {"rules": [{"oneof": ["user", "assistant"]}]}}},
  "turns": {"type": "array", "rules": "length(max=6)", "fields": {"role": {"type": "string", "rules": "oneof(user,assistant)"}, "text": {"type": "string", "rules": "max=400"}, "turn": {"type": "uint", "rules": "lt=3"}}}}}"""


def schema_conversations(spark, sf_dir):
    """A schema from text over conversations as JSON: nested objects, arrays, an untyped field."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    rows = talks.select("conv_id", F.to_json(F.struct(F.struct(F.size("turns").alias("turns"), F.get("turns", 0)["role"].alias("first")).alias("meta"), "turns")).alias("talk"))
    return Checker(Schema.from_json(TALK)).validate_json(rows, "talk").failures("conv_id").select("conv_id", "namespace", "kind", "rule")


def unique_compound_keys(spark, sf_dir):
    """Long arrays, each supplier's lines, with keys of one field and of several."""
    line = F.struct(F.col("l_orderkey").alias("order"), F.col("l_quantity").alias("quantity"), F.struct(F.col("l_partkey").alias("key")).alias("part"))
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_list(line).alias("lines"))
    model = Model("Supplier", {"lines": "unique=order|max=1,unique(order,quantity)|max=1,unique(part.key,order,quantity)"})
    return Checker().validate(rows, model).failures("l_suppkey").select("l_suppkey", "namespace", "rule", "reason")


def _repeated_keys(spark, sf_dir) -> DataFrame:
    """Orders as JSON in which ``a`` stands twice, at the top and inside ``o``; every fifth text is cut short."""
    text = F.concat(F.lit('{"a":"x","o":{"n":1.5,"n":'), F.col("o_custkey"), F.lit('},"a":'), F.col("o_orderkey"), F.lit("}"))
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
    return rows.withColumn("t", F.expr("CASE WHEN o_orderkey % 5 = 0 THEN substr(t, 1, length(t) - 1) ELSE t END"))


def json_repeated_keys(spark, sf_dir):
    """Text with repeated keys is JSON, and of these the last counts."""
    rows = _repeated_keys(spark, sf_dir).withColumn("ok", Checker().passes(F.col("t"), "json", T.StringType()))
    schema = Schema({"fields": {"a": {"type": "uint", "rules": "lte=3000"}, "o": {"type": "object", "fields": {"n": {"type": "int", "rules": "gt=50"}}}}})
    found = Checker(schema).validate_json(rows, "t").failures("o_orderkey", "ok")
    return found.select("o_orderkey", "ok", "namespace", "kind", "rule")


NESTED_ROWS = {
    "fields": {
        "key": {"type": "int", "rules": "lt=5000"},
        "balance": {"type": "float", "rules": "gte=0"},
        "name": {"type": "string", "rules": "endswith=7"},
        "day": {"type": "string", "rules": "startswith=199"},
        "lines": {"type": "array", "rules": "unique(part,quantity),max=5", "fields": {"quantity": {"type": "float", "rules": "lte=40"}, "flag": {"type": "string", "rules": "oneof(N,A)"}, "part": {"type": "uint"}}},
        "marks": {"type": "object", "fields": {"size": {"type": "string", "rules": "ne=1"}}},
        "clerk": {"rules": "required"},
    }
}


def schema_nested_rows(spark, sf_dir):
    """A schema over typed rows: a renamed column, a flattened struct, dates, arrays of structs, a map."""
    rows = _orders(spark, sf_dir).join(_read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("day")), "k")
    found = Checker(Schema(NESTED_ROWS)).validate_rows(rows, rename={"k": "key"}, flatten=["customer"])
    return found.failures("k").select("k", "namespace", "kind", "rule")


def field_dotted(spark, sf_dir):
    """A rule that looks at a field of a nested record."""
    rows = _orders(spark, sf_dir).join(_read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price")), "k")
    return _places(Checker().validate(rows, Model("Order", {"price": "gt_field=customer.balance"})).failures("k"))


def wide_integers(spark, sf_dir):
    """Values of 38 digits, and bounds of more, up to those of 128 bits."""
    digits = F.lpad(F.col("o_orderkey").cast("string"), 38, "9")
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), digits.cast("decimal(38,0)").alias("high"), F.concat(F.lit("-"), digits).cast("decimal(38,0)").alias("low"), (F.col("o_orderkey") % 7).alias("narrow"))
    model = Model("Wide", {"high": f"lt={10**38},max={10**38 - 10**4}", "low": f"gt={-(2**127)},min={10**4 - 10**38}", "narrow": f"omitempty,gte={10**38}"})
    return _places(Checker().validate(rows, model).failures("k"))


def custom_rule_with_parameter(spark, sf_dir):
    multiple = Rule("multiple", lambda v, p: v.column % int(p["of"]) == 0, Signature("text", "of"))
    found = Checker().rule(multiple).validate(_read(spark, sf_dir, "part"), Model("Part", {"p_size": "multiple=3"})).failures("p_partkey")
    return found.select("p_partkey", "rule", F.get("params", 0)["text"].alias("of"))


def i18n_order_and_fallback(spark, sf_dir):
    """An unknown locale falls back; a template of the rule's name goes before one of its reason, which an alias hands on."""
    checker = Checker().alias("balance", "gte=0").alias("segment", "oneof(BUILDING,MACHINERY)")
    catalog = Catalog().use_locale(Locale.from_json("en", '{"rules": {"balance": "{field} is overdrawn"}, "fields": {"c_acctbal": "Account"}}'))
    found = checker.validate(_read(spark, sf_dir, "customer"), Model("Customer", {"c_acctbal": "balance", "c_mktsegment": "segment"})).failures("c_custkey")
    return catalog.locale("xx").render(found).select("c_custkey", "rule", "reason", "text")


def adapted_money(spark, sf_dir):
    """A struct of the user's own, seen as the number it holds, also inside an array."""
    money = lambda c: F.struct(F.col(c).alias("amount"), F.lit("EUR").alias("currency"))
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", money("l_extendedprice").alias("price"), F.array(money("l_discount"), money("l_tax")).alias("rates"))
    checker = Checker().adapter(lambda t: isinstance(t, T.StructType) and t.fieldNames() == ["amount", "currency"], lambda c: c["amount"].cast("double"), T.DoubleType())
    model = Model("Line", {"price": "range(min=1000,max=50000)", "rates": Field(dive=Dive("lt=0.08"))})
    return checker.validate(rows, model).failures("l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "namespace", "kind", "rule")


def custom_field_rule(spark, sf_dir):
    """A rule of the user's own that looks at another field."""
    twice = Rule("twice_field", lambda v, p: v.column >= 2 * v.siblings(p["compare"]).column, target())
    model = Model("Line", {"l_discount": "twice_field=l_tax"})
    return Checker().rule(twice).validate(_read(spark, sf_dir, "lineitem"), model).failures("l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "namespace", "rule", F.get("params", 0)["text"].alias("compare"))


def message_function(spark, sf_dir):
    """A message that a function writes from the failure's columns."""
    locale = Locale("en").rule("gte", lambda c: F.concat(F.upper(c["field"]), F.lit(" fails "), c["rule"])).label("c_acctbal", "Balance")
    found = Checker().validate(_read(spark, sf_dir, "customer"), Model("Customer", {"c_acctbal": "gte=0", "c_mktsegment": "oneof(BUILDING)"})).failures("c_custkey")
    return Catalog().use_locale(locale).locale("en").render(found).select("c_custkey", "rule", "text")


def errors_per_record(spark, sf_dir):
    found = Checker().validate(_read(spark, sf_dir, "customer"), CUSTOMER).annotated
    return found.select("c_custkey", F.size(ERRORS).cast("long").alias("errors"))


QUERIES = {
    f.__name__: f
    for f in (summary_by_rule, customer_failures, customer_valid, nested_orders, partial_orders, except_orders, filter_orders, filter_elements, omitempty_flow, or_group, dive_embeddings_range, schema_events_props, schema_customer_rows, struct_check, custom_rule, wide_integers, custom_rule_with_parameter, field_ship_after_order, field_dotted, schema_conversations, i18n_order_and_fallback, errors_per_record, unique_compound_keys, json_repeated_keys, schema_nested_rows, adapted_money, custom_field_rule, message_function)
} | {"i18n_en_messages": _messages("en"), "i18n_zh_messages": _messages("zh-CN")}

_CUSTOMER = """SELECT c_custkey, 'c_name' AS field, 'required' AS rule FROM customer WHERE c_name = ''
UNION ALL SELECT c_custkey, 'c_name', 'startswith' FROM customer WHERE c_name NOT LIKE 'Customer#%'
UNION ALL SELECT c_custkey, 'c_name', 'length' FROM customer WHERE length(c_name) <> 18
UNION ALL SELECT c_custkey, 'c_acctbal', 'gte' FROM customer WHERE NOT c_acctbal >= 0
UNION ALL SELECT c_custkey, 'c_mktsegment', 'oneof' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"""
ORACLES = {
    "summary_by_rule": f"SELECT 'Customer.' || field AS namespace, rule, count(*) AS errors FROM ({_CUSTOMER}) GROUP BY ALL",
    "customer_failures": f"SELECT c_custkey, 'Customer.' || field AS namespace, field, CASE field WHEN 'c_acctbal' THEN 'float' ELSE 'string' END AS kind, rule, rule AS reason FROM ({_CUSTOMER})",
    "customer_valid": f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM ({_CUSTOMER}))",
    "errors_per_record": f"SELECT c_custkey, (SELECT count(*) FROM ({_CUSTOMER}) e WHERE e.c_custkey = customer.c_custkey) AS errors FROM customer",
    "nested_orders": " UNION ALL ".join((_STATUS, _NAME, _BALANCE, _UNIQUE, _MANY, _QUANTITY, _FLAG, _SIZE_KEY, _SIZE)),
    "partial_orders": f"{_NAME} UNION ALL SELECT * FROM ({_QUANTITY}) WHERE namespace = 'Order.lines[0].quantity'",
    "except_orders": " UNION ALL ".join((_STATUS, _NAME, _BALANCE)),
    "filter_orders": " UNION ALL ".join((_QUANTITY, _UNIQUE, _MANY, _FLAG, _SIZE_KEY, _SIZE)),
    "filter_elements": " UNION ALL ".join((f"SELECT * FROM ({_QUANTITY}) WHERE namespace NOT LIKE '%[0]%'", _UNIQUE, _MANY, f"SELECT * FROM ({_FLAG}) AS f(k, namespace, rule) WHERE namespace NOT LIKE '%[0]%' AND namespace NOT LIKE '%[1]%'")),
    "omitempty_flow": f"""WITH t AS ({_FLOW}) SELECT k, 'T.v' AS namespace, 'opt_short' AS rule FROM t WHERE length(v) > 4
UNION ALL SELECT k, 'T.v', 'min' FROM t WHERE v <> '' AND length(v) < 3
UNION ALL SELECT k, 'T.v', 'startswith|startswith' FROM t WHERE v <> '' AND NOT (v LIKE 'F%' OR v LIKE 'O%')""",
    "or_group": "SELECT c_custkey, 'eq|startswith|endswith' AS rule, 'eq|startswith|endswith' AS reason, CAST(0 AS BIGINT) AS n_params FROM customer WHERE NOT (c_mktsegment = 'BUILDING' OR c_mktsegment LIKE 'M%' OR c_mktsegment LIKE '%E')",
    "dive_embeddings_range": "SELECT vec_id, 'E.embedding[' || (i - 1) || ']' AS namespace, 'range' AS rule FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE x < CAST(-0.3 AS FLOAT) OR x > CAST(0.3 AS FLOAT)",
    "schema_events_props": """SELECT event_id, 'k' AS namespace, 'uint' AS kind, 'range' AS rule FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) NOT BETWEEN 10 AND 90
UNION ALL SELECT event_id, 'missing', 'string', 'required' FROM events""",
    "schema_customer_rows": """SELECT c_custkey, 'c_acctbal' AS namespace, 'float' AS kind, 'gte' AS rule FROM customer WHERE c_acctbal < 0
UNION ALL SELECT c_custkey, 'c_mktsegment', 'string', 'oneof' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')""",
    "i18n_en_messages": f"""SELECT c_custkey, CASE field WHEN 'c_acctbal' THEN 'Balance' ELSE field END AS field, rule,
CASE rule WHEN 'gte' THEN 'Balance must be greater than or equal to 0' WHEN 'oneof' THEN 'c_mktsegment must be one of: BUILDING,MACHINERY' WHEN 'length' THEN 'c_name length must be exactly 18' WHEN 'startswith' THEN 'c_name must start with Customer#' ELSE 'c_name is required' END AS text FROM ({_CUSTOMER})""",
    "i18n_zh_messages": f"""SELECT c_custkey, field, rule,
CASE rule WHEN 'gte' THEN 'c_acctbal必须大于或等于0' WHEN 'oneof' THEN 'c_mktsegment必须是以下值之一：BUILDING,MACHINERY' WHEN 'length' THEN 'c_name长度必须等于18' WHEN 'startswith' THEN 'c_name必须以Customer#开头' ELSE 'c_name不能为空' END AS text FROM ({_CUSTOMER})""",
    "struct_check": """SELECT l_orderkey, l_linenumber, 'Line.l_quantity' AS namespace, 'gt' AS rule FROM lineitem WHERE NOT l_quantity > 0
UNION ALL SELECT l_orderkey, l_linenumber, 'Line.l_discount', 'pair' FROM lineitem WHERE l_discount > l_tax AND l_quantity > 45
UNION ALL SELECT l_orderkey, l_linenumber, 'Line.l_tax', 'pair' FROM lineitem WHERE l_discount > l_tax AND l_quantity > 45""",
    "unique_compound_keys": """WITH n AS (SELECT l_suppkey, count(*) AS n, count(DISTINCT l_orderkey) AS a, count(DISTINCT (l_orderkey, l_quantity)) AS b, count(DISTINCT (l_partkey, l_orderkey, l_quantity)) AS c FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, 'Supplier.lines' AS namespace, 'unique|max' AS rule, 'unique|max' AS reason FROM n WHERE a < n AND n > 1
UNION ALL SELECT l_suppkey, 'Supplier.lines', 'unique|max', 'unique|max' FROM n WHERE b < n AND n > 1
UNION ALL SELECT l_suppkey, 'Supplier.lines', 'unique', 'unique' FROM n WHERE c < n""",
    "json_repeated_keys": """SELECT o_orderkey, false AS ok, '$value' AS namespace, 'option' AS kind, 'type' AS rule FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, true, 'a', 'uint', 'lte' FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey > 3000
UNION ALL SELECT o_orderkey, true, 'o.n', 'int', 'gt' FROM orders WHERE o_orderkey % 5 <> 0 AND o_custkey <= 50""",
    "schema_nested_rows": f"""SELECT o_orderkey AS k, 'key' AS namespace, 'int' AS kind, 'lt' AS rule FROM orders WHERE o_orderkey >= 5000
UNION ALL SELECT o_orderkey, 'balance', 'float', 'gte' FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0
UNION ALL SELECT o_orderkey, 'name', 'string', 'endswith' FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name NOT LIKE '%7'
UNION ALL SELECT o_orderkey, 'day', 'string', 'startswith' FROM orders WHERE strftime(o_orderdate, '%Y') NOT LIKE '199%'
UNION ALL SELECT l_orderkey, 'lines', 'vec', 'unique' FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey HAVING count(*) <> count(DISTINCT (l_partkey, l_quantity))
UNION ALL SELECT l_orderkey, 'lines', 'vec', 'max' FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey HAVING count(*) > 5
UNION ALL SELECT k, 'lines[' || i || '].quantity', 'float', 'lte' FROM ({_LINES}) JOIN orders ON k = o_orderkey WHERE quantity > 40
UNION ALL SELECT k, 'lines[' || i || '].flag', 'string', 'oneof' FROM ({_LINES}) JOIN orders ON k = o_orderkey WHERE flag NOT IN ('N', 'A')
UNION ALL SELECT o_orderkey, 'marks.size', 'string', 'ne' FROM orders WHERE substr(o_orderpriority, 1, 1) = '1'
UNION ALL SELECT o_orderkey, 'clerk', 'option', 'required' FROM orders""",
    "adapted_money": """SELECT l_orderkey, l_linenumber, 'Line.price' AS namespace, 'float' AS kind, 'range' AS rule FROM lineitem WHERE l_extendedprice NOT BETWEEN 1000 AND 50000
UNION ALL SELECT l_orderkey, l_linenumber, 'Line.rates[0]', 'float', 'lt' FROM lineitem WHERE NOT l_discount < 0.08::DOUBLE
UNION ALL SELECT l_orderkey, l_linenumber, 'Line.rates[1]', 'float', 'lt' FROM lineitem WHERE NOT l_tax < 0.08::DOUBLE""",
    "custom_field_rule": "SELECT l_orderkey, l_linenumber, 'Line.l_discount' AS namespace, 'twice_field' AS rule, 'l_tax' AS compare FROM lineitem WHERE NOT l_discount >= 2 * l_tax",
    "message_function": """SELECT c_custkey, 'gte' AS rule, 'BALANCE fails gte' AS text FROM customer WHERE c_acctbal < 0
UNION ALL SELECT c_custkey, 'oneof', 'c_mktsegment must be one of: BUILDING' FROM customer WHERE c_mktsegment <> 'BUILDING'""",
    "custom_rule": "SELECT p_partkey, 'even' AS rule FROM part WHERE p_size % 2 <> 0 UNION ALL SELECT p_partkey, 'gt' FROM part WHERE p_size <= 4",
    "wide_integers": f"""WITH t AS (SELECT o_orderkey AS k, CAST(lpad(CAST(o_orderkey AS VARCHAR), 38, '9') AS HUGEINT) AS high FROM orders), m AS (SELECT k, high, -high AS low, k % 7 AS narrow FROM t)
        SELECT k, 'Wide.high' AS namespace, 'max' AS rule FROM m WHERE high > {10**38 - 10**4} UNION ALL SELECT k, 'Wide.low', 'min' FROM m WHERE low < {10**4 - 10**38}
        UNION ALL SELECT k, 'Wide.narrow', 'gte' FROM m WHERE narrow <> 0 AND narrow < {10**38}""",
    "custom_rule_with_parameter": "SELECT p_partkey, 'multiple' AS rule, '3' AS of FROM part WHERE p_size % 3 <> 0",
    "field_dotted": "SELECT o_orderkey AS k, 'Order.price' AS namespace, 'gt_field' AS rule FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT o_totalprice > c_acctbal",
    "schema_conversations": """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, 'meta.turns' AS namespace, 'int' AS kind, 'lte' AS rule FROM t WHERE i = 0 AND n > 4
UNION ALL SELECT conv_id, 'meta.first', 'string', 'oneof' FROM t WHERE i = 0 AND role NOT IN ('user', 'assistant')
UNION ALL SELECT conv_id, 'turns', 'vec', 'length' FROM t WHERE i = 0 AND n > 6
UNION ALL SELECT conv_id, 'turns[' || i || '].role', 'string', 'oneof' FROM t WHERE role NOT IN ('user', 'assistant')
UNION ALL SELECT conv_id, 'turns[' || i || '].text', 'string', 'max' FROM t WHERE length(text) > 400
UNION ALL SELECT conv_id, 'turns[' || i || '].turn', 'uint', 'lt' FROM t WHERE turn >= 3""",
    "i18n_order_and_fallback": """SELECT c_custkey, 'balance' AS rule, 'gte' AS reason, 'Account is overdrawn' AS text FROM customer WHERE c_acctbal < 0
UNION ALL SELECT c_custkey, 'segment', 'oneof', 'c_mktsegment must be one of: BUILDING,MACHINERY' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')""",
    "field_ship_after_order": """SELECT l_orderkey, l_linenumber, 'l_shipdate' AS field, 'gt_field' AS rule FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT l_shipdate > o_orderdate
UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', 'lte_field' FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT l_discount <= l_tax""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
