"""Schemas bound to typed rows, repeated keys in JSON, and keys by value."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checkframe.errors import ConfigError, UnknownField
from checkframe.operators import Checker, Model
from checkframe.sources import Schema

REPEATED = "spark.sql.variant.allowDuplicateKeys"


def errors(df, fields, **kw):
    found = Checker(Schema({"fields": fields})).validate_rows(df, **kw).annotated
    return [[(e.namespace, e.kind, e.rule) for e in r._errors] for r in found.collect()]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().lower()


def test_numbers_that_json_has_not(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(nan, 1.5), (inf, 0.0), (-inf, None), (2.0, 5.0)], "a double, b float").coalesce(1)
    got = errors(df, {"a": {"type": "float", "rules": "required,lte=1"}, "b": {"type": "float", "rules": "lt=5"}})
    assert got == [[("a", "float", "required")], [("a", "float", "required")], [("a", "float", "required")], [("a", "float", "lte"), ("b", "float", "lt")]]
    assert errors(df, {"a": {"rules": "required"}})[0] == [("a", "option", "required")]


def test_integers_and_decimals(spark):
    rows = [(1, Decimal("5"), Decimal(2**64 - 1), Decimal("1.50")), (-1, Decimal("-5"), Decimal(2**64), Decimal("2.00")), (None, None, Decimal(7), None)]
    df = spark.createDataFrame(rows, "a int, b decimal(10,0), c decimal(38,0), d decimal(10,2)").coalesce(1)
    got = errors(df, {"a": {"type": "uint"}, "b": {"type": "int", "rules": "gt=0"}, "c": {"type": "uint", "rules": "gt=7"}, "d": {"type": "float", "rules": "lt=2"}})
    assert got == [[], [("a", "int", "type"), ("b", "int", "gt"), ("c", "float", "type"), ("d", "float", "lt")], [("c", "uint", "gt")]]
    assert errors(df, {"c": {"type": "int"}}) == [[("c", "uint", "type")], [("c", "float", "type")], []]
    # an integer is no float, and a float no integer
    assert errors(df, {"a": {"type": "float"}, "d": {"type": "int"}})[0] == [("a", "int", "type"), ("d", "float", "type")]


def test_times_bytes_and_texts(spark):
    now = dt.datetime(2024, 3, 1, 12, 30, tzinfo=dt.UTC)
    df = spark.createDataFrame([(now, now.replace(tzinfo=None), now.date(), b"\x01\xff", True)], "t timestamp, u timestamp_ntz, d date, b binary, f boolean")
    fields = {
        "t": {"type": "string", "rules": "datetime,eq=2024-03-01T12:30:00.000Z"},
        "u": {"type": "string", "rules": "eq=2024-03-01T12:30:00.000"},
        "d": {"type": "string", "rules": "eq=2024-03-01"},
        "b": {"type": "array", "rules": "length(exact=2),unique"},
        "f": {"type": "boolean", "rules": "isdefault"},
    }
    assert errors(df, fields) == [[("f", "bool", "isdefault")]]
    assert errors(spark.createDataFrame([(b"",), (b"aa",), (None,)], "b binary").coalesce(1), {"b": {"type": "array", "rules": "required,unique"}}) == [[("b", "vec", "required")], [("b", "vec", "unique")], [("b", "vec", "required")]]


NESTED = "id int, who struct<name:string,place:struct<city:string,zip:int>>, items array<struct<sku:string,n:int,tags:array<string>>>, extra map<string,int>, m map<int,string>"
FIELDS = {
    "id": {"type": "int"},
    "who": {"type": "object", "fields": {"name": {"type": "string", "rules": "required"}, "city": {"type": "string", "rules": "min=3"}}},
    "items": {"type": "array", "rules": "unique(sku,n)", "fields": {"sku": {"type": "string", "rules": "required"}, "n": {"type": "uint"}, "tags": {"type": "array", "rules": "unique,max=2"}}},
    "extra": {"type": "object", "rules": "max=1", "fields": {"a": {"type": "int", "rules": "gt=1"}, "b": {"type": "string"}}},
}


def test_nested_rows_with_names(spark):
    rows = [(1, ("", ("Rome", 1)), [("x", 1, ["a", "a"]), None, ("x", -1, None)], {"a": 1, "b": 2}, {7: "x"}), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, NESTED).coalesce(1)
    inside = {"code" if k == "sku" else k: v for k, v in FIELDS["items"]["fields"].items()}
    who = {"type": "object", "fields": {"name": {"type": "string", "rules": "required"}, "city": {"type": "string", "rules": "min=5"}}}
    fields = {**FIELDS, "who": who, "items": {**FIELDS["items"], "rules": "unique(code,n)", "fields": inside}}
    got = errors(df, fields, rename={"items.sku": "code"}, flatten=["who.place"])
    want = [("extra", "map", "max"), ("extra.a", "int", "gt"), ("extra.b", "int", "type"), ("items[0].tags", "vec", "unique"), ("items[1]", "option", "type"), ("items[2].n", "int", "type"), ("who.city", "string", "min"), ("who.name", "string", "required")]
    assert sorted(got[0]) == want
    assert got[1] == []
    assert errors(df, {"m": {"type": "object", "fields": {"7": {"type": "string", "rules": "eq=y"}, "8": {"rules": "required"}}}})[0] == [("m.7", "string", "eq"), ("m.8", "option", "required")]
    same = spark.createDataFrame([(1, None, [("x", 1, None), ("x", 1, None)], None, None)], NESTED)
    assert errors(same, fields, rename={"items.sku": "code"}) == [[("items", "vec", "unique")]]
    with pytest.raises(UnknownField):
        errors(df, FIELDS, rename={"nope": "x"})
    with pytest.raises(UnknownField):
        errors(df, FIELDS, flatten=["who.nope"])
    with pytest.raises(ConfigError):
        errors(df, FIELDS, flatten=["items"])


def test_rows_agree_with_their_json(spark):
    """Where JSON has all that the rows hold, both ways see the same."""
    rows = [(i, ("n" * (i % 4), ("c" * (i % 5), i)), [("s", i % 3, ["t"] * (i % 4)), ("s", 1, [])], {"a": i % 4}, None) for i in range(30)]
    df = spark.createDataFrame(rows, NESTED)
    both = lambda r: {x.id: sorted((e.namespace, e.kind, e.rule) for e in x._errors) for x in r.annotated.collect()}
    checker = Checker(Schema({"fields": FIELDS}))
    as_json = df.select("id", F.to_json(F.struct("id", "who", "items", "extra"), {"ignoreNullFields": "false"}).alias("j"))
    assert both(checker.validate_rows(df)) == both(checker.validate_json(as_json, "j"))


def test_no_json_in_the_plan(spark):
    df = spark.createDataFrame([(1, ("", ("Rome", 1)), [], {}, {})], NESTED)
    plan = plan_of(Checker(Schema({"fields": FIELDS})).validate_rows(df).annotated)
    assert "json" not in plan and "variant" not in plan and "python" not in plan


def test_variant_columns(spark):
    df = spark.createDataFrame([('{"n": 1.0}',), ('"x"',)], "j string").coalesce(1).select(F.parse_json("j").alias("v"))
    got = errors(df, {"v": {"type": "object", "fields": {"n": {"type": "float", "rules": "gt=1"}}}})
    assert got == [[("v.n", "float", "gt")], [("v", "string", "type")]]


def test_repeated_keys(spark):
    before = spark.conf.get(REPEATED)
    texts = ['{"a":1,"a":2}', '{"a":3,"o":{"n":1,"n":"x"},"a":1}', '{"a":1', '{"a":{"b":1,"b":1}}']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    checker = Checker(Schema({"fields": {"a": {"type": "int", "rules": "eq=2"}, "o": {"type": "object", "fields": {"n": {"type": "int"}}}}}))
    found = checker.validate_json(df, "t").failures("k")
    assert spark.conf.get(REPEATED) == before
    want = [(1, "a"), (1, "o.n"), (2, "$value"), (3, "a")]
    listed = lambda d: sorted((r.k, r.namespace) for r in d.collect())
    assert listed(found) == want
    # later use of the plan sees the same
    assert listed(found.join(df.select("k"), "k")) == want
    passes = df.select("k", Checker().passes(F.col("t"), "json", T.StringType()).alias("ok")).collect()
    assert [r.ok for r in sorted(passes)] == [True, True, False, True]


def test_json_keys_by_value(spark):
    schema = Schema({"fields": {"xs": {"type": "array", "rules": "unique=a", "fields": {"a": {}}}, "ys": {"type": "array", "rules": "unique"}}})
    cases = ['{"xs":[{"a":1.0},{"a":1.00}]}', '{"xs":[{"a":"\\u0061"},{"a":"a"}]}', '{"xs":[{"a":1},{"a":"1"}]}', '{"xs":[{"a":10.0},{"a":1e1}]}', '{"ys":[1.50,1.5]}', '{"ys":[1,"1",true,"true",null]}', '{"ys":[null,null]}', '{"ys":[{"p":1},{"p":1}]}']
    df = spark.createDataFrame([(c,) for c in cases], "j string").coalesce(1)
    got = [[e.namespace for e in r._errors] for r in Checker(schema).validate_json(df, "j").annotated.collect()]
    assert got == [["xs"], ["xs"], [], ["xs"], ["ys"], [], ["ys"], ["ys"]]


def test_unique_over_long_arrays(spark):
    items = F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.struct(i.alias("a"), (i % 7).cast("string").alias("b")))
    df = spark.range(1).select(items.alias("v"), F.concat(items, F.array(items[500])).alias("w"))
    model = Model("M", {"v": "unique(a,b),unique=a", "w": "unique(a,b)|unique=a,unique=b"})
    found = Checker().validate(df, model).failures().collect()
    assert [(r.namespace, r.rule) for r in found] == [("M.w", "unique|unique"), ("M.w", "unique")]


def test_unique_of_keys_that_hash_alike(spark):
    """Keys are compared, not their hashes: texts of one hash are found to differ."""
    df = spark.createDataFrame([([("Aa", 1), ("BB", 1)],), ([("Aa", 1), ("Aa", 1)],), ([(None, 1), (None, 1)],), ([None, None],)], "v array<struct<a:string,b:int>>").coalesce(1)
    got = Checker().validate(df, Model("M", {"v": "unique(a,b)"})).annotated.collect()
    assert [len(r._errors) for r in got] == [0, 1, 1, 0]
