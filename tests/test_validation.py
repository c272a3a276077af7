import datetime as dt
import ipaddress
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checkframe.errors import ConfigError, InvalidParam, InvalidSchema, MissingFieldContext, UnknownField, ValidationFailed
from checkframe.functions import builtin
from checkframe.i18n import Catalog, Locale, messages
from checkframe.operators import Dive, Field, MapDive, Model, Checker, model_of
from checkframe.sources import Schema
from checkframe.streaming import run_to_tables


def check(spark, rows, schema, model, how="validate", *args, checker=None):
    df = spark.createDataFrame(rows, schema)
    found = getattr(checker or Checker(), how)(df, model, *args).failures()
    return [(r.namespace, r.rule) for r in found.collect()]


def value(spark, x, expression, dtype="string", checker=None, **kw):
    df = spark.createDataFrame([(x,)], f"v {dtype}")
    out = df.select((checker or Checker()).value(F.col("v"), expression, df.schema["v"].dataType, **kw).alias("e")).first().e
    return [(r.rule, r.reason) for r in out]


def test_absence(spark):
    assert value(spark, None, "email") == []
    assert value(spark, None, "required,email") == [("required", "required")]
    assert value(spark, "", "omitempty,email") == []
    assert value(spark, "", "required") == [("required", "required")]
    assert value(spark, "", "required", optional=True) == []
    assert value(spark, 0, "required", "int") == [("required", "required")]
    assert value(spark, float("nan"), "required", "double") == []


def test_flow_of_aliases(spark):
    v = Checker().alias("optional_email", "omitempty,email").alias("username", "required,length(min=3,max=20)")
    assert value(spark, "", "optional_email,required", checker=v) == []
    assert value(spark, "", "email|optional_email,required", checker=v) == []
    assert value(spark, "al", "username", checker=v) == [("username", "length")]
    assert value(spark, "x", "omitempty|email") == []
    assert value(spark, "#000-", "iscolor") == [("iscolor", "hexcolor|rgb|rgba|hsl|hsla|cmyk")]


def test_preflight_comes_before_data(spark):
    for expression in ("min=invalid", "omitempty,range(min=5,max=1)", "email|min=x", "length(exact=1,min=1)"):
        with pytest.raises(InvalidParam):
            value(spark, None, expression)
    with pytest.raises(MissingFieldContext):
        value(spark, "a", "eq_field=b")
    with pytest.raises(InvalidParam):
        value(spark, "a", "regex='(?=a)'")


def test_nan_and_zero(spark):
    nan = float("nan")
    assert value(spark, nan, "gt=1", "double") == [("gt", "gt")]
    assert value(spark, nan, "eq=nan", "double") == [("eq", "eq")]
    assert value(spark, nan, "ne=1", "double") == []
    assert value(spark, [nan, nan, 1.0], "unique", "array<double>") == []
    assert value(spark, [0.0, -0.0], "unique", "array<double>") == [("unique", "unique")]
    assert value(spark, [None, None], "unique", "array<int>") == [("unique", "unique")]


def test_whole_numbers_of_128_bits(spark):
    most = 10**38 - 1
    frame = spark.createDataFrame([("a", str(most)), ("b", str(-most)), ("c", "0")], "k string, x string").select("k", F.col("x").cast("decimal(38,0)").alias("x"))

    def failing(rule):
        return {r.k for r in Checker().validate(frame, Model("M", {"x": rule})).failures("k").collect()}

    assert failing(f"lt={10**38}") == failing(f"gt={-(10**38)}") == failing(f"range(min={-(2**127)},max={2**127 - 1})") == failing(f"ne={10**38}") == set()
    assert failing(f"eq={10**38}") == failing(f"gte={10**38}") == failing(f"noneof({most},{-most},0)") == {"a", "b", "c"}
    assert failing(f"oneof({10**38},{most})") == {"b", "c"}
    text = spark.createDataFrame([("a", "abc")], "k string, x string")
    assert Checker().validate(text, Model("M", {"x": f"length(max={2**128 - 1})"})).failures("k").count() == 0
    for rule in (f"lt={2**127}", f"gt={-(2**127) - 1}"):
        with pytest.raises(InvalidParam):
            failing(rule)
    with pytest.raises(InvalidParam):
        Checker().validate(text, Model("M", {"x": f"length(max={2**128})"}))


def test_newline_at_the_end_fails(spark):
    for rule in ("alpha", "number", "uuid", "md5", "ipv4", "jwt"):
        sample = {"alpha": "a", "number": "1", "uuid": "550e8400-e29b-41d4-a716-446655440000", "md5": "d" * 32, "ipv4": "1.2.3.4", "jwt": "a.b."}[rule]
        assert value(spark, sample, rule) == []
        assert value(spark, sample + "\n", rule) == [(rule, rule)]


def test_long_texts_do_not_overflow(spark):
    long = "a" * 200_000
    for rule, text in (("url_encoded", long), ("semver", "1.0.0-" + "a." * 50_000 + "a"), ("hostname", "a." * 50_000 + "a"), ("base64", "aaaa" * 50_000), ("datauri", "data:," + "aaaa" * 50_000)):
        assert value(spark, text, rule) == []


def test_ipv6_against_a_parser(spark):
    rng = random.Random(5)
    texts = [":".join(rng.choice(["", "0", "1", "ffff", "12345", "1.2.3.4", "g"]) for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts += ["::", "1::", "::1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::1.2.3.4"]

    def parsed(x):
        try:
            return bool(ipaddress.IPv6Address(x))
        except ValueError:
            return False

    df = spark.createDataFrame([(x,) for x in texts], "v string")
    got = {r.v: r.ok for r in df.select("v", Checker().passes(F.col("v"), "ipv6", T.StringType()).alias("ok")).collect()}
    assert {x for x in texts if got[x] != parsed(x)} == set()


def test_nested_dive_and_maps(spark):
    schema = "tags array<string>, labels map<string,string>, p struct<n:int,s:string>, ps array<struct<n:int,t:array<int>>>"
    rows = [(["x", "", None], {"source": ""}, (1, "q"), [(0, [1, 1]), (5, [2])])]
    model = Model("U", {"tags": Field(dive=Dive("required")), "labels": Field(dive=MapDive(Dive("required"), Dive("required"))), "p": Field("required", nested=Model("P", {"n": "gt=3"})), "ps": Field(dive=Dive(nested=Model("Q", {"n": "required", "t": Field("unique", dive=Dive("gt=1"))})))})
    assert check(spark, rows, schema, model) == [("U.tags[1]", "required"), ("U.tags[2]", "required"), ('U.labels["source"]', "required"), ("U.p.n", "gt"), ("U.ps[0].n", "required"), ("U.ps[0].t", "unique"), ("U.ps[0].t[0]", "gt"), ("U.ps[0].t[1]", "gt")]
    assert check(spark, rows, schema, model, "partial", ["ps[0].t[1]", "p"]) == [("U.p.n", "gt"), ("U.ps[0].t[1]", "gt")]
    assert check(spark, rows, schema, model, "excluding", ["ps", "tags[1]"]) == [("U.tags[2]", "required"), ('U.labels["source"]', "required"), ("U.p.n", "gt")]
    with pytest.raises(UnknownField):
        check(spark, rows, schema, model, "partial", ["tagz"])
    assert check(spark, [(None, None, None, None)], schema, model) == []
    with pytest.raises(ConfigError):
        check(spark, rows, schema, Model("U", {"tags": Field(dive=Dive("eq_field=p"))}))


def test_compound_unique(spark):
    schema = "ms array<struct<t:bigint,p:struct<e:string>>>"
    model = Model("Team", {"ms": "unique=t p.e"})
    assert check(spark, [([(1, ("a",)), (1, ("b",)), (2, ("a",))],)], schema, model) == []
    assert check(spark, [([(1, ("a",)), (1, ("a",))],)], schema, model) == [("Team.ms", "unique")]
    with pytest.raises(UnknownField):
        check(spark, [([],)], schema, Model("Team", {"ms": "unique=zz"}))


def test_relations_need_one_type(spark):
    assert check(spark, [(1, 1)], "a int, b bigint", Model("R", {"a": "eq_field=b"})) == [("R.a", "eq_field")]
    assert check(spark, [(1, None)], "a int, b int", Model("R", {"a": "ne_field=b"})) == [("R.a", "ne_field")]
    assert check(spark, [("a", None)], "a string, b string", Model("R", {"a": "fieldexcludes=b"})) == []
    now = dt.datetime(2020, 1, 1)
    assert check(spark, [(now, now)], "a timestamp, b timestamp", Model("R", {"a": "eq_field=b,gt_field=b,lt"})) == [("R.a", "gt_field")]


def test_metadata_models(spark):
    schema = T.StructType([T.StructField("name", T.StringType(), True, {"rules": "required"}), T.StructField("tags", T.ArrayType(T.StringType()), True, {"dive": "min=2"}), T.StructField("free", T.StringType())])
    df = spark.createDataFrame([("", ["a", "bb"], "")], schema)
    assert [(r.namespace, r.rule) for r in Checker().validate(df, "User").failures().collect()] == [("User.name", "required"), ("User.tags[0]", "min")]
    assert set(model_of(schema, "User").fields) == {"name", "tags"}


def test_results(spark):
    df = spark.createDataFrame([(1, "a"), (2, "")], "k int, v string")
    result = Checker().validate(df, Model("M", {"v": "required"}))
    assert [r.k for r in result.valid.collect()] == [1] and [r.k for r in result.invalid.collect()] == [2]
    assert result.failures("k").first().k == 2
    with pytest.raises(ValidationFailed):
        result.raise_if_failed()


def test_schema(spark):
    text = '{"users":[{"age":1,"p":{"e":"a@b.co"}},null,{"age":"x"},{"age":1,"p":{"e":"a@b.co"}}],"n":2.0,"k":null}'
    schema = Schema({"fields": {"users": {"type": "array", "rules": "unique=age p.e", "fields": {"age": {"type": "uint"}, "p": {"fields": {"e": {"type": "string", "rules": "required,email"}}}}}, "n": {"type": "float", "rules": [{"range": {"min": 0, "max": 1}}]}, "k": {"type": "string", "rules": "required"}}})
    df = spark.createDataFrame([(text,), ("[1]",), ('{"n":2,"k":"a"}',)], "j string")
    got = [[(e.namespace, e.kind, e.rule) for e in r._errors] for r in Checker(schema).validate_json(df, "j").annotated.collect()]
    assert got[0] == [("k", "string", "required"), ("n", "float", "range"), ("users", "vec", "unique"), ("users[1]", "option", "type"), ("users[2].age", "string", "type")]
    assert got[1] == [("$value", "vec", "type")]
    assert got[2] == [("n", "int", "type")]
    for bad in ({}, {"fields": {}, "x": 1}, {"fields": {"a": {"type": "text"}}}, {"fields": {"a": {"type": "int", "fields": {}}}}, {"fields": {"a": {"types": "int"}}}, {"fields": {"a": {"rules": [{"oneof": []}]}}}):
        with pytest.raises(InvalidSchema):
            Schema(bad)


def test_every_rule_has_messages():
    sized = {"length", "min", "max", "range", "gt", "gte", "lt", "lte"}
    for table in (messages.EN, messages.ZH_CN):
        assert set(builtin()) - sized <= set(table) and {"iscolor", "type"} <= set(table)


def test_messages(spark):
    df = spark.createDataFrame([("ab", [1, 2, 3])], "name string, xs array<int>")
    found = Checker().validate(df, Model("M", {"name": "min=3,regex=^z", "xs": "max=2"})).failures()
    catalog = Catalog().use_locale(Locale("en", {"regex": "{field} {nope} {pattern} {kind}"}, {"name": "Name"}))
    assert [r.text for r in catalog.locale("en").render(found).collect()] == ["Name length must be at least 3", "Name {nope} ^z string", "xs size must be at most 2"]
    assert [r.text for r in catalog.locale("zh-CN").render(found).collect()][2] == "xs数量不能大于2"


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(100).select("id", F.when(F.col("id") % 3 == 0, "").otherwise("x").alias("v"))
    rows.write.parquet(str(tmp_path / "in"))
    model = Model("M", {"v": "required"})
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = run_to_tables(Checker().validate(stream, model), str(tmp_path / "valid"), str(tmp_path / "bad"), str(tmp_path / "ckpt"), "id")
    query.awaitTermination()
    batch = {r.id for r in Checker().validate(rows, model).failures("id").collect()}
    assert {r.id for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == batch
    assert spark.read.parquet(str(tmp_path / "valid")).count() == 66


def test_plan_adds_no_shuffle(spark):
    df = spark.range(10).select(F.col("id"), F.col("id").cast("string").alias("v"))
    plan = Checker().validate(df, Model("M", {"v": "required,length(max=3),number"})).annotated._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_schema_and_locale_texts():
    import pytest

    from checkframe.errors import InvalidExpression, InvalidLocale, InvalidSchema
    from checkframe.functions.rule import Rule
    from checkframe.i18n import Locale
    from checkframe.plans.signature import target
    from checkframe.sources import Schema

    pytest.importorskip("yaml")
    text = "fields:\n  a: {type: string, rules: 'required,max=3'}\n  b:\n    fields:\n      c: {rules: [{oneof: [x, 1]}]}\n"
    assert Schema.from_yaml(text).fields == Schema.from_json('{"fields": {"a": {"type": "string", "rules": "required,max=3"}, "b": {"fields": {"c": {"rules": [{"oneof": ["x", "1"]}]}}}}}').fields
    for wrong in ("fields: [a]", "field: {}", "fields: {a: {type: text}}", "fields: {a: {type: string, fields: {}}}", "fields: {a: {rule: x}}", "{"):
        with pytest.raises(InvalidSchema):
            Schema.from_yaml(wrong)
    assert Locale.from_yaml("x", "rules: {eq: same}") == Locale.from_json("x", '{"rules": {"eq": "same"}}')
    for wrong in ('{"rule": {}}', '{"rules": {"eq": 1}}', "[]", "{"):
        with pytest.raises(InvalidLocale):
            Locale.from_json("x", wrong)
    with pytest.raises(InvalidExpression):
        Checker().rule(Rule("differs", lambda v, p: v.column, target()))
