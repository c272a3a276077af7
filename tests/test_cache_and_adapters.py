"""Plans that are compiled once, and values of a user's own types."""

import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checkframe.errors import ConfigError, UnknownField
from checkframe.functions.rule import Rule
from checkframe.operators import Checker, Dive, Field, MapDive, Model
from checkframe.queries.rule_cases import TEXT


def found(result):
    return sorted((r.k, r.namespace, r.rule) for r in result.failures("k").collect())


def test_the_second_plan_is_found(spark):
    model = lambda: Model("M", {f"v{i}": expression for i, (expression, _, _) in enumerate(TEXT.values())})
    columns = [F.lit("x").alias(f"v{i}") for i in range(len(TEXT))]
    one, two = spark.range(3).select(F.col("id").alias("k"), *columns), spark.range(5, 9).select(F.col("id").alias("k"), *columns)
    checker = Checker()
    began = time.perf_counter()
    checker.validate(one, model())
    first = time.perf_counter() - began
    assert (checker.plans.hits, checker.plans.misses) == (0, 1)
    compile_again = []
    for _ in range(3):
        began = time.perf_counter()
        checker.plans.get(next(iter(checker.plans._kept)), lambda: pytest.fail("compiled again"))
        compile_again.append(time.perf_counter() - began)
    assert min(compile_again) < first / 10
    result = checker.validate(two, model())
    assert checker.plans.misses == 1
    assert {r.k for r in result.failures("k").select("k").distinct().collect()} == {5, 6, 7, 8}


def test_what_makes_another_plan(spark):
    df = spark.createDataFrame([(1, "a", ["a"]), (2, "", [])], "k int, v string, xs array<string>")
    checker = Checker()
    model = Model("M", {"v": "required", "xs": Field(dive=Dive("min=2"))})
    assert found(checker.validate(df, model)) == [(1, "M.xs[0]", "min"), (2, "M.v", "required")]
    model.fields["v"] = Field("min=2")  # a changed model is another one
    assert found(checker.validate(df, model)) == [(1, "M.v", "min"), (1, "M.xs[0]", "min"), (2, "M.v", "min")]
    assert found(checker.partial(df, model, ["xs"])) == [(1, "M.xs[0]", "min")]
    assert found(checker.filter(df, model, lambda p: p == "v")) == [(1, "M.v", "min"), (2, "M.v", "min")]
    assert found(checker.filter(df, model, lambda p: p != "v")) == [(1, "M.xs[0]", "min")]
    assert found(checker.validate(df.withColumn("v", F.lit(7)), model)) == [(1, "M.xs[0]", "min")]
    misses = checker.plans.misses
    checker.rule(Rule("odd", lambda v, p: v.column == "odd"))
    model.fields["v"] = Field("odd")
    assert found(checker.partial(df, model, ["v"])) == [(1, "M.v", "odd"), (2, "M.v", "odd")] and checker.plans.misses == misses + 1
    with pytest.raises(UnknownField):
        checker.partial(df, model, ["nope"])
    with pytest.raises(UnknownField):  # a failure is not kept either
        checker.partial(df, model, ["nope"])
    checks = [lambda get: [("v", "a", get("v") == "a", {})], lambda get: [("v", "b", get("v") == "", {})]]
    assert [found(checker.validate(df, Model("M", {"k": ""}, [c]))) for c in checks] == [[(1, "M.v", "a")], [(2, "M.v", "b")]]


def test_old_plans_go(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    checker = Checker()
    checker.plans.size = 3
    for n in range(6):
        checker.validate(df, Model("M", {"v": f"min={n}"}))
    assert len(checker.plans._kept) == 3 and checker.plans.misses == 6


def test_names_that_need_quotes(spark):
    df = spark.createDataFrame([(1, "", "")], ["k", "a.b", "c`d"])
    assert found(Checker().validate(df, Model("M", {"a.b": "required", "c`d": "required"}))) == [(1, "M.a.b", "required"), (1, "M.c`d", "required")]
    twice = df.select("k", F.col("`a.b`").alias("x"), F.col("`a.b`").alias("x"))
    with pytest.raises(ConfigError):
        Checker().validate(twice, Model("M", {"x": "required"}))


def test_a_users_type(spark):
    schema = "k int, price struct<amount:decimal(12,2),currency:string>, fees array<struct<amount:decimal(12,2),currency:string>>, by map<string,struct<amount:decimal(12,2),currency:string>>, top double"
    rows = [(1, (5, "EUR"), [(1, "EUR"), (9, "EUR")], {"a": (0, "EUR")}, 4.0), (2, None, None, None, None)]
    df = spark.createDataFrame(spark.createDataFrame(rows, schema.replace("decimal(12,2)", "int")).collect(), schema.replace("decimal(12,2)", "int"))
    money = T.StructType().add("amount", T.IntegerType()).add("currency", T.StringType())
    checker = Checker().adapter(money, lambda c: c["amount"].cast("double"), T.DoubleType())
    model = Model("O", {"price": "required,lte=4,lte_field=top", "fees": Field("max=1", dive=Dive("lt=5")), "by": Field(dive=MapDive(Dive("min=2"), Dive("required")))})
    assert found(checker.validate(df, model)) == [(1, "O.by[\"a\"]", "min"), (1, "O.by[\"a\"]", "required"), (1, "O.fees", "max"), (1, "O.fees[1]", "lt"), (1, "O.price", "lte"), (1, "O.price", "lte_field"), (2, "O.price", "required")]
    ids = Checker().adapter(lambda t: isinstance(t, T.StructType) and t.fieldNames() == ["amount", "currency"], lambda c: c["currency"], T.StringType())
    assert found(ids.validate(df, Model("O", {"price": "eq=USD"}))) == [(1, "O.price", "eq")]
    with pytest.raises(ConfigError):
        Checker().adapter(lambda t: True, lambda c: c, T.StringType())
