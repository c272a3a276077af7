"""Selectors of single elements: taken from their places, and noticed when no row has them."""

import pytest
from pyspark.sql import functions as F

from checkframe.errors import UnknownField, ValidationFailed
from checkframe.operators import Checker, Dive, Field, MapDive, Model

SCHEMA = "k int, lines array<struct<q:int,tags:array<string>>>, marks map<string,int>, n map<int,int>"
LINE = Model("Line", {"q": "lt=5", "tags": Field("max=1", dive=Dive("min=2"))})
MODEL = Model("O", {"k": "gt=0", "lines": Field("max=2", dive=Dive(nested=LINE)), "marks": Field(dive=MapDive(Dive("min=2"), Dive("gt=0"))), "n": Field(dive=MapDive(Dive(), Dive("gt=0")))})
ROWS = [
    (0, [(9, ["a", "bb"]), (9, ["c"]), (1, None)], {"a": 0, "bb": 0, 'q"x': 0}, {7: 0}),
    (1, [(1, ["aa", "b"]), None], {"bb": 1}, None),
    (2, None, None, {8: 0}),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(1)


def places(result):
    return sorted((r.k, r.namespace.removeprefix("O."), r.rule) for r in result.failures("k").collect())


@pytest.mark.parametrize("paths", [["lines[0].q"], ["lines[1]"], ["lines[0].tags[1]", "lines[1].q"], ["lines[0].tags"], ["lines[].tags[0]"], ["lines[*].q", "lines[0].tags[0]"], ["lines"], ["lines[0]", "lines"], ['marks["a"]'], ['marks["bb"]', 'marks["q\\"x"]'], ["n[7]", "k"], ["lines[2].tags", "marks"]])
def test_partial_is_what_a_full_run_says_of_these_places(df, paths):
    from checkframe.plans.selection import parts

    def covered(place):
        p = parts(place)
        return any(len(s) <= len(p) and all(a == b or b in ("[]", "[*]") and a.startswith("[") for a, b in zip(p, s, strict=False)) for s in map(parts, paths))

    full = places(Checker().validate(df, MODEL))
    assert places(Checker().partial(df, MODEL, paths)) == [x for x in full if covered(x[1])]
    assert places(Checker().excluding(df, MODEL, paths)) == [x for x in full if not covered(x[1])]


def test_named_elements_are_not_searched_for(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    plan = Checker().partial(read, MODEL, ["lines[0].q"]).annotated._jdf.queryExecution().executedPlan().toString()
    assert "transform(" not in plan and "exists(" not in plan
    only = Checker().partial(read, MODEL, ['marks["a"]']).annotated.select("_errors")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<marks:map<string,int>>" in only


def test_whole_collections_keep_their_guard(df):
    plan = Checker().partial(df, MODEL, ["lines"]).annotated._jdf.queryExecution().executedPlan().toString()
    assert "exists(" in plan


def test_selectors_that_meet_nothing(df):
    result = Checker().partial(df, MODEL, ["lines[0].q", "lines[9].q", 'marks["zz"]', "n[8]", "lines[x]"])
    result.annotated.write.format("noop").mode("overwrite").save()
    assert result.unmatched() == ["lines[9].q", 'marks["zz"]', "lines[x]"]
    with pytest.raises(UnknownField, match=r"lines\[9\]"):
        result.raise_if_unmatched()
    other = Checker().excluding(df, MODEL, ['marks["a"]', "lines[1].tags[4]"])
    assert other.annotated.count() == 3 and other.unmatched() == ["lines[1].tags[4]"]
    clean = Checker().partial(df, MODEL, ["lines[5]"])
    with pytest.raises(UnknownField):
        clean.raise_if_failed()
    with pytest.raises(ValidationFailed):
        Checker().partial(df, MODEL, ["lines[0].q"]).raise_if_failed()
    assert Checker().partial(df, MODEL, ["lines"]).unmatched() == []
    with pytest.raises(UnknownField):
        Checker().partial(df, MODEL, ["nope[0]"])


def test_counting_changes_nothing(df):
    result = Checker().partial(df, MODEL, ["lines[0].q"])
    assert result.valid.count() + result.invalid.count() == 3
    assert result.annotated.where(F.size("_errors") > 0).count() == 1
