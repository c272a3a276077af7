import pytest

from checkframe.errors import ConfigError, DuplicateRule, InvalidExpression, InvalidParam, RecursiveAlias, ReservedName, UnknownRule
from checkframe.functions import builtin
from checkframe.plans import signature as S
from checkframe.plans.expressions import AnyOf, Call, parse
from checkframe.plans.registry import Registry


def test_forms():
    assert parse("required,length(min=3,max=20)") == (Call("required"), Call("length", (), (("min", "3"), ("max", "20"))))
    assert parse("oneof=a b") == (Call("oneof", ("a", "b")),)
    assert parse("a|b") == (AnyOf((Call("a"), Call("b"))),)
    assert parse('oneof("x,y",\'z|w\')') == (Call("oneof", ("x,y", "z|w")),)
    assert parse(r'eq="a\"b"') == (Call("eq", ('a"b',)),)


@pytest.mark.parametrize("text", ["", "a,", "a||b", "f(", "f)", "f()", 'f("a', "f(a,k=v)", 'f("a"b)', "f=", "(a)"])
def test_bad_forms(text):
    with pytest.raises(InvalidExpression):
        parse(text)


def test_binding():
    assert S.text("value").bind(Call("eq", ("1",))) == {"value": "1"}
    assert S.conditions().bind(Call("required_if", (), (("a", "1"), ("b", "2")))) == {"conditions": [("a", "1"), ("b", "2")]}
    assert S.conditions().bind(Call("required_if", ("a", "1"))) == {"conditions": [("a", "1")]}
    for bad in (Call("eq"), Call("eq", ("1", "2")), Call("eq", (), (("other", "1"),))):
        with pytest.raises(InvalidParam):
            S.text("value").bind(bad)


def test_registry():
    r = Registry()
    assert len(builtin()) == 146
    with pytest.raises(DuplicateRule):
        r.add_alias("email", "required")
    with pytest.raises(ReservedName):
        r.add_alias("dive", "required")
    r.add_alias("one", "two")
    r.add_alias("two", "one")
    with pytest.raises(RecursiveAlias):
        r.check_names(parse("one"))
    for absent in ("postcode", "image", "timezone", "nope"):
        with pytest.raises(UnknownRule):
            r.check_names(parse(absent))
    assert issubclass(UnknownRule, ConfigError)
