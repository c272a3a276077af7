"""Built-in rules: each is a predicate column over one value."""

from __future__ import annotations

from . import choice, compare, conditional, formats, network, presence, relation, strings

TABLES = (presence.RULES, compare.RULES, relation.RULES, conditional.RULES, choice.RULES, strings.RULES, formats.RULES, network.RULES)

#: Aliases that come with the rules.
ALIASES = {"iscolor": "hexcolor|rgb|rgba|hsl|hsla|cmyk"}


def builtin() -> dict:
    out = {}
    for table in TABLES:
        for rule in table:
            assert rule.name not in out, rule.name
            out[rule.name] = rule
    return out
