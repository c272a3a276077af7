"""Names of rules and aliases."""

from __future__ import annotations

from ..errors import DuplicateRule, InvalidExpression, RecursiveAlias, ReservedName, UnknownRule
from ..functions import ALIASES, builtin
from ..functions.rule import Rule
from .expressions import NAME, AnyOf, Step, parse

#: Names that the language keeps for itself.
RESERVED = ("alias", "check", "dive", "keys", "nested", "omitempty", "values")


class Registry:
    """Built-in rules and aliases; others may be added, none replaced."""

    def __init__(self):
        self.rules: dict[str, Rule] = builtin()
        self.aliases: dict[str, tuple[Step, ...]] = {name: parse(text) for name, text in ALIASES.items()}

    def _free(self, name: str) -> None:
        if not NAME.match(name):
            raise InvalidExpression(f"not a rule name: {name!r}")
        if name in RESERVED:
            raise ReservedName(name)
        if name in self.rules or name in self.aliases:
            raise DuplicateRule(name)

    def add_rule(self, rule: Rule) -> None:
        self._free(rule.name)
        if rule.signature.field and not rule.name.endswith("_field"):
            raise InvalidExpression(f"{rule.name}: the name of a rule that looks at other fields ends in _field")
        self.rules[rule.name] = rule

    def add_alias(self, name: str, expression: str) -> None:
        self._free(name)
        self.aliases[name] = parse(expression)

    def check_names(self, steps: tuple[Step, ...], inside: tuple[str, ...] = ()) -> None:
        """Every name is known and no alias contains itself."""
        for step in steps:
            for call in step.calls if isinstance(step, AnyOf) else (step,):
                if call.name == "omitempty" or call.name in self.rules:
                    continue
                if call.name not in self.aliases:
                    raise UnknownRule(call.name)
                if call.name in inside:
                    raise RecursiveAlias(call.name)
                if call.positional or call.named:
                    raise InvalidExpression(f"alias {call.name} takes no parameters")
                self.check_names(self.aliases[call.name], (*inside, call.name))
