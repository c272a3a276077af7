"""Network and identifier rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .addresses import IPV4, IPV6, full as _full, ipv4, ipv6
from .formats import port
from .rule import Rule, text_only
from .urls import URL_RULES

def hostname(c: Column, letter_first: bool) -> Column:
    labels = F.split(c, r"\.", -1)
    ok = F.forall(labels, lambda x: (F.octet_length(x) <= 63) & x.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\z"))
    return ok & c.rlike("^[A-Za-z]") if letter_first else ok


def _fqdn(c: Column, p: dict) -> Column:
    labels = F.split(F.regexp_replace(c, r"\.\z", ""), r"\.", -1)
    return (F.size(labels) >= 2) & F.forall(labels, lambda x: (F.octet_length(x) <= 63) & x.rlike(r"^[A-Za-z0-9][A-Za-z0-9-]*\z")) & F.element_at(labels, -1).rlike("^[A-Za-z]")


def _hostname_port(c: Column, p: dict) -> Column:
    host, at = F.regexp_replace(c, r":[^:]*\z", ""), F.regexp_extract(c, r":([^:]*)\z", 1)
    return c.contains(":") & port(at) & ((host == "") | hostname(F.regexp_replace(host, r"^\[(.*)\]\z", "$1"), letter_first=False))


def _prefix(c: Column) -> tuple[Column, Column]:
    """Address and prefix length; the length is null unless it is a number below 256."""
    at = F.instr(c, "/")
    size = c.substr(at + 1, F.length(c))
    small = F.length(F.regexp_replace(size, r"^\+?0*", "")) <= 3
    n = F.when(size.rlike(r"^\+?[0-9]+\z") & small & (at > 0), F.concat(F.lit("0"), F.regexp_replace(size, r"^\+?0*", "")).try_cast("int"))
    return F.when(at > 0, c.substr(F.lit(1), at - 1)), F.when(n < 256, n)


def _cidrv6(c: Column, p: dict) -> Column:
    address, n = _prefix(c)
    return ipv6(address) & (n <= 128)


def _cidr(c: Column, p: dict) -> Column:
    address, n = _prefix(c)
    return F.coalesce(ipv4(address) & (n <= 32), F.lit(False)) | F.coalesce(ipv6(address) & (n <= 128), F.lit(False))


def _cidrv4(c: Column, p: dict) -> Column:
    address, n = _prefix(c)
    octets = F.split(address, r"\.")
    number = reduce(lambda a, b: a * 256 + b, [F.get(octets, i).try_cast("long") for i in range(4)])
    return ipv4(address) & (n <= 32) & (number % F.pow(F.lit(2.0), 32 - n).cast("long") == 0)


_HEX = "[0-9a-f]"


def _uuid(version: str, any_case: bool) -> str:
    hexa = "[0-9a-fA-F]" if any_case else _HEX
    third = f"{hexa}{{4}}" if not version else f"{version}{hexa}{{3}}"
    variant = "[89abAB]" if any_case else "[89ab]"
    fourth = f"{variant}{hexa}{{3}}" if version in ("4", "5") else f"{hexa}{{4}}"
    return f"{hexa}{{8}}-{hexa}{{4}}-{third}-{fourth}-{hexa}{{12}}"


_PORT = "(?:0*(?:6553[0-5]|655[0-2][0-9]|65[0-4][0-9]{2}|6[0-4][0-9]{3}|[1-5][0-9]{4}|[0-9]{1,4}))"
TCP4 = rf"{IPV4}:{_PORT}"
TCP6 = rf"\[{IPV6}(?:%[0-9]+)?\]:{_PORT}"


def _pattern(name: str, pattern: str) -> Rule:
    return Rule(name, text_only(lambda c, p: _full(c, pattern)))


RULES = (
    *URL_RULES,
    _pattern("ip", f"{IPV4}|{IPV6}"),
    _pattern("ipv4", IPV4),
    _pattern("ipv6", IPV6),
    Rule("cidr", text_only(_cidr)),
    Rule("cidrv4", text_only(_cidrv4)),
    Rule("cidrv6", text_only(_cidrv6)),
    Rule("hostname", text_only(lambda c, p: hostname(c, letter_first=True))),
    Rule("hostname_port", text_only(_hostname_port)),
    Rule("hostname_rfc1123", text_only(lambda c, p: hostname(c, letter_first=False))),
    Rule("fqdn", text_only(_fqdn)),
    Rule("port", text_only(lambda c, p: port(c))),
    *(_pattern(f"uuid{v}", _uuid(v, False)) for v in ("", "3", "4", "5")),
    *(_pattern(f"uuid{v}_rfc4122", _uuid(v, True)) for v in ("", "3", "4", "5")),
    _pattern("ulid", "[0-9A-HJKMNP-TV-Za-hjkmnp-tv-z]{26}"),
    *(_pattern(f"{p}{v}", pattern) for p in ("tcp", "udp") for v, pattern in (("4", TCP4), ("6", TCP6), ("", f"{TCP4}|{TCP6}"))),
)
