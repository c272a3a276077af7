"""IPv4 and IPv6 addresses as patterns and column tests."""

from __future__ import annotations

from pyspark.sql import Column

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _ipv6_pattern() -> str:
    """Eight groups, or fewer around one ``::``; the last two may be an IPv4 address."""
    group = "[0-9a-fA-F]{1,4}"
    tail = f"(?:{group}:{group}|{IPV4})"
    forms = [f"(?:{group}:){{6}}{tail}"]
    for left in range(8):
        head = f"{group}(?::{group}){{{left - 1}}}" if left else ""
        rights, most = [""], 7 - left
        if most >= 1:
            rights.append(f"{group}(?::{group}){{0,{most - 1}}}")
        if most >= 2:
            rights.append(f"(?:{group}:){{0,{most - 2}}}{IPV4}")
        forms.append(f"{head}::(?:{'|'.join(rights)})")
    return "(?:" + "|".join(forms) + ")"


IPV6 = _ipv6_pattern()


def full(c: Column, pattern: str) -> Column:
    return c.rlike(rf"^(?:{pattern})\z")


def ipv4(c: Column) -> Column:
    return full(c, IPV4)


def ipv6(c: Column) -> Column:
    return full(c, IPV6)
