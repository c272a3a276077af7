"""URL rules: a text is taken apart in stages, each a struct of columns that the next one reads.

Ordinary URLs are told by one pattern first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .addresses import ipv6
from .domains import international, let, mapped
from .rule import Rule, text_only

# Schemes whose URLs have an authority, of the WHATWG URL standard.
SPECIAL = ("http", "https", "ws", "wss", "ftp", "file")
_FORBIDDEN = r"[\x00-\x20#/:<>?@\[\\\]^|]"
_FORBIDDEN_DOMAIN = r"[\x00-\x20\"#%/:<>?@\[\\\]^`{|}\x7f]"
_SPACE = r"(?U)\s"


def _after(text: Column, n: Column) -> Column:
    """``text`` without its first ``n`` characters."""
    return text.substr(n + 1, F.length(text))


def _number(part: Column) -> Column:
    """Number of an IPv4 part: decimal, octal after ``0``, hexadecimal after ``0x``; null where it is none or beyond 32 bits."""
    hexa = F.regexp_replace(F.regexp_extract(part, r"^0x([0-9a-f]*)\z", 1), "^0+", "")
    octal = F.regexp_replace(part, "^0+", "")
    return (
        F.when(part.rlike(r"^0x[0-9a-f]*\z"), F.when(F.length(hexa) <= 8, F.conv(F.concat(F.lit("0"), hexa), 16, 10).cast("long")))
        .when(part.rlike(r"^0[0-7]+\z"), F.when(F.length(octal) <= 11, F.conv(F.concat(F.lit("0"), octal), 8, 10).cast("long")))
        .when(part.rlike(r"^(?:0|[1-9][0-9]*)\z"), F.when(F.length(part) <= 10, part.try_cast("long")))
    )


def _ipv4(parts: Column) -> Column:
    """Whether labels, the last of which is a number, are an IPv4 address."""

    def fits(numbers: Column) -> Column:
        n = F.size(numbers)
        most = F.element_at(F.array(*[F.lit(256**k) for k in (4, 3, 2, 1)]), F.least(n, F.lit(4)))
        return (n <= 4) & ~F.exists(numbers, lambda x: x.isNull()) & ~F.exists(F.slice(numbers, F.lit(1), n - 1), lambda x: x > 255) & (F.element_at(numbers, -1) < most)

    return let(F.transform(parts, _number), fits)


def _domain(host: Column) -> Column:
    """Whether the host of a URL with authority is a domain name or an IPv4 address."""

    def checked(name: Column) -> Column:
        parts = F.split(F.regexp_replace(name, r"\.\z", ""), r"\.", -1)
        numeric = F.element_at(parts, -1).rlike(r"^(?:[0-9]+|0x[0-9a-f]*)\z")
        plain = ~name.rlike(r"[^\x00-\x7F]|(?:^|\.)xn--")
        return (name != "") & ~name.rlike(_FORBIDDEN_DOMAIN) & (plain | international(name)) & (~numeric | _ipv4(parts))

    # a plus sign stands for itself in a host; bytes that are no text show as U+FFFD
    decoded = F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B")))
    return let(F.when(decoded.isNotNull() & ~decoded.contains("\ufffd"), mapped(decoded)), lambda name: F.coalesce(checked(name), F.lit(False)))


def _host(host: Column, special: Column) -> Column:
    literal = host.endswith("]") & ~host.contains("%") & ipv6(host.substr(F.lit(2), F.length(host) - 2))
    return F.when(host.startswith("["), literal).when(~special, ~host.rlike(_FORBIDDEN)).otherwise(_domain(host))


def parts(text: Column) -> Column:
    """A struct: ``valid``, ``scheme``, ``host`` (whether there is one), ``path``, ``fragment`` (whether it holds anything), ``opaque``."""

    def scheme(t: Column) -> Column:
        name = F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
        return F.struct(F.lower(name).alias("scheme"), F.when(name != "", _after(t, F.length(name) + 1)).alias("rest"))

    def body(s: Column) -> Column:
        special = s["scheme"].isin(*SPECIAL)
        before = F.substring_index(s["rest"], "#", 1)
        path = F.substring_index(before, "?", 1)
        return F.struct(s["scheme"].alias("scheme"), special.alias("special"), (F.length(s["rest"]) > F.length(before) + 1).alias("fragment"), F.when(special, F.translate(path, "\\", "/")).otherwise(path).alias("path"))

    def authority(s: Column) -> Column:
        net = F.when(s["special"] & (s["scheme"] != "file"), F.regexp_replace(s["path"], "^/+", "")).when(s["path"].startswith("//"), _after(s["path"], F.lit(2)))
        named = F.regexp_extract(net, "^[^/]*", 0)
        return F.struct(*[s[k].alias(k) for k in ("scheme", "special", "fragment", "path")], named.alias("authority"), _after(net, F.length(named)).alias("below"))

    def place(s: Column) -> Column:
        at = F.substring_index(s["authority"], "@", -1)
        port = F.regexp_extract(at, r":[^:\]]*\z", 0)
        return F.struct(s.alias("s"), s["authority"].contains("@").alias("user"), port.alias("port"), at.substr(F.lit(1), F.length(at) - F.length(port)).alias("host"))

    def verdict(p: Column) -> Column:
        s, host = p["s"], p["host"]
        file = s["scheme"] == "file"
        given = s["authority"].isNotNull()
        drive = file & s["authority"].rlike(r"^[A-Za-z][:|]\z")
        digits = F.regexp_replace(_after(p["port"], F.lit(1)), "^0+", "")
        port_ok = p["port"].rlike(r"^(?::[0-9]*)?\z") & (F.length(digits) <= 5) & (F.coalesce(digits.try_cast("int"), F.lit(0)) <= 65535)
        bare = ~(s["special"] | p["user"] | (p["port"] != ""))
        name = F.when(file, s["authority"]).otherwise(host)
        needed = F.when(file, ~drive & (name != "")).otherwise(name != "")
        named_ok = ~needed | _host(name, s["special"])
        valid = ~given | ((file | (port_ok & ((host != "") | bare))) & named_ok)
        below = F.when((s["below"] == "") & s["special"], "/").otherwise(s["below"])
        path = F.when(given, F.when(drive, F.concat(F.lit("/"), s["authority"], s["below"])).otherwise(below)).when(file, F.concat(F.lit("/"), F.regexp_replace(s["path"], "^/+", ""))).otherwise(s["path"])
        return F.struct(
            F.coalesce((s["scheme"] != "") & valid, F.lit(False)).alias("valid"),
            s["scheme"].alias("scheme"),
            F.coalesce(given & needed & ~(file & (name == "localhost")), F.lit(False)).alias("host"),
            path.alias("path"),
            s["fragment"].alias("fragment"),
            (~given & ~s["special"] & ~s["path"].startswith("/")).alias("opaque"),
        )

    trimmed = F.regexp_replace(F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")
    return reduce(let, (scheme, body, authority, place, verdict), trimmed)


def _url(u: Column) -> Column:
    return u["valid"] & F.when(u["scheme"] == "file", u["path"] != "/").otherwise(u["host"] | u["fragment"] | (u["opaque"] & (u["path"] != "")))


def _uri(c: Column) -> Column:
    def one(t: Column) -> Column:
        return (t != "") & ~t.rlike(_SPACE) & F.when(t.startswith("/"), ~t.rlike(r"[\x00-\x20\x7F\x{80}]")).otherwise(let(parts(t), lambda u: u["valid"]))

    return let(F.substring_index(c, "#", 1), one)


def _http(c: Column, *schemes: str) -> Column:
    return ~c.rlike(_SPACE) & let(parts(c), lambda u: _url(u) & u["host"] & u["scheme"].isin(*schemes))


def _plain(schemes: str) -> str:
    """URLs that need no taking apart: a host of plain labels, the last of which begins with a letter."""
    return rf"(?U)^(?i:{schemes})://(?!\S*(?i:xn--))(?:[A-Za-z0-9_-]+\.)*[A-Za-z][A-Za-z0-9_-]*(?::[0-9]{{1,4}})?(?:[/?#]\S*)?\z"


def _rule(name: str, plain: str, check: Callable[[Column], Column]) -> Rule:
    return Rule(name, text_only(lambda c, p: F.when(c.rlike(plain), True).otherwise(check(c))))


URL_RULES = (
    _rule("url", _plain("https?|wss?|ftp"), lambda c: ~c.rlike(_SPACE) & let(parts(c), _url)),
    _rule("uri", _plain("https?|wss?|ftp"), _uri),
    _rule("http", _plain("https?"), lambda c: _http(c, "http", "https")),
    _rule("https", _plain("https"), lambda c: _http(c, "https")),
)
