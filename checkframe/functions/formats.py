"""Format rules on text (and numbers, where said)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import signature as S
from ..plans.kinds import NUMBERS, Value
from .rule import Rule, never, text_only
from .strings import user_pattern

# Formats defined by one pattern each, over the whole text.
_BYTE = r"(?:0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
_COMMA = r"\s*,\s*"
_TRIPLE = rf"(?:{_BYTE}{_COMMA}{_BYTE}{_COMMA}{_BYTE}|{_BYTE}%{_COMMA}{_BYTE}%{_COMMA}{_BYTE}%)"
_HUE = r"(?:0|[1-9][0-9]?|[12][0-9][0-9]|3[0-5][0-9]|360)"
_SHARE = r"(?:0|[1-9][0-9]?|100)%"
_ALPHA = r"(?:0(?:\.[0-9]+)?|1(?:\.0+)?)"
_INK = r"(?:100|[1-9]?[0-9])%"
_PRE = r"(?:0|[1-9][0-9]*+|[0-9]*+[a-zA-Z-][0-9a-zA-Z-]*+)"
PATTERNS = {
    "e164": r"\+?[1-9][0-9]{7,14}",
    "base32": r"(?:[A-Z2-7]{8})*(?:[A-Z2-7]{2}={6}|[A-Z2-7]{4}={4}|[A-Z2-7]{5}={3}|[A-Z2-7]{7}=|[A-Z2-7]{8})",
    "base64": r"(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=|[A-Za-z0-9+/]{4})",
    "base64url": r"(?:[A-Za-z0-9\-_]{4})*(?:[A-Za-z0-9\-_]{2}==|[A-Za-z0-9\-_]{3}=|[A-Za-z0-9\-_]{4})",
    "base64rawurl": r"(?:[A-Za-z0-9\-_]{4})*(?:[A-Za-z0-9\-_]{2,4})",
    "hexadecimal": r"(?:0[xX])?[0-9a-fA-F]+",
    "jwt": r"[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]*",
    "semver": rf"(?:0|[1-9][0-9]*+)\.(?:0|[1-9][0-9]*+)\.(?:0|[1-9][0-9]*+)(?:-{_PRE}(?=[.+]|\z)(?:\.{_PRE}(?=[.+]|\z))*+)?(?:\+[0-9a-zA-Z-]++(?:\.[0-9a-zA-Z-]++)*+)?",
    "mac": r"[0-9A-Fa-f]{2}(?:(?::[0-9A-Fa-f]{2}){5}|(?::[0-9A-Fa-f]{2}){7}|(?::[0-9A-Fa-f]{2}){19}|(?:-[0-9A-Fa-f]{2}){5}|(?:-[0-9A-Fa-f]{2}){7}|(?:-[0-9A-Fa-f]{2}){19})|[0-9A-Fa-f]{4}(?:(?:\.[0-9A-Fa-f]{4}){2}|(?:\.[0-9A-Fa-f]{4}){3}|(?:\.[0-9A-Fa-f]{4}){9})",
    "eth_addr": r"0x[0-9a-fA-F]{40}",
    "mongodb": r"[a-f0-9]{24}",
    "mongodb_connection_string": r"mongodb(?:\+srv)?://(?:[a-zA-Z0-9]+:[a-zA-Z0-9$:/?#\[\]@]+@)?[a-z0-9.-]++(?::[0-9]++)?(?:,[a-z0-9.-]++(?::[0-9]++)?)*+(?:/[a-zA-Z\-_]{1,64})?(?:\?[a-zA-Z]++=[a-zA-Z0-9]++(?:&(?:[a-zA-Z0-9]++=[a-zA-Z0-9]++)?)*+)?",
    "cve": r"CVE-(?:1999|2[0-9]{3})-(?:0[^0][0-9]{2}|0[0-9][^0][0-9]{1}|0[0-9]{2}[^0]|[1-9]{1}[0-9]{3,})",
    "cron": r"(?:@(?:annually|yearly|monthly|weekly|daily|hourly|reboot)|(?:@every (?:[0-9]+(?:ns|us|µs|ms|s|m|h))+)|(?:(?:[A-Za-z0-9*?][A-Za-z0-9*?/,#L-]+|[*?0-9])(?: +(?:[A-Za-z0-9*?][A-Za-z0-9*?/,#L-]+|[*?0-9])){4,6}))",
    "ein": r"[0-9]{2}-[0-9]{7}",
    "bic_iso_9362_2014": r"[A-Za-z]{6}[A-Za-z0-9]{2}(?:[A-Za-z0-9]{3})?",
    "bic": r"[A-Z0-9]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?",
    "hexcolor": r"#(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})",
    "rgb": rf"rgb\(\s*{_TRIPLE}\s*\)",
    "rgba": rf"rgba\(\s*{_TRIPLE}{_COMMA}{_ALPHA}\s*\)",
    "hsl": rf"hsl\(\s*{_HUE}{_COMMA}{_SHARE}{_COMMA}{_SHARE}\s*\)",
    "hsla": rf"hsla\(\s*{_HUE}{_COMMA}{_SHARE}{_COMMA}{_SHARE}{_COMMA}{_ALPHA}\s*\)",
    "cmyk": rf"cmyk\({_INK}{_COMMA}{_INK}{_COMMA}{_INK}{_COMMA}{_INK}\)",
}
# Digits of lower-case hexadecimal hashes.
HASHES = {"md4": 32, "md5": 32, "sha256": 64, "sha384": 96, "sha512": 128, "ripemd128": 32, "ripemd160": 40, "tiger128": 32, "tiger160": 40, "tiger192": 48}
LATITUDE = r"[-+]?(?:[1-8]?[0-9](?:\.[0-9]+)?|90(?:\.0+)?)"
LONGITUDE = r"[-+]?(?:180(?:\.0+)?|(?:1[0-7][0-9]|[1-9]?[0-9])(?:\.[0-9]+)?)"
SSN = r"[0-9]{3}[ -]?(?:0[1-9]|[1-9][0-9])[ -]?(?:[1-9][0-9]{3}|[0-9][1-9][0-9]{2}|[0-9]{2}[1-9][0-9]|[0-9]{3}[1-9])"
HTML = r"<[/]?[a-zA-Z]+[^\n]*?>"
HTML_ENCODED = r"&#[x]?[0-9a-fA-F]{2}|&gt|&lt|&quot|(?:&amp)+[;]?"
EMAIL = r"[^\s@]+@[^\s@]+\.[^\s@]+"
DATETIME = r"([0-9]{4})-([0-9]{2})-([0-9]{2})T([01][0-9]|2[0-3]):[0-5][0-9]:(?:[0-5][0-9]|60)(?:\.[0-9]+)?(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])"


def whole(c: Column, pattern: str) -> Column:
    """The pattern matches the whole text; classes are Unicode and nothing but the end is the end."""
    return c.rlike(rf"(?U)^(?:{pattern})\z")


def _pattern(name: str, pattern: str) -> Rule:
    return Rule(name, text_only(lambda c, p: whole(c, pattern)))


def _email(c: Column, p: dict) -> Column:
    local = F.substring_index(c, "@", 1)
    domain = F.regexp_replace(F.substring_index(c, "@", -1), r"\.\z", "")
    labels = F.split(domain, r"\.", -1)
    edge = r"[\p{IsAlphabetic}\p{N}]"
    label = rf"^{edge}(?:[\p{{IsAlphabetic}}\p{{N}}~-]*{edge})?\z"
    return (
        (F.octet_length(c) <= 254)
        & whole(c, EMAIL)
        & (F.octet_length(local) <= 64)
        & ~local.rlike(r"^\.|\.\z|\.\.")
        & (F.size(labels) >= 2)
        & F.forall(labels, lambda x: (F.octet_length(x) <= 63) & x.rlike(label))
        & F.element_at(labels, -1).rlike(r"^\p{IsAlphabetic}")
    )


def _datetime(c: Column, p: dict) -> Column:
    day = F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")
    return c.rlike(rf"^(?:{DATETIME})\z") & day.isNotNull() & (F.substring(c, 1, 4) != "0000")


#: How JSON text is read: nothing beyond the standard, and what does not parse is told apart.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": "_bad"}


def _json(c: Column, p: dict) -> Column:
    # a reader stops after a value and ignores what follows, so the text has to fit inside two others;
    # the value is copied as text, so keys may repeat
    item = F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>", {k: v for k, v in _STRICT.items() if k != "columnNameOfCorruptRecord"})
    member = F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "v string, _bad string", _STRICT)
    return (F.size(item) == 1) & member.isNotNull() & member["_bad"].isNull()


def _degrees(name: str, pattern: str, most: int) -> Rule:
    def check(v: Value, p: dict) -> Column:
        if v.kind == "string":
            return whole(v.column, pattern)
        return (F.abs(v.column) <= most) & v.not_nan() if v.kind in NUMBERS else never()

    return Rule(name, check)


def _weighted(digits: Column, n: int, weight) -> Column:
    """Sum of ``weight(i) * digit`` over the first ``n`` characters; X counts as ten."""
    value = [F.when(F.substring(digits, i, 1) == "X", 10).otherwise(F.substring(digits, i, 1).try_cast("int")) * weight(i) for i in range(1, n + 1)]
    return reduce(lambda a, b: a + b, value)


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, "[- ]", "")


def _isbn10(c: Column, p: dict) -> Column:
    d = _bare(c)
    return (F.length(c) - F.length(d) <= 3) & d.rlike(r"^[0-9]{9}[0-9X]\z") & (_weighted(d, 10, lambda i: i) % 11 == 0)


def _isbn13(c: Column, p: dict) -> Column:
    d = _bare(c)
    return (F.length(c) - F.length(d) <= 4) & d.rlike(r"^97[89][0-9]{10}\z") & (_weighted(d, 13, lambda i: 1 if i % 2 else 3) % 10 == 0)


def _issn(c: Column, p: dict) -> Column:
    return c.rlike(r"^[0-9]{4}-[0-9]{3}[0-9X]\z") & (_weighted(F.replace(c, F.lit("-"), F.lit("")), 8, lambda i: 9 - i) % 11 == 0)


def _luhn(c: Column) -> Column:
    return c.rlike(r"^[0-9]{2,}\z") & F.coalesce(F.call_function("luhn_check", c), F.lit(False))


def _credit_card(c: Column, p: dict) -> Column:
    d = F.replace(c, F.lit(" "), F.lit(""))
    return F.forall(F.split(c, " ", -1), lambda s: F.octet_length(s) >= 3) & d.rlike(r"^[0-9]{12,19}\z") & _luhn(d)


def _luhn_checksum(v: Value, p: dict) -> Column:
    if v.kind == "string":
        return _luhn(v.column)
    return (v.column >= 0) & _luhn(v.column.cast("string")) if v.kind in ("int", "uint") else never()


def _datauri(c: Column, p: dict) -> Column:
    at = F.instr(c, ",")
    return (at > 0) & c.startswith("data:") & whole(c.substr(at + 1, F.length(c)), PATTERNS["base64"])


def port(c: Column, zero: bool = False) -> Column:
    n = F.when(c.rlike(r"^\+?[0-9]+\z"), F.when(F.length(F.regexp_replace(c, r"^\+?0*", "")) <= 5, F.concat(F.lit("0"), F.regexp_replace(c, r"^\+", "")).cast("decimal(38,0)")))
    return F.coalesce((n >= (0 if zero else 1)) & (n <= 65535), F.lit(False))


def _origin(c: Column, p: dict) -> Column:
    from .network import hostname, ipv4, ipv6

    rest = F.regexp_replace(c, r"^https?://", "")
    v6 = rest.rlike(r"^\[")
    host = F.when(v6, F.regexp_extract(rest, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(rest, r":[^:]*\z", ""))
    tail = F.when(v6, F.regexp_replace(rest, r"^\[[^\]]*\]", "")).otherwise(F.regexp_extract(rest, r"(:[^:]*)\z", 1))
    good_port = (tail == "") | (tail.startswith(":") & port(tail.substr(F.lit(2), F.length(tail))))
    good_host = F.when(v6, ipv6(host)).otherwise((ipv4(host) | hostname(host, letter_first=False)) & (F.octet_length(host) <= 253))
    return c.rlike(r"^https?://") & ~whole_any(rest, r"[/?#@\s]") & (rest != "") & good_host & good_port


def whole_any(c: Column, pattern: str) -> Column:
    return c.rlike("(?U)" + pattern)


RULES = (
    Rule("email", text_only(_email)),
    Rule("regex", text_only(lambda c, p: c.rlike(user_pattern(p["pattern"]))), S.text("pattern")),
    Rule("json", text_only(_json)),
    Rule("datetime", text_only(_datetime)),
    *(_pattern(name, pattern) for name, pattern in PATTERNS.items()),
    Rule("url_encoded", text_only(lambda c, p: ~c.rlike("%(?![0-9A-Fa-f]{2})"))),
    Rule("html", text_only(lambda c, p: c.rlike(HTML))),
    Rule("html_encoded", text_only(lambda c, p: c.rlike(HTML_ENCODED))),
    Rule("origin", text_only(_origin)),
    Rule("datauri", text_only(_datauri)),
    _degrees("latitude", LATITUDE, 90),
    _degrees("longitude", LONGITUDE, 180),
    Rule("ssn", text_only(lambda c, p: (F.octet_length(c) == 11) & whole(c, SSN))),
    *(_pattern(name, f"[0-9a-f]{{{n}}}") for name, n in HASHES.items()),
    Rule("dns_rfc1035_label", text_only(lambda c, p: (F.octet_length(c) <= 63) & whole(c, r"[a-z](?:[-a-z0-9]*[a-z0-9])?"))),
    Rule("isbn", text_only(lambda c, p: F.coalesce(_isbn10(c, p), F.lit(False)) | F.coalesce(_isbn13(c, p), F.lit(False)))),
    Rule("isbn10", text_only(_isbn10)),
    Rule("isbn13", text_only(_isbn13)),
    Rule("issn", text_only(_issn)),
    Rule("credit_card", text_only(_credit_card)),
    Rule("luhn_checksum", _luhn_checksum),
)
