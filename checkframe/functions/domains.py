"""Internationalised domain names as columns.

A name is mapped (case and width, ignorable characters), its ``xn--`` labels are decoded, and every
label is checked: characters that names may not hold, marks at the start, joiners out of place,
directions that do not mix.  Classes and the mapping come from the properties of Unicode by rule.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The parameters of Punycode (RFC 3492).
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
#: Most code points of a label, beyond which it is no name.
_MOST_CODE = 0x10FFFF


def let(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once: an array of one is walked, which gives its item a name."""
    return F.element_at(F.transform(F.array(x), then), 1)


def _points(test: Callable[[str], bool]) -> list[int]:
    return [c for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and test(chr(c))]


def _class(points: Iterable[int]) -> str:
    """Code points as the inside of a character class."""
    runs: list[list[int]] = []
    for c in points:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs)


#: Characters that leave no trace in a name, beside the variation selectors.
_IGNORED = "\u00ad\u034f\u180b\u180c\u180d\u200b\u2060\u2064\ufeff" + "".join(map(chr, range(0xFE00, 0xFE10)))
#: Full stops of other scripts.
_STOPS = "\u3002\uff0e\uff61"


@cache
def _tables() -> dict[str, str]:
    """What the rules need of Unicode's properties, made once."""
    single, forbidden = {}, []
    for c in _points(lambda c: unicodedata.category(c) not in ("Cn", "Co")):
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", chr(c)).casefold())
        if len(folded) == 1 and folded.isascii():
            single[chr(c)] = folded
        elif any(x in " \"#%/:<>?@[\\]^`{|}" or ord(x) < 32 for x in folded):
            forbidden.append(c)
    for c in _STOPS:
        single[c] = "."
    ignored = set(_IGNORED)
    keys = sorted(k for k in single if k not in ignored)
    direction = lambda *kinds: _class(_points(lambda c: unicodedata.bidirectional(c) in kinds))
    return {
        # a key without a partner is removed by ``translate``
        "from": "".join(keys) + "".join(sorted(ignored)),
        "to": "".join(single[k] for k in keys),
        "forbidden": _class(forbidden),
        "rtl": direction("R", "AL"),
        "arabic_number": direction("AN"),
        "ltr": direction("L"),
        "mark": direction("NSM"),
        "virama": _class(_points(lambda c: unicodedata.combining(c) == 9)),
    }


def mapped(domain: Column) -> Column:
    """The name with case and width folded and ignorable characters gone."""
    tables = _tables()
    return F.lower(F.translate(domain, tables["from"], tables["to"]))


def _digit(c: Column) -> Column:
    return F.when((c >= 97) & (c <= 122), c - 97).when((c >= 48) & (c <= 57), c - 22)


def _adapt(delta: Column, count: Column, first: Column) -> Column:
    """Punycode's next bias; the division runs six times at most below 2 ** 31."""
    least = BASE - T_MIN
    step = let(F.floor(delta / F.when(first, DAMP).otherwise(2)), lambda d: F.struct((d + F.floor(d / count)).alias("d"), F.lit(0).cast("bigint").alias("k")))

    def smaller(s: Column, _: Column) -> Column:
        return F.when(s["d"] > least * T_MAX // 2, F.struct(F.floor(s["d"] / least).alias("d"), (s["k"] + BASE).alias("k"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(6)), step, smaller, lambda s: s["k"] + F.floor(BASE * s["d"] / (s["d"] + SKEW)))


def code_points(text: Column) -> Column:
    """Code points of a text; its UTF-32 bytes, four by four."""
    size = F.length(text)
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda i: F.conv(F.hex(F.encode(F.substring(text, i, F.lit(1)), "UTF-32")), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def punycode(label: Column) -> Column:
    """Code points of a Punycode text (without ``xn--``), or null where it is none."""
    at = F.length(label) - F.length(F.substring_index(label, "-", -1)) - 1
    basic = F.when(at > 0, F.substring(label, F.lit(1), at)).otherwise("")
    extended = F.when(label.contains("-"), F.substring_index(label, "-", -1)).otherwise(label)

    def state(out, n, bias, i, old, w, k, ok) -> Column:
        names = ("out", "n", "bias", "i", "old", "w", "k", "ok")
        kinds = ("array<bigint>", *["bigint"] * 6, "boolean")
        return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).cast(t).alias(name) for x, t, name in zip((out, n, bias, i, old, w, k, ok), kinds, names, strict=True)])

    def step(s: Column, point: Column) -> Column:
        def of(d: Column) -> Column:
            i = s["i"] + d * s["w"]
            t = F.greatest(F.lit(T_MIN), F.least(F.lit(T_MAX), s["k"] - s["bias"]))
            count = F.size(s["out"]) + 1
            n = s["n"] + F.floor(i / count)
            place = (i % count).cast("int")
            out = F.concat(F.slice(s["out"], F.lit(1), place), F.array(n), F.slice(s["out"], place + 1, F.greatest(F.size(s["out"]) - place, F.lit(0))))
            done = state(out, n, _adapt(i - s["old"], count.cast("bigint"), s["old"] == 0), place + 1, place + 1, 1, BASE, s["ok"] & (n <= _MOST_CODE))
            more = state(s["out"], s["n"], s["bias"], i, s["old"], s["w"] * (BASE - t), s["k"] + BASE, s["ok"])
            return F.when(d < t, done).otherwise(more)

        lost = state(s["out"], s["n"], s["bias"], s["i"], s["old"], s["w"], s["k"], False)
        d = _digit(point)
        # i and w stay below 2 ** 31, as the standard asks
        fine = s["ok"] & d.isNotNull() & (s["w"] < 2**31) & (s["i"] < 2**31)
        return F.when(fine, of(d)).otherwise(lost)

    start = state(code_points(basic), FIRST_CODE, FIRST_BIAS, 0, 0, 1, BASE, True)
    end = F.aggregate(code_points(extended), start, step)
    # a text that ends within a number is none
    return let(end, lambda s: F.when(s["ok"] & (s["k"] == BASE) & (F.length(extended) > 0) & ~basic.rlike(r"[^\x00-\x7F]") & ~F.exists(s["out"], lambda c: (c >= 0xD800) & (c < 0xE000)), s["out"]))


def _text(points: Column) -> Column:
    return F.decode(F.unhex(F.array_join(F.transform(points, lambda c: F.lpad(F.hex(c), 8, "0")), "")), "UTF-32")


_EUROPEAN = "0-9\\x{B2}\\x{B3}\\x{B9}\\x{6F0}-\\x{6F9}\\x{2070}-\\x{2079}\\x{2080}-\\x{2089}"
#: What no label holds: controls, spaces, private and unassigned code points, and the replacement character.
_NEVER = r"[\p{Cc}\p{Cs}\p{Co}\p{Cn}\p{Z}\x{FFF9}-\x{FFFD}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2061}-\x{2063}\x{206A}-\x{206F}\x{E0001}\x{E0020}-\x{E007F}]"


def _label_ok(label: Column) -> Column:
    """Whether a label, in Unicode, may stand in a name."""
    tables = _tables()
    joiner = f"[{tables['virama']}]\\x{{200C}}|[{tables['virama']}]\\x{{200D}}|[\\p{{IsArabic}}\\p{{IsSyriac}}]\\p{{M}}*\\x{{200C}}\\p{{M}}*[\\p{{IsArabic}}\\p{{IsSyriac}}]"
    left = F.regexp_replace(label, joiner, "")
    return ~label.rlike(_NEVER) & ~label.rlike(f"[{tables['forbidden']}]") & ~label.rlike(r"^\p{M}") & ~left.rlike(r"[\x{200C}\x{200D}]")


def _directions_ok(labels: Column) -> Column:
    """Names that hold right-to-left text keep to one direction in each label."""
    t = _tables()
    rtl, ltr, an, mark = t["rtl"], "A-Za-z" + t["ltr"], t["arabic_number"], t["mark"]

    def one(x: Column) -> Column:
        right = ~x.rlike(f"[{ltr}]") & x.rlike(f"[{rtl}{an}{_EUROPEAN}][{mark}]*\\z") & ~(x.rlike(f"[{an}]") & x.rlike(f"[{_EUROPEAN}]"))
        left = ~x.rlike(f"[{rtl}{an}]") & x.rlike(f"[{ltr}{_EUROPEAN}][{mark}]*\\z")
        return F.when(x == "", True).when(x.rlike(f"^[{rtl}]"), right).when(x.rlike(f"^[{ltr}]"), left).otherwise(False)

    return ~F.exists(labels, lambda x: x.rlike(f"[{rtl}{an}]")) | F.forall(labels, one)


def unicode_labels(name: Column) -> Column:
    """Labels of a mapped name in Unicode; a label that is no Punycode, or needless one, is null."""

    def one(x: Column) -> Column:
        def decoded(points: Column) -> Column:
            return let(F.when(points.isNotNull() & F.exists(points, lambda c: c >= 128), _text(points)), lambda t: F.when(mapped(t) == t, t))

        return F.when(x.startswith("xn--"), let(punycode(F.substring(x, 5, 1 << 20)), decoded)).otherwise(x)

    return F.transform(F.split(name, r"\.", -1), one)


def international(name: Column) -> Column:
    """Whether a mapped name that is not plain ASCII, or has ``xn--`` labels, is a name."""
    return let(unicode_labels(name), lambda labels: ~F.exists(labels, lambda x: x.isNull()) & F.forall(labels, _label_ok) & _directions_ok(labels))


