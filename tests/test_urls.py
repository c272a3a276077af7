"""URL rules against a plain parser, and internationalised hosts."""

import ipaddress
import random
import re
from urllib.parse import unquote_to_bytes

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checkframe.functions import domains
from checkframe.operators import Checker

# Schemes whose URLs have an authority, of the WHATWG URL standard.
SPECIAL = ("http", "https", "ws", "wss", "ftp", "file")
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):(.*)\Z", re.S)
_FORBIDDEN = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|]")
_FORBIDDEN_DOMAIN = re.compile(r"[\x00-\x20\"#%/:<>?@\[\\\]^`{|}\x7f]")


def _ipv4_number(part: str) -> int | None:
    try:
        if part[:2].lower() == "0x":
            return int(part[2:] or "0", 16)
        return (int(part, 8) if len(part) > 1 and part[0] == "0" else int(part)) if part.isdigit() else None
    except ValueError:
        return None


def _host(text: str, special: bool) -> bool:
    """Whether the text is a host of a URL."""
    if text.startswith("["):
        try:
            return text.endswith("]") and "%" not in text and bool(ipaddress.IPv6Address(text[1:-1]))
        except ValueError:
            return False
    if not special:
        return not _FORBIDDEN.search(text)
    try:
        domain = unquote_to_bytes(text).decode()
    except UnicodeDecodeError:
        return False
    if not domain or _FORBIDDEN_DOMAIN.search(domain):
        return False
    parts = domain.removesuffix(".").split(".")
    if re.fullmatch(r"[0-9]+|0[xX][0-9a-fA-F]*", parts[-1]):
        numbers = [_ipv4_number(x) if x.isascii() else None for x in parts]
        return len(parts) <= 4 and None not in numbers and all(n < 256 for n in numbers[:-1]) and numbers[-1] < 256 ** (5 - len(parts))
    return True


def parse(text: str) -> dict | None:
    """scheme, host (None: none), path, fragment and opacity of an absolute URL, or None."""
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(33)))))
    m = _SCHEME.match(text)
    if not m:
        return None
    scheme, rest = m[1].lower(), m[2]
    rest, _, fragment = rest.partition("#")
    special = scheme in SPECIAL
    if special:
        rest = rest.replace("\\", "/") if "?" not in rest else rest.split("?", 1)[0].replace("\\", "/") + "?" + rest.split("?", 1)[1]
    path_part = rest.partition("?")[0]
    out = {"scheme": scheme, "host": None, "path": path_part, "fragment": fragment, "opaque": False}
    if special and scheme != "file":
        after = rest.lstrip("/")
    elif rest.startswith("//"):
        after = rest[2:]
    else:
        if scheme == "file":
            out["path"] = "/" + path_part.lstrip("/")
        out["opaque"] = not special and not rest.startswith("/")
        return out
    cut = re.search(r"[/?]", after)
    authority, path = (after[: cut.start()], after[cut.start() :]) if cut else (after, "")
    out["path"] = path.partition("?")[0] or ("/" if special else "")
    if scheme == "file":
        if re.fullmatch(r"[A-Za-z][:|]", authority):
            out["path"] = f"/{authority}{out['path']}"
            return out
        if authority and not _host(authority, True):
            return None
        out["host"] = authority if authority not in ("", "localhost") else None
        return out
    credentials, at, place = authority.rpartition("@")
    port = re.search(r":([^:\]]*)\Z", place)
    host = place[: port.start()] if port else place
    if port and port[1] and not (port[1].isascii() and port[1].isdigit() and int(port[1]) <= 65535):
        return None
    if not host and (special or at or port):
        return None
    if host and not _host(host, special):
        return None
    out["host"] = host or None
    return out


def is_url(text: str) -> bool:
    if re.search(r"\s", text):
        return False
    u = parse(text)
    if u is None:
        return False
    if u["scheme"] == "file":
        return u["path"] != "/"
    return u["host"] is not None or u["fragment"] != "" or (u["opaque"] and u["path"] != "")


def is_uri(text: str) -> bool:
    text = text.partition("#")[0]
    if not text or re.search(r"\s", text):
        return False
    if text.startswith("/"):
        return all(33 <= ord(c) <= 126 or ord(c) > 127 for c in text)
    return parse(text) is not None


def is_http(text: str, schemes: tuple[str, ...] = ("http", "https")) -> bool:
    if not is_url(text):
        return False
    u = parse(text)
    return u["host"] is not None and u["scheme"] in schemes


PIECES = ["http", "https", "HTTP", "file", "ftp", "mailto", "x-y", "data", ":", "://", "//", "/", "\\", "a", "b.c", "example.com", "1.2.3.4", "0x7f.1", "256", "08", "0xffffffff", "1.2.3", "[::1]", "[1::2::3]", "[", "]", "@", "u:p@", ":80", ":99999", ":", "?", "q=1", "#", "#f", "%41", "%zz", "%", "+", "localhost", "C:", "|", " ", "\x01", ".", "..", "-", "_", "*", "<", ">", "^", "{", "0", "00000000012", '"']


def passes(spark, texts, *rules):
    df = spark.createDataFrame([(t,) for t in texts], "v string").repartition(2)
    return {r.v: r for r in df.select("v", *[Checker().passes(F.col("v"), k, T.StringType()).alias(k) for k in rules]).collect()}


def test_rules_equal_the_plain_parser(spark):
    rng = random.Random(11)
    texts = {rng.choice(["", "http://", "https://", "file://", "x:", "x://", "http:", "/", "FTP://"]) + "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 7))) for _ in range(4000)}
    got = passes(spark, texts, "url", "uri", "http", "https")
    want = {t: (is_url(t), is_uri(t), is_http(t), is_http(t, ("https",))) for t in texts}
    assert sum(w[0] for w in want.values()) > 300
    assert [(t, tuple(got[t])[1:], want[t]) for t in texts if tuple(got[t])[1:] != want[t]] == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("http://a.b",)], "v string")
    plan = df.select(*[Checker().passes(F.col("v"), k, T.StringType()) for k in ("url", "uri", "http", "https")])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


GOOD = ["münchen.de", "xn--mnchen-3ya.de", "XN--MNCHEN-3YA.de", "faß.de", "ａｂｃ.com", "a。b", "１２７.0.0.1", "💩.la", "xn--ls8h.la", "אבג.com", "א1.com", "क्\u200dष.in", "a\u00adb.com", "ÉCOLE.fr", "%C3%A9.fr", "日本語.jp", "xn--wgv71a119e.jp", "o%2Do.com", "例え.テスト", "نامه\u200cای.ir"]
BAD = ["xn--", "xn--a", "xn--abc-", "xn--zzzzzzzzzzzzz99999", "xn--mnchen-3yb-!.de", "\u0301a.com", "a\u200db.com", "אa.com", "aא.com", "1א.com", "a％b.com", "a／b.com", "\u00ad", "\ue000.com", "a\ufffdb.com", "a%FFb.com", "３００.0.0.1", "a\u0378b.com", "a\u202eb.com", "xn--MNCHEN-3YA-.de\u2028", "א٠1.com"]


def test_hosts_of_other_scripts(spark):
    got = passes(spark, [f"http://{h}/x" for h in GOOD + BAD], "url", "http", "uri")
    assert [h for h in GOOD if tuple(got[f"http://{h}/x"])[1:] != (True,) * 3] == []
    assert [h for h in BAD if got[f"http://{h}/x"].url] == []


def test_punycode_equals_the_plain_one(spark):
    rng = random.Random(5)
    pools = ["abc-z09", "äöüßéñ", "日本語テスト", "abא-ß", "💩🙂z"]
    texts = {"".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 24))) for _ in range(300)}
    coded = {t.encode("punycode").decode(): t for t in texts if not t.isascii()}
    df = spark.createDataFrame([(c,) for c in coded], "c string")
    got = {r.c: "".join(map(chr, r.p)) for r in df.select("c", domains.punycode(F.col("c")).alias("p")).collect()}
    assert got == coded
    # texts that are no Punycode, and random ones
    alphabet = "abcdefghijklmnopqrstuvwxyz0123456789-"
    for_ = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9))) for _ in range(400)} | {"é-a", "a_b", "99999999", "abc-"}
    found = spark.createDataFrame([(c,) for c in for_], "c string").select("c", domains.punycode(F.col("c")).alias("p")).collect()
    for r in found:
        try:
            want = [ord(x) for x in r.c.encode("ascii").decode("punycode")] if not r.c.endswith("-") else None
            want = None if want is None or any(0xD800 <= x < 0xE000 for x in want) else want
        except (UnicodeError, ValueError):
            want = None
        assert r.p == want, r.c
