"""Secrets in texts: fixed patterns, and formats learned from what they find.

Three fixed patterns label credentials: values given to a password, secret or key, access
keys, and hexadecimal keys.  From a sample of the distinct labelled values of each kind,
and one of the other candidates, probabilistic automata are inferred (``automata``).  A
candidate is any longest run of credential characters.  Each one outside the labelled
spans is scored by all automata: it is added as a span where a format is at least
``min_odds`` times as likely to have written it as what other candidates are written by
(a format that is common among the unlabelled candidates thus counts as ordinary).

A text is searched once.  What is found is written (spans and values, no texts), and
learning and scoring read that.  The only thing gathered on the driver is the sample:
``FIT_VALUES`` values of at most ``FIT_LENGTH`` characters of each kind, chosen by
hash among all distinct ones.

Defined cases: null text counts as empty and has no spans; rows that share an id, or
have none, stay rows of their own; with no labelled credential, or no other candidate, no
spans are added; other columns are not read.  Places are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import Automaton, infer
from .common import small_batches
from .storage import cut

KINDS = ("assign", "access", "hex")
OTHER = "other"
#: Distinct values of each kind that an automaton is inferred from, and their greatest length.
FIT_VALUES, FIT_LENGTH = 2000, 256
#: Shortest run of credential characters that is a candidate.
MIN_CANDIDATE = 16
#: Times that a format has to be likelier than what other candidates are written by.
MIN_ODDS = 1000.0

# The patterns of the base, as the contract words them.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20

_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{MIN_CANDIDATE},}}")
#: marks of the text around a candidate that are no part of it
_EDGES = ".=-_/+"

_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
SPANS = "array<struct<kind:string,start:long,end:long,value:string>>"


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """``(kind, start, end, credential)`` of what the fixed patterns find, by start, then kind."""
    out = []
    low = text.lower()
    if any(name in low for name in NAMES):
        out += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return [(KINDS[k], start, end, value) for start, k, end, value in sorted(out)]


def candidates(text: str, taken: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Runs of credential characters that touch no labelled span, without marks at their edges."""
    out, held = [], []
    for _, start, end, _ in sorted(taken, key=lambda x: x[1]):
        if held and start < held[-1][1]:
            held[-1][1] = max(held[-1][1], end)
        else:
            held.append([start, end])
    at = 0
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(held) and held[at][1] <= start:
            at += 1
        if at < len(held) and held[at][0] < end:
            continue
        value = m[0].strip(_EDGES)
        if len(value) >= MIN_CANDIDATE:
            start += m[0].index(value[0])
            out.append((OTHER, start, start + len(value), value))
    return out


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = []
        for text in batch.column(1):
            text = text.as_py() or ""
            base = base_spans(text)
            spans.append([dict(zip(("kind", "start", "end", "value"), x, strict=True)) for x in base + candidates(text, base)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_SPAN))], names=["_id", "spans"])


def learn(found: DataFrame, *, fit_values: int = FIT_VALUES) -> dict[str, Automaton]:
    """An automaton for each kind of ``spans``, and one for the other candidates."""
    values = found.select(F.explode("spans").alias("s")).select("s.kind", "s.value").where(F.length("value") <= FIT_LENGTH)
    # a sample by the hash of the value: the same whatever the order of rows, copies count once
    kinds = (*KINDS, OTHER)
    distinct = cut(values.groupBy("kind", "value").agg(F.count("*").alias("n")))
    out = {}
    for kind in kinds:
        chosen = distinct.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(fit_values).select("value").collect()
        out[kind] = infer([r["value"] for r in chosen])
    return out


def best_format(value: str, automata: dict[str, Automaton]) -> tuple[str, float]:
    """The likeliest format of a value, and the natural log of its odds against other candidates."""
    other = automata[OTHER].log_probability(value)
    return max(((kind, automata[kind].log_probability(value) - other) for kind in KINDS if automata[kind].steps), key=lambda x: x[1], default=(OTHER, float("-inf")))


def secrets(docs: DataFrame, *, min_odds: float = MIN_ODDS, fit_values: int = FIT_VALUES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans`` of every row, by start: those of the fixed patterns, and ``like_<kind>`` for values of a learned format."""
    import math

    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind_of_id = own.schema["_id"].dataType.simpleString()
    found = cut(own.transform(small_batches).mapInArrow(_found, f"_id {kind_of_id}, spans {SPANS}"))
    automata = learn(found, fit_values=fit_values)
    # without formats, or without anything to hold against them, nothing is added
    ready = automata[OTHER].steps and any(automata[k].steps for k in KINDS)
    least = math.log(min_odds)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}
        for batch in batches:
            known.clear()
            out = []
            for spans in batch.column(1).to_pylist():
                kept = []
                for s in spans:
                    if s["kind"] == OTHER:
                        if s["value"] not in known:
                            kind, odds = best_format(s["value"], automata) if ready else (OTHER, float("-inf"))
                            known[s["value"]] = f"like_{kind}" if odds >= least else None
                        if known[s["value"]] is None:
                            continue
                        s["kind"] = known[s["value"]]
                    kept.append(s)
                order = {k: i for i, k in enumerate((*KINDS, *(f"like_{k}" for k in KINDS)))}
                out.append(sorted(kept, key=lambda s: (s["start"], order[s["kind"]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(_SPAN))], names=[id_col, "spans"])

    return found.transform(small_batches).mapInArrow(judge, f"`{id_col}` {kind_of_id}, spans {SPANS}")


def _sql_spans(pattern: str, kind: str, least: int, group: int = 0) -> str:
    """DuckDB SQL: a list of {kind, start, end} of the matches of ``pattern`` whose ``group`` has ``least`` characters or more.

    What stands between the matches gives their places.
    """
    rank = KINDS.index(kind)
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pattern}')) + 1), lambda i: {{
    'at': coalesce(list_sum(list_transform((string_split_regex(t, '{pattern}'))[:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform((regexp_extract_all(t, '{pattern}'))[:i - 1], lambda x: length(x))), 0)::BIGINT,
    'k': {rank}, 'kind': '{kind}', 'size': length((regexp_extract_all(t, '{pattern}'))[i]), 'ok': length((regexp_extract_all(t, '{pattern}', {group}))[i]) >= {least}}}), lambda s: s.ok)"""


_NAMES_SQL = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else "_?" for c in name) for name in ("password", "passwd", "secret", "token", "api_key"))

#: DuckDB SQL for the columns that the fixed patterns give.
BASE_ORACLE = f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), found AS (
  SELECT doc_id, {_sql_spans(f'''({_NAMES_SQL})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)''', "assign", MIN_ASSIGN, 2)} AS a,
    {_sql_spans("AKIA[A-Z0-9]+", "access", MIN_ACCESS)} AS b, {_sql_spans("[0-9a-f]{24,}", "hex", 1)} AS c FROM texts
)
SELECT doc_id, len(a)::BIGINT AS n_assign, len(b)::BIGINT AS n_access, len(c)::BIGINT AS n_hex,
  sha256(coalesce(array_to_string(list_transform(list_sort(list_concat(list_concat(a, b), c)), lambda s: s.kind || ':' || s.at || ':' || (s.at + s.size)), ','), '')) AS base_sha256
FROM found"""
