"""Secret scans: fixed patterns, and windows of high Shannon entropy.

Base spans are the matches of the kinds in ``BASE``, leftmost and not
overlapping within a kind, long enough.  Places come from the lengths of the
pieces between matches (a split) and of the matches, added up from the left.

The method adds spans.  Candidates are runs of key characters that no base
pattern has taken; each belongs to a character class with its own window and
least entropy.  A window slides over the candidate: one count goes up, one
goes down, and the sum of ``c log c`` over the counts follows by two table
look-ups in fixed-point integers, so both the sum and the threshold are exact.
Windows at or above the class's entropy that touch or overlap become one span.
Candidates on the allow list add nothing; it never takes a base span away.

Everything is a Spark expression on one row; no Python, no shuffle.  Long
texts are handled whole: sums and windows are taken in blocks, so the work
grows with the length, not its square.

Defined results: null text is empty text and has no spans; repeated rows each
have their spans; spans that start at one place are ordered as the kinds are
listed; an empty table gives no rows.  A column named like the result is
replaced; others are untouched.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.functions.text import bind


class Kind(NamedTuple):
    """A pattern; a match counts if its ``group`` has ``least`` characters or more.

    Texts without any of ``words`` (in lower case), or in which ``guard`` finds
    nothing, hold no match and are not searched.
    """

    name: str
    pattern: str
    group: int
    least: int
    words: tuple[str, ...] = ()
    guard: str = ""


class CharacterClass(NamedTuple):
    """Runs of ``alphabet`` only, held against ``bits`` of entropy in windows of ``window`` characters."""

    name: str
    alphabet: str
    window: int
    bits: float


def either_case(word: str) -> str:
    """The ASCII letters of a pattern in either case, without flags (engines differ in theirs)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The base kinds and the words of the first.
NAMES = ["password", "passwd", "secret", "token", "api_?key"]
ASSIGN = "(" + "|".join(map(either_case, NAMES)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of at least 20 key characters, tried at its start only.
LONG_RUN = "(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20}"
# A run that is long enough is what is left of all runs after dropping the short ones: a match ends where its run ends.
BASE = [Kind("assign", ASSIGN, 2, 8, ("password", "passwd", "secret", "token", "apikey", "api_key")),
        Kind("access", "AKIA[A-Z0-9]{12,}", 0, 16, ("akia",)), Kind("hex", "[0-9a-f]{32,}", 0, 32, guard=LONG_RUN)]

#: The first class whose alphabet holds the whole candidate decides.
CLASSES = [CharacterClass("entropy_hex", "[0-9A-Fa-f]", 24, 3.2), CharacterClass("entropy_key", "[A-Za-z0-9+/=_-]", 20, 3.75)]
#: What a base pattern takes is no candidate; the last group is the candidate.
CANDIDATES = f"{ASSIGN}|AKIA[A-Z0-9]{{12,}}|[0-9a-f]{{32,}}|([A-Za-z0-9+/=_-]{{20,}})"
#: Candidates that hold one of these are no secrets: placeholders, character rows, identifiers of known form.
ALLOW = "|".join([*(f"({either_case(w)})" for w in ["example", "sample", "placeholder", "changeme", "dummy", "xxxx"]),
                  "0123456789", either_case("abcdefgh"), either_case("qwerty"),
                  "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"])

BLOCK = 256
POINT = 1 << 20
FIRST, CODES = ord("+"), ord("z") - ord("+") + 1
SPAN = "struct<start: bigint, rank: int, end: bigint, kind: string>"


def entropy_table(window: int) -> list[int]:
    """``c * log2(c)`` for the counts 0 to ``window``, in fixed point."""
    return [round(c * math.log2(c) * POINT) if c else 0 for c in range(window + 1)]


def entropy_limit(window: int, bits: float) -> int:
    """The largest sum of ``c * log2(c)`` with at least ``bits`` of entropy: H = log2(window) - sum / window."""
    return math.floor(window * (math.log2(window) - bits) * POINT)


def _blocks(items: Column, ahead: int = 0) -> Column:
    """``(first, items)``: blocks of ``BLOCK`` items, each with ``ahead`` items of the next."""
    firsts = F.sequence(F.lit(0), F.greatest(F.size(items) - ahead - 1, F.lit(0)), F.lit(BLOCK))
    return F.transform(firsts, lambda i: F.struct(i.alias("first"), F.slice(items, i + 1, F.lit(BLOCK + ahead)).alias("items")))


def _sums(items: Column) -> Column:
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(items, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.array_append(a["out"], a["sum"] + x).alias("out")),
                       lambda a: a["out"])


def running_sums(items: Column) -> Column:
    """Sums from the left, in blocks: within each, over their totals, and added."""
    inner = F.transform(_blocks(items), lambda b: _sums(b["items"]))
    return bind(inner, lambda parts: bind(
        _sums(F.transform(parts, lambda p: F.coalesce(F.get(p, F.size(p) - 1), F.lit(0).cast("bigint")))),
        lambda totals: F.flatten(F.transform(parts, lambda p, i: F.transform(
            p, lambda x: x + F.when(i > 0, F.get(totals, i - 1)).otherwise(F.lit(0).cast("bigint")))))))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches of ``pattern``, leftmost and not overlapping: ``(start, end, text of the group)`` in code points."""
    place = lambda gaps, found, wanted: bind(
        running_sums(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: (F.char_length(g) + F.char_length(m)).cast("bigint"))),
        lambda ends: F.transform(wanted, lambda w, i: F.struct(
            (F.get(ends, i) - F.char_length(F.get(found, i))).alias("start"), F.get(ends, i).alias("end"), w.alias("value"))))
    out = bind(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
                        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("wanted")),
               lambda s: place(s["gaps"], s["found"], s["wanted"]))
    none = F.array().cast("array<struct<start: bigint, end: bigint, value: string>>")
    return F.when(text.rlike(pattern), out).otherwise(none)


def _span(m: Column, rank: int, kind: str) -> Column:
    return F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"))


def base_spans(text: Column, kind: Kind, rank: int = 0) -> Column:
    found = F.filter(matches(text, kind.pattern, kind.group), lambda m: F.char_length(m["value"]) >= kind.least)
    out = F.transform(found, lambda m: _span(m, rank, kind.name)).cast(f"array<{SPAN}>")
    none = F.array().cast(f"array<{SPAN}>")
    if kind.guard:
        out = F.when(text.rlike(kind.guard), out).otherwise(none)
    if kind.words:
        low = F.lower(text)
        out = F.when(reduce(or_, [F.contains(low, F.lit(w)) for w in kind.words]), out).otherwise(none)
    return out


def high_windows(run: Column, cls: CharacterClass) -> Column:
    """Starts (from 0) of the windows of ``run`` with ``cls.bits`` of entropy or more."""
    w = cls.window
    table = F.array(*map(F.lit, entropy_table(w))).cast("array<bigint>")
    limit = F.lit(entropy_limit(w, cls.bits))
    codes = F.transform(F.split(run, ""), lambda c: F.ascii(c) - FIRST)
    grown = lambda c: F.get(table, c + 1) - F.get(table, c)

    def slide(block: Column) -> Column:
        items = block["items"]
        start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("sum"),
                         F.array_repeat(F.lit(0), CODES).alias("counts"), F.array().cast("array<int>").alias("out"))

        def leave(a: Column) -> Column:
            """One character goes once the window is full."""
            old = F.get(items, a["at"] - w)
            less = F.struct(a["at"].alias("at"), (a["sum"] - grown(F.get(a["counts"], old) - 1)).alias("sum"),
                            F.transform(a["counts"], lambda c, i: F.when(i == old, c - 1).otherwise(c)).alias("counts"), a["out"].alias("out"))
            return F.when(a["at"] >= w, less).otherwise(a)

        def enter(a: Column, x: Column) -> Column:
            total = a["sum"] + grown(F.get(a["counts"], x))
            hit = (a["at"] >= w - 1) & (total <= limit)
            return F.struct((a["at"] + 1).alias("at"), total.alias("sum"),
                            F.transform(a["counts"], lambda c, i: F.when(i == x, c + 1).otherwise(c)).alias("counts"),
                            F.when(hit, F.array_append(a["out"], a["at"] - (w - 1) + block["first"])).otherwise(a["out"]).alias("out"))

        return F.aggregate(items, start, lambda a, x: bind(leave(a), lambda b: enter(b, x)), lambda a: a["out"])

    return F.flatten(F.transform(bind(codes, lambda c: _blocks(c, w - 1)), slide))


def _united(starts: Column, window: int) -> Column:
    """``(start, end)`` of the stretches that windows at the sorted ``starts`` cover."""
    opens = F.filter(starts, lambda s, i: (i == 0) | (s - F.get(starts, i - 1) > window))
    closes = F.filter(starts, lambda s, i: (i == F.size(starts) - 1) | (F.get(starts, i + 1) - s > window))
    return F.zip_with(opens, closes, lambda a, b: F.struct(a.cast("bigint").alias("start"), (b + window).cast("bigint").alias("end")))


def entropy_spans(text: Column, classes: list[CharacterClass], candidates: str, group: int, allow: str, guard: str = "",
                  first_rank: int = 0) -> Column:
    """Stretches of high entropy of the candidates (``group`` of the pattern) that are not on the allow list."""
    runs = F.filter(matches(text, candidates, group), lambda m: (m["value"] != "") & ~m["value"].rlike(allow))

    def in_class(m: Column, cls: CharacterClass, rank: int) -> Column:
        found = bind(high_windows(m["value"], cls), lambda starts: _united(starts, cls.window))
        return F.transform(found, lambda s: F.struct(
            (m["start"] + s["start"]).alias("start"), F.lit(rank).alias("rank"), (m["start"] + s["end"]).alias("end"),
            F.lit(cls.name).alias("kind"))).cast(f"array<{SPAN}>")

    def of(m: Column) -> Column:
        out = F.array().cast(f"array<{SPAN}>")
        for k, cls in reversed(list(enumerate(classes))):
            out = F.when(m["value"].rlike(f"^{cls.alphabet}{{{cls.window},}}$"), in_class(m, cls, first_rank + k)).otherwise(out)
        return out

    found = F.flatten(F.transform(runs, of))
    return F.when(text.rlike(guard), found).otherwise(F.array().cast(f"array<{SPAN}>")) if guard else found


def scan(docs: DataFrame, text_col: str = "text", base: list[Kind] = BASE, classes: list[CharacterClass] = CLASSES,
         candidates: str = CANDIDATES, candidate_group: int = 3, allow: str = ALLOW,
         guard: str = LONG_RUN) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: ``(start, rank, end, kind)`` by start and kind, ends exclusive."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(*(base_spans(text, kind, k) for k, kind in enumerate(base)))
    more = entropy_spans(text, classes, candidates, candidate_group, allow, guard, len(base))
    # the text leaves the row's struct only here, so no column of the table can clash
    rows = docs.withColumns({"base_spans": F.sort_array(found), "spans": more})
    return rows.withColumn("spans", F.sort_array(F.concat("base_spans", "spans")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
