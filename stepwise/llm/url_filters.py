"""URL rules and an exact block list held in a Bloom filter cascade (native).

The cascade knows the whole key universe of the corpus.  Level 0 encodes the
listed keys; the unlisted keys that pass it are its false positives, which
level 1 encodes; the listed keys passing level 1 go into level 2, and so on
until a level lets nothing wrong through.  A key is decided by the first
level that rejects it, so membership is exact for every key of the universe
and needs no join: a level is a binary literal in the expression.

Defined results: null keys are listed nowhere; repeated keys count once; an
empty list or universe gives a cascade without levels (nothing is listed).
The literals of all levels together may hold ``max_bits``; a longer list is
looked up by a shuffle join on the key instead (same results).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 10
HASHES = 4
# All levels together are a literal of at most this many bits (4 MiB).
MAX_BITS = 1 << 25


@dataclass(frozen=True)
class Level:
    salt: int
    bits: int
    bitmap: bytes


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting ``(verdict, host, path)`` rule; nulls if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _positions(key: Column, salt: int, bits: int) -> list[Column]:
    a = F.pmod(F.xxhash64(F.lit(2 * salt), key), F.lit(bits))
    b = F.pmod(F.xxhash64(F.lit(2 * salt + 1), key), F.lit(bits))
    return [F.pmod(a + b * F.lit(j), F.lit(bits)) for j in range(HASHES)]


def _passes(key: Column, level: Level) -> Column:
    bitmap = F.lit(bytearray(level.bitmap))
    ok = F.lit(True)
    for pos in _positions(key, level.salt, level.bits):
        byte = F.conv(F.hex(F.substring(bitmap, (F.floor(pos / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        ok = ok & (F.getbit(byte, F.pmod(pos, F.lit(8)).cast("int")) == 1)
    return ok


def _encode(keys: DataFrame, salt: int, bits: int) -> Level:
    """One level's bitmap; only its words (at most bits / 64) reach the driver."""
    pos = keys.select(F.explode(F.array(*_positions(F.col("key"), salt, bits))).alias("pos"))
    words = (pos.groupBy(F.floor(F.col("pos") / 32).alias("word"))
                .agg(F.bit_or(F.expr("shiftleft(1L, cast(pos % 32 as int))")).alias("bits")))
    bitmap = bytearray(4 * math.ceil(bits / 32))
    for w in words.toLocalIterator():
        bitmap[4 * w["word"]:4 * w["word"] + 4] = int(w["bits"]).to_bytes(4, "little")
    return Level(salt, bits, bytes(bitmap))


def key_universe(universe: DataFrame, listed: DataFrame, key: str = "key") -> DataFrame:
    """One row per distinct non-null key with its flag ``listed`` (map-side combined, no join)."""
    return (universe.select(F.col(key).alias("key"), F.lit(False).alias("listed"))
            .unionByName(listed.select(F.col(key).alias("key"), F.lit(True).alias("listed")))
            .where("key is not null").groupBy("key").agg(F.max("listed").alias("listed")))


def build_cascade(keys: DataFrame, max_bits: int = MAX_BITS) -> list[Level] | None:
    """The levels for ``keys(key, listed)``; None if they exceed ``max_bits``."""
    levels: list[Level] = []
    alive, spent, inside = keys, 0, True
    while True:
        n = {r["listed"]: r["count"] for r in alive.groupBy("listed").count().collect()}
        if not n.get(inside, 0):
            return levels
        bits = max(64, BITS_PER_KEY * n[inside])
        spent += bits
        if spent > max_bits:
            return None
        level = _encode(alive.where(F.col("listed") == inside), len(levels), bits)
        levels.append(level)
        if not n.get(not inside, 0):
            return levels
        alive, inside = alive.where(_passes(F.col("key"), level)), not inside


def in_cascade(key: Column, levels: Sequence[Level]) -> Column:
    """Exact membership of a key of the universe; null is never listed."""
    found = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        found = F.when(~_passes(key, levels[i]), F.lit(i % 2 == 1)).otherwise(found)
    return F.coalesce(found & key.isNotNull(), F.lit(False))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]],
                id_col: str = "page_id", url_col: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """Verdict per page: the longest rule's, else ``block`` for listed hosts.

    ``listed(key)`` are blocked hosts.  A null url or one without ``://``
    has an empty host and path, fits no rule and is allowed.  Every input
    row gives one row; other columns of ``pages`` are not read.
    """
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    keys = key_universe(rows.select(F.col("host").alias("key")), listed)
    levels = build_cascade(keys, max_bits)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    if levels is None:
        rows = (rows.join(keys.where("listed").select(F.col("key").alias("host"), "listed"), "host", "left"))
        inside = F.coalesce(F.col("listed"), F.lit(False))
    else:
        inside = in_cascade(F.col("host"), levels)
    return rows.select("page_id", "host", "path", rule.alias("rule"),
                       F.coalesce(verdict, F.when(inside, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
