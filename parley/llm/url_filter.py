"""URL filters by rules and a Bloom filter cascade, in DataFrame functions alone.

The cascade decides membership of a key in a list without a join: level 1 holds the listed
keys; level 2 holds the other keys of the corpus that level 1 lets through; level 3 the
listed keys that level 2 lets through, and so on until a level lets nothing wrong through.
Over the complete key universe it is built on, the answer is exact.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import written

#: Bits for a key of a level, rounded up to a power of two; hashes for a key.
BITS, HASHES = 10, 5
#: Bits of one bitmap row, as Spark's bitmap functions make them.
BITMAP = 32768
#: Largest level that travels with the plan, in bytes; larger ones are looked up by a join.
LARGEST = 4 << 20


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the contract.
RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host and path; both empty for a null url or one without ``://``."""
    whole = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(whole, PARTS, 1), CAPITALS, SMALL)
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(whole, PARTS, 2))


def ruled(rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """(rule, verdict) columns of the longest rule that fits host and path; null if none does.

    Rules of one length are tried in the given order.
    """
    rule, verdict = (F.lit(None).cast("string") for _ in range(2))
    for one in sorted(rules, key=lambda r: -len(r.text))[::-1]:
        host = (F.col("host") == one.host) | F.col("host").endswith("." + one.host)
        fits = host & F.col("path").startswith(one.path)
        rule = F.when(fits, one.text).otherwise(rule)
        verdict = F.when(fits, one.verdict).otherwise(verdict)
    return rule, verdict


class Level(NamedTuple):
    """One Bloom filter: its number, its bits, and its bitmaps (bucket, bitmap)."""

    number: int
    bits: int
    bitmaps: DataFrame


def levels(keys: DataFrame, listed: DataFrame) -> list[Level]:
    """The cascade over the distinct column ``key`` of ``keys``, of which ``listed`` are to be found.

    Listed keys outside of the universe are left out; null keys are in no list.
    """
    universe = keys.filter("key is not null").select("key").distinct()
    wanted = written(universe.join(listed.select("key").distinct(), "key", "left_semi"), "listed")
    others = written(universe.join(listed.select("key"), "key", "left_anti"), "others")
    found: list[Level] = []
    while (size := wanted.count()) > 0:
        bits = max(BITMAP, 1 << (BITS * size - 1).bit_length())
        level = Level(len(found) + 1, bits, written(_bitmaps(wanted, len(found) + 1, bits), "bitmaps"))
        found.append(level)
        wanted, others = written(let_through(others, level), "through"), wanted
    return found


def _places(key: str, number: int, bits: int) -> list[Column]:
    """The bits of a key in a level."""
    return [F.pmod(F.xxhash64(F.col(key), F.lit(number), F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def _bitmaps(keys: DataFrame, number: int, bits: int) -> DataFrame:
    # Spark's bitmap functions count from 1.
    placed = keys.select(F.explode(F.array(*[place + 1 for place in _places("key", number, bits)])).alias("place"))
    return placed.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap")
    )


def _bit(bitmap: Column, place: Column) -> Column:
    """Whether a bit of a bitmap is set; bits count from the lowest of each byte."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10)
    return F.getbit(byte.cast("bigint"), (place % 8).cast("int")) == 1


def _literal(level: Level) -> Column:
    """All bitmaps of a level as one binary value, at most LARGEST bytes."""
    whole = bytearray(level.bits // 8)
    for row in level.bitmaps.collect():
        start = (row["bucket"] - 1) * BITMAP // 8
        whole[start : start + BITMAP // 8] = row["bitmap"]
    return F.lit(whole)


def let_through(keys: DataFrame, level: Level) -> DataFrame:
    """The keys that a level takes for its own."""
    if level.bits // 8 <= LARGEST:
        return keys.filter(_in_literal(level, "key"))
    # A level beyond the bound stays a table, and each of a key's bits is looked up in it.
    place = F.explode(F.array(*_places("key", level.number, level.bits))).alias("place")
    probes = keys.select("key", place).withColumn("bucket", F.shiftright("place", 15) + 1)
    hit = _bit(F.col("bitmap"), F.col("place") % BITMAP)
    met = probes.join(level.bitmaps, "bucket").filter(hit)
    return met.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") == HASHES).select("key")


def _in_literal(level: Level, key: str) -> Column:
    bitmap = _literal(level)
    hit = F.lit(True)
    for place in _places(key, level.number, level.bits):
        hit = hit & _bit(bitmap, place)
    return hit


def members(rows: DataFrame, key: str, cascade: list[Level]) -> DataFrame:
    """``rows`` with the boolean ``member``: whether their key is listed. Null keys are not."""
    if all(level.bits // 8 <= LARGEST for level in cascade):
        # Passing an odd number of levels and failing the next one is membership.
        answer = F.lit(len(cascade) % 2 == 1)
        for level in reversed(cascade):
            answer = F.when(_in_literal(level, key), answer).otherwise(F.lit(level.number % 2 == 0))
        return rows.withColumn("member", F.coalesce(answer & F.col(key).isNotNull(), F.lit(False)))
    left = rows.select(F.col(key).alias("key")).filter("key is not null").distinct()
    inside = left.limit(0)
    for level in cascade:
        through = written(let_through(left, level), "through")
        if level.number % 2 == 0:
            inside = inside.union(left.join(through, "key", "left_anti"))
        left = through
    inside = (inside.union(left) if len(cascade) % 2 else inside).select(F.col("key").alias("__key"), F.lit(True).alias("member"))
    joined = rows.join(inside, rows[key] == inside["__key"], "left").drop("__key")
    return joined.withColumn("member", F.coalesce("member", F.lit(False)))


def judged(pages: DataFrame, listed: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed), one row per row of ``pages`` (page_id, url).

    ``listed`` has blocked hosts in the column ``key``. A rule's verdict goes before the list's.
    Pages without a host are allowed unless the empty host is listed.
    """
    parts = with_parts(pages.select("page_id", "url"))
    cascade = levels(parts.select(F.col("host").alias("key")), listed)
    rule, verdict = ruled(rules)
    own = F.when(F.col("member"), "block").otherwise("allow")
    return members(parts, "host", cascade).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("member").alias("listed")
    )
