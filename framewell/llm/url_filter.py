"""URL filters: host and path rules, and a Bloom filter cascade for the hosts that no rule fits.

The cascade answers membership in a list of keys exactly for every key of a known universe, here all
hosts of the table, without joining keys: level 1 is a Bloom filter of the listed keys, level 2 one of the
universe's false positives of level 1, level 3 one of the listed keys that level 2 would take back, and
so on until a level makes no mistake. The first level that doesn't hold a key decides: listed at even
levels, not listed at odd ones. Sizes follow from the counts of listed and other keys: about
1.44 log2(1.4 others / listed) + 4 bits a listed key in all.

The levels are a table of shards by hash of the key, some SHARD bytes each, at any size: built by aggregation
alone, nothing of it passes the driver, and a row of pages meets the one shard of its host. The table is
broadcast while it is small, which its size decides; beyond, shards and pages are dealt by shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.llm.common import free_name, table, written

#: Bytes of a shard, about.
SHARD = 64 << 10
#: Bytes of all shards that are broadcast.
BROADCAST = 128 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path): the rule fits its host and all subdomains where the path starts with its path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Names whose hosts are listed, for the query: a host with one of them as a label before its last.
LISTED = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Empty where url is null or has no `://`."""
    rest = F.coalesce(F.try_element_at(F.split(url, "://", 2), F.lit(2)), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def under(host: Column, domain: str) -> Column:
    return (host == domain) | F.endswith(host, F.lit("." + domain))


class Cascade:
    """table: (shard, n0, l0, n1, l1, ...): each level's number of bits and its bits in words of 64, null where a shard has no such level. hashes: of each level."""

    def __init__(self, table: DataFrame, shards: int, hashes: list[int], size: int) -> None:
        self.table, self.shards, self.hashes, self.size = table, shards, hashes, size

    def contains(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """rows plus the boolean `name`: whether the key is listed, for keys of the universe; null keys are not."""
        of: dict[str, str] = {}  # the table's columns, by names that rows don't have
        for c in self.table.columns:
            of[c] = free_name([*rows.columns, *of.values()], c)
        levels, shard = self.table.withColumnsRenamed(of), of["shard"]
        joined = rows.withColumn(shard, shard_of(F.col(key), self.shards)).join(F.broadcast(levels) if self.size <= BROADCAST else levels, shard, "left")
        return joined.select(*rows.columns, F.coalesce(self.verdict(F.col(key), of), F.lit(False)).alias(name))

    def verdict(self, key: Column, of: dict[str, str]) -> Column:
        """of: the names of the table's columns."""
        listed = F.lit(len(self.hashes) % 2 == 1)
        for i in reversed(range(len(self.hashes))):
            inside = F.lit(True)
            for at in _positions(key, i, F.col(of[f"n{i}"]), self.hashes[i]):
                inside &= F.getbit(F.get(of[f"l{i}"], F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1
            # where a shard has no such level, the one before decided
            listed = F.when(F.coalesce(inside, F.lit(False)), listed).otherwise(F.lit(i % 2 == 1))
        return listed


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(shards)).cast("int")


def _positions(key: Column, level: int, bits: Column, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), bits) for i in range(hashes)]


def _level(keys: DataFrame, level: int, p: float, hashes: int) -> DataFrame:
    """(shard, n, l) of keys (shard, key)."""
    sizes = keys.groupBy("shard").agg(F.count("*").alias("keys")).select("shard", F.greatest(F.lit(64), F.ceil(F.col("keys") * (1.4427 * -math.log2(p)))).alias("n"))
    at = keys.join(sizes, "shard").select("shard", F.explode(F.array(*_positions(F.col("key"), level, F.col("n"), hashes))).alias("at"))
    set_ = at.select("shard", F.floor(F.col("at") / 64).alias("word"), F.expr("shiftleft(1L, cast(pmod(at, 64) as int))").alias("bits"))
    empty = sizes.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 64))).alias("word"), F.lit(0).cast("long").alias("bits"))
    words = set_.unionByName(empty).groupBy("shard", "word").agg(F.bit_or("bits").alias("bits"))
    # a shard's words, some SHARD bytes
    arrays = words.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("l"))
    return arrays.join(sizes, "shard").select("shard", F.col("n").alias(f"n{level}"), F.transform("l", lambda x: x["bits"]).alias(f"l{level}"))


def cascade(universe: DataFrame, shard_bytes: int = SHARD) -> Cascade:
    """universe: distinct (key, listed)."""
    universe = written(universe, "universe")
    listed, others = (x or 0 for x in universe.agg(F.count_if(F.col("listed")), F.count_if(~F.col("listed"))).first())
    p = min(0.5, listed * math.sqrt(0.5) / max(1, others)) if listed else 0.5
    size = math.ceil(listed * (1.4427 * -math.log2(p) + 5) / 8)
    shards = max(1, -(-size // shard_bytes))
    universe = universe.withColumn("shard", shard_of(F.col("key"), shards))
    found = Cascade(universe.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")), shards, [], size)
    wrong = universe.where("listed")
    while wrong.head(1):
        level = len(found.hashes)
        hashes = max(1, round(-math.log2(p))) if not level else 1
        table_ = found.table.join(_level(wrong.select("shard", "key"), level, p if not level else 0.5, hashes), "shard", "left")
        found = Cascade(written(table_, "cascade"), shards, [*found.hashes, hashes], size)
        # what the levels so far say is wrong for one side only: others after even levels, listed keys after odd ones
        side = universe.where("not listed" if level % 2 == 0 else "listed")
        wrong = found.contains(side, "key", "said").where("said <> listed")
    return found


def url_filter(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES, shard_bytes: int = SHARD) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages(page_id, url, ...).

    rule is the longest rule that fits (of equally long ones the first), as host and path, else null;
    verdict is the rule's, else block where the host is in listed(host), else allow. A null url or one
    without `://` has an empty host and path, which no list holds. Rows with any null, repeated rows and
    extra columns are no special case: each row of pages gives one. An empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        # the longest is tested first
        fits = under(F.col("host"), domain) & F.startswith(F.col("path"), F.lit(start))
        rule, verdict = F.when(fits, domain + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    parsed = parsed.select("*", rule.alias("rule"), verdict.alias("ruled"))
    keys = parsed.where("host <> ''").select(F.col("host").alias("key")).distinct()
    marks = listed.select(F.col("host").alias("key"), F.lit(True).alias("listed")).where("key is not null").distinct()
    found = cascade(keys.join(marks, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")), shard_bytes)
    parsed = found.contains(parsed, "host", "in_list")
    blocked = (F.col("host") != "") & F.col("in_list")
    return parsed.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(blocked, "block").otherwise("allow")).alias("verdict"))


def listed_hosts(pages: DataFrame, names: list[str] = LISTED) -> DataFrame:
    """The hosts of the table that have one of the names as a label before the last."""
    host = host_and_path(F.col("url"))[0]
    return pages.select(host.alias("host")).where(F.rlike("host", F.lit(rf"(^|\.)({'|'.join(names)})\."))).distinct()


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter(pages, listed_hosts(pages))


def _sql() -> str:
    def fits(domain: str, path: str) -> str:
        return f"(host = '{domain}' or host like '%.{domain}') and starts_with(path, '{path}')"

    by_length = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"when {fits(d, p)} then '{d}{p}'" for _, d, p in by_length)
    verdict = " ".join(f"when {fits(d, p)} then '{v}'" for v, d, p in by_length)
    listed = rf"regexp_matches(host, '(^|\.)({'|'.join(LISTED)})\.')"
    return rf"""
with r as (select page_id, case when url like '%://%' then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r
)
select page_id, host, path, case {rule} end as rule, case {verdict} when {listed} then 'block' else 'allow' end as verdict from p
"""


SQL = _sql()
