"""URL filters: Bloom filter cascades that answer exactly for every key of the corpus, without joins.

Level 1 encodes the listed keys. Over the corpus's complete set of keys it lets some unlisted ones
through; level 2 encodes those, level 3 the listed keys that level 2 lets through, and so on until
a level lets nothing wrong through. A key is listed if the first level that it fails is even.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import let
from .common import scope, scratch, table
from .wordhash import mix

_U = np.uint64


class Level:
    """One Bloom filter: bits in 64-bit words, and the number of hashes."""

    def __init__(self, number: int, keys: int, rate: float) -> None:
        self.number = number
        self.bits = max(64, math.ceil(-keys * math.log(rate) / math.log(2) ** 2 / 64) * 64)
        self.hashes = max(1, round(-math.log2(rate)))
        self.words = np.zeros(self.bits // 64, _U)

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The bits of each key, one row per hash; other ones at each level."""
        a, b = mix(h1 + _U(self.number * 0x9E3779B97F4A7C15 % 2**64)), mix(h2 ^ _U(self.number)) | _U(1)
        return np.stack([(a + _U(i) * b) % _U(self.bits) for i in range(self.hashes)])

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for p in self.places(h1, h2):
            out &= (self.words[p >> _U(6)] >> (p & _U(63))) & _U(1) == 1
        return out


def listed(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is listed, by the first level that it fails."""
    out = np.zeros(len(h1), bool)
    left = np.arange(len(h1))
    for k, level in enumerate(levels):
        passed = level.has(h1[left], h2[left])
        out[left[~passed]] = k % 2 == 1
        left = left[passed]
    out[left] = len(levels) % 2 == 1
    return out


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit("second")).alias("h2")]


class Cascade:
    """``shards`` cascades, a key belonging to one by its hash."""

    def __init__(self, shards: list[list[Level]]) -> None:
        self.shards = shards

    def has(self, h1: np.ndarray, h2: np.ndarray, only: range | None = None) -> np.ndarray:
        out, shard = np.zeros(len(h1), bool), (mix(h1 ^ h2) % _U(len(self.shards))).astype(np.int64)
        for k in only if only is not None else range(len(self.shards)):
            at = np.flatnonzero(shard == k)
            if len(at):
                out[at] = listed(self.shards[k], h1[at], h2[at])
        return out

    def passes(self, most: int) -> list[range]:
        """Runs of shards whose bits take ``most`` bytes at most together, one shard at least."""
        out, at, size = [], 0, 0
        for k, levels in enumerate(self.shards):
            own = sum(x.words.nbytes for x in levels)
            if size and size + own > most:
                out.append(range(at, k))
                at, size = k, 0
            size += own
        return [*out, range(at, len(self.shards))]


def _set_bits(keys: DataFrame, levels: list[Level], shards: int) -> None:
    """Fill one level of each shard with the bits of ``keys`` (shard, h1, h2).

    The bits are joined by OR per 64-bit word on the executors; what reaches the driver is no more
    than the filters themselves, whose size goes with the listed keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, h1, h2 = (np.asarray(c) for c in b.columns)
            for k in np.unique(shard):
                at = shard == k
                p = np.unique(levels[k].places(h1[at].view(_U), h2[at].view(_U)))
                word, first = np.unique(p >> _U(6), return_index=True)
                value = np.bitwise_or.reduceat(_U(1) << (p & _U(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), k, np.int32)), pa.array(word.view(np.int64)), pa.array(value.view(np.int64))], names=["shard", "word", "bits"])

    rows = keys.select("shard", "h1", "h2").mapInArrow(run, "shard int, word long, bits long").groupBy("shard", "word").agg(F.bit_or("bits").alias("bits"))
    t = rows.toArrow()
    shard, word, bits = (np.asarray(t.column(c)) for c in ("shard", "word", "bits"))
    for k in range(shards):
        levels[k].words[word[shard == k]] = bits[shard == k].view(_U)


def build(universe: DataFrame, keys: DataFrame, shard_keys: int = 1_000_000, most_levels: int = 40) -> Cascade:
    """The cascade for column ``key`` of ``keys`` over column ``key`` of ``universe``.

    One shuffle makes the keys distinct and marks the listed ones, with partial aggregation before
    it. Level 1's rate is such that about as many unlisted keys come through as keys are listed; all
    further levels let half through, so the bits go with the listed keys, not with the corpus.
    """
    marked = universe.select("key", F.lit(0).alias("l")).unionByName(keys.select("key", F.lit(1).alias("l")))
    marked = marked.where("key is not null").groupBy("key").agg(F.max("l").alias("l")).select(*_hashes(F.col("key")), "l")
    marked = scratch(marked)
    n, total = marked.agg(F.sum("l"), F.count("*")).first()
    n = n or 0
    shards = max(1, -(-n // shard_keys))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2, flag = (np.asarray(c) for c in b.columns)
            s = (mix(h1.view(_U) ^ h2.view(_U)) % _U(shards)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(s), b.column(0), b.column(1), pa.array(flag)], names=["shard", "h1", "h2", "l"])

    schema = "shard int, h1 long, h2 long, l int"
    left = marked.mapInArrow(place, schema)
    inside, outside = left.where("l = 1"), left.where("l = 0")
    cascade: list[list[Level]] = [[] for _ in range(shards)]
    count = {r.shard: r["count"] for r in inside.groupBy("shard").count().collect()}
    rate = min(0.5, max(1e-9, n / max(1, total - n) * 0.7))
    for number in range(most_levels):
        level = [Level(number, max(1, count.get(k, 0)), rate if number == 0 else 0.5) for k in range(shards)]
        _set_bits(inside, level, shards)
        for k in range(shards):
            cascade[k].append(level[k])

        def through(batches: Iterator[pa.RecordBatch], level: list[Level] = level) -> Iterator[pa.RecordBatch]:
            for b in batches:
                s, h1, h2 = (np.asarray(c) for c in b.columns[:3])
                ok = np.zeros(len(s), bool)
                for k in np.unique(s):
                    at = np.flatnonzero(s == k)
                    ok[at] = level[k].has(h1[at].view(_U), h2[at].view(_U))
                yield b.filter(pa.array(ok))

        # What was encoded is next tried against what comes through of the other side.
        inside, outside = scratch(outside.mapInArrow(through, schema)), inside
        count = {r.shard: r["count"] for r in inside.groupBy("shard").count().collect()}
        if not count:
            return Cascade(cascade)
    raise ValueError(f"two different keys have the same 128-bit hash, or {most_levels} levels don't do")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty where there is no "://"."""
    rest = F.substring_index(url, "://", 1)
    has = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    rest = F.when(has, url.substr(F.length(rest) + 4, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest.substr(F.length(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    return host, path


def keys_of(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The host's last labels with the path's beginning, for each (number of labels, path length) of
    ``shapes`` that the url is long enough for; longest first, of equally long ones the longer host.

    A key takes time in proportion to its length, whatever the host's number of labels.
    """
    known = F.from_json(F.lit(json.dumps([{"l": k, "n": n} for k, n in shapes])), "array<struct<l:int,n:int>>")

    def key(s: Column) -> Column:
        return let(F.call_function("substring_index", host, F.lit("."), -s["l"]), lambda h: F.struct((-F.length(h) - s["n"]).alias("n"), (-F.length(h)).alias("m"), F.concat(h, F.left(path, s["n"])).alias("key")))

    def keys(size: Column) -> Column:
        fit = F.filter(known, lambda s: (s["l"] <= size["l"]) & (s["n"] <= size["n"]))
        return F.transform(F.array_sort(F.transform(fit, key)), lambda k: k["key"])

    size = F.struct(F.size(F.split(host, r"\.")).alias("l"), F.length(path).alias("n"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(let(size, keys))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow", most_bytes: int = 64 << 20) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule and verdict.

    ``rules``: (verdict, host, path) rows, verdict block or allow. A rule fits its host and all
    subdomains if the path starts with the rule's; the longest wins, then the one with the longer
    host. A page that no rule fits gets ``default``, as the cascades say that none of its keys is
    listed. If one rule has both verdicts, block holds.

    Two cascades, of blocked and of allowed keys, are built over all keys of the pages; judging
    reads them from broadcasts of at most ``most_bytes`` (a shard of a million keys takes less),
    one pass over the pages for each such part, so lists of any length are exact and nothing is
    joined. A url's keys are those of the shapes (labels of the host, length of the path) that the
    rules have; the shapes reach the driver, of which there are as many as rules differ in them.
    Defined cases: a null url or one without "://" has an empty host and path, no rule and
    ``default``; rules with a null host or path fit nothing; an empty table gives no rows; repeated
    rows are judged alike; only page_id and url are read, so further columns may have any name.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "verdict string, host string, path string")
    shape = rules.where("host is not null and path is not null").select(F.size(F.split("host", r"\.")).alias("l"), F.length("path").alias("n"))
    shapes = sorted((r.l, r.n) for r in shape.distinct().collect())
    host, path = parts(F.col("url"))
    p = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("keys", keys_of(F.col("host"), F.col("path"), shapes))
    universe = p.select(F.explode("keys").alias("key"))
    keyed = rules.select("verdict", F.concat("host", "path").alias("key"))
    p = p.withColumn("h1", F.transform("keys", lambda k: F.xxhash64(k))).withColumn("h2", F.transform("keys", lambda k: F.xxhash64(k, F.lit("second"))))
    for verdict in ("allow", "block"):
        with scope():
            cascade = build(universe, keyed.where(F.col("verdict") == verdict))
        p = p.withColumn(verdict, F.lit(0))
        for only in cascade.passes(most_bytes):
            p = _mark(p, verdict, Cascade([x if k in only else [] for k, x in enumerate(cascade.shards)]), only)
    first = lambda c: F.when(F.col(c) > 0, F.element_at("keys", F.when(F.col(c) > 0, F.col(c)).otherwise(1)))
    blocks = (F.col("block") > 0) & ((F.col("allow") == 0) | (F.col("block") <= F.col("allow")))
    rule = F.when(blocks, first("block")).otherwise(first("allow"))
    verdict = F.when(blocks, F.lit("block")).when(F.col("allow") > 0, F.lit("allow")).otherwise(F.lit(default))
    return p.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def _mark(p: DataFrame, column: str, cascade: Cascade, only: range) -> DataFrame:
    """Set ``column`` to the place (from 1) of the first listed key, where that is earlier than known."""
    at = p.columns.index(column)
    i1, i2 = p.columns.index("h1"), p.columns.index("h2")
    held = p.sparkSession.sparkContext.broadcast(cascade)
    schema = p.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col, known = b.column(i1), np.asarray(b.column(at)).copy()
            n = np.asarray(pc.list_value_length(col)).astype(np.int64)
            hit = held.value.has(np.asarray(col.flatten()).view(_U), np.asarray(b.column(i2).flatten()).view(_U), only)
            row = np.repeat(np.arange(len(n)), n)[hit]
            place = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))[hit] + 1
            best = np.full(len(n), np.iinfo(np.int32).max, np.int64)
            np.minimum.at(best, row, place)
            found = best < np.iinfo(np.int32).max
            known[found] = np.where(known[found] > 0, np.minimum(known[found], best[found]), best[found])
            yield pa.RecordBatch.from_arrays([pa.array(known.astype(np.int32)) if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)

    return p.mapInArrow(run, schema)


#: The rules of the query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


ORACLE_SQL = r"""
with p as (
  select page_id,
         case when url like '%://%' then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages
), q as (
  select page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
  from p
)
select page_id, host, path,
  case
    when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
    when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
    when (host = 'net' or host like '%.net') and path like '/%' then 'net/'
  end as rule,
  case
    when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'allow'
    when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'block'
    when (host = 'org' or host like '%.org') and path like '/fr/%' then 'allow'
    when (host = 'net' or host like '%.net') and path like '/%' then 'block'
    else 'allow'
  end as verdict
from q
"""
