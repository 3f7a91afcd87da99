"""URL filters: exact membership by a cascade of Bloom filters.

Level 0 encodes the listed keys; every key of the corpus that it passes wrongly is encoded by level 1, the listed
keys that level 1 passes by level 2, and so on until nothing is passed wrongly. Over the key universe that built it,
the cascade answers exactly, with no join against the list. Hashes are Spark's xxhash64; bits are tested in NumPy. The
cascades of several lists are built in one scan of the universe.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

#: The bits of all levels together; a list that needs more is refused, as its filters are sent to every task.
MAX_BITS = 1 << 29
#: Keys of a list, which come to the driver as two hashes each; a longer list of hosts is joined instead. False positives of a list's first
#: level that come with it, at most (or as many as the list has).
MAX_KEYS, MAX_WRONG = 1 << 24, 100_000


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return f"{self.host}{self.path}"


#: `path` starts with the slash that ends the host.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))
#: Hosts that are blocked where no rule fits, if the caller brings no table of them.
LISTED_HOSTS = ("spam-farm.example.org", "cheap-pills.example.net", "cheap-pills.example.org", "spam-farm.example.net")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or where :// is missing."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


class Cascade:
    """Bloom filters by level, for keys given as two 64-bit hashes."""

    def __init__(self, bits: list[np.ndarray], rounds: list[int]):
        self.bits, self.rounds = bits, rounds

    @staticmethod
    def places(level: int, h1: np.ndarray, h2: np.ndarray, m: int, k: int):
        a, b = h1.view(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)), h2.view(np.uint64) | np.uint64(1)
        for i in range(k):
            x = a + b * np.uint64(i)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield (x ^ (x >> np.uint64(32))) % np.uint64(m)

    def passes(self, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        bits, out = self.bits[level], np.ones(len(h1), bool)
        for p in self.places(level, h1, h2, len(bits) * 8, self.rounds[level]):
            out &= (bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out

    def add(self, h1: np.ndarray, h2: np.ndarray, rate: float) -> None:
        n = max(1, len(h1))
        m = 8 * math.ceil(max(64, -n * math.log(rate) / math.log(2) ** 2) / 8)
        if m + sum(8 * len(b) for b in self.bits) > MAX_BITS:
            raise ValueError(f"{n} keys need more filter bits than {MAX_BITS}: shard the list by host")
        k, bits = max(1, round(-math.log2(rate))), np.zeros(m // 8, np.uint8)
        for p in self.places(len(self.bits), h1, h2, m, k):
            np.bitwise_or.at(bits, (p >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))
        self.bits.append(bits)
        self.rounds.append(k)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """True where the first level that rejects a key is an odd one, or where all of an odd number pass it."""
        out, open_ = np.zeros(len(h1), bool), np.ones(len(h1), bool)
        for level in range(len(self.bits)):
            passed = self.passes(level, h1, h2)
            out[open_ & ~passed] = level % 2 == 1
            open_ &= passed
        out[open_] = len(self.bits) % 2 == 1
        return out

    def test_each(self, spark: SparkSession):
        """The same for arrays of hashes: an array of booleans."""
        held = spark.sparkContext.broadcast(self)

        @F.pandas_udf("array<boolean>")
        def within(h1: pd.Series, h2: pd.Series) -> pd.Series:
            size = h1.map(len).to_numpy()
            if not size.sum():
                return pd.Series([[]] * len(h1))
            flat = held.value.holds(*(np.concatenate([np.asarray(x, np.int64) for x in h]) for h in (h1, h2)))
            return pd.Series(np.split(flat, np.cumsum(size)[:-1]))

        return within


def name(k) -> Column:
    """The name of a key: a host and a path, which no host can hold together as it has no space."""
    k = F.col(k) if isinstance(k, str) else k
    return F.concat(k["host"], F.lit(" "), k["path"])


def hashes(key) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(7), key)


def hashed(keys: DataFrame) -> DataFrame:
    """(a, b): the hashes of a DataFrame's first column, nulls left out."""
    col = F.col(keys.columns[0])
    return keys.where(col.isNotNull()).select(*[h.alias(x) for h, x in zip(hashes(col), "ab", strict=True)])


def build(keys: DataFrame, lists: dict[str, DataFrame], rate: float = 0.01) -> dict[str, Cascade]:
    """The cascades of `lists` (of one string column each) over the universe `keys` (one string column, any repeats).

    One scan of the universe finds what the first levels of all lists pass wrongly, of which rate times the universe is
    expected; where that is more than MAX_WRONG and more than the list, its rate is lowered and the scan repeated for
    it. Only the lists and their false positives reach the driver. Lists over MAX_KEYS or MAX_BITS are refused.
    """
    universe, listed = hashed(keys), {}
    for k, v in lists.items():
        got = hashed(v).distinct().limit(MAX_KEYS + 1).toArrow()
        if got.num_rows > MAX_KEYS:
            raise ValueError(f"list {k} has more than {MAX_KEYS} keys: shard it by host")
        listed[k] = got["a"].to_numpy(), got["b"].to_numpy()
    rates = dict.fromkeys(lists, rate)
    out: dict[str, Cascade] = {}
    while todo := [k for k in lists if k not in out]:
        first = {k: Cascade([], []) for k in todo}
        for k in todo:
            first[k].add(*listed[k], rates[k])
        held = keys.sparkSession.sparkContext.broadcast(first)  # MAX_BITS a list at most

        def passing(it: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in it:
                a, b_ = b["a"].to_numpy(), b["b"].to_numpy()
                for k, c in held.value.items():
                    hit = np.flatnonzero(c.passes(0, a, b_))
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(hit), pa.string()), pa.array(a[hit]), pa.array(b_[hit])], ["list", "a", "b"])

        wrong = settle(universe.mapInArrow(passing, "list string, a long, b long").distinct())
        counts = {r["list"]: r["count"] for r in wrong.groupBy("list").count().collect()}
        for k in todo:
            n = len(listed[k][0])
            if counts.get(k, 0) > max(MAX_WRONG, n) + n:
                rates[k] /= 100
                continue
            got = wrong.where(F.col("list") == k).select("a", "b").toArrow()
            out[k] = filled(first[k], listed[k], (got["a"].to_numpy(), got["b"].to_numpy()))
    return out


def filled(cascade: Cascade, listed: tuple[np.ndarray, np.ndarray], passed: tuple[np.ndarray, np.ndarray]) -> Cascade:
    """The cascade with the levels above the first, of which the keys that pass it are given."""
    whole = lambda h: np.ascontiguousarray(np.column_stack(h)).view("V16").ravel()
    fresh = ~np.isin(whole(passed), whole(listed)) if len(passed[0]) and len(listed[0]) else np.ones(len(passed[0]), bool)
    sets = [listed, tuple(h[fresh] for h in passed)] if len(listed[0]) else [listed, (passed[0][:0],) * 2]
    while len(sets[len(cascade.bits) % 2][0]):
        level = len(cascade.bits)
        cascade.add(*sets[level % 2], 0.3)
        a, b = sets[(level + 1) % 2]
        still = cascade.passes(level, a, b)
        sets[(level + 1) % 2] = (a[still], b[still])
    return cascade


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, listed: DataFrame | tuple[str, ...] = LISTED_HOSTS) -> DataFrame:
    """page_id, url, host, path, rule and verdict of every page. listed: blocked hosts, as a tuple or a DataFrame's first column.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest key wins (of equal
    lengths, the longer host). Candidate keys are the suffixes of the host at a dot, of as many labels as a key has at
    most (so that a very long url makes few), with the path's prefixes of the lengths that rules have. Without a rule, a
    page is blocked where its host or a parent domain is listed, else allowed. Null or odd urls have an empty host and
    path and are allowed; repeated rows and rows without an id are judged alike. Other columns of pages don't come out,
    so their names can't clash.
    """
    spark = pages.sparkSession
    if not isinstance(listed, DataFrame):
        listed = spark.createDataFrame([(h,) for h in listed], "host string")
    listed = listed.select(F.col(listed.columns[0]).alias("host")).where("host IS NOT NULL")
    depth = max([listed.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 1, *(r.host.count(".") + 1 for r in rules)])
    host, path = host_path(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    sizes = sorted({len(r.path) for r in rules} | {0})
    labels = F.split("host", r"\.", -1)
    tails = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - (depth - 1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tails = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(tails)
    keys = F.flatten(F.transform(tails, lambda h: F.filter(F.array(*[F.when(F.char_length("path") >= n, F.struct(h.alias("host"), F.substring("path", 1, n).alias("path"))) for n in sizes]), lambda x: x.isNotNull())))
    split = split.withColumn("keys", keys)
    universe = split.select(F.explode("keys").alias("k")).select(name("k").alias("key"))
    lists = {a: spark.createDataFrame([(f"{r.host} {r.path}",) for r in rules if r.action == a], "key string") for a in ("allow", "block")}
    joined = listed.limit(MAX_KEYS + 1).count() > MAX_KEYS
    if joined:
        split = named_hosts(split, tails, listed)
    else:
        lists["listed"] = listed.select(F.concat("host", F.lit(" ")).alias("key"))
    tests = {k: c.test_each(spark) for k, c in build(universe, lists).items()}
    pair = [F.transform("keys", lambda k: hashes(name(k))[0]), F.transform("keys", lambda k: hashes(name(k))[1])]
    split = split.withColumns({"a": pair[0], "b": pair[1]}).withColumns({x: t("a", "b") for x, t in tests.items()})
    ruled = F.filter(F.arrays_zip("keys", "allow", "block"), lambda z: z["allow"] | z["block"])
    rank = F.transform(ruled, lambda z: F.struct((F.char_length(z["keys"]["host"]) + F.char_length(z["keys"]["path"])).alias("size"), F.char_length(z["keys"]["host"]).alias("hsize"), F.concat(z["keys"]["host"], z["keys"]["path"]).alias("rule"), z["block"].alias("block")))
    best = F.array_max(rank)
    block = F.coalesce(best["block"], F.exists("listed", lambda x: x))
    return split.select("page_id", "url", "host", "path", best["rule"].alias("rule"), F.when(block, "block").otherwise("allow").alias("verdict"))


def named_hosts(split: DataFrame, tails: Column, listed: DataFrame) -> DataFrame:
    """split with listed: whether a host or a parent domain of it is listed, by joins of distinct hosts, for lists of any size."""
    hosts = split.select("host", tails.alias("tails")).distinct().select("host", F.explode("tails").alias("tail"))
    found = hosts.join(listed.select(F.col("host").alias("tail")).distinct(), "tail", "left_semi").select("host").distinct()
    return split.join(found.withColumn("found", F.lit(True)), "host", "left").withColumn("listed", F.array(F.coalesce("found", F.lit(False)))).drop("found")


def tracked_hosts(pages: DataFrame, least: int = 4, share: float = 0.4) -> DataFrame:
    """(host): the hosts of `least` pages or more of whose urls at least `share` have a query string, as trackers' do."""
    host, _ = host_path(F.col("url"))
    asked = (F.instr("url", "?") > 0).cast("long")
    by = pages.select(host.alias("host"), asked.alias("asked")).where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.sum("asked").alias("asked"))
    return by.where((F.col("n") >= least) & (F.col("asked") >= share * F.col("n"))).select("host")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge all pages by the fixed rules, and those that no rule fits by the hosts that pages themselves show to be trackers."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, listed=settle(tracked_hosts(pages))).drop("url")


SQL = r"""
WITH s AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM s),
q AS (SELECT CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS h, url LIKE '%?%' AS asked FROM pages),
listed AS (SELECT h FROM q WHERE h <> '' GROUP BY h HAVING count(*) >= 4 AND sum(asked::INT) >= 0.4 * count(*)),
r AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN EXISTS (SELECT 1 FROM listed WHERE r.host = listed.h OR ends_with(r.host, '.' || listed.h)) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
