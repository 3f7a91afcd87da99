"""Ranked lexical search by TPUT over term-partitioned postings.

A posting holds what a term adds to the score of a document. First, the heads of the lists give some documents' partial
scores, the k-th of which is a bound for each query: a document of which every posting is below the bound divided by the
number of lists can't reach it. Second, every list is fetched down to that threshold; partial scores are summed where a
document's postings meet, and bounds drop what can't be among the best. Third, the scores of what is left are looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, Words, discard, scratch, settle, steps, stored, table, whole_groups

TOP = 50
#: Pairs of a query and a term that go to all tasks at once, or those of one query; more queries are answered in turns.
PAIRS = 1 << 18
#: Postings of a term that are kept together.
LIST = 1 << 20
#: Candidates that a task holds before it leaves out those that later bounds exclude.
HELD = 1 << 19


def term_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, code): the distinct terms of each query."""
    for b in it:
        for i, _, data, off in steps(b["text"]):
            w = Words(LOWER[data], off, ALNUM)
            pair = np.unique(np.stack([w.doc.astype(np.int64), w.code.view(np.int64)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([b["item"].take(pa.array(pair[:, 0] + i)), pa.array(pair[:, 1])], ["item", "code"])


def forward_batches(held):
    """(doc_id, n, terms) of the documents with terms: the number of all, and those of the queries with their numbers."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = held.value
        for b in it:
            for i, _, data, off in steps(b["text"]):
                w = Words(LOWER[data], off, ALNUM)
                code = w.code.view(np.int64)
                t = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
                hit = np.flatnonzero(codes[t] == code) if len(codes) else np.zeros(0, np.int64)
                pair, tf = np.unique(w.doc[hit].astype(np.int64) << 32 | t[hit], return_counts=True)
                rows = np.flatnonzero(w.count > 0)
                ends = np.append(np.searchsorted(pair >> 32, rows), len(pair)).astype(np.int32)
                terms = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array((pair & 0xFFFFFFFF).astype(np.int32)), pa.array(tf.astype(np.int64))], ["t", "tf"]))
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(rows + i)), pa.array(w.count[rows].astype(np.int64)), terms], ["doc_id", "n", "terms"])

    return run


class Lists:
    """Which queries want a term, with what bound and how many lists each has: arrays that all tasks get."""

    def __init__(self, item: np.ndarray, t: np.ndarray, tau: np.ndarray, m: np.ndarray, n_terms: int):
        order = np.argsort(t, kind="stable")
        self.item, self.first = item[order], np.searchsorted(t[order], np.arange(n_terms + 1))
        self.tau, self.m = tau, m


def fetch_batches(held, k: int):
    """(item, doc, part, upper) of whole documents' fetched postings, sorted by document: the sum of those that a query's
    threshold lets through, and what it may be with those that it does not.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = held.value
        least, found, n = lists.tau.copy(), [], 0
        unseen = np.maximum(lists.tau - 1, 0) // np.maximum(lists.m, 1)

        def prune() -> tuple[np.ndarray, ...]:
            item, doc, part, upper = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((-part, item))
            first = np.searchsorted(item[order], np.arange(len(least)))
            nth = first + k - 1
            full = np.flatnonzero(nth < np.append(first[1:], len(item)))
            least[full] = np.maximum(least[full], part[order[nth[full]]])
            stay = upper >= least[item]
            return item[stay], doc[stay], part[stay], upper[stay]

        for t in whole_groups(it):
            doc, term, c = t["key"].to_numpy(), t["t"].to_numpy(), t["c"].to_numpy()
            size = lists.first[term + 1] - lists.first[term]
            at = np.repeat(np.arange(len(doc)), size)
            item = lists.item[np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + lists.first[term][at]]
            own = c[at] * lists.m[item] >= lists.tau[item]
            at, item = at[own], item[own]
            if not len(at):
                continue
            order = np.lexsort((item, doc[at]))
            d, item, add = doc[at][order], item[order], c[at][order]
            start = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (item[1:] != item[:-1])))
            part, seen = np.add.reduceat(add, start), np.diff(np.append(start, len(d)))
            d, item = d[start], item[start]
            upper = part + (lists.m[item] - seen) * unseen[item]
            stay = upper >= least[item]
            found.append((item[stay], d[stay], part[stay], upper[stay]))
            n += int(stay.sum())
            if n > HELD:
                found = [prune()]
                if len(found[0][0]) > n // 2:  # nothing to gain: all of it goes on
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found[0]], ["item", "doc", "part", "upper"])
                    found = []
                n = sum(len(x[0]) for x in found)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in prune()], ["item", "doc", "part", "upper"])

    return run


def kth(rows: DataFrame, score: str, k: int) -> DataFrame:
    """(item, tau): the k-th largest score of each query that has so many."""
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc(score)))
    return rows.select("item", score, nth.alias("nth")).where(F.col("nth") <= k).where(F.col("nth") == k).select("item", F.col(score).alias("tau"))


def answered(docs: DataFrame, terms: DataFrame, k: int, folder: str) -> DataFrame:
    """(item, doc_id, score, rank) for the queries of terms (item, code), PAIRS at most."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    pairs = terms.toPandas()  # PAIRS at most
    codes = np.unique(pairs["code"].to_numpy())
    forward = stored(docs.mapInArrow(forward_batches(sc.broadcast(codes)), "doc_id long, n long, terms array<struct<t: int, tf: long>>"), f"{folder}/forward")
    n_docs, n_terms = forward.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return spark.createDataFrame([], "item long, doc_id long, score long, rank int")
    df = forward.select(F.explode("terms.t").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = settle(df.select("t", "df", weight.alias("w")).where("w > 0"))
    m = F.expr(f"50 + (50L * n * {n_docs}L) div {n_terms}L")
    # documents of equal terms have equal scores for every query: of each such group, only the k of the least ids can count
    alike = Window.partitionBy(F.xxhash64("n", "terms"), F.xxhash64(F.lit(1), "n", "terms")).orderBy(F.asc_nulls_last("doc_id"))
    lean = forward.where(F.size("terms") > 0).withColumn("nth", F.row_number().over(alike)).where(F.col("nth") <= k)
    lean = stored(lean.select(F.monotonically_increasing_id().alias("doc"), "doc_id", m.alias("m"), "terms"), f"{folder}/lean")
    discard(sc, f"{folder}/forward")
    adds = F.expr("w * ((1000000000L * tf) div (1000L * tf + 20L * m))").alias("c")
    known = F.broadcast(weights.select("t", "w", F.ceil(F.col("df") / LIST).alias("salts")))  # PAIRS rows at most
    each = lean.select("doc", "m", F.explode("terms").alias("x")).select("doc", "m", "x.t", "x.tf").join(known, "t")
    size = weights.agg(F.sum("df")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // LIST))
    postings = stored(each.select("t", "doc", adds, F.pmod("doc", F.col("salts")).alias("salt")).where("c > 0").repartition(parts, "t", "salt").drop("salt"), f"{folder}/postings")

    pairs["t"] = np.searchsorted(codes, pairs["code"].to_numpy()).astype(np.int32)
    lists = pairs.merge(weights.select("t").toPandas(), on="t")[["item", "t"]]
    table_ = settle(spark.createDataFrame(lists, "item long, t int"))
    head = postings.withColumn("nth", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("c"), "doc"))).where(F.col("nth") <= k)
    some = head.join(table_, "t").groupBy("item", "doc").agg(F.sum("c").alias("part"))
    bound = {r.item: r.tau for r in kth(some, "part", k).collect()}  # a number per query

    items = np.unique(lists["item"].to_numpy())
    at = np.searchsorted(items, lists["item"].to_numpy())
    tau, n_lists = np.array([bound.get(x, 0) for x in items.tolist()], np.int64), np.bincount(at, minlength=len(items)).astype(np.int64)
    lists = lists.assign(least=-(-tau[at] // n_lists[at]))
    floors = spark.createDataFrame(lists.groupby("t", as_index=False)["least"].min(), "t int, least long")
    fetched = postings.join(F.broadcast(floors), "t").where("c >= least").select(F.col("doc").alias("key"), "t", "c")
    held = sc.broadcast(Lists(at, lists["t"].to_numpy(), tau, n_lists, len(codes)))
    bounds = fetched.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(fetch_batches(held, k), "item long, doc long, part long, upper long")
    bounds = stored(bounds, f"{folder}/bounds")
    names = spark.createDataFrame([(i, int(x)) for i, x in enumerate(items)], "item long, name long")
    left = bounds.join(kth(bounds, "part", k), "item", "left").where("tau IS NULL OR upper >= tau").join(F.broadcast(names), "item").select(F.col("name").alias("item"), "doc")

    exact = left.join(lean, "doc").select("item", "doc", "doc_id", "m", F.explode("terms").alias("x")).select("item", "doc", "doc_id", "m", "x.t", "x.tf")
    exact = exact.join(table_, ["item", "t"]).join(known, "t").groupBy("item", "doc").agg(F.first("doc_id").alias("doc_id"), F.sum(adds).alias("score"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "doc"))
    return settle(exact.where("score > 0").select("item", "doc_id", "score", rank.alias("rank")).where(F.col("rank") <= k))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, pairs: int = PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents above 0 of each row of items.

    Null and empty texts have no terms: such documents don't count, and such items find nothing. Equal scores go by the
    smaller doc_id, a null one last; documents of one id each count by themselves. Items of one id, or without one, are
    answered each by itself. A very long text is one step of a task. Terms are compared by fingerprints of 61 bits.
    Of documents whose terms and lengths agree, only the k of the smallest ids go on, as no more can be among the best.
    Other columns of either table aren't read, so their names can't clash.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    folder = scratch(sc, "lexical")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = stored(items.select("item_id", "text", F.monotonically_increasing_id().alias("item")), f"{folder}/items")
    terms = stored(items.select("item", "text").mapInArrow(term_batches, "item long, code long"), f"{folder}/terms")
    turns = max(1, -(-terms.count() // (pairs // 2 or 1)))
    turn = F.pmod(F.xxhash64("item"), F.lit(turns))
    out = None
    for i in range(turns):
        some = answered(docs, terms.where(turn == i), k, f"{folder}/{i}")
        out = some if out is None else out.unionByName(some)
        discard(sc, f"{folder}/{i}")
    named = settle(out.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score"))
    discard(sc, folder)
    return named


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
p AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(ws)::BIGINT AS n, unnest(ws) AS t FROM d) GROUP BY doc_id, n, t),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY t, n_docs),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM i JOIN p USING (t) JOIN w USING (t), s GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 50
"""
