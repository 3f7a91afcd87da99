"""Which windows of a corpus also start in a document of a smaller id: the search both substring operators share.

The anchor of a window is the first of the least grams in it, so equal windows have equal anchors at the same place. Its
context is the text that all the windows with this occurrence as their anchor cover. Occurrences with equal contexts agree on
all their windows: all but those of the smallest id are repeats entirely. Only the first of a context needs a look at
single windows, and only where its anchor has other contexts. Every step is an aggregation that combines before the
shuffle, or a join of which one side is unique, which Spark can split where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, settle, stored

#: Stands for a null id in comparisons.
NULL_ID = -(1 << 63)
KEY = ["id", "tid"]
OCCURRENCE = "id long, tid long, code long, ctx long, lo long, n_windows int"


def keyed(docs: DataFrame) -> DataFrame:
    """docs with id (null: NULL_ID) and tid, so that rows of one id and several texts stay apart."""
    return docs.withColumns(key_as(*KEY))


def key_as(id_: str, tid: str) -> dict[str, Column]:
    """The columns of a document's key under names of the caller's."""
    return {id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), tid: F.xxhash64(F.coalesce("text", F.lit("")))}


def occurrences(docs: DataFrame, anchors, locate, extra: str, folder: str) -> DataFrame:
    """Each place where a recurring anchor occurs: OCCURRENCE and what `locate` adds (extra), stored in folder.

    anchors: batches of (id, tid, text) -> (id, tid, code). locate: batches of (id, tid, text, codes) -> OCCURRENCE, extra.
    """
    slim = docs.select("id", "tid", "text")
    found = slim.mapInArrow(anchors, "id long, tid long, code long")
    recurring = stored(contested(found.withColumnRenamed("id", "first"), "code").select("code"), f"{folder}/recurring")
    dealt = stored(found.join(recurring, "code", "left_semi").groupBy(*KEY).agg(F.collect_set("code").alias("codes")), f"{folder}/dealt")
    out = stored(slim.join(dealt, KEY).mapInArrow(locate, f"{OCCURRENCE}, {extra}"), f"{folder}/occurrences")
    discard(docs.sparkSession.sparkContext, f"{folder}/dealt")
    return out


def contested(rows: DataFrame, key: str) -> DataFrame:
    """(key, low): the keys of rows (key, first) that several first ids have, and the least of those."""
    return rows.groupBy(key).agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low < high").select(key, "low")


def firsts(occ: DataFrame, extra: str, folder: str) -> DataFrame:
    """(code, ctx, first, n_windows, extra): the first id of each context, stored in folder."""
    return stored(occ.groupBy("code", "ctx").agg(F.min("id").alias("first"), F.first("n_windows").alias("n_windows"), F.first(extra).alias(extra)), f"{folder}/firsts")


def covered(windows: DataFrame, window: int) -> DataFrame:
    """(code, ctx, runs) of repeated windows (code, ctx, at), or runs of them (code, ctx, at, end), from a context's start."""
    end = F.col("end") if "end" in windows.columns else F.col("at") + window
    return windows.groupBy("code", "ctx").agg(cover(F.collect_set(F.struct("at", end.alias("end")))).alias("runs"))


def spans(occ: DataFrame, first: DataFrame, repeats: DataFrame, window: int, folder: str) -> DataFrame:
    """(id, tid, spans), settled: the maximal runs of units that repeated windows cover. repeats: (code, ctx, runs).

    What is known of a context is stored as one row, so that one join reaches the occurrences, which Spark can split at
    a hot context. The tables in folder go.
    """
    sc = occ.sparkSession.sparkContext
    known = stored(first.select("code", "ctx", "first").join(repeats, ["code", "ctx"], "left"), f"{folder}/known")
    discard(sc, f"{folder}/firsts")
    seen = occ.select("id", "tid", "code", "ctx", "lo", "n_windows").join(known, ["code", "ctx"])
    span = lambda at, end: F.struct(at.cast("long").alias("at"), end.cast("long").alias("end"))
    whole = F.array(span(F.col("lo"), F.col("lo") + F.col("n_windows") + (window - 1)))
    some = F.transform("runs", lambda r: span(F.col("lo") + r["at"], F.col("lo") + r["end"]))
    found = seen.select("id", "tid", F.explode(F.when(F.col("id") > F.col("first"), whole).otherwise(some)).alias("s"))
    out = settle(found.groupBy(*KEY).agg(cover(F.collect_set("s")).alias("spans")))
    discard(sc, folder)
    return out


def cover(found: Column) -> Column:
    """The maximal runs of an array of (at, end) structs, in order; runs that touch are one."""
    one = lambda at, end: F.struct(at.cast("long").alias("at"), end.cast("long").alias("end"))
    empty = F.struct(F.array().cast("array<struct<at: bigint, end: bigint>>").alias("done"), F.lit(None).cast("struct<at: bigint, end: bigint>").alias("now"))

    def step(a, x):
        joined = F.struct(a["done"].alias("done"), one(a["now"]["at"], F.greatest(a["now"]["end"], x["end"])).alias("now"))
        fresh = F.struct(F.when(a["now"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))).alias("done"), one(x["at"], x["end"]).alias("now"))
        return F.when(a["now"].isNotNull() & (x["at"] <= a["now"]["end"]), joined).otherwise(fresh)

    return F.aggregate(F.array_sort(found), empty, step, lambda a: F.when(a["now"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))
