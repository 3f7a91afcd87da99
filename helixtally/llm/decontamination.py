"""Benchmark decontamination by winnowing.

Fingerprints are k-grams that are the least of a sliding window of w, with k + w - 1 words in an item's window; so a
document that shares a whole window with an item shares a fingerprint inside it. Documents are scanned once against a
Bloom filter of the benchmark's fingerprints (built at a bounded size, it can only let too much through); around a hit
the scan extends to the windows that hold it, and their fingerprints are joined with the benchmark's windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, U64, Words, selected, settle, steps, table

WINDOW, GRAM = 10, 5
#: Bits of the filter that tasks get: 16 a fingerprint, and this many at most.
MAX_BITS = 1 << 28
#: Bytes of the filter that one row holds while it is made.
SEGMENT = 1 << 13

HITS = "doc_id long, n_words long, hits array<struct<at: int, size: int, code: long>>"


def scan(col: pa.Array) -> Iterator[tuple[int, int, Words]]:
    for i, j, data, off in steps(col):
        yield i, j, Words(LOWER[data], off, ALNUM)


def windows(w: Words, window: int, gram: int):
    """(row, start, size, code, sampled grams) of each item's windows; an item shorter than a window is one."""
    ends = w.first[w.doc + 1]
    at = np.arange(len(w.start))
    whole = np.flatnonzero(at + window <= ends)
    short = np.flatnonzero((w.count > 0) & (w.count < window))
    return np.concatenate([w.doc[whole], short]), np.concatenate([w.grams(whole, whole + window), w.grams(w.first[short], w.first[short] + w.count[short])]), np.concatenate([np.full(len(whole), window), w.count[short]])


def benchmark_batches(window: int):
    def run(it):
        for b in it:
            for i, _, w in scan(b["text"]):
                row, code, size = windows(w, window, GRAM)
                ids = b["item_id"].slice(i).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(code.view(np.int64)), pa.array(size.astype(np.int32)), pa.array(np.zeros(len(row), bool))], ["item_id", "code", "size", "print"])
                ends = w.first[w.doc + 1]
                g = np.arange(max(0, len(w.start) - GRAM + 1))
                gram = w.grams(g, g + GRAM)
                s = selected(gram, ends, GRAM, window - GRAM + 1)
                yield pa.RecordBatch.from_arrays([b["item_id"].slice(i).take(pa.array(w.doc[s])), pa.array(gram[s].view(np.int64)), pa.array(np.full(len(s), GRAM, np.int32)), pa.array(np.ones(len(s), bool))], ["item_id", "code", "size", "print"])

    return run


class Filter:
    """A Bloom filter of 64-bit fingerprints with two bits each."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.m = U64(len(bits) * 8)

    @staticmethod
    def places(code: np.ndarray, m):
        return code % m, (code >> U64(17) ^ code * U64(0x9FB21C651E98DF25)) % m

    def __call__(self, code: np.ndarray) -> np.ndarray:
        out = np.ones(len(code), bool)
        for p in self.places(code, self.m):
            out &= (self.bits[(p >> U64(3)).astype(np.int64)] >> (p & U64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def filter_of(prints: DataFrame) -> Filter:
    """The filter of a settled column of fingerprints.

    Its bits are dealt out by segments of SEGMENT bytes, of which each task makes whole ones; only those come to the
    driver, MAX_BITS / 8 bytes at most.
    """
    n = max(1, prints.count())
    size = int(min(MAX_BITS, 1 << max(10, (16 * n - 1).bit_length()))) // 8

    def places(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at = np.unique(np.concatenate(list(Filter.places(b["code"].to_numpy().view(U64), U64(size * 8))))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // (8 * SEGMENT)), pa.array((at % (8 * SEGMENT)).astype(np.int32))], ["segment", "bit"])

    def segment(t: pa.Table) -> pa.Table:
        bits = np.zeros(8 * SEGMENT, np.uint8)
        bits[t["bit"].to_numpy()] = 1
        return pa.table({"segment": t["segment"].slice(0, 1), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    found = prints.select("code").mapInArrow(places, "segment long, bit int").distinct()  # 8 * SEGMENT rows of a segment at most
    out = np.zeros(max(size, SEGMENT), np.uint8)
    for r in found.groupBy("segment").applyInArrow(segment, "segment long, bits binary").collect():
        out[r.segment * SEGMENT : (r.segment + 1) * SEGMENT] = np.frombuffer(r.bits, np.uint8)
    return Filter(out[:size])


def hit_batches(held, short, window: int):
    """Candidate windows of each document: those that hold a passing fingerprint, and all of the sizes in `short`."""

    def run(it):
        fits = held.value
        for b in it:
            for i, j, w in scan(b["text"]):
                n = len(w.start)
                ends = w.first[w.doc + 1] if n else np.zeros(0, np.int64)
                g = np.arange(max(0, n - GRAM + 1))
                gram = w.grams(g, g + GRAM)
                s = selected(gram, ends, GRAM, window - GRAM + 1)
                s = s[fits(gram[s])]
                at = (s[:, None] - np.arange(window - GRAM + 1)).ravel()
                at = np.unique(at[at >= 0])
                at = at[at + window <= ends[at]]
                size = np.full(len(at), window)
                for k in short:
                    x = np.arange(max(0, n - k + 1))
                    x = x[x + k <= ends[x]]
                    x = x[short[k](w.grams(x, x + k))]
                    at, size = np.concatenate([at, x]), np.concatenate([size, np.full(len(x), k)])
                code, doc = w.grams(at, at + size), w.doc[at]
                order = np.argsort(doc, kind="stable")
                at, size, code, doc = at[order], size[order], code[order], doc[order]
                offsets = np.searchsorted(doc, np.arange(j - i + 1))
                hits = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array((at - w.first[doc]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(code.view(np.int64))], ["at", "size", "code"]))
                beside = [c for c in b.schema.names if c not in ("doc_id", "text")]
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(i, j - i), pa.array(w.count.astype(np.int64)), hits, *(b[c].slice(i, j - i) for c in beside)], ["doc_id", "n_words", "hits", *beside])

    return run


def covered(spans) -> F.Column:
    """Words that an array of (at, end) structs covers."""
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["at"], a["upto"]))).alias("n"), F.greatest(a["upto"], x["end"]).alias("upto"))
    return F.aggregate(F.sort_array(spans), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")), step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, beside: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and items (sorted as strings) of every document,
    and the long columns `beside` of its row.

    Windows are `window` words, or a whole item that is shorter; null and empty texts have no words and hit nothing; a
    row that is repeated, or has no id, is judged by itself. Items with a null id count as items, with an empty name. A
    very long text is one step of a task. Other columns of docs only come out if they are named in `beside`, which must
    not clash with the columns above.
    """
    spark = docs.sparkSession
    marks = settle(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").mapInArrow(benchmark_batches(window), "item_id string, code long, size int, print boolean").distinct())
    held = spark.sparkContext.broadcast(filter_of(marks.where("print")))
    sizes = [r[0] for r in marks.where(~F.col("print") & (F.col("size") < window)).select("size").distinct().collect()]  # fewer than window
    short = {k: filter_of(marks.where(~F.col("print") & (F.col("size") == k))) for k in sizes}
    found = docs.select(F.col("doc_id").cast("long"), "text", *beside).mapInArrow(hit_batches(held, short, window), ", ".join([HITS, *(f"{c} long" for c in beside)]))
    found = settle(found.withColumn("n", F.monotonically_increasing_id()))
    items = marks.where(~F.col("print")).select("item_id", "code", "size")
    hit = found.where(F.size("hits") > 0).select("n", F.explode("hits").alias("h")).select("n", F.col("h.at").cast("long").alias("at"), F.col("h.size").alias("size"), F.col("h.code").alias("code"))
    hit = hit.join(items, ["code", "size"])
    by = hit.groupBy("n").agg(F.collect_set(F.struct("at", (F.col("at") + F.col("size")).alias("end"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    by = by.select("n", covered(F.col("spans")).alias("n_hit"), "items")
    out = found.select("n", "doc_id", "n_words", *beside).join(by, "n", "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), names.alias("items"), *beside)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
longs AS (SELECT item, 10 AS size, array_to_string(ws[i:i + 9], ' ') AS g FROM (SELECT item, ws, unnest(range(1, len(ws) - 8)) AS i FROM b)),
shorts AS (SELECT item, len(ws) AS size, array_to_string(ws, ' ') AS g FROM b WHERE len(ws) BETWEEN 1 AND 9),
w AS (SELECT DISTINCT * FROM (FROM longs UNION ALL FROM shorts)),
sizes AS (SELECT DISTINCT size FROM w),
place AS (SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS g FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes)),
hit AS (SELECT doc_id, i, size, item FROM place JOIN w USING (size, g)),
n AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) FROM hit) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item) AS k, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(k, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, n IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
