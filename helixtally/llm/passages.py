"""Substring dedup by repeated-phrase automata.

A first scan winnows phrases of PHRASE words and keeps those that recur in documents of several ids, each with the symbols
of its words. Every document that holds one is then dealt the recurring phrases that the scan found in it; the phrases of
a run of documents are a shard of at most PATTERNS, which is compiled to an Aho-Corasick automaton before the documents
are looked at. They stream through it, and its hits alone give the places at which phrases occur. A document with more
phrases streams through several automata. Around the hits, windows of WINDOW words are compared: each word that one covers
is removed if the window also starts in a document of a smaller id. A document without a recurring phrase can't hold
such a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import earliest
from .common import NOT_SPACE, U64, Words, designated, discard, mix, once, scratch, steps, stored, table

WINDOW, PHRASE = 50, 8
#: Words beside the phrase of which one side of a window has this many at least.
SIDE = (WINDOW - PHRASE) // 2
#: Phrases that an automaton holds at most.
PATTERNS = 8192


def symbols(w: Words) -> np.ndarray:
    """The automaton's letters: 31 bits of each word's code."""
    return (w.code & U64(0x7FFFFFFF)).astype(np.int32)


def anchors(w: Words):
    """Each phrase start's code, and the designated anchors with the first and last window that each stands for."""
    ends = w.first[w.doc + 1] if len(w.doc) else np.zeros(0, np.int64)
    at = np.arange(max(0, len(w.start) - PHRASE + 1))
    code = w.grams(at, at + PHRASE)
    return code, *designated(code, ends, PHRASE, WINDOW - PHRASE + 1)


def anchor_batches(worded: bool):
    """(id, tid, code) of each document's distinct anchors, or (id, code, words) with the phrase's symbols."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, _, data, off in steps(b["text"]):
                w = Words(data, off, NOT_SPACE)
                code, s, _, _ = anchors(w)
                s = s[once(w.doc[s], code[s])]
                row, codes = pa.array(w.doc[s] + i), pa.array(code[s].view(np.int64))
                if worded:
                    words = np.ascontiguousarray(symbols(w)[s[:, None] + np.arange(PHRASE)])
                    held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * PHRASE), len(s), [None, pa.py_buffer(words)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([b["id"].take(row), codes, held], ["id", "code", "words"])
                else:
                    yield pa.RecordBatch.from_arrays([b["id"].take(row), b["tid"].take(row), codes], ["id", "tid", "code"])

    return run


def automaton_of(phrases: dict[int, bytes]):
    """The automaton of phrases given as code -> symbols; its values are the codes."""
    out = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for code, words in phrases.items():
        out.add_word(tuple(np.frombuffer(words, np.int32).tolist()), code)
    out.make_automaton()
    return out


def shards(lists: list[list[tuple[int, bytes]]]) -> Iterator[tuple[int, int, dict[int, bytes]]]:
    """(first row, end row, phrases): runs of rows and the PATTERNS phrases at most that they were dealt.

    A row of more phrases comes alone, once with each part of them.
    """
    start, held = 0, {}
    for k, mine in enumerate(lists):
        if held and len(held) + len(mine) > PATTERNS:
            yield start, k, held
            held = {}
        start = start if held else k
        if len(mine) > PATTERNS:
            for i in range(0, len(mine), PATTERNS):
                yield k, k + 1, dict(mine[i : i + PATTERNS])
        else:
            held.update(mine)
    if held:
        yield start, len(lists), held


AROUND = "around struct<edge: int, right: bigint, left: bigint, windows: array<bigint>>"


def locate_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every occurrence that the shards' automata find, with the fingerprints of the windows that it is the anchor of."""
    for batch in it:
        lists = [[(p["code"], p["words"]) for p in x] for x in batch["phrases"].to_pylist()]
        for start, end, phrases in shards(lists):
            automaton, b = automaton_of(phrases), batch.slice(start, end - start)
            for i, _, data, off in steps(b["text"]):
                w = Words(data, off, NOT_SPACE)
                letters, at, value = symbols(w).tolist(), [], []
                for d in np.flatnonzero(w.count >= WINDOW).tolist():
                    a, e = int(w.first[d]), int(w.first[d + 1])
                    for last, code in automaton.iter(tuple(letters[a:e])):
                        at.append(a + last - PHRASE + 1)
                        value.append(code)
                if at:
                    yield from occurrences_at(b, i, w, np.array(at, np.int64), np.array(value, np.int64))


def occurrences_at(b: pa.RecordBatch, i: int, w: Words, at: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The hits that are anchors, of the rows of b from i on; value: the code of the phrase that was hit, which tells apart
    words of equal symbols.
    """
    code, anchor, lo, last = anchors(w)
    at = at[code[at].view(np.int64) == value]
    found = np.flatnonzero(np.isin(anchor, at))
    if not len(found):
        return
    at, lo, last = anchor[found], lo[found], last[found]
    doc = w.doc[at]
    d0, d1 = w.first[doc], w.first[doc + 1]
    n = last - lo + 1
    ctx = mix(w.grams(lo, at) * U64(3) + w.grams(at, last + WINDOW))
    begin = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    windows = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(w.grams(begin, begin + WINDOW).view(np.int64)))
    right, left = w.grams(at, np.minimum(at + PHRASE + SIDE, d1)), mix(w.grams(np.maximum(at - SIDE, d0), at + PHRASE) + U64(1))
    edge = np.clip(at - lo - SIDE + 1, 0, n)  # windows from here on have SIDE words right of the phrase, those before SIDE left of it
    around = pa.StructArray.from_arrays([pa.array(edge.astype(np.int32)), pa.array(right.view(np.int64)), pa.array(left.view(np.int64)), windows], ["edge", "right", "left", "windows"])
    row = pa.array(doc + i)
    yield pa.RecordBatch.from_arrays([b["id"].take(row), b["tid"].take(row), pa.array(code[at].view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(lo - d0), pa.array(n.astype(np.int32)), around], ["id", "tid", "code", "ctx", "lo", "n_windows", "around"])


def removal_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for i, j, data, off in steps(b["text"]):
            w = Words(data, off, NOT_SPACE)
            removed, digest, texts = [], [], []
            for d, spans in enumerate(b["spans"].slice(i, j - i).to_pylist()):
                a, e = int(w.first[d]), int(w.first[d + 1])
                raw = data[off[d] : off[d + 1]].tobytes()
                words = raw.split() if b"\x1c" not in raw else None
                if words is None or len(words) != e - a:
                    words = [data[x:y].tobytes() for x, y in zip(w.start[a:e].tolist(), w.end[a:e].tolist(), strict=True)]
                gone = 0
                for s in reversed(spans or []):
                    gone += s["end"] - s["at"]
                    del words[s["at"] : s["end"]]
                kept = b" ".join(words)
                removed.append(gone)
                digest.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept if gone else raw)
            beside = [c for c in b.schema.names if c not in ("doc_id", "text", "spans")]
            cols = [b["doc_id"].slice(i, j - i), pa.array(w.count.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *(b[c].slice(i, j - i) for c in beside)], [*REMOVED.fieldNames(), *beside])


REMOVED = StructType().add("doc_id", "long").add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept_text", "string")


def phrase_table(docs: DataFrame) -> DataFrame:
    """(code, words) of the phrases that documents of several ids hold."""
    found = docs.mapInArrow(anchor_batches(True), "id long, code long, words binary")
    by = found.groupBy("code").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("words").alias("words"))
    return by.where("low < high").select("code", "words")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, tid, spans) of the keyed docs that hold repeated words."""
    sc = docs.sparkSession.sparkContext
    folder, slim = scratch(sc), docs.select("id", "tid", "text")
    phrases = stored(phrase_table(slim), f"{folder}/phrases")
    held = slim.mapInArrow(anchor_batches(False), "id long, tid long, code long").join(phrases, "code")
    dealt = stored(held.groupBy(*earliest.KEY).agg(F.collect_set(F.struct("code", "words")).alias("phrases")), f"{folder}/dealt")
    occ = stored(slim.join(dealt, earliest.KEY).mapInArrow(locate_batches, f"{earliest.OCCURRENCE}, {AROUND}"), f"{folder}/occurrences")
    discard(sc, f"{folder}/dealt")
    first = earliest.firsts(occ, "around", folder)
    return earliest.spans(occ, first, earliest.covered(repeated_windows(first, folder), WINDOW), WINDOW, folder)


def repeated_windows(first: DataFrame, folder: str) -> DataFrame:
    """(code, ctx, at) of the windows of contexts that a context of a smaller first id has too.

    A window has SIDE words on one side of its phrase, so it can only recur where those do. What is left are rows of a
    window each. All is summed up before the shuffle, stored, and joined as one row a key, so that Spark can split a hot
    key: no task holds, or need read, all contexts of a phrase.
    """
    w, edge = F.col("around.windows"), F.col("around.edge")
    right = F.struct(F.col("around.right").alias("key"), edge.alias("at"), F.slice(w, edge + 1, F.size(w)).alias("windows"))
    left = F.struct(F.col("around.left").alias("key"), F.lit(0).alias("at"), F.slice(w, 1, edge).alias("windows"))
    halves = first.select("code", "ctx", "first", F.explode(F.array(right, left)).alias("h")).select("code", "ctx", "first", "h.*").where(F.size("windows") > 0)
    busy = stored(earliest.contested(halves, "key"), f"{folder}/busy")
    each = halves.join(busy, "key").select("code", "ctx", "first", "at", F.posexplode("windows").alias("i", "window"))
    least = stored(earliest.contested(each, "window"), f"{folder}/least")
    return each.join(least, "window").where("first > low").select("code", "ctx", (F.col("at") + F.col("i")).cast("long").alias("at"))


def remove_passages(docs: DataFrame, row: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text and, if row, the row itself without its text of every row of docs.

    kept_text is the text itself if nothing goes, else the kept words joined by one space. Null and empty texts have no
    words; fewer than WINDOW words hold no window; rows of equal ids don't count as earlier than each other, and a null
    id counts as the smallest. A repeated row is cut each time in the same way. A very long text is one step of a task,
    and its phrases are dealt to automata of PATTERNS each. Further columns of docs only come out inside `row`, so their
    names can't clash.
    """
    beside = [F.struct(*(F.col(c) for c in docs.columns if c != "text")).alias("row")] if row else []
    docs = earliest.keyed(docs.select("doc_id", "text", *beside))
    found = repeated_spans(docs)
    beside = [c for c in docs.columns if c == "row"]
    return docs.join(found, earliest.KEY, "left").select("doc_id", "text", "spans", *beside).mapInArrow(removal_batches, StructType([*REMOVED.fields, *(docs.schema[c] for c in beside)]))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated passages, as digests."""
    return remove_passages(table(spark, sf_dir, "documents")).drop("kept_text")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
least AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (h) WHERE d < doc_id),
word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
