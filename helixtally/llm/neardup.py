"""MinHash near-dedup: one-permutation hashing with optimal densification, bands, and star-shaped candidate edges.

Documents of equal shingle sets are one class, so a group of copies costs one row from there on. Each class has one hash
of every shingle, split over BINS bins; an empty bin borrows from a full one that a hash of the bin picks (optimal
densification). BANDS bands of ROWS bins give buckets, and each bucket a star: an edge from its least member to every
other. Edges are confirmed on full shingle sets. Where a bucket's members are not all linked by then, it is split by set
sizes that can be near each other; the pairs between its components are screened block by block inside tasks (first
common band, sizes, signatures), and the rows that may have a link are compared there by their sets, so that a star's
centre hides no link and no pairs are written out.

A pair at the threshold of 0.85 shares no band with a chance below 4e-7. The screen's slack is five deviations of as many bins
as the smaller set fills (bins that borrow from one source move together, so that a small set has few that count).
Tests measure both by set size. Shingles are compared as 61-bit fingerprints of a prime field.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import earliest
from .common import LOWER, NOT_SPACE, U64, Words, mix, settle, steps, table, whole_groups

SHINGLE, PERCENT = 5, 85
BANDS, ROWS = 20, 4
BINS = BANDS * ROWS
#: LEAST_EQUAL[n]: the share of equal bins below which a pair is no link, by the shingles of the smaller set (the last for
#: all larger ones): the threshold less five deviations of the bins that so many shingles fill.
_filled = BINS * (1 - np.exp(-np.arange(1, 16 * BINS + 1) / BINS))
LEAST_EQUAL = np.append(0.0, PERCENT / 100 - 5 * np.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / (0.9 * _filled)))
#: Attempts at a borrow before the next full bin to the right is taken.
ATTEMPTS = 300
#: Members of a bucket that are compared in one group.
BLOCK = 256


def shingles(w: Words, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the distinct shingles of each row, sorted by both; a row of fewer words is one shingle."""
    at = np.arange(len(w.start))
    whole = np.flatnonzero(at + shingle <= w.first[w.doc + 1]) if len(at) else at
    short = np.flatnonzero((w.count > 0) & (w.count < shingle))
    row = np.concatenate([w.doc[whole], short]).astype(np.int64)
    code = np.concatenate([w.grams(whole, whole + shingle), w.grams(w.first[short], w.first[short] + w.count[short])])
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return row[new], code[new]


def borrowed() -> np.ndarray:
    """borrowed()[t, bin]: the bin that an empty bin looks at in attempt t."""
    t, b = np.meshgrid(np.arange(ATTEMPTS, dtype=U64), np.arange(BINS, dtype=U64), indexing="ij")
    return (mix(t * U64(0x9E3779B97F4A7C15) + b * U64(0xC2B2AE3D27D4EB4F) + U64(1)) % U64(BINS)).astype(np.int64)


def signatures(row: np.ndarray, code: np.ndarray, rows: int) -> np.ndarray:
    """rows x BINS least hashes; a row without shingles has the greatest value throughout."""
    empty = U64(0xFFFFFFFFFFFFFFFF)
    h = mix(code * U64(0xD6E8FEB86659FD93))
    sig = np.full(rows * BINS, empty, U64)
    np.minimum.at(sig, row * BINS + ((h >> U64(33)) * U64(BINS) >> U64(31)).astype(np.int64), mix(h))
    sig = sig.reshape(rows, BINS)
    full = sig != empty
    r, b = np.nonzero(~full & full.any(1)[:, None])
    for look in borrowed():
        if not len(r):
            break
        source = look[b]
        got = full[r, source]
        sig[r[got], b[got]] = sig[r[got], source[got]]
        r, b = r[~got], b[~got]
    for d, k in zip(r.tolist(), b.tolist(), strict=True):
        others = np.flatnonzero(full[d])
        sig[d, k] = sig[d, others[np.searchsorted(others, k) % len(others)]]
    return sig


def sketch_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for i, j, data, off in steps(batch["text"]):
            w = Words(LOWER[data], off, NOT_SPACE)
            row, code = shingles(w)
            n = np.bincount(row, minlength=j - i)
            sums = [np.zeros(len(code) + 1, U64) for _ in range(2)]
            for s, odd in zip(sums, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), strict=True):
                np.cumsum(mix(code * U64(odd)), out=s[1:])
            at = np.append(0, np.cumsum(n))
            sig = signatures(row, code, j - i)
            band = np.zeros((j - i, BANDS), U64)
            for k in range(ROWS):
                band = mix(band + sig[:, k::ROWS])
            band = mix(band + np.arange(BANDS, dtype=U64) * U64(0xA0761D6478BD642F))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, BANDS), pa.int32()), pa.array(band.ravel().view(np.int64)))
            # what the screen needs of a row: a byte of each bin, and four of each band
            low = np.concatenate([(sig & U64(0xFF)).astype(np.uint8), (band & U64(0xFFFFFFFF)).astype("<u4").view(np.uint8).reshape(j - i, 4 * BANDS)], axis=1)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(low.shape[1]), j - i, [None, pa.py_buffer(np.ascontiguousarray(low))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch["id"].slice(i, j - i), batch["tid"].slice(i, j - i), pa.array(n.astype(np.int64)), *(pa.array((s[at[1:]] - s[at[:-1]]).view(np.int64)) for s in sums), bands, packed], ["id", "tid", "n_shingles", "d1", "d2", "bands", "sig"])


def set_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for i, j, data, off in steps(b["text"]):
            row, code = shingles(Words(LOWER[data], off, NOT_SPACE))
            at = np.searchsorted(row, np.arange(j - i + 1))
            yield pa.RecordBatch.from_arrays([b["id"].slice(i, j - i), b["tid"].slice(i, j - i), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(code.view(np.int64)))], ["id", "tid", "codes"])


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, tid, codes): the shingle sets of some documents, sorted."""
    some = docs.select("id", "tid", "text").join(nodes.distinct(), ["id", "tid"])
    return settle(some.mapInArrow(set_batches, "id long, tid long, codes array<long>").dropDuplicates(["id", "tid"]))


def node(id_: str, tid: str) -> Column:
    """A document as a node: rows of one id (or of none) and different texts are nodes of their own."""
    return F.struct(F.col(id_).alias("id"), F.col(tid).alias("tid"))


def confirm(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """The links (a, b) of nodes among settled edges (a, ta, b, tb), by full shingle sets."""
    sets = sets_of(docs, edges.select(F.col("a").alias("id"), F.col("ta").alias("tid")).union(edges.select("b", "tb")))
    one, two = (sets.select(F.col("id").alias(x), F.col("tid").alias(f"t{x}"), F.col("codes").alias(f"codes_{x}")) for x in "ab")
    both = F.size(F.array_intersect("codes_a", "codes_b"))
    linked = 100 * both >= PERCENT * (F.size("codes_a") + F.size("codes_b") - both)
    return settle(edges.join(one, ["a", "ta"]).join(two, ["b", "tb"]).where(linked).select(node("a", "ta").alias("a"), node("b", "tb").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of settled links (a, b): the least node reachable, by label passing and halving."""
    both = settle(links.union(links.select("b", "a")).where("a <> b").distinct())
    label = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        moved = label.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        up = label.select(F.col("node").alias("mid"), F.col("component").alias("top"))
        moved = settle(moved.join(up, "mid", "left").select("node", "old", F.least("mid", F.coalesce("top", "mid")).alias("component")))
        label = moved.select("node", "component")
        if moved.where("old <> component").isEmpty():
            return label


def numbers(ids, tids) -> np.ndarray:
    """A number for each node, in their order: equal for equal nodes."""
    return np.unique(np.column_stack([ids, tids]).astype(np.int64), axis=0, return_inverse=True)[1].ravel()


def screen(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group (key), the rows that may have a link to another component: they are compared in full.

    Rows come sorted by key, and a component as its least node's cid and ctid; a group holds two blocks (x, y) of a bucket
    at most. Rows of a greater size class (upper) only meet those of the lesser one, and two rows that share several
    buckets meet in that of their first common band.
    """
    for t in whole_groups(it):
        key, band, block, n, x, y = (t[c].to_numpy() for c in ("key", "band", "block", "n_shingles", "x", "y"))
        upper = t["upper"].to_numpy(zero_copy_only=False)
        own, comp = numbers(t["id"].to_numpy(), t["tid"].to_numpy()), numbers(t["cid"].to_numpy(), t["ctid"].to_numpy())
        low = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(key), BINS + 4 * BANDS)
        sig, bands = low[:, :BINS], np.ascontiguousarray(low[:, BINS:]).view("<u4")
        keep = np.zeros(len(key), bool)
        edge = np.flatnonzero(np.diff(key, prepend=~key[0], append=~key[-1]))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            for i in range(lo, hi):
                j = lo + np.flatnonzero((comp[lo:hi] != comp[i]) & (own[lo:hi] > own[i]) & (100 * np.minimum(n[lo:hi], n[i]) >= PERCENT * np.maximum(n[lo:hi], n[i])) & ~(upper[lo:hi] & upper[i]))
                if x[lo] != y[lo]:
                    j = j[block[j] != block[i]]
                j = j[(sig[j] == sig[i]).mean(1) >= LEAST_EQUAL[np.minimum(np.minimum(n[j], n[i]), len(LEAST_EQUAL) - 1)]] if len(j) else j
                j = j[(bands[j] == bands[i]).argmax(1) == band[i]] if len(j) else j
                if len(j):
                    keep[j] = keep[i] = True
        yield from t.select(["key", "x", "y", "block", "id", "tid", "cid", "ctid"]).filter(pa.array(keep)).to_batches()


def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, ta, b, tb) between components within each group, by full shingle sets; a forest of them, so one a row at most."""
    for t in whole_groups(it):
        key, ids, tids, x, y, block = (t[c].to_numpy() for c in ("key", "id", "tid", "x", "y", "block"))
        comp = numbers(t["cid"].to_numpy(), t["ctid"].to_numpy())
        codes = t["codes"].combine_chunks()
        flat, size = codes.flatten().to_numpy(zero_copy_only=False), codes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.append(0, np.cumsum(size))
        links = []
        edge = np.flatnonzero(np.diff(key, prepend=~key[0], append=~key[-1]))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            n, own = size[lo:hi], np.unique(comp[lo:hi], return_inverse=True)[1]
            word = np.unique(flat[at[lo] : at[hi]], return_inverse=True)[1]
            begin, mark = at[lo:hi] - at[lo], np.zeros(int(word.max(initial=-1)) + 1, np.int32)
            for i in range(hi - lo):
                other = own != own[i]
                if x[lo] != y[lo]:
                    other &= block[lo:hi] != block[lo + i]
                if not other.any():
                    continue
                mine = word[begin[i] : begin[i] + n[i]]
                mark[mine] = 1
                both = np.add.reduceat(mark[word], begin)  # rows in a bucket have shingles
                mark[mine] = 0
                for j in np.flatnonzero(other & (100 * both >= PERCENT * (n + n[i] - both))).tolist():
                    if own[j] != own[i]:
                        links.append((int(ids[lo + i]), int(tids[lo + i]), int(ids[lo + j]), int(tids[lo + j])))
                        own[own == own[j]] = own[i]
        cols = list(zip(*links, strict=True)) if links else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "ta", "b", "tb"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs.

    Null and empty texts have no shingles and stay alone; fewer than five words are one shingle. A null id counts as the
    smallest and stays null. Rows of one id, or of none, and different texts are documents of their own, by the hash of
    the text from the least; only the same text again is the same document, and each row of it is returned. A very long
    text is one step of a task. Other columns of docs don't come out, so their names can't clash.
    """
    own, least = node("id", "tid"), F.col("component")
    real = lambda c: F.when(c != earliest.NULL_ID, c)
    return groups(earliest.keyed(docs.select("doc_id", "text"))).select(real(F.col("id")).alias("doc_id"), "n_shingles", real(least["id"]).alias("component_id"), (own == least).alias("kept"))


def groups(docs: DataFrame) -> DataFrame:
    """id, tid, n_shingles and component (the least node of its group) of every row of keyed docs."""
    held = settle(docs.select("id", "tid", "text").mapInArrow(sketch_batches, "id long, tid long, n_shingles long, d1 long, d2 long, bands array<long>, sig binary"))
    digest = ["n_shingles", "d1", "d2"]
    classes = held.where("n_shingles > 0").groupBy(*digest).agg(F.min(F.struct("id", "tid")).alias("rep"))
    reps = settle(classes.select("rep.id", "rep.tid", *digest))
    sketch = held.join(reps.select("id", "tid"), ["id", "tid"], "left_semi").dropDuplicates(["id", "tid"])
    member = sketch.select("id", "tid", "n_shingles", F.posexplode("bands").alias("band", "key"))
    bucket = member.groupBy("key").agg(F.min(F.struct("id", "tid", "n_shingles")).alias("c"), F.count("*").alias("m")).where("m > 1").drop("m")
    member = settle(member.join(bucket, "key"))
    sized = 100 * F.least("n_shingles", "c.n_shingles") >= PERCENT * F.greatest("n_shingles", "c.n_shingles")
    star = settle(member.where(sized & (node("id", "tid") != node("c.id", "c.tid"))).select(F.col("c.id").alias("a"), F.col("c.tid").alias("ta"), F.col("id").alias("b"), F.col("tid").alias("tb")).distinct())
    links = confirm(docs, star)
    label = components(links)

    named = member.select("key", "band", "id", "tid", "n_shingles").join(label.select("node.id", "node.tid", "component"), ["id", "tid"], "left").withColumn("component", F.coalesce("component", node("id", "tid")))
    # sizes of a pair that may be linked are in one class or in neighbours: a group is a class with the next one
    class_ = F.floor(F.log(F.col("n_shingles").cast("double")) / (1.0001 * math.log(100 / PERCENT))).cast("int")
    named = named.withColumn("upper", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("size", class_ - F.col("upper").cast("int"))
    several = lambda c: F.min(c) < F.max(c)
    split = named.groupBy("key", "size").agg(several("component").alias("open"), F.min("upper").alias("one"), F.count("*").alias("m")).where("open AND NOT one").select("key", "size", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    open_ = named.join(split, ["key", "size"]).join(sketch.select("id", "tid", "sig"), ["id", "tid"])
    open_ = open_.withColumn("block", F.pmod(F.xxhash64("id", "tid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    open_ = open_.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    open_ = open_.select(F.xxhash64("key", "size", "x", "y").alias("key"), "x", "y", "band", "upper", "block", "id", "tid", F.col("component.id").alias("cid"), F.col("component.tid").alias("ctid"), "n_shingles", "sig")
    held_open = settle(open_.repartition("key").sortWithinPartitions("key").mapInArrow(screen, "key long, x int, y int, block int, id long, tid long, cid long, ctid long"))
    if not held_open.isEmpty():
        ask = held_open.join(sets_of(docs, held_open.select("id", "tid")), ["id", "tid"])
        more = ask.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, ta long, b long, tb long").select(node("a", "ta").alias("a"), node("b", "tb").alias("b")).distinct()
        label = components(settle(links.union(more)))

    home = reps.join(label.select("node.id", "node.tid", "component"), ["id", "tid"], "left").select(*digest, F.coalesce("component", node("id", "tid")).alias("component"))
    out = docs.select("id", "tid").join(held.select("id", "tid", *digest).dropDuplicates(["id", "tid"]), ["id", "tid"]).join(home, digest, "left")
    return out.select("id", "tid", "n_shingles", F.coalesce("component", node("id", "tid")).alias("component"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d) UNION SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
