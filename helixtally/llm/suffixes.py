"""Suffix-array dedup: repeated byte strings by the difference-cover algorithm, over the places where text recurs.

A suffix array of the whole corpus would cost many rows per byte, so anchors (see `earliest`) first find the contexts
around recurring grams. Contexts that are equal as a whole count once. Their bytes are dealt out by an anchor and the bytes
on one side of it, and each block is sorted with a difference cover modulo 3: sort the sampled triples, recurse on their
names, merge in the remaining suffixes, and compare the prefixes of neighbours. Repeats inside one document are found in
the same way when the document is rewritten.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import earliest
from .common import BASE, U64, designated, fixed_grams, grams, mix, once, prefix_sums, scratch, steps, stored, table

WINDOW, GRAM = 100, 32
#: Bytes of a window beside its anchor, and how many of them one side surely has.
BESIDE = WINDOW - GRAM
SIDE = BESIDE // 2
#: Half contexts that are sorted together, about; a larger group of one key is split into blocks, and these are merged.
BLOCK = 2048
#: Bytes of contexts that are handed on at once, about.
FETCH = 1 << 26
#: Bytes of a document whose repeats in itself are looked at together, about; more than a step of several documents has.
PART = 1 << 20


def names_of(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks from 1 of integer keys."""
    _, rank = np.unique(keys, return_inverse=True)
    return rank.astype(np.int64) + 1, int(rank.max()) + 1 if len(rank) else 0


def difference_cover(s: np.ndarray) -> np.ndarray:
    """The suffix array of a sequence of integers of 1 or more, by sampling the suffixes at 1 and 2 modulo 3."""
    n = len(s)
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    if int(s.max()) >= 1 << 20:
        s = names_of(s)[0]
    x, size = np.append(s, (0, 0, 0)).astype(np.int64), int(s.max()) + 1
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    pair = x[:-1] * size + x[1:]  # of the symbols at i and i + 1
    if size > 1 << 10:
        pair = names_of(pair)[0]
    wide = int(pair.max()) + 1
    name, distinct = names_of(pair[sample] * size + x[sample + 2])  # both factors are below 2**21 or ranks of n
    order = sample[difference_cover(name)] if distinct < len(sample) else sample[np.argsort(name)]
    rank = np.zeros(n + 3, np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    order = order[order < n]
    rest = np.arange(0, n, 3)
    key = x[rest] * (n + 3) + rank[rest + 1]
    by = np.argsort(key)
    rest, key = rest[by], key[by]
    one, two = order[order % 3 == 1], order[order % 3 == 2]
    before = np.searchsorted(x[one] * (n + 3) + rank[one + 1], key)
    full = pair if wide * (n + 3) < 1 << 62 else names_of(pair)[0]
    before += np.searchsorted(full[two] * (n + 3) + rank[two + 2], full[rest] * (n + 3) + rank[rest + 2])
    out, place = np.empty(n, np.int64), before + np.arange(len(rest))
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place], out[~taken] = rest, order
    return out


def equal_prefixes(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Group numbers of `starts`, which are in suffix order: neighbours with equal first `size` bytes are in one group."""
    same = np.zeros(len(starts), bool)
    view = np.lib.stride_tricks.sliding_window_view(data, size)
    for i in range(1, len(starts), 1 << 15):
        j = min(len(starts), i + (1 << 15))
        same[i:j] = (view[starts[i:j]] == view[starts[i - 1 : j - 1]]).all(1)
    return np.cumsum(~same) - 1


def groups_of(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A number for each start: equal for those whose `size` bytes are equal."""
    wanted = np.full(len(data), -1, np.int64)
    wanted[starts] = np.arange(len(starts))
    order = wanted[difference_cover(data.astype(np.int64) + 1)]
    order = order[order >= 0]
    out = np.empty(len(starts), np.int64)
    out[order] = equal_prefixes(data, starts[order], size)
    return out


def later(group: np.ndarray, place: np.ndarray) -> np.ndarray:
    """True for the members of a group that do not have its least place."""
    least = np.full(int(group.max()) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, place)
    return place > least[group]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def anchors(data: np.ndarray, off: np.ndarray):
    """(code, row, start, first window, last window) of the designated anchors."""
    code = fixed_grams(data, GRAM)
    s, lo, last = designated(code, np.repeat(off[1:], np.diff(off)), GRAM, BESIDE + 1)
    return code[s], np.searchsorted(off, s, "right") - 1, s, lo, last


def anchor_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for i, _, data, off in steps(b["text"]):
            code, doc, _, _, _ = anchors(data, off)
            first = once(doc, code)
            row = pa.array(doc[first] + i)
            yield pa.RecordBatch.from_arrays([b["id"].take(row), b["tid"].take(row), pa.array(code[first].view(np.int64))], ["id", "tid", "code"])


def context_codes(sums: np.ndarray, at: np.ndarray, lo: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Fingerprints of contexts: of the bytes before the anchor, and from it on."""
    return mix(grams(sums, BASE, lo, at) * U64(3) + grams(sums, BASE, at, last + WINDOW))


def locate_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every occurrence of a document's recurring anchors: its context's fingerprint, and those of the anchor's two sides.

    Windows from `edge` on have SIDE bytes right of the anchor, the others have them left of it.
    """
    for b in it:
        wanted = np.unique(b["codes"].flatten().to_numpy(zero_copy_only=False).view(U64))
        if not len(wanted):
            continue
        for i, _, data, off in steps(b["text"]):
            code, doc, at, lo, last = anchors(data, off)
            known = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)] == code)
            code, doc, at, lo, last = code[known], doc[known], at[known], lo[known], last[known]
            sums = prefix_sums(data, BASE)
            n, row = last - lo + 1, pa.array(doc + i)
            edge = np.clip(at - lo - SIDE, 0, n)
            right = grams(sums, BASE, at, np.minimum(at + GRAM + SIDE, off[doc + 1]))
            left = mix(grams(sums, BASE, np.maximum(at - SIDE, off[doc]), at + GRAM) + U64(1))
            cols = [code.view(np.int64), context_codes(sums, at, lo, last).view(np.int64), lo - off[doc], n.astype(np.int32), edge.astype(np.int32), right.view(np.int64), left.view(np.int64)]
            yield pa.RecordBatch.from_arrays([b["id"].take(row), b["tid"].take(row), *map(pa.array, cols)], ["id", "tid", "code", "ctx", "lo", "n_windows", "edge", "right", "left"])


def fetch_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each document's listed half contexts."""
    for b in it:
        for i, j, data, off in steps(b["text"]):
            lists = b["wanted"].slice(i, j - i)
            asked, row = lists.flatten(), np.repeat(np.arange(j - i), lists.value_lengths().to_numpy(zero_copy_only=False))
            lo = asked.field("lo").to_numpy() + asked.field("at").to_numpy() + off[row]
            size = asked.field("n").to_numpy().astype(np.int64) + (WINDOW - 1)
            kept = ["block", "key", "split", "code", "ctx", "at", "n"]
            ends = np.cumsum(size)
            cuts = np.searchsorted(ends, np.arange(FETCH, int(ends[-1]) if len(ends) else 0, FETCH), "right").tolist()
            for a, e in zip([0, *cuts], [*cuts, len(size)], strict=True):  # so that a long document's contexts come in several batches
                off_ = np.append(0, np.cumsum(size[a:e]))
                begin = np.repeat(lo[a:e] - off_[:-1], size[a:e]) + np.arange(off_[-1])
                held = pa.Array.from_buffers(pa.binary(), e - a, [None, pa.py_buffer(off_.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[begin]))])
                yield pa.RecordBatch.from_arrays([*(asked.field(c).slice(a, e - a) for c in kept), b["id"].take(pa.array(row[a:e] + i)), held], [*kept, "first", "bytes"])


def blocks_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole blocks together, BLOCK rows or one block at least, of rows that are sorted by block."""
    held: list[pa.RecordBatch] = []
    for b in it:
        held.append(b)
        if sum(x.num_rows for x in held) < BLOCK:
            continue
        t = pa.Table.from_batches(held)
        block = t["block"].to_numpy()
        cut = int(np.searchsorted(block, block[-1]))
        while cut >= BLOCK:  # several whole blocks, as many as fill one sort
            end = int(np.searchsorted(block, block[BLOCK - 1], "right"))
            end = min(end, cut)
            yield t.slice(0, end).combine_chunks()
            t, block, cut = t.slice(end), block[end:], cut - end
        held = t.combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


COMPARED = "key long, code long, ctx long, at int, n int, first long, window long"


def compare_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a sort of the suffixes of whole blocks tells, as COMPARED.

    Runs of n windows that a smaller first id in the block has (window: null); and of a key that is split into several
    blocks, the windows that are least in theirs, by fingerprint, so that the blocks can be merged.
    """
    for t in blocks_of(it):
        col = t["bytes"].chunk(0)
        off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data, off = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]
        n, first, at = t["n"].to_numpy().astype(np.int64), t["first"].to_numpy(), t["at"].to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(row)) - (np.cumsum(n) - n)[row]
        starts = off[row] + within
        # blocks of several keys may share bytes: that only finds the same repeats, as first ids are true in each
        bad = later(groups_of(data, starts, WINDOW), first[row])
        new, fine = np.diff(row, prepend=-1) != 0, ~bad
        begin = np.flatnonzero(bad & (new | np.append(True, fine[:-1])))
        end = np.flatnonzero(bad & np.append(new[1:] | fine[1:], True))
        rest = np.flatnonzero(fine & t["split"].to_numpy(zero_copy_only=False)[row])
        own = np.concatenate([row[begin], row[rest]])
        window = pa.array(np.concatenate([np.zeros(len(begin), np.int64), grams(prefix_sums(data, BASE), BASE, starts[rest], starts[rest] + WINDOW).view(np.int64)]), mask=np.arange(len(own)) < len(begin))
        place = at[own] + within[np.concatenate([begin, rest])]
        size = np.concatenate([end - begin + 1, np.ones(len(rest), np.int64)])
        taken = [t[c].to_numpy()[own] for c in ("key", "code", "ctx")]
        yield pa.RecordBatch.from_arrays([*map(pa.array, taken), pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(first[own]), window], ["key", "code", "ctx", "at", "n", "first", "window"])


def repeats_of(docs: DataFrame, first: DataFrame, folder: str) -> DataFrame:
    """(code, ctx, runs): which bytes of a context repeated windows cover, relative to its start.

    A window can only recur where SIDE bytes beside its anchor do, so contexts are taken as two halves that are dealt by
    those. A key of more than BLOCK halves is dealt as several blocks. Each block is sorted by itself; of a split key, the
    least of each block are summed up, which combines before the shuffle, and joined back.
    """
    edge = F.col("edge")
    right = F.struct(F.col("right").alias("key"), edge.alias("at"), (F.col("n_windows") - edge).alias("n"))
    left = F.struct(F.col("left").alias("key"), F.lit(0).alias("at"), edge.alias("n"))
    halves = first.select("code", "ctx", "first", "id", "tid", "lo", F.explode(F.array(right, left)).alias("h")).select("code", "ctx", "first", "id", "tid", "lo", "h.*").where("n > 0")
    busy = halves.groupBy("key").agg(F.min("first").alias("low"), F.max("first").alias("high"), F.count("*").alias("m")).where("low < high").select("key", F.ceil(F.col("m") / BLOCK).alias("blocks"))
    busy = stored(busy, f"{folder}/busy")  # so that Spark can split the join at a hot key
    block = F.xxhash64("key", F.pmod(F.xxhash64("ctx"), F.col("blocks")))
    asked = halves.join(busy, "key").select("id", "tid", F.struct(block.alias("block"), "key", (F.col("blocks") > 1).alias("split"), "code", "ctx", "at", "n", "lo").alias("w"))
    wanted = asked.groupBy(*earliest.KEY).agg(F.collect_list("w").alias("wanted"))
    held = docs.select(*earliest.KEY, "text").dropDuplicates(earliest.KEY).join(wanted, earliest.KEY).mapInArrow(fetch_batches, "block long, key long, split boolean, code long, ctx long, at int, n int, first long, bytes binary")
    found = stored(held.repartition("block").sortWithinPartitions("block").mapInArrow(compare_batches, COMPARED), f"{folder}/compared")
    split = found.where("window IS NOT NULL")
    least = split.groupBy("key", "window").agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low < high").select("key", "window", "low")
    least = stored(least, f"{folder}/least")
    merged = split.join(least, ["key", "window"]).where("first > low")
    runs_ = found.where("window IS NULL").select("code", "ctx", "at", "n").union(merged.select("code", "ctx", "at", "n"))
    return earliest.covered(runs_.select("code", "ctx", F.col("at").cast("long").alias("at"), (F.col("at") + F.col("n") + (WINDOW - 1)).cast("long").alias("end")), WINDOW)


def mark(flag: np.ndarray, lo: np.ndarray, end: np.ndarray) -> None:
    """Set flag in the spans lo..end."""
    if not len(lo):
        return
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.append(True, lo[1:] > end[:-1]))
    for a, b in zip(lo[new].tolist(), end[np.append(new[1:], len(lo)) - 1].tolist(), strict=True):
        flag[a:b] = True


def heads_of(found: list[np.ndarray], flag: np.ndarray) -> np.ndarray:
    """The first of each context among rows (ctx, code, first window, last window) in order; the others' bytes are flagged."""
    rows = np.concatenate(found, axis=1)
    head = np.unique(rows[0], return_index=True)[1]
    copy = np.ones(rows.shape[1], bool)
    copy[head] = False
    mark(flag, rows[2, copy], rows[3, copy] + WINDOW)
    return rows[:, np.sort(head)]


def inner_repeats(raw: np.ndarray, flag: np.ndarray) -> None:
    """Flag the bytes of a document that windows cover which also start earlier in it, in the same way as between documents.

    Equal contexts repeat the first of them as a whole. A document is read in parts, of which the first contexts stay: they
    are unlike each other, and some 32 bytes for each. Those that share an anchor with others are sorted, as many whole
    anchors at a time as make a part.
    """
    found, size, last_size = [np.zeros((4, 0), np.int64)], 0, 0
    for a in range(0, len(raw) - WINDOW + 1, PART):
        part = raw[a : a + PART + WINDOW - 1]
        code, _, at, lo, last = anchors(part, np.array([0, len(part)]))
        ctx = context_codes(prefix_sums(part, BASE), at, lo, last)
        found.append(heads_of([np.stack([ctx.view(np.int64), code.view(np.int64), lo + a, last + a])], flag))
        size += found[-1].shape[1]
        if size > max(2 * last_size, PART >> 3):
            found = [heads_of(found, flag)]
            size = last_size = found[0].shape[1]
    heads = heads_of(found, flag)
    _, group, count = np.unique(heads[1], return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[group] > 1)
    some = some[np.argsort(group[some], kind="stable")]
    group, lo, n = group[some], heads[2, some], heads[3, some] - heads[2, some] + 1
    border = np.flatnonzero(np.diff(group, prepend=-1))  # whole anchors are kept together
    taken = (np.cumsum(n + WINDOW - 1) - (n + WINDOW - 1))[border] // PART
    cuts = [*border[np.flatnonzero(np.diff(taken, prepend=-1))].tolist(), len(some)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        sort_contexts(raw, lo[i:j], n[i:j], flag)


def sort_contexts(raw: np.ndarray, lo: np.ndarray, n: np.ndarray, flag: np.ndarray) -> None:
    """Flag the bytes of the windows lo..lo + n - 1 of contexts that also start earlier in one of them."""
    size = n + WINDOW - 1
    base = np.cumsum(size) - size
    data = raw[np.repeat(lo - base, size) + np.arange(size.sum())]
    row = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    place = lo[row] + within
    bad = place[later(groups_of(data, base[row] + within, WINDOW), place)]
    mark(flag, bad, bad + WINDOW)


def removal_batches(it: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    """What is left of each document, or its digest alone."""
    for b in it:
        for i, j, data, off in steps(b["text"]):
            if len(data) > PART:  # one document
                inner = {0}
            else:
                code, doc, _, _, _ = anchors(data, off)
                order = np.lexsort((code, doc))  # a document that repeats a window has an anchor twice
                code, doc = code[order], doc[order]
                inner = set(doc[1:][(doc[1:] == doc[:-1]) & (code[1:] == code[:-1])].tolist())
            cols: list[list] = [[] for _ in range(5 if texts else 4)]
            for d, spans in enumerate(b["spans"].slice(i, j - i)):
                raw = data[off[d] : off[d + 1]]
                if not spans.is_valid and d not in inner:
                    kept, n, k = raw.tobytes(), 0, 0
                else:
                    flag = np.zeros(len(raw), bool)
                    if spans.is_valid:
                        mark(flag, *(spans.values.field(c).to_numpy().astype(np.int64) for c in ("at", "end")))
                    if d in inner:
                        inner_repeats(raw, flag)
                    kept, n, k = raw[~flag].tobytes(), int(flag.sum()), len(runs(flag)[0])
                for c, v in zip(cols, (len(raw), n, k, hashlib.sha256(kept).hexdigest(), kept), strict=False):
                    c.append(v)
            own = [b["doc_id"].slice(i, j - i), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=False))]
            yield pa.RecordBatch.from_arrays(own, REMOVED[: len(own)])


REMOVED = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, tid, spans) of the keyed docs that hold bytes of documents of smaller ids."""
    folder = scratch(docs.sparkSession.sparkContext)
    occ = earliest.occurrences(docs, anchor_batches, locate_batches, "edge int, right long, left long", folder)
    one = F.min(F.struct("id", "tid", "lo", "n_windows", "edge", "right", "left")).alias("one")
    first = stored(occ.groupBy("code", "ctx").agg(one).select("code", "ctx", F.col("one.id").alias("first"), "one.*"), f"{folder}/firsts")
    return earliest.spans(occ, first, repeats_of(docs, first, folder), WINDOW, folder)


def remove_substrings(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if texts, kept (the bytes) of every row of docs.

    Null and empty texts have no bytes; texts shorter than WINDOW keep all of theirs. Rows of equal ids don't count as
    earlier than each other, and a null id counts as the smallest. A repeated row is cut each time in the same way. A
    very long text is one step of a task. Other columns of docs don't come out, so their names can't clash.
    """
    docs = earliest.keyed(docs.select("doc_id", "text"))
    found = repeated_spans(docs)
    return docs.join(found, earliest.KEY, "left").select("doc_id", "text", "spans").mapInArrow(lambda it: removal_batches(it, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else ""))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated bytes, as digests."""
    return remove_substrings(table(spark, sf_dir, "documents"), texts=False)
