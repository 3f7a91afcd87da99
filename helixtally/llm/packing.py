"""Best-fit packing: a grouping genetic algorithm on islands, over shards of documents.

A chromosome is a grouping of a shard's pieces into sequences. Crossover injects whole well-filled sequences of one
parent into the other, removes the sequences that hold a duplicate, and best-fits the displaced pieces. Each shard is
evolved on several islands; after each epoch an island's elite moves to the next one. Pieces in loosely filled
sequences are pooled over all shards and evolved once more.
"""

from __future__ import annotations

import bisect
import math
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table
from .tokens import byte_letters, vocabulary_path

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
#: Pieces in a shard on average; islands per shard; epochs; chromosomes per island; children per epoch.
SHARD, ISLANDS, EPOCHS, POPULATION, CHILDREN = 4096, 3, 2, 4, 6
#: Sequences filled less than this are pooled for the second pass.
TIGHT = 0.985
#: Entries of a worker's cache of encoded words; it starts afresh when full.
CACHE = 600_000
#: Letters that compose with nothing and have one lower-case form each, and marks that the tokenizer splits from them.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")
#: From a byte to the letter that stands for it in the vocabulary.
LETTERS = {b: x for b, x in enumerate(byte_letters())}
#: Characters that Python takes for white space and the tokenizer does not.
UNLIKE = ("\x1c", "\x1d", "\x1e", "\x1f")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins letters over it, so a text is encoded word by word; each distinct
    word goes through the tokenizer once while it stays in the cache.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.cache: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of some texts."""
        out = self.batch(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in out]

    def learn(self, new: list[str]) -> None:
        """Put words into the cache; a plain word and the marks behind it are looked up apart, the word in lower case."""
        parts, cache, odd = self.parts, self.cache, []
        for w in new:
            if (m := PLAIN.fullmatch(w)) is None:
                odd.append(w)
                continue
            a, b = m[1].lower(), m[2]
            ids = parts.get(a)
            if ids is None:  # one pre-token, so the vocabulary's merges are all there is to do
                ids = parts[a] = array("I", [t.id for t in self.merge(a.encode().decode("latin-1").translate(LETTERS))]).tobytes()
            if b:
                marks = parts.get(b)
                if marks is None:
                    marks = parts[b] = self.encode([b])[0]
                ids += marks
            cache[w] = ids
        for i in range(0, len(odd), 20_000):
            cache.update(zip(odd[i : i + 20_000], self.encode(odd[i : i + 20_000]), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) >= CACHE:
            self.cache.clear()
        if len(self.parts) >= CACHE:
            self.parts.clear()
        get = self.cache.get
        words = [t.split() for t in texts]
        got = [list(map(get, ws)) for ws in words]
        self.learn(list({ws[i] for ws, g in zip(words, got, strict=True) for i, x in enumerate(g) if x is None}))
        out = []
        for t, ws, g in zip(texts, words, got, strict=True):
            if any(c in t for c in UNLIKE):
                out += self.encode([t])
            else:
                out.append(b"".join([get(w) if x is None else x for w, x in zip(ws, g, strict=True)]))
        return out


_encoders: dict[str, Encoder] = {}


def piece_batches(path: Callable[[], str], capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(it):
        encoder = _encoders.setdefault(path(), Encoder(path())) if path() not in _encoders else _encoders[path()]
        for b in it:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rows = []
                for doc, ids in zip(part["doc_id"].to_pylist(), encoder([t or "" for t in part["text"].to_pylist()]), strict=True):
                    ids += b"\0\0\0\0"
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces_of(docs: DataFrame, path: Callable[[], str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every document's ids and the id 0 after them, cut at capacity.

    A null or empty text is the id 0 alone; null ids and repeated rows are packed like others. A very long text is cut in
    the task that encodes it. Other columns of docs don't come out, so their names can't clash.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(piece_batches(path or vocabulary_path(TOKENIZER), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- the genetic algorithm, over one shard's lengths in descending order ---


def best_fit(order: np.ndarray, lengths: list[int], bins: np.ndarray, loads: list[int], capacity: int) -> None:
    """Put each item of `order` into the fullest bin that holds it, or a new one; changes bins and loads."""
    spare = sorted((capacity - x, i) for i, x in enumerate(loads) if x < capacity)
    for item in order.tolist():
        size = lengths[item]
        k = bisect.bisect_left(spare, (size, -1))
        if k < len(spare):
            left, b = spare.pop(k)
        else:
            left, b = capacity, len(loads)
            loads.append(0)
        loads[b] += size
        bins[item] = b
        if left > size:
            bisect.insort(spare, (left - size, b))


def fitness(loads: np.ndarray, capacity: int) -> float:
    """Fewer bins first, then uneven fill, which leaves room to empty a bin."""
    return -len(loads) + float(np.square(loads / capacity).mean() if len(loads) else 0)


def renumber(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def first_of(lengths: np.ndarray, rng, capacity: int) -> np.ndarray:
    """Best fit in descending order, or (with rng) in an order near it."""
    order = np.argsort(-lengths * (rng.uniform(0.85, 1.15, len(lengths)) if rng else 1), kind="stable")
    bins = np.zeros(len(lengths), np.int32)
    best_fit(order, lengths.tolist(), bins, [], capacity)
    return bins


def cross(one: np.ndarray, two: np.ndarray, lengths: np.ndarray, rng, capacity: int) -> np.ndarray:
    """A child of two: whole well-filled bins of `one` in `two`; what they displace is best-fitted."""
    loads = np.bincount(one, lengths).astype(np.int64)
    full = np.flatnonzero(loads >= np.quantile(loads, 0.5))
    taken = np.zeros(len(loads), bool)
    taken[rng.choice(full, max(1, len(full) // 2), replace=False)] = True
    inside = taken[one]
    broken = np.zeros(int(two.max()) + 1, bool)
    broken[two[inside]] = True
    other = np.bincount(two, lengths).astype(np.int64)  # each generation also breaks up some loose bins
    loose = np.flatnonzero(other < 0.97 * capacity)
    broken[rng.choice(loose, min(len(loose), 1 + len(loose) // 4), replace=False)] = True
    child = np.where(inside, one + len(other), two)
    lost = np.flatnonzero(~inside & broken[two])
    kept = np.ones(len(child), bool)
    kept[lost] = False
    child[kept] = renumber(child[kept])
    held = np.bincount(child[kept], lengths[kept]).astype(np.int64).tolist() if kept.any() else []
    best_fit(lost, lengths.tolist(), child, held, capacity)  # lengths fall with the index, so lost does too
    return renumber(child)


def evolve(lengths: np.ndarray, population: list[np.ndarray], seed: int, children: int, size: int, capacity: int) -> list[np.ndarray]:
    """The population after some children, the fittest first."""
    rng = np.random.default_rng(seed)
    while len(population) < size:
        population = [*population, first_of(lengths, rng if population or seed % 2 else None, capacity)]
    rate = lambda c: fitness(np.bincount(c, lengths), capacity)
    ranked = sorted(((rate(c), i, c) for i, c in enumerate(population)), key=lambda x: (-x[0], x[1]))[:size]
    least = math.ceil(int(lengths.sum()) / capacity)
    for n in range(children if len(lengths) > 1 else 0):
        if int(ranked[0][2].max()) + 1 <= least:
            break
        a, b = rng.choice(len(ranked), 2, replace=False) if len(ranked) > 1 else (0, 0)
        child = cross(ranked[a][2], ranked[b][2], lengths, rng, capacity)
        ranked = sorted([*ranked, (rate(child), size + n, child)], key=lambda x: (-x[0], x[1]))[:size]
    return [c for _, _, c in ranked]


def epoch_batches(epoch: int, children: int, size: int, capacity: int):
    def run(it):
        for b in it:
            for r in b.to_pylist():
                lengths = np.array(r["lengths"], np.int64)
                population = [np.frombuffer(x, np.int32) for x in (r["population"] or []) + ([r["migrant"]] if r["migrant"] else [])]
                seed = (r["shard"] * 8191 + r["island"] * 2 + epoch) * 2 + (r["island"] > 0)
                population = evolve(lengths, population, seed, children, size, capacity)
                fit = fitness(np.bincount(population[0], lengths), capacity)
                cols = [[r["shard"]], [r["island"]], [r["uids"]], [r["lengths"]], [[p.astype(np.int32).tobytes() for p in population]], [None], [fit]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary(), pa.float64()), strict=True)], ["shard", "island", "uids", "lengths", "population", "migrant", "fit"])

    return run


def place_batches(it):
    """(uid, shard, bin, offset, load) of each piece of a shard's best grouping."""
    for b in it:
        for r in b.to_pylist():
            lengths, bins = np.array(r["lengths"], np.int64), np.frombuffer(r["best"], np.int32)
            order = np.lexsort((np.arange(len(bins)), bins))
            before = np.cumsum(lengths[order]) - lengths[order]
            first = np.flatnonzero(np.diff(bins[order], prepend=-1))
            offset = before - np.repeat(before[first], np.diff(np.append(first, len(order))))
            load = np.bincount(bins, lengths).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(r["uids"], np.int64)[order]), pa.array(np.full(len(order), r["shard"], np.int64)), pa.array(bins[order].astype(np.int64)), pa.array(offset), pa.array(load[bins[order]])], ["uid", "shard", "bin", "offset", "load"])


STATE = "shard long, island int, uids array<long>, lengths array<long>, population array<binary>, migrant binary, fit double"


def evolve_pool(pool: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(uid, shard, bin, offset, load) for a settled pool of (uid, length): one evolved grouping per shard."""
    spark = pool.sparkSession
    shards = max(1, math.ceil(pool.count() / shard))
    tasks = min(shards * islands, 4 * spark.sparkContext.defaultParallelism + shards * islands // 8)
    groups = pool.groupBy(F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard")).agg(F.sort_array(F.collect_list(F.struct("length", "uid")), asc=False).alias("x"))
    state = groups.select("shard", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), F.col("x.uid").alias("uids"), F.col("x.length").alias("lengths"), F.lit(None).cast("array<binary>").alias("population"), F.lit(None).cast("binary").alias("migrant"))
    for epoch in range(epochs):
        if epoch:
            elite = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("population")[0].alias("migrant"))
            state = state.drop("migrant", "fit").join(elite, ["shard", "island"]).select("shard", "island", "uids", "lengths", "population", "migrant")
        state = settle(state.repartition(tasks, "shard", "island").mapInArrow(epoch_batches(epoch, CHILDREN, POPULATION, capacity), STATE))
    best = state.groupBy("shard").agg(F.max_by(F.struct("uids", "lengths", F.col("population")[0].alias("best")), F.struct("fit", "island")).alias("x")).select("shard", "x.*")
    return best.mapInArrow(place_batches, "uid long, shard long, bin long, offset long, load long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with length) and their sequence_id, offset and n_in_sequence's load (sequence_length).

    No piece may be longer than capacity; an empty table gives no rows. Of bins that fit equally well the first takes a
    piece, and of equally good groupings that of the last island counts; the numbers of sequences may be any. pieces must
    have no columns named uid, sequence_id, offset or sequence_length.
    """
    held = settle(pieces.withColumn("uid", F.monotonically_increasing_id()))
    full = held.where(F.col("length") >= capacity).select("uid", (F.col("uid") * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("sequence_length"))
    placed, pool = full, held.where(F.col("length") < capacity).select("uid", "length")
    for k in (1, 2):
        got = settle(evolve_pool(pool, capacity))
        tight = F.col("load") >= (TIGHT * capacity if k == 1 else 0)
        placed = placed.unionByName(got.where(tight).select("uid", ((F.col("shard") * (1 << 20) + F.col("bin")) * 4 + k).alias("sequence_id"), "offset", F.col("load").alias("sequence_length")))
        if k == 1:
            pool = settle(pool.join(got.where(~tight).select("uid"), "uid", "left_semi"))
    return held.join(placed, "uid").drop("uid")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens at most."""
    return pack(pieces_of(table(spark, sf_dir, "documents"))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
