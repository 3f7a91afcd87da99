"""Exact top-k search by inner product over vector-approximation files.

Each component of a vector falls into one of at most CELLS cells, whose borders are quantiles of a bounded sample and whose
ends are exact. The file of cells, a byte a component, is scanned against the queries: the cells of a vector give a lower and
an upper bound of its score, and only vectors whose upper bound reaches the k-th lower bound stay. Those are read exactly
in the order of their bounds, a few at a time, until no unread bound reaches the k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, scratch, settle, stored, table

K, EVERY, SCALE = 5, 50, 256
CELLS = 256
#: Components of the sample that the borders come from, and bytes of queries that a task holds; neither decides a result.
SAMPLE, QUERY_BYTES = 1 << 22, 1 << 26
#: Vectors of a part of the file, and of a step inside a task.
PART, STEP, QUERY_STEP = 1 << 18, 4096, 256
#: Candidates that a task holds before it leaves out those that later bounds exclude.
HELD = 1 << 20
#: Relative error that a sum of products of doubles may have.
SLACK = 2.0**-40


def usable_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, vec) of the rows that take part; vec: floor(SCALE * x) of each component as little-endian doubles."""
    for b in it:
        v = b["v"]
        size = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = v.flatten().cast(pa.float64())  # without what stands under a null vector
        x = np.floor(SCALE * flat.to_numpy(zero_copy_only=False)) + 0.0  # null: NaN; minus zero: zero
        end = np.cumsum(size)
        bad = np.append(0, np.cumsum(~np.isfinite(x)))
        rows = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False) & (bad[end] == bad[end - size]) & b["vec_id"].is_valid().to_numpy(zero_copy_only=False))
        cells = [x[e - n : e].tobytes() for e, n in zip(end[rows].tolist(), size[rows].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b["vec_id"].take(pa.array(rows)), pa.array(cells, pa.binary())], ["vec_id", "vec"])


def matrix(col: pa.Array, kind=np.float64) -> np.ndarray:
    """The rows of a binary column of one width."""
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data.view(kind).reshape(n, -1) if len(data) else np.zeros((n, 0), kind)


def runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of rows that are equal in all columns."""
    n = len(columns[0])
    new = np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))[:n]
    at = np.append(np.flatnonzero(new), n).tolist()
    yield from zip(at[:-1], at[1:], strict=True)


def extremes(lengths: set[int]):
    """(size, at, low, high) of each batch, for vectors of these lengths."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            size = b["size"].to_numpy()
            for n in set(np.unique(size).tolist()) & lengths:
                x = matrix(b["vec"].take(pa.array(np.flatnonzero(size == n))))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, n), pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(x.min(axis=0)), pa.array(x.max(axis=0))], ["size", "at", "low", "high"])

    return run


class Cells:
    """The cells of vectors of one length: borders, and the least and greatest value in each cell of each component."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray):
        n = sample.shape[1]
        self.borders = [np.unique(np.quantile(sample[:, j], np.arange(1, CELLS) / CELLS, method="nearest")) for j in range(n)]
        self.low, self.high = np.zeros((n, CELLS)), np.zeros((n, CELLS))
        for j, b in enumerate(self.borders):
            self.low[j, : len(b) + 1] = np.append(low[j], b)
            self.high[j, : len(b) + 1] = np.append(b - 1, high[j])  # components are whole numbers
        self.high = np.maximum(self.low, self.high)
        self.middle, self.half = (self.low + self.high) / 2, (self.high - self.low) / 2
        self.most = np.maximum(np.abs(low), np.abs(high))

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, x[:, j], "right") for j, b in enumerate(self.borders)], axis=1).astype(np.uint8)


def cells_of(exact: DataFrame) -> dict[int, Cells]:
    """Cells by length, of the lengths that the sample has; vectors of others are few and are read exactly."""
    values = exact.agg(F.sum("size")).first()[0] or 0
    sample = exact.sample(min(1.0, SAMPLE / max(1, values)), 0).where("size > 0").select("size", "vec").toArrow().combine_chunks()
    size = sample["size"].to_numpy()
    lengths = set(np.unique(size).tolist())
    rows = exact.mapInArrow(extremes(lengths), "size int, at int, low double, high double").groupBy("size", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ends = rows.orderBy("size", "at").toPandas()  # as many as the sampled vectors have components
    vecs = pa.concat_arrays(sample["vec"].chunks) if sample.num_rows else None
    return {n: Cells(matrix(vecs.take(pa.array(np.flatnonzero(size == n)))), own["low"].to_numpy(), own["high"].to_numpy()) for n, own in ends.groupby("size")}


def cell_batches(held):
    """(size, rk, cells): the approximation file."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            size = b["size"].to_numpy()
            for n in np.unique(size).tolist():
                at = pa.array(np.flatnonzero(size == n))
                known = held.value.get(n)
                cells = [x.tobytes() for x in known.of(matrix(b["vec"].take(at)))] if known else [b""] * len(at)
                yield pa.RecordBatch.from_arrays([b["size"].take(at), b["rk"].take(at), pa.array(cells, pa.binary())], ["size", "rk", "cells"])

    return run


class Scan:
    """The candidates of some queries among the rows of cells that it gets."""

    def __init__(self, keys: np.ndarray, queries: np.ndarray, cells: Cells | None, keep: int):
        self.keys, self.queries, self.cells = keys, queries, cells
        self.top = np.full((len(keys), keep), -np.inf)
        self.found: list[tuple[np.ndarray, ...]] = []
        self.n = 0
        if cells is not None:
            self.size = np.abs(queries)
            self.slack = (self.size @ cells.most)[:, None] * SLACK

    def add(self, rk: np.ndarray, cells: np.ndarray) -> None:
        for i in range(0, len(rk), STEP):
            some, place = rk[i : i + STEP], np.arange(cells.shape[1])
            if self.cells is not None:
                middle, half = self.cells.middle[place, cells[i : i + STEP]].T, self.cells.half[place, cells[i : i + STEP]].T
            for q in range(0, len(self.keys), QUERY_STEP):
                own = slice(q, q + QUERY_STEP)
                if self.cells is None:
                    n = len(self.keys[own])
                    lower, upper = np.full((n, len(some)), -np.inf), np.full((n, len(some)), np.inf)
                else:
                    score, off = self.queries[own] @ middle, self.size[own] @ half + self.slack[own]
                    lower, upper = score - off, score + off
                keep = self.top.shape[1]
                best = lower if lower.shape[1] <= keep else np.partition(lower, lower.shape[1] - keep, axis=1)[:, -keep:]
                self.top[own] = np.sort(np.concatenate([self.top[own], best], axis=1), axis=1)[:, -keep:]
                row, col = np.nonzero(upper >= self.top[own, :1])
                self.found.append((row + q, some[col], lower[row, col], upper[row, col]))
                self.n += len(row)
            if self.n > HELD:
                before = self.n
                self.prune()
                if self.n > before // 2:  # nothing to gain: all of it goes on
                    yield from self.out()

    def prune(self) -> None:
        row, rk, lower, upper = (np.concatenate(x) for x in zip(*self.found, strict=True))
        stay = upper >= self.top[row, 0]
        self.found, self.n = [(row[stay], rk[stay], lower[stay], upper[stay])], int(stay.sum())

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            self.prune()
            row, rk, lower, upper = self.found[0]
            self.found, self.n = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(self.keys[row]), pa.array(rk), pa.array(lower), pa.array(upper)], ["qk", "rk", "lower", "upper"])


def scan_batches(held, keep: int):
    """Batches sorted by (part, size, kind), queries (kind 0: their vectors) before approximations (kind 1: cells)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, vecs, scan = None, [], [], None
        for b in it:
            part, size, kind, key = (b[c].to_numpy() for c in ("part", "size", "kind", "key"))
            for i, j in runs(part, size, kind):
                if (part[i], size[i]) != at:
                    if scan is not None:
                        yield from scan.out()
                    at, keys, vecs, scan = (part[i], size[i]), [], [], None
                if kind[i] == 0:
                    keys.append(key[i:j])
                    vecs.append(matrix(b["payload"].slice(i, j - i)).copy())
                elif keys:
                    if scan is None:
                        scan = Scan(np.concatenate(keys), np.concatenate(vecs), held.value.get(int(size[i])), keep)
                    yield from scan.add(key[i:j], matrix(b["payload"].slice(i, j - i), np.uint8))
        if scan is not None:
            yield from scan.out()

    return run


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers; beyond 64 bits, the nearest 64-bit number."""
    if not q.size:
        return np.zeros(len(q), np.int64)
    if (np.abs(q) * np.abs(c)).sum(axis=1).max() < 2.0**53:
        return (q * c).sum(axis=1).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    sums = (whole(q) * whole(c)).sum(axis=1)
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in sums], np.int64)


def exact_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(qk, rk, vec_id, score, same) of pairs with both vectors."""
    for b in it:
        size = b["size"].to_numpy()
        for n in np.unique(size).tolist():
            at = pa.array(np.flatnonzero(size == n))
            q, c = matrix(b["query"].take(at)), matrix(b["vec"].take(at))
            yield pa.RecordBatch.from_arrays([b["qk"].take(at), b["rk"].take(at), b["vec_id"].take(at), pa.array(product(q, c)), pa.array((q == c).all(axis=1))], ["qk", "rk", "vec_id", "score", "same"])


def candidates(exact: DataFrame, queries: DataFrame, keep: int, folder: str) -> DataFrame:
    """(qk, rk, upper, place): the vectors that may be among the `keep` best of each query, by their bounds.

    Queries meet the file in a grid: a task holds QUERY_BYTES of queries and streams a part of PART vectors past them, so
    that each is sent once for each part of the other.
    """
    sc = exact.sparkSession.sparkContext
    held = sc.broadcast(cells_of(exact))
    file = stored(exact.mapInArrow(cell_batches(held), "size int, rk long, cells binary"), f"{folder}/cells")
    n, (_, q_bytes) = exact.count(), queries.agg(F.count("*"), F.sum(F.octet_length("query"))).first()
    parts, rounds = max(2 * sc.defaultParallelism, -(-n // PART)), max(1, -(-int(q_bytes or 0) // QUERY_BYTES))
    part = lambda r, p: (r * parts + p).cast("int").alias("part")
    own = F.pmod("qk", F.lit(rounds))
    left = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), own.alias("r"), "size", "qk", "query").select(part(F.col("r"), F.col("p")), "size", F.lit(0).alias("kind"), F.col("qk").alias("key"), F.col("query").alias("payload"))
    right = file.select(F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("r"), F.pmod("rk", F.lit(parts)).alias("p"), "size", "rk", "cells").select(part(F.col("r"), F.col("p")), "size", F.lit(1).alias("kind"), F.col("rk").alias("key"), F.col("cells").alias("payload"))
    grid = left.unionByName(right).repartitionById(rounds * parts, F.col("part")).sortWithinPartitions("part", "size", "kind")
    found = grid.mapInArrow(scan_batches(held, keep), "qk long, rk long, lower double, upper double")
    by = Window.partitionBy("qk")
    nth = F.row_number().over(by.orderBy(F.desc("lower"), "rk"))
    found = found.withColumn("nth", nth).withColumn("least", F.max(F.when(F.col("nth") == keep, F.col("lower"))).over(by))
    found = found.where(F.col("least").isNull() | (F.col("upper") >= F.col("least")))
    out = stored(found.select("qk", "rk", "upper", F.row_number().over(by.orderBy(F.desc("upper"), "rk")).alias("place")), f"{folder}/candidates")
    discard(sc, f"{folder}/cells")
    return out


def refined(found: DataFrame, exact: DataFrame, queries: DataFrame, keep: int, folder: str) -> DataFrame:
    """(qk, vec_id, score, same, nth): the `keep` best vectors of each query, read in the order of their bounds.

    A round reads the next vectors of the queries that are open: a bound that is not read yet reaches their last score.
    """
    sc, done, upto, best, k = found.sparkSession.sparkContext, 0, 2 * keep, None, 0
    asked = found
    while True:
        pairs = asked.where((F.col("place") > done) & (F.col("place") <= upto)).select("qk", "rk").join(exact.select("rk", "vec_id", "vec"), "rk").join(queries, "qk")
        now = pairs.select("qk", "rk", "vec_id", "size", "query", "vec").mapInArrow(exact_batches, "qk long, rk long, vec_id long, score long, same boolean")
        now = now if best is None else best.drop("nth").unionByName(now)
        nth = F.row_number().over(Window.partitionBy("qk").orderBy(F.desc("score"), "vec_id", "rk"))
        best = stored(now.withColumn("nth", nth).where(F.col("nth") <= keep), f"{folder}/best{k}")
        if k:
            discard(sc, f"{folder}/best{k - 1}")
        last = best.where(F.col("nth") == keep).select("qk", F.col("score").alias("last"))
        open_ = found.where(F.col("place") == upto + 1).join(last, "qk", "left").where(F.col("last").isNull() | (F.col("upper") >= F.col("last"))).select("qk")
        open_ = settle(open_)
        if open_.isEmpty():
            return best
        asked, done, upto, k = found.join(open_, "qk", "left_semi"), upto, 4 * upto, k + 1


def search(rows: DataFrame, vector: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each row whose vec_id is divisible by `every`, itself left out.

    Components become floor(SCALE * x); the score is the inner product, and equal scores go by the smaller vec_id. Rows
    whose vector is null or holds a null or a number that is not finite take no part, nor do rows without a vec_id, which
    could neither ask nor be named. Vectors of different lengths are not compared; empty ones have a score of 0. Of rows
    that repeat, each is found, but they ask once; rows of one id and several vectors each ask, and find each other. A
    score beyond 64 bits is the nearest 64-bit number. Of equal vectors, only the k + 1 of the smallest ids go on, as no
    more can be among the best. Other columns of rows aren't read, so their names can't clash.
    """
    spark, keep = rows.sparkSession, k + 1
    folder = scratch(spark.sparkContext, "vectors")
    raw = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(usable_batches, "vec_id long, vec binary")
    size = (F.octet_length(F.col("vec")) / 8).cast("int").alias("size")
    first = raw.withColumn("nth", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("nth") <= keep)
    exact = stored(first.select("vec_id", "vec", size, F.monotonically_increasing_id().alias("rk")), f"{folder}/exact")
    asking = stored(raw.where(F.col("vec_id") % every == 0).distinct(), f"{folder}/asking")
    queries = stored(asking.select("vec").distinct().select(F.col("vec").alias("query"), size, F.monotonically_increasing_id().alias("qk")), f"{folder}/queries")
    best = refined(candidates(exact, queries, keep, folder), exact, queries, keep, folder)
    asking = asking.join(queries.select(F.col("query").alias("vec"), "qk"), "vec").select("qk", F.col("vec_id").alias("query_id"), F.monotonically_increasing_id().alias("ask"))
    pairs = asking.join(best, "qk")
    own = F.min(F.when(F.col("same") & (F.col("vec_id") == F.col("query_id")), F.col("nth"))).over(Window.partitionBy("ask"))  # one row of the query's own
    pairs = pairs.withColumn("own", own).where(F.col("own").isNull() | (F.col("nth") != F.col("own")))
    rank = (F.col("nth") - F.when(F.col("nth") > F.col("own"), 1).otherwise(0)).cast("int")
    out = settle(pairs.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k))
    discard(spark.sparkContext, folder)
    return out


def op12_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of every embedding whose id is divisible by 50."""
    return search(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, (row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id))::INT AS rank, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v) QUALIFY rank <= 5
"""
