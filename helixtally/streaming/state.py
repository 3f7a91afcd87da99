"""Profiles as state: each sample's panel tallies, brought up to date as its reads arrive, and not recounted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from helixtally.operators import database, profile
from helixtally.sources.store import discard

#: Markers of a slice of a panel, or of the short panels of a part, about: together they are a key of the state, whose value one task holds.
SLICE = 4096
#: Tags that a task holds before it sums them up.
HELD = 1 << 20
#: How a key's places, markers and copies are stored.
KINDS = ("<i4", "<i8", "<i8")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PanelTally(StatefulProcessor):
    """How often each marker of each panel of a part has been seen, as state; out comes, of the panels that were met, how many
    markers have been seen how often. A panel is its place in its part."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "places binary, markers binary, copies binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [[np.frombuffer(x, kind) for x, kind in zip(self.seen.get(), KINDS, strict=True)]] if self.seen.exists() else []
        new = [[np.frombuffer(x, kind) for x, kind in zip(row, KINDS, strict=True)] for pdf in rows for row in zip(pdf["place"], pdf["marker"], pdf["copies"], strict=True)]
        met = np.unique(np.concatenate([x[0] for x in new]))
        place, marker, total = summed(*map(np.concatenate, zip(*held, *new, strict=True)))
        self.seen.update(tuple(x.astype(kind).tobytes() for x, kind in zip((place, marker, total), KINDS, strict=True)))
        some = np.isin(place, met)
        place, value, m = summed(place[some], total[some], np.ones(int(some.sum()), np.int64))
        yield pd.DataFrame({**dict(zip(self.names, key, strict=True)), "place": place.astype(np.int32), "copies": value.astype(np.int64), "m": m.astype(np.int64)})

    def close(self) -> None:
        pass

    def __init__(self, names: list[str]):
        self.names = names


def summed(one: np.ndarray, two: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of one and two, in order, with the sums of n."""
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    start = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
    return one[start], two[start], np.add.reduceat(n[order], start)


def combined(tags: DataFrame, *by: str) -> DataFrame:
    """(by, marker, copies): the tags of each HELD rows of a task, summed up before they are shuffled."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def added(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
            return pa.Table.from_batches(held).group_by([*by, "marker"]).aggregate([([], "count_all")]).rename_columns([*by, "marker", "copies"]).to_batches()

        held, n = [], 0
        for b in it:
            held.append(b)
            n += b.num_rows
            if n >= HELD:
                yield from added(held)
                held, n = [], 0
        if held:
            yield from added(held)

    kinds = dict(tags.dtypes)
    return tags.select(*by, "marker").where("marker IS NOT NULL").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in (*by, "marker")) + ", copies long")


def packed(met: DataFrame, *keys: str) -> DataFrame:
    """met (keys, place, marker, copies) with the rows of a key in each HELD rows of a task as one, of bytes: every row that a
    state's processor is given costs far more than what is in it.
    """
    values = ("place", "marker", "copies")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            codes = [pc.dictionary_encode(t[c].combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in keys]
            order = np.lexsort(codes)
            new = np.append(True, np.zeros(len(order) - 1, bool))
            for c in codes:
                new[1:] |= c[order[1:]] != c[order[:-1]]
            start = np.flatnonzero(new)
            out = t.select(keys).take(pa.array(order[start]))
            for c, kind in zip(values, KINDS, strict=True):
                x = t[c].to_numpy()[order].astype(kind)
                off = (np.append(start, len(order)) * x.itemsize).astype(np.int32)
                out = out.append_column(c, pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(x)]))
            return out.to_batches()

        held, n = [], 0
        for b in it:
            held, n = [*held, b] if b.num_rows else held, n + b.num_rows
            if n >= HELD:
                yield from put(held)
                held, n = [], 0
        if held:
            yield from put(held)

    kinds = dict(met.dtypes)
    return met.select(*keys, *values).mapInArrow(run, ", ".join([f"{c} {kinds[c]}" for c in keys] + [f"{c} binary" for c in values]))


def dealt(panels: DataFrame, *scope: str, slice_size: int = SLICE) -> DataFrame:
    """(scope, unit, part, place, slices): a scope's panels in parts of about slice_size markers, a long panel in slices of a part."""
    n = F.sum(F.least("panel_n", F.lit(slice_size))).over(Window.partitionBy(*scope) if scope else Window.partitionBy(F.lit(0)))
    parts = F.greatest(F.ceil(n / slice_size), F.lit(1))
    out = panels.select(*scope, "unit", F.greatest(F.ceil(F.col("panel_n") / slice_size), F.lit(1)).alias("slices"), F.pmod(F.xxhash64("unit"), parts).alias("part"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*scope, "part").orderBy("unit")))


def tallies(tags: DataFrame, db: DataFrame, panels: DataFrame, *scope: str, by: tuple[str, ...] = (), slice_size: int = SLICE) -> DataFrame:
    """(by, scope, unit, slice, copies, m): of each slice that a trigger's tags touch, the tally of all tags so far.

    tags: a stream of (by, marker), a row an occurrence; db: (scope, unit, marker, is_unique[, usable]), markers as long;
    panels: (scope, unit, panel_n), computed once (a table or a checkpoint). A stored database (`tables.stored_database`)
    isn't shuffled. A key of the state is a slice of a part: of a long panel, or of many short ones, which would cost a key
    each. How panels are dealt follows from their sizes alone, so a database must stay the same for as long as the state is kept.
    """
    keys, sized = [*by, *scope, "part", "slice"], dealt(panels, *scope, slice_size=slice_size)
    met = combined(tags, *by).join(database.unique_markers(db).select(*scope, "unit", "marker"), "marker").join(sized, [*scope, "unit"])
    met = met.withColumn("slice", F.pmod(F.xxhash64("marker"), F.col("slices")).cast("int"))
    kinds = dict(met.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", place int, copies long, m long"
    out = packed(met, *keys).groupBy(*keys).transformWithStateInPandas(PanelTally(keys), schema, "update", "none")
    return out.join(sized.drop("slices"), [*scope, "part", "place"]).select(*by, *scope, "unit", "slice", "copies", "m")


def snapshots(spark: SparkSession, out: str) -> list[int]:
    """The numbers of the snapshots that are whole, in order."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(out)
    fs = where.getFileSystem(sc._jsc.hadoopConfiguration())
    found = [x.getPath() for x in fs.listStatus(where)] if fs.exists(where) else []
    done = lambda p: fs.exists(sc._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(p.getName()) for p in found if p.getName().isdigit() and done(p))


def keep(touched: DataFrame, out: str, checkpoint: str) -> None:
    """Run the stream of `tallies` over all that is there, and keep the tallies of all slices as a table at out.

    A trigger's slices replace those of the snapshot before it, in a snapshot of its own, which a repeated trigger
    overwrites. The last two stay. Snapshots hold a row per slice and distinct count: the markers stay in the state.
    """
    spark, names = touched.sparkSession, [c for c in touched.columns if c not in ("copies", "m")]

    def put(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        before = [n for n in snapshots(own, out) if n < number]
        batch = batch.persist()
        try:
            rows = batch
            if before:
                old = own.read.schema(batch.schema).parquet(f"{out}/{before[-1]}")
                rows = rows.unionByName(old.join(batch.select(*names).distinct(), names, "left_anti"))
            rows.write.mode("overwrite").parquet(f"{out}/{number}")
        finally:
            batch.unpersist()
        for n in before[:-1]:
            discard(own.sparkContext, f"{out}/{n}")

    provider = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        run = touched.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(PROVIDER) if provider is None else spark.conf.set(PROVIDER, provider)
    run.awaitTermination()


def stats(spark: SparkSession, out: str, panels: DataFrame, *scope: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The panel statistics of everything that has arrived, (by, scope, unit, ...), of the units of which any marker has."""
    keys = [*by, *scope, "unit"]
    tally = spark.read.parquet(f"{out}/{snapshots(spark, out)[-1]}").groupBy(*keys, "copies").agg(F.sum("m").alias("m"))
    sized = panels.select(*scope, "unit", "n_markers", "panel_n")
    return profile.filled(profile.sums_of(tally, *keys).join(sized, [*scope, "unit"]), *keys)


def profiles(spark: SparkSession, out: str, panels: DataFrame, *scope: str, by: tuple[str, ...] = (), params: profile.Params = profile.Params()) -> DataFrame:
    """The profiles of everything that has arrived: (by, scope, unit, abundance, coverage, support, depth, n_markers)."""
    return profile.calls_of(stats(spark, out, panels, *scope, by=by), *by, *scope, params=params)
