"""Digestion: sequences to tags, markers and counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from helixtally.functions.arrow import steps, strings
from helixtally.functions.dna import Cutter, Enzyme, canonical_cells, fnv64


def sites(sequences: DataFrame, enzymes: Sequence[Enzyme], seq: str = "seq", canonical: bool = True, places: bool = True, letters: tuple[str, str] | None = None) -> DataFrame:
    """One row per tag occurrence: the other columns of sequences, enzyme_id, pos (if places) and tag.

    A bag: enzymes of equal length that match the same place each give a row, and so does an enzyme that is named twice.
    pos counts bases from 0. Each sequence is read once in Arrow batches, whatever the number of enzymes, and matched in
    NumPy; nothing is shuffled. Null sequences have no tags. letters: characters of the sequences, and the bases they stand for.
    """
    keep = [c for c in sequences.columns if c != seq]
    added = [StructField("enzyme_id", IntegerType()), *([StructField("pos", LongType())] if places else []), StructField("tag", StringType())]
    cutter = Cutter(enzymes, letters)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, _, data, off in steps(b[seq]):
                chars = np.append(0, np.cumsum((data & 0xC0) != 0x80)) if places and (data >= 0x80).any() else None
                for enzyme_id, row, place, tags in cutter.sites(data, off):
                    if chars is not None:  # count characters, not bytes
                        place = chars[off[row] + place] - chars[off[row]]
                    at = pa.array(row + i)
                    cols = [pa.array(np.full(len(row), enzyme_id, np.int32)), *([pa.array(place.astype(np.int64))] if places else []), strings(canonical_cells(tags) if canonical else tags)]
                    yield pa.RecordBatch.from_arrays([*(b[c].take(at) for c in keep), *cols], [*keep, *(f.name for f in added)])

    return sequences.select(*keep, seq).mapInArrow(cut, StructType([*(sequences.schema[c] for c in keep), *added]))


def digest(sequences: DataFrame, enzymes: Sequence[Enzyme], seq: str = "seq", letters: tuple[str, str] | None = None) -> DataFrame:
    """One row per tag occurrence: the other columns of sequences, enzyme_id and canonical tag. See sites."""
    return sites(sequences, enzymes, seq, places=False, letters=letters)


def markers(tagged: DataFrame) -> DataFrame:
    """tagged with the 64-bit marker of each canonical tag."""
    return tagged.withColumn("marker", fnv64("tag"))


def counts(tagged: DataFrame, *keys: str, marker: str = "tag") -> DataFrame:
    """(keys, marker, copies)."""
    return tagged.groupBy(*keys, marker).agg(F.count("*").alias("copies"))


def distinct_markers(tagged: DataFrame, *keys: str, marker: str = "tag") -> DataFrame:
    return tagged.select(*keys, marker).distinct()


def single_copy(counted: DataFrame) -> DataFrame:
    """The markers that occur once, without the count."""
    return counted.where(F.col("copies") == 1).drop("copies")


def merge_counts(*counted: DataFrame) -> DataFrame:
    """The sums of several count tables of the same columns."""
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out.groupBy(*[c for c in out.columns if c != "copies"]).agg(F.sum("copies").alias("copies"))
