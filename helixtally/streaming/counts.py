"""Marker counts of reads that arrive as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixtally.functions.dna import Enzyme
from helixtally.operators.digest import counts, digest, merge_counts
from helixtally.sources import fastx


def stream_counts(sequences: DataFrame, enzymes: Sequence[Enzyme], *keys: str) -> DataFrame:
    """(keys, tag, copies) over a streaming (or batch) DataFrame with seq: the same counts, kept as running state."""
    return counts(digest(sequences.select(*keys, "seq"), enzymes), *keys)


def run_to_table(streamed: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """All that is there now, as the table `name` in memory, for tests and small states."""
    q = streamed.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return streamed.sparkSession.table(name)


def run_to_parquet(streamed: DataFrame, path: str, checkpoint: str) -> None:
    """The whole state after each trigger, for large states: each batch overwrites the table."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    streamed.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def reads_stream(spark: SparkSession, folder: str, schema: str = "seq string") -> DataFrame:
    """Reads from Parquet files as they come."""
    return spark.readStream.schema(schema).parquet(folder).select(F.col("seq"))


FILES = "path string, modificationTime timestamp, length long, content binary"


def count_files(spark: SparkSession, folder: str, enzymes: Sequence[Enzyme], out: str, checkpoint: str, per_batch: int = 100) -> DataFrame:
    """(enzyme_id, tag, copies) of the FASTA and FASTQ files that have arrived in a folder since the last call, and before.

    A batch of files is streamed into counts of its own, out/batch=.., which a repeated batch overwrites; their sum is the
    state. Only the names of a batch's files come to the driver.
    """

    def put(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.select("path").collect()]  # per_batch at most
        if paths:
            tagged = digest(fastx.read_sequences(batch.sparkSession, paths).select("seq"), enzymes)
            counts(tagged, "enzyme_id").write.mode("overwrite").parquet(f"{out}/batch={number}")

    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_batch).load(folder).select("path")
    files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return merge_counts(spark.read.parquet(out).drop("batch"))
