"""The corpus pipeline: quality rules, near-dedup, passage dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. A row goes through the stages as a struct beside its key, so
that columns of documents may have any names. A document is told apart by id and text: rows without an id, or that share
one, are judged each by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixtally.llm import decontamination, earliest, neardup, packing, passages, quality
from helixtally.llm.common import table
from helixtally.sources.store import discard, scratch, stored

KEY = earliest.KEY


def rows_of(docs: DataFrame) -> DataFrame:
    """(id, tid, doc_id, text, row): the key of each document, what the operators read, and the whole row."""
    return earliest.keyed(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the vote posterior reject go."""
    return quality.judge(docs.select("text", F.struct(*docs.columns).alias("row")), without=("text",)).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the least id (a repeated row of it once)."""
    rows = rows_of(docs)
    groups = neardup.groups(rows.select(*KEY, "text"))
    kept = groups.where(neardup.node("id", "tid") == F.col("component")).select(*KEY).distinct()
    return rows.join(kept, KEY, "left_semi").dropDuplicates(KEY).select("row.*")


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; documents that lose all their words go too."""
    cut = passages.remove_passages(docs, row=True).where("n_words > n_removed")
    fresh = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return cut.select(*[fresh.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go."""
    rows = rows_of(docs)
    found = decontamination.contamination(rows.select("doc_id", "text", *KEY), table(spark, sf_dir, "benchmark"), beside=tuple(KEY)).where("contaminated").select(*KEY)
    return rows.join(found, KEY, "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences."""
    return packing.pack(packing.pieces_of(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("substring dedup", passage_dedup), ("benchmark decontamination", decontaminate), ("best-fit packing", pack)]
#: The posterior of the quality stage and the packing have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again; a stage's table goes after the next."""
    sc = spark.sparkContext
    folder = scratch(sc, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{k}")
        if k:
            discard(sc, f"{folder}/{k - 1}")
    return docs
