"""DNA from the text tables: a word is its md5 in bases, a sentence a contig, a document a genome, a language a species."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixtally.functions.dna import Enzyme, enzyme
from helixtally.operators import digest

#: The enzyme of the queries over documents: it cuts every 512 bases or so.
CUTTER = enzyme("BslFI")
#: Hexadecimal digits, and the bases that they stand for.
LETTERS = ("0123456789abcdef", "ACGTACGTACGTACGT")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digits(sentence: Column) -> Column:
    words = F.filter(F.split(sentence, " ", -1), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.md5(w.cast("binary"))), "")


def bases(sentence: Column) -> Column:
    return F.translate(digits(sentence), *LETTERS)


def sequences(spark: SparkSession, sf_dir: str, of=bases) -> DataFrame:
    """(species, gid, seq) of documents; of: bases, or the digits that stand for them."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("species"), F.col("doc_id").alias("gid"), F.explode(F.split("text", r"\. ", -1)).alias("s"))
    return docs.select("species", "gid", of(F.col("s")).alias("seq"))


def small_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, seq) of conversations."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split("text", r"\. ", -1)).alias("s"))
    return turns.select("conv_id", "turn", bases(F.col("s")).alias("seq"))


def genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(species, gid, n_contigs) of documents that have any: sentences with a word are contigs."""
    n = F.size(F.filter(F.split("text", r"\. ", -1), lambda s: F.translate(s, " ", "") != ""))
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("species"), F.col("doc_id").alias("gid"), n.cast("long").alias("n")).groupBy("species", "gid").agg(F.sum("n").alias("n_contigs")).where("n_contigs > 0")


def genome_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(species, gid) of documents that have a contig: what is left of them without the ends of sentences is not blank."""
    some = F.trim(F.replace("text", F.lit(". "), F.lit(""))) != ""
    return table(spark, sf_dir, "documents").where(some).select(F.col("lang").alias("species"), F.col("doc_id").alias("gid")).distinct()


def genome_markers(spark: SparkSession, sf_dir: str, e: Enzyme = CUTTER) -> DataFrame:
    """(species, gid, marker, copies): markers are canonical tags."""
    tagged = digest.digest(sequences(spark, sf_dir, digits), [e], letters=LETTERS)  # translated as it is matched
    return digest.counts(tagged, "species", "gid").withColumnRenamed("tag", "marker")


def incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(species, unit, marker) from lineitem: suppliers hold parts."""
    item = table(spark, sf_dir, "lineitem")
    return item.select((F.col("l_suppkey") % 5).alias("species"), F.col("l_suppkey").alias("unit"), F.col("l_partkey").alias("marker")).distinct()


def sample(spark: SparkSession, sf_dir: str, held: DataFrame | None = None) -> DataFrame:
    """(marker, copies) of a mixture of all documents at depths of 0 to 6. held: genome_markers, if they are there."""
    depth = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("gid"), (F.char_length("text") % 7).alias("depth"))
    held = genome_markers(spark, sf_dir) if held is None else held
    return held.join(depth, "gid").groupBy("marker").agg(F.sum(F.col("copies") * F.col("depth")).alias("copies")).where("copies > 0")
