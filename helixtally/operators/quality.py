"""Genome quality: fragmented and incomplete assemblies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A kept genome with fewer than this share of the median number of markers is flagged.
FLAG_FRACTION = 0.5


def upper_median(genomes: DataFrame, *keys: str) -> DataFrame:
    """(keys, median): of n_tags, the upper one of an even number; ranks are counted over distinct values, so no list is built."""
    by = genomes.groupBy(*keys, "n_tags").agg(F.count("*").alias("n"))
    total = by.groupBy(*keys).agg(F.sum("n").alias("total"))
    from pyspark.sql import Window

    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("n_tags"))
    ranked = by.withColumn("upto", upto)
    ranked = ranked.join(total, list(keys)) if keys else ranked.crossJoin(F.broadcast(total))  # one row
    return ranked.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(*keys).agg(F.min("n_tags").alias("median"))


def assess(genomes: DataFrame, *keys: str, max_contigs: int | None = None, min_tag_fraction: float | None = None) -> DataFrame:
    """genomes (n_contigs, n_tags) with median, status (kept, flagged, dropped) and reason.

    Too many contigs is looked at before too few markers; the median is that of all genomes, dropped ones too; thresholds
    are cut to whole numbers.
    """
    median = upper_median(genomes, *keys)
    out = genomes.join(median, list(keys)) if keys else genomes.crossJoin(F.broadcast(median))  # one row
    contigs = F.col("n_contigs") > max_contigs if max_contigs is not None else F.lit(False)
    tags = F.col("n_tags") < F.floor(F.col("median") * min_tag_fraction) if min_tag_fraction is not None else F.lit(False)
    flagged = (F.col("median") > 0) & (F.col("n_tags") < F.floor(F.col("median") * FLAG_FRACTION))
    status = F.when(contigs | tags, "dropped").when(flagged, "flagged").otherwise("kept")
    reason = F.when(contigs, "contigs").when(tags, "completeness").when(flagged, "partial")
    return out.withColumn("status", status).withColumn("reason", reason)
