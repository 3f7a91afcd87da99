"""Two small made-up cases: a mixture of strains, and clusters of near-identical genomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixtally.operators import cluster, database, profile
from helixtally.sources.store import settle

CORE, PRIVATE, DEPTH, ERRORS = 200, 50, 30, 50
SHARES = {0: 0.7, 2: 0.3}


def strains(spark: SparkSession) -> DataFrame:
    """(unit, marker) of four strains: a common core and private markers."""
    core = spark.range(4).select(F.col("id").alias("k")).crossJoin(spark.range(CORE).select(F.col("id").alias("marker")))  # a fixed 800 rows
    own = spark.range(4 * PRIVATE).select(F.floor(F.col("id") / PRIVATE).alias("k"), (1000 + F.col("id")).alias("marker"))
    return core.unionByName(own).select(F.concat(F.lit("strain"), "k").alias("unit"), "marker")


def reads(spark: SparkSession) -> DataFrame:
    """(marker, copies) of two of the strains, and errors that are seen once."""
    share = F.when(F.col("unit") == "strain0", SHARES[0]).when(F.col("unit") == "strain2", SHARES[2])
    seen = strains(spark).withColumn("share", share).where("share IS NOT NULL").groupBy("marker").agg(F.sum(F.round(F.col("share") * DEPTH)).cast("long").alias("copies"))
    return seen.unionByName(spark.range(ERRORS).select((100_000 + F.col("id")).alias("marker"), F.lit(1).cast("long").alias("copies")))


def mixture(spark: SparkSession) -> DataFrame:
    """The calls of the mixture."""
    return profile.profile(database.build(strains(spark)), reads(spark))


def genomes(spark: SparkSession) -> DataFrame:
    """(gid, marker) of four genomes in two clades: a core, markers of each clade, and private ones."""
    parts = [(g, m) for g in range(4) for m in [*range(200), *range(200 + 100 * (g // 2), 240 + 100 * (g // 2)), *range(1000 + 10 * g, 1003 + 10 * g)]]
    return spark.createDataFrame(parts, "gid long, marker long")


def clusters(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The clades' membership, their marker classes, and the cluster database's panels."""
    held = genomes(spark)
    mem = settle(cluster.single_linkage(held.select("gid").distinct(), held, method="exact"))
    return mem, cluster.class_summary(cluster.classify(held, mem)), database.panels(cluster.cluster_db(held, held, mem))
