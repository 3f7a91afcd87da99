"""Accuracy of a predicted composition against a known one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixtally.sources.store import settle


def ratio(a: Column, b: Column, undefined: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(undefined)


def scores(df: DataFrame, undefined: float = 0.0) -> DataFrame:
    """df (tp, fp, fn) with precision, recall and f1, `undefined` where a denominator is 0."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    out = df.withColumn("precision", ratio(tp, tp + fp, undefined)).withColumn("recall", ratio(tp, tp + fn, undefined))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", ratio(2 * p * r, p + r, undefined))


def evaluate(predicted: DataFrame, truth: DataFrame, present: float = 0.01, undefined: float = 0.0) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1, l1 and bray_curtis of two tables (name, abundance).

    Presence is an abundance of `present` or more; the distances use all abundances. undefined: ratios of denominator 0.
    """
    both = predicted.select("name", F.col("abundance").alias("p")).join(truth.select("name", F.col("abundance").alias("t")), "name", "full_outer").na.fill(0.0, ["p", "t"])
    p, t = F.col("p") >= present, F.col("t") >= present
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = both.agg(n(p & t).alias("tp"), n(p & ~t).alias("fp"), n(~p & t).alias("fn"), F.coalesce(F.sum(F.abs(F.col("p") - F.col("t"))), F.lit(0.0)).alias("l1"), F.sum(F.col("p") + F.col("t")).alias("mass"))
    return scores(out, undefined).select("tp", "fp", "fn", "precision", "recall", "f1", "l1", ratio(F.col("l1"), F.col("mass"), undefined).alias("bray_curtis"))


def species_max(calls: DataFrame, value: str, *keys: str) -> DataFrame:
    """The largest value of a species' clusters."""
    return calls.groupBy(*keys, "species").agg(F.max(value).alias("value"))


def sweep(predicted: DataFrame, truth: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1) summed over samples.

    predicted: (sample, species, value), one value each; truth: (sample, species), in which a null sample stands for those
    that have no rows of their own; thresholds: (threshold). Such samples are not paired with the common species: what they
    miss is what all of them could have less what they hit. Values and thresholds are summed by value before they meet;
    a threshold's hits are the sum of all values from it on, so rows are not multiplied by thresholds.
    """
    samples = predicted.select("sample").distinct()
    own = truth.where("sample IS NOT NULL").select("sample", "species").distinct()
    common = truth.where("sample IS NULL").select("species").distinct()
    without = samples.join(own.select("sample").distinct(), "sample", "left_anti")
    could = without.count() * common.count()
    known = own.join(samples, "sample", "left_semi").withColumn("known", F.lit(1))
    held = predicted.select("sample", "species", "value")
    mine = held.join(without, "sample", "left_anti").join(known, ["sample", "species"], "full_outer")
    rest = held.join(without, "sample", "left_semi").join(common.withColumn("known", F.lit(1)), "species", "left")
    n = lambda c: F.sum(c.cast("long"))
    real = F.col("known").isNotNull()
    could = could + (mine.agg(n(real)).first()[0] or 0)  # all that is there to be hit
    tally = mine.unionByName(rest, allowMissingColumns=True).where("value IS NOT NULL").groupBy(F.col("value").alias("at")).agg(n(real).alias("tp"), n(~real).alias("fp"))
    zero = F.lit(0).cast("long")
    both = tally.select("at", "tp", "fp", F.lit(False).alias("asked")).unionByName(thresholds.select(F.col("threshold").cast("double").alias("at")).distinct().select("at", zero.alias("tp"), zero.alias("fp"), F.lit(True).alias("asked")))
    sums = running(both, "at", "tp", "fp").where("asked")
    return scores(sums.select(F.col("at").alias("threshold"), "tp", "fp", (F.lit(could) - F.col("tp")).alias("fn")))


def running(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """rows with each column summed over all rows of an equal or a larger `by`.

    Rows are sorted into partitions of ranges; sums of whole partitions, a row each, are added to the sums inside them.
    """
    part = settle(rows.repartitionByRange(F.col(by)).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(F.desc(by))
    totals = part.groupBy("part").agg(F.min(by).alias("low"), *(F.sum(c).alias(c) for c in columns))
    above = Window.orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    totals = totals.select("part", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"above_{c}") for c in columns))
    out = part.withColumns({c: F.sum(c).over(inside) for c in columns}).join(F.broadcast(totals), "part")
    return out.select(*(c for c in rows.columns if c not in columns), *((F.col(c) + F.col(f"above_{c}")).cast("long").alias(c) for c in columns))
