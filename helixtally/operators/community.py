"""Many species at once: which are there, which can be resolved, and three scopes of abundance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixtally.operators.database import restrict
from helixtally.operators.profile import Params, detectable_fraction, min_count, profile
from helixtally.operators.totals import with_totals

#: The floor of markers is relaxed for shallow species, to this share of itself at most.
LEAST_FLOOR = 0.25
RESOLVED, DETECTED, ABSENT = "resolved", "detected", "absent"


@dataclass(frozen=True)
class Gate:
    min_markers: int = 200
    min_fraction: float = 0.0
    min_detect: int = 10


def tier(present: Column, total: Column, reachable: Column, g: Gate) -> Column:
    """resolved, detected or absent, by how many of its specific markers a species shows."""
    r = F.greatest(F.least(F.greatest(reachable, F.lit(0.0)), F.lit(1.0)), F.lit(LEAST_FLOOR))
    floor, share = F.ceil(F.lit(float(g.min_markers)) * r), F.ceil(F.lit(max(g.min_fraction, 0.0)) * total * r)
    resolve = F.greatest(floor, share, F.lit(g.min_detect), F.lit(1))
    detect = F.least(F.lit(g.min_detect), resolve)
    return F.when(present >= resolve, RESOLVED).when(present >= detect, DETECTED).otherwise(ABSENT)


def species_specific(db: DataFrame, marker: str = "marker") -> DataFrame:
    """(species, marker): the markers that one species alone holds."""
    held = db.select("species", marker).distinct()
    alone = held.groupBy(marker).agg(F.count("*").alias("n"), F.min("species").alias("species")).where("n = 1")
    return alone.select("species", marker)


def filter_counters(db: DataFrame, marker: str = "marker") -> DataFrame:
    """(before, after, excluded_pct): how many markers the cross-species filter leaves."""
    held = db.select("species", marker).distinct().groupBy(marker).agg(F.count("*").alias("n"))
    out = held.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("before"), F.coalesce(F.sum((F.col("n") == 1).cast("long")), F.lit(0)).alias("after"))
    return out.withColumn("excluded_pct", F.when(F.col("before") > 0, 100.0 * (F.col("before") - F.col("after")) / F.col("before")).otherwise(0.0))


def species_gate(species: DataFrame, specific: DataFrame, sample: DataFrame, marker: str = "marker", params: Params = Params(), gate: Gate = Gate()) -> DataFrame:
    """(species, present_specific, total_specific, lambda, tier) of every row of species, those without markers too.

    lambda is the plain mean count over all of a species' specific markers.
    """
    total = specific.groupBy("species").agg(F.count("*").alias("total_specific"))
    seen = specific.join(sample.select(marker, "copies"), marker)
    by = seen.groupBy("species").agg(F.sum("copies").alias("observed"), F.sum((F.col("copies") >= 1).cast("long")).alias("once"), F.sum((F.col("copies") >= 2).cast("long")).alias("twice"))
    out = species.select("species").distinct().join(total, "species", "left").join(by, "species", "left").na.fill(0, ["total_specific", "observed", "once", "twice"])
    out = out.withColumn("lambda", F.when(F.col("total_specific") > 0, F.col("observed") / F.col("total_specific")).otherwise(0.0))
    least = min_count(F.col("lambda"), params.adaptive_singleton)
    out = out.withColumn("present_specific", F.when(least >= 2, F.col("twice")).otherwise(F.col("once")))
    reach = detectable_fraction(F.col("lambda")) if params.adaptive_floor else F.lit(1.0)
    return out.select("species", "present_specific", "total_specific", "lambda", tier(F.col("present_specific"), F.col("total_specific"), reach, gate).alias("tier"))


def community_profile(db: DataFrame, sample: DataFrame, species: DataFrame | None = None, unit: str = "unit", marker: str = "marker", params: Params = Params(), gate: Gate = Gate(), min_global: float = 0.0, cross_species_filter: bool = True) -> tuple[DataFrame, DataFrame]:
    """(calls, gates) of a sample against the databases of many species, in one job over all of them.

    calls: species, unit, abundance, coverage, support, depth, global_abundance, sample_fraction, species_abundance, n_markers.
    """
    specific = species_specific(db, marker)
    gates = species_gate(db if species is None else species, specific, sample, marker, params, gate)
    used = restrict(db, specific, "species", marker=marker) if cross_species_filter else db
    open_ = used.join(gates.where(F.col("tier") == RESOLVED).select("species"), "species", "left_semi")
    calls = profile(open_, sample, "species", unit=unit, marker=marker, params=params)
    if min_global > 0:
        calls, gates = trace_filter(calls, gates, min_global)
    return scopes(calls, sample), gates


def trace_filter(calls: DataFrame, gates: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Calls of at least this share of all depth; a resolved species that is left without calls is only detected."""
    judged = with_totals(calls, _total=F.sum("depth"))
    kept = judged.where((F.col("_total") <= 0) | (F.col("depth") / F.col("_total") >= least)).drop("_total")
    sum_ = F.sum("abundance").over(Window.partitionBy("species"))
    kept = kept.withColumn("abundance", F.when(sum_ > 0, F.col("abundance") / sum_).otherwise(F.col("abundance")))
    any_ = calls.agg((F.coalesce(F.sum("depth"), F.lit(0.0)) > 0).alias("_any"))
    left = kept.select("species").distinct().withColumn("_left", F.lit(True))
    out = gates.join(left, "species", "left").crossJoin(F.broadcast(any_))  # one row
    lost = (F.col("tier") == RESOLVED) & F.col("_left").isNull() & F.col("_any")
    return kept, out.withColumn("tier", F.when(lost, DETECTED).otherwise(F.col("tier"))).drop("_left", "_any")


def scopes(calls: DataFrame, sample: DataFrame) -> DataFrame:
    """calls with global_abundance (of all calls' depth), sample_fraction (of all tags) and species_abundance."""
    totals = calls.agg(F.sum("depth").alias("_depth")).crossJoin(sample.agg(F.sum("copies").alias("_tags")))  # one row each
    out = calls.crossJoin(F.broadcast(totals))
    out = out.withColumn("global_abundance", F.when(F.col("_depth") > 0, F.col("depth") / F.col("_depth")).otherwise(0.0))
    out = out.withColumn("sample_fraction", F.when(F.col("_tags") > 0, F.col("depth") * F.col("n_markers") / F.col("_tags")).otherwise(0.0))
    out = out.withColumn("species_abundance", F.sum("global_abundance").over(Window.partitionBy("species")))
    rest = [c for c in calls.columns if c != "n_markers"]
    return out.select(*rest, "global_abundance", "sample_fraction", "species_abundance", "n_markers")


def tier_tally(gates: DataFrame) -> DataFrame:
    return gates.groupBy("tier").agg(F.count("*").alias("n"))


def coverage_of_sample(calls: DataFrame, sample: DataFrame) -> DataFrame:
    """(total_tags, classified_pct, unclassified_pct): how much of the sample the calls account for."""
    mass = calls.agg(F.coalesce(F.sum(F.col("depth") * F.col("n_markers")), F.lit(0.0)).alias("mass"))
    out = mass.crossJoin(sample.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("total_tags")))  # one row each
    pct = F.when(F.col("total_tags") > 0, 100.0 * F.col("mass") / F.col("total_tags")).otherwise(0.0)
    return out.select("total_tags", F.least(pct, F.lit(100.0)).alias("classified_pct"), F.greatest(100.0 - pct, F.lit(0.0)).alias("unclassified_pct"))
