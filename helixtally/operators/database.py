"""Marker databases: units (strains or clusters) and the markers that tell them apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixtally.operators.totals import with_totals


def degree(units: DataFrame, *scope: str, unit: str = "unit", marker: str = "marker") -> DataFrame:
    """(scope, marker, degree): how many units hold a marker."""
    return units.select(*scope, unit, marker).distinct().groupBy(*scope, marker).agg(F.count("*").alias("degree"))


def build(units: DataFrame, *scope: str, unit: str = "unit", marker: str = "marker") -> DataFrame:
    """A database of (scope, unit, marker) in which the markers of degree 1 are unique."""
    held = units.select(*scope, unit, marker).distinct()
    return held.join(degree(held, *scope, unit=unit, marker=marker), [*scope, marker]).select(*scope, unit, marker, "degree", (F.col("degree") == 1).alias("is_unique"))


def with_unique(db: DataFrame, unique: DataFrame, *scope: str, marker: str = "marker") -> DataFrame:
    """A database whose unique markers are given as (scope, marker).

    A scope without any falls back to the markers of degree 1.
    """
    db = db.drop("is_unique")
    named = unique.select(*scope, marker).distinct().withColumn("_named", F.lit(True))
    any_ = named.groupBy(*scope).agg(F.lit(True).alias("_any")) if scope else named.limit(1).agg((F.count("*") > 0).alias("_any"))
    out = db.join(named, [*scope, marker], "left")
    out = out.join(any_, list(scope), "left") if scope else out.crossJoin(F.broadcast(any_))  # one row
    is_unique = F.when(F.coalesce("_any", F.lit(False)), F.coalesce("_named", F.lit(False))).otherwise(F.col("degree") == 1)
    return out.withColumn("is_unique", is_unique).drop("_named", "_any")


def restrict(db: DataFrame, allowed: DataFrame, *scope: str, marker: str = "marker") -> DataFrame:
    """db with `usable`: whether a marker is allowed to quantify its unit."""
    mask = allowed.select(*scope, marker).distinct().withColumn("usable", F.lit(True))
    return db.drop("usable").join(mask, [*scope, marker], "left").withColumn("usable", F.coalesce("usable", F.lit(False)))


def unique_markers(db: DataFrame) -> DataFrame:
    """The rows that tell a unit from the others of its scope and that no mask excludes."""
    return db.where("is_unique AND usable") if "usable" in db.columns else db.where("is_unique")


def panels(db: DataFrame, *scope: str, unit: str = "unit", marker: str = "marker") -> DataFrame:
    """(scope, unit, n_markers, panel_n): all markers of a unit, unmasked, and those of its unique panel."""
    use = F.col("is_unique") & F.col("usable") if "usable" in db.columns else F.col("is_unique")
    return db.groupBy(*scope, unit).agg(F.count("*").alias("n_markers"), F.sum(use.cast("long")).alias("panel_n"))


def stats(db: DataFrame, *scope: str, unit: str = "unit", marker: str = "marker") -> DataFrame:
    """(scope, n_strains, n_markers, unique_markers, avg_markers_per_strain, unique_fraction), by degree, not by name."""
    per_marker = db.groupBy(*scope, marker).agg(F.count("*").alias("units"))
    by_marker = per_marker.groupBy(*scope).agg(F.count("*").alias("n_markers"), F.sum((F.col("units") == 1).cast("long")).alias("unique_markers"))
    by_unit = db.groupBy(*scope, unit).agg(F.count("*").alias("m")).groupBy(*scope).agg(F.count("*").alias("n_strains"), F.avg("m").alias("avg_markers_per_strain"))
    out = by_unit.join(by_marker, list(scope)) if scope else by_unit.crossJoin(by_marker)  # one row each
    return out.select(*scope, "n_strains", "n_markers", "unique_markers", "avg_markers_per_strain", (F.col("unique_markers") / F.col("n_markers")).alias("unique_fraction"))


def resolvable(db: DataFrame, *scope: str, unit: str = "unit", least: int = 10) -> DataFrame:
    """(scope, unit, panel_n, resolvable, doable): enough unique markers; a scope is doable if any unit has them."""
    out = panels(db, *scope, unit=unit).withColumn("resolvable", F.col("panel_n") >= least)
    return with_totals(out, *scope, doable=F.max("resolvable")).drop("n_markers")
