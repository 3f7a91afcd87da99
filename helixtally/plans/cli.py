"""The eight commands, as Spark jobs: build, cluster, profile, multi-profile, evaluate, info, demo, cst-demo."""

from __future__ import annotations

import argparse
import functools
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixtally.functions.dna import enzyme_set
from helixtally.operators import cluster, community, database, digest, metrics, profile, quality
from helixtally.plans import demo
from helixtally.sources import fastx, tables
from helixtally.sources.store import settle


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="helixtally", description=__doc__)
    cmd = out.add_subparsers(dest="command", required=True)
    for name in ("build", "cluster"):
        p = cmd.add_parser(name)
        p.add_argument("--genomes", required=True)
        p.add_argument("--out", required=True)
        p.add_argument("--enzyme", default="recommended")
        p.add_argument("--max-contigs", type=int)
        p.add_argument("--min-tag-fraction", type=float)
        if name == "cluster":
            p.add_argument("--similarity", type=float, default=cluster.SIMILARITY)
            p.add_argument("--containment", action="store_true")
            p.add_argument("--method", choices=("auto", "exact", "minhash"), default="auto")
    for name in ("profile", "multi-profile"):
        p = cmd.add_parser(name)
        p.add_argument("--db" if name == "profile" else "--dbs", dest="db", required=True)
        p.add_argument("--sample", required=True)
        p.add_argument("--out")
        p.add_argument("--enzyme", default="recommended")
        p.add_argument("--min-support", type=int, default=10)
        p.add_argument("--min-coverage", type=float, default=0.1)
        p.add_argument("--min-abundance", type=float, default=0.0)
        p.add_argument("--min-consistency", type=float, default=0.5)
        p.add_argument("--no-adaptive-singleton", action="store_true")
        p.add_argument("--no-adaptive-floor", action="store_true")
        p.add_argument("--fixed-gate", action="store_true", help="both of the above")
        if name == "multi-profile":
            p.add_argument("--min-species-markers", type=int, default=200)
            p.add_argument("--min-species-marker-frac", type=float, default=0.0)
            p.add_argument("--min-species-detect", type=int, default=10)
            p.add_argument("--min-global-abundance", type=float, default=0.0)
            p.add_argument("--no-cross-species-filter", action="store_true")
    p = cmd.add_parser("evaluate")
    p.add_argument("--pred", required=True)
    p.add_argument("--truth", required=True)
    p.add_argument("--present", type=float, default=0.01)
    cmd.add_parser("info").add_argument("--db", required=True)
    cmd.add_parser("demo")
    cmd.add_parser("cst-demo")
    return out


def params_of(a: argparse.Namespace) -> profile.Params:
    return profile.Params(a.min_support, a.min_coverage, a.min_abundance, a.min_consistency, not (a.no_adaptive_singleton or a.fixed_gate), not (a.no_adaptive_floor or a.fixed_gate))


def kept_genomes(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """(genomes, counts) of the genomes that pass the quality filter."""
    genomes, seqs = fastx.read_genomes(spark, a.genomes)
    counted = settle(digest.counts(digest.markers(digest.digest(seqs.select("gid", "seq"), enzyme_set(a.enzyme))), "gid", marker="marker"))
    n = digest.single_copy(counted).groupBy("gid").agg(F.count("*").alias("n_tags"))
    judged = settle(quality.assess(genomes.join(n, "gid", "left").na.fill(0, ["n_tags"]), max_contigs=a.max_contigs, min_tag_fraction=a.min_tag_fraction))
    judged.where("status <> 'kept'").select("name", "n_tags", "status", "reason").show(truncate=False)
    genomes = judged.where("status <> 'dropped'").select("gid", "name")
    if genomes.isEmpty():
        raise ValueError("no genome passes the quality filter")
    return genomes, counted.join(genomes.select("gid"), "gid", "left_semi")


def members_path(out: str) -> str:
    """Where the membership of a database goes: its name with the extension replaced."""
    folder, _, name = out.rstrip("/").rpartition("/")
    stem = name[: name.rindex(".")] if "." in name[1:] else name
    return f"{folder}{'/' if folder else ''}{stem}.members.tsv"


def load_all(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The same of all databases of a folder, text and Parquet ones together."""
    names = tables.databases_in(spark, folder)
    if not names:
        raise FileNotFoundError(f"no database in {folder}")
    text = [n for n in names if not n.endswith(".parquet")]
    parts = [tables.read_databases(spark, text)] if text else []
    parts += [tables.load_database(spark, n) for n in names if n.endswith(".parquet")]
    species, units, unique = (functools.reduce(DataFrame.unionByName, x) for x in zip(*parts, strict=True))
    return species, database.with_unique(database.build(units, "species"), unique, "species")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(species, database) of one text database or several, or of a Parquet one."""
    species, units, unique = tables.load_database(spark, path) if path.rstrip("/").endswith(".parquet") else tables.read_databases(spark, path)
    return species, database.with_unique(database.build(units, "species"), unique, "species")


def sample_of(spark: SparkSession, path: str, spec: str) -> DataFrame:
    seqs = fastx.read_sequences(spark, path)
    return settle(digest.counts(digest.markers(digest.digest(seqs.select("seq"), enzyme_set(spec))), marker="marker"))


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.command in ("build", "cluster"):
        genomes, counted = kept_genomes(spark, a)
        single = digest.single_copy(counted)
        names = [e.name for e in enzyme_set(a.enzyme)]
        if a.command == "build":
            db = database.build(single.join(genomes, "gid").select(F.col("name").alias("unit"), "marker")).withColumn("is_unique", F.lit(False))
        else:
            mem = settle(cluster.single_linkage(genomes, single, threshold=a.similarity, containment=a.containment, method=a.method))
            cluster.class_summary(cluster.classify(single, mem)).show()
            db = cluster.cluster_db(single, counted, mem)
            database.resolvable(db).orderBy("unit").show(truncate=False)
            tables.write_lines(tables.membership_lines(genomes, mem), members_path(a.out), "#genome\tcluster")
        if a.out.endswith(".parquet"):
            tables.save_database(db, a.out, names)
        else:
            tables.write_database(db, a.out, names)
        database.stats(db).show()
    elif a.command == "profile":
        species, db = load(spark, a.db)
        own = species.first()["enzymes"]
        calls = profile.profile(db, sample_of(spark, a.sample, ",".join(own) if own else a.enzyme), params=params_of(a))
        calls.orderBy(F.desc("abundance"), "unit").show(truncate=False)
        if a.out:
            tables.write_lines(tables.profile_lines(calls), a.out, "\t".join(tables.PROFILE_COLUMNS))
    elif a.command == "multi-profile":
        species, db = load_all(spark, a.db)
        gate = community.Gate(a.min_species_markers, a.min_species_marker_frac, a.min_species_detect)
        sample = sample_of(spark, a.sample, a.enzyme)
        calls, gates = community.community_profile(db, sample, species, params=params_of(a), gate=gate, min_global=a.min_global_abundance, cross_species_filter=not a.no_cross_species_filter)
        calls = settle(calls)
        community.filter_counters(db).show()
        calls.orderBy("species", F.desc("abundance"), "unit").show(truncate=False)
        community.tier_tally(gates).show()
        community.coverage_of_sample(calls, sample).show()
        if a.out:
            tables.write_lines(tables.community_lines(calls), a.out, "\t".join(tables.COMMUNITY_COLUMNS))
    elif a.command == "evaluate":
        metrics.evaluate(tables.read_abundances(spark, a.pred), tables.read_abundances(spark, a.truth), a.present).show()
    elif a.command == "info":
        species, db = load(spark, a.db)
        species.show(truncate=False)
        database.stats(db).show()
        database.panels(db).orderBy("unit").show(truncate=False)
    elif a.command == "demo":
        demo.mixture(spark).show()
    else:
        for df in demo.clusters(spark):
            df.show()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        run(SparkSession.builder.getOrCreate(), a)
    except (ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
