"""Registered queries against their SQL, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from helixtally.plans import registry

SF = "/root/testdata/sf0.001"
CHEAP = ("digest_counts", "single_copy_markers", "site_positions", "fnv_markers", "fasta_scan", "fastq_scan", "abundance_lines", "marker_degree", "db_stats", "resolvable_units", "restricted_panels", "named_unique_markers", "median_tags", "quality_report", "similarity_pairs", "minhash_pairs", "cross_species_filter", "evaluate_composition", "threshold_sweep", "streamed_counts", "linkage_containment", "marker_classes", "multi_profile", "database_files", "database_parquet", "prediction_files", "truth_files", "linkage_auto", "linkage_containment_minhash", "regression_apart", "profile_report", "streamed_profile", "species_catalogue")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.QUERIES) - set(registry.ORACLES) == {"regression_weights", "multi_enzyme_documents"}


@pytest.mark.parametrize("name", CHEAP)
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(registry.ORACLES[name])
    assert cols == sorted(rel.columns)
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM rel").fetchall()
    key = lambda r: tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) and math.isfinite(v) else str(v) for v in r)
    assert sorted(map(key, df.select(*cols).collect())) == sorted(map(key, want))


def test_entry(spark):
    assert entry.entry(spark).columns == ["species", "unit", "abundance", "coverage", "support", "depth", "global_abundance", "sample_fraction", "species_abundance", "n_markers"]


def test_all_enzymes_over_documents_match_brute_force(spark, tmp_path):
    import re

    from helixtally.functions.dna import ENZYMES
    from helixtally.plans import fixture

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 900").limit(12)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want: dict = {}
    for r in fixture.sequences(spark, str(tmp_path)).collect():
        for e in ENZYMES:
            for i in range(len(r.seq) - e.tag_length + 1):
                t = r.seq[i : i + e.tag_length]
                if re.fullmatch(e.regex, t):
                    key = (e.enzyme_id, min(t, t[::-1].translate(str.maketrans("ACGT", "TGCA"))))
                    want[key] = want.get(key, 0) + 1
    got = {(r.enzyme_id, r.tag): r.copies for r in registry.QUERIES["multi_enzyme_documents"](spark, str(tmp_path)).collect()}
    assert got == want and len({e for e, _ in want}) > 10
