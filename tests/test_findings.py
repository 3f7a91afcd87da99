"""Queries on tables larger or odder than the smallest ones: results as SQL has them, and steps that are done once."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from helixtally.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_composition_without_a_present_name_matches_sql(spark, tmp_path):
    """2,000 suppliers of equal shares: none reaches 0.001, and every ratio of the counts is undefined."""
    spark.range(2000).select(F.col("id").alias("l_suppkey"), F.lit(5.0).alias("l_quantity")).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(2000).select(F.col("id").alias("s_suppkey"), F.lit(7.0).alias("s_acctbal")).write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = registry.QUERIES["evaluate_composition"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES['evaluate_composition']})").fetchall()
    plain = lambda r: ["nan" if isinstance(x, float) and math.isnan(x) else x for x in r]
    assert plain(got.first()) == plain(want[0]) and plain(want[0])[3:6] == ["nan"] * 3


def test_merged_counts_digests_once_and_keeps_documents_without_a_language(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    df = registry.QUERIES["merged_counts"](spark, str(tmp_path))
    assert "MapInArrow" not in df._jdf.queryExecution().toString()  # it is done, and not once a language
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, df.select("marker", "copies").collect())) == sorted(con.execute(f"SELECT marker, copies FROM ({registry.ORACLES['merged_counts']})").fetchall())


def test_digits_are_cut_as_their_bases(spark):
    """The digits of a text give the tags of its bases, odd characters beside them or not."""
    from helixtally.operators import digest
    from helixtally.plans import fixture as fx

    rows = [(k, " ".join(f"w{j * k}" for j in range(300)) + (". é x" if k % 3 else "")) for k in range(1, 12)]
    df = spark.createDataFrame(rows, "gid int, s string")
    of = lambda seq, **k: sorted(map(tuple, digest.digest(df.select("gid", seq.alias("seq")), [fx.CUTTER], **k).collect()))
    assert of(fx.digits(F.col("s")), letters=fx.LETTERS) == of(fx.bases(F.col("s"))) != []


def test_genome_ids_are_those_of_genomes(spark, tmp_path):
    from helixtally.plans import fixture as fx

    texts = ["a", "", " ", ". ", ".. ", " . . ", "a. ", ". b", "\n", None, ".", ". . ."]
    spark.createDataFrame([(k, "en", t) for k, t in enumerate(texts)], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(r.gid for r in fx.genome_ids(spark, str(tmp_path)).collect())
    assert got == sorted(r.gid for r in fx.genomes(spark, str(tmp_path)).collect()) and 0 < len(got) < len(texts)


def test_cluster_database_is_one_pass(spark):
    """A marker that another cluster holds in several copies is not unique; what is returned was computed once."""
    from helixtally.operators import cluster

    mem = spark.createDataFrame([("s", 1, "C0"), ("s", 2, "C0"), ("s", 3, "C1"), ("t", 4, "C0"), ("t", 5, "C1")], "species string, gid int, cluster string")
    full = spark.createDataFrame([("s", 1, 10, 1), ("s", 2, 10, 2), ("s", 3, 11, 1), ("s", 1, 11, 2), ("s", 1, 12, 1), ("s", 3, 12, 1), ("t", 4, 13, 1), ("t", 5, 13, 2)], "species string, gid int, marker long, copies int")
    db = cluster.cluster_db(full.where("copies = 1").drop("copies"), full, mem, "species")
    assert {(r.species, r.unit, r.marker): (r.degree, r.is_unique) for r in db.collect()} == {("s", "C0", 10): (1, True), ("s", "C1", 11): (1, False), ("s", "C0", 12): (2, False), ("s", "C1", 12): (2, False), ("t", "C0", 13): (1, True)}
    assert "Window" not in db._jdf.queryExecution().toString() and "SortMergeJoin" not in db._jdf.queryExecution().toString()


def test_lone_units_are_weighted_without_a_solver(spark, monkeypatch):
    """Units that share no marker have a closed form; linked ones are dealt to as many tasks as there are partitions."""
    from helixtally.operators import profile

    met, solved = [], profile.Blocks.solved
    monkeypatch.setattr(profile.Blocks, "solved", lambda self, rows, key: (met.extend(r.unit for r in rows.collect()), solved(self, rows, key))[1])
    db = spark.createDataFrame([("s", u, 100 * u + m) for u in range(5) for m in range(10)] + [("s", 3, 1000), ("s", 4, 1000)], "species string, unit int, marker long")
    counts = db.select("marker", (F.col("marker") % 7).alias("copies")).distinct()
    got = {r.unit: r.weight for r in profile.regress(db, counts, "species").collect()}
    n, y = 51, lambda u: sum((100 * u + m) % 7 for m in range(10))
    assert set(met) == {3, 4} and len(got) == 5
    assert [got[u] for u in range(3)] == pytest.approx([max(0, y(u) - 0.005 * n) / (10 + 0.005 * n) for u in range(3)])


def test_a_large_group_is_weighted_without_a_row_per_pair(spark, monkeypatch):
    """Units that hold one common marker, more than one task may solve: no normal equations are made, and the weights are the plain solver's."""
    import numpy as np

    from helixtally.operators import profile

    made, grams = [], profile.grams
    monkeypatch.setattr(profile, "grams", lambda *a: (lambda df: (made.append(df.count()), df)[1])(grams(*a)))
    n, other = 20, 4000
    db = spark.createDataFrame([("s", u, m) for u in range(n) for m in (0, 3 * u + 1, 3 * u + 2, 3 * u + 3)] + [("s", n, 1000 + m) for m in range(other)], "species string, unit int, marker long")
    count = lambda m: 2000 if m == 0 else m % 11
    counts = spark.createDataFrame([(m, count(m)) for m in range(3 * n + 1)], "marker long, copies long")
    got = {r.unit: r.weight for r in profile.regress(db, counts, "species", dense=5, tolerance=1e-7).collect()}
    target = np.array([2000.0 + sum(count(3 * u + k) for k in (1, 2, 3)) for u in range(n)])
    want = profile.from_gram(np.ones((n, n)) + 3 * np.eye(n), target, 3 * n + 1 + other)
    assert made == [0] and got.pop(n) == 0 and [got[u] for u in range(n)] == pytest.approx(want.tolist(), abs=1e-6) and want.max() > 0


def test_a_text_database_is_written_by_several_tasks(spark, tmp_path):
    """Its parts, one after another, are the file, and are read as one database."""
    from helixtally.sources import tables

    db = spark.createDataFrame([(f"u{u:03d}", 1000 * u + m, m > 0) for u in range(200) for m in range(5)], "unit string, marker long, is_unique boolean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_database(db, str(tmp_path / "x.tsv"), ["BcgI"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "x.tsv").glob("part-*"))
    lines = [line for p in parts for line in p.read_text().splitlines()]
    assert len([p for p in parts if p.stat().st_size]) > 1 and lines[0].startswith(tables.DB_HEADER) and lines[1].startswith(tables.UNIQUE_HEADER) and lines[2:] == sorted(lines[2:])
    species, units, unique = tables.read_databases(spark, str(tmp_path / "*.tsv"))
    assert [r.species for r in species.collect()] == ["x"] and units.count() == 1000 and unique.count() == 800


def test_linked_units_that_a_task_holds_need_no_table_a_step(spark, monkeypatch):
    """Weights are the plain solver's, in one task a scope, by products of few units, and by steps over blocks; only the last make a table each."""
    import numpy as np

    from helixtally.operators import profile

    made, stored = [], profile.stored
    monkeypatch.setattr(profile, "stored", lambda df, path: (made.append(path), stored(df, path))[1])
    rng, n = np.random.default_rng(7), 24
    x = np.zeros((90, n))
    for u in range(n):  # two groups, each with a marker that all its units hold
        x[[60 * (u % 2), *(60 * (u % 2) + rng.choice(30, 6))], u] = 1
    y = rng.integers(0, 60, 90).astype(float)
    db = spark.createDataFrame([("s", int(u), int(m)) for m, u in zip(*np.nonzero(x), strict=True)], "species string, unit int, marker long")
    counts = spark.createDataFrame([(m, int(c)) for m, c in enumerate(y)], "marker long, copies long")
    held = x.any(axis=1)
    want = profile.elastic_net(x[held], y[held], tolerance=1e-12)
    monkeypatch.setattr(profile, "BLOCK", 40)
    for packed, dense in ((profile.PACKED, 3), (0, n), (0, 3)):
        made.clear()
        got = {r.unit: r.weight for r in profile.regress(db, counts, "species", dense=dense, tolerance=1e-6, packed=packed).collect()}
        assert [got[u] for u in range(n)] == pytest.approx(want.tolist(), abs=1e-5) and bool(made) == (packed == 0 and dense < n)
    assert want.max() > 0


def test_columns_in_lists_have_the_weights_of_their_products():
    """Without a ridge too; steps that don't arrive are an error."""
    import numpy as np

    from helixtally.operators import profile

    lists, own = [[1, 2, 3], [2, 3], [3, 9, 1], [9, 2]], np.array([4.0, 0, 1, 2])
    gram = np.array([[len({*a} & {*b}) for b in lists] for a in lists]) + np.diag(own)
    lens, target = np.array([*map(len, lists)]), np.array([30.0, 4, 22, 9])
    for alpha in (0.0, 0.01, 0.2):
        got = profile.from_lists(lens, np.concatenate(lists), own, lens + own, target, 12, alpha=alpha)
        assert got == pytest.approx(profile.from_gram(gram, target, 12, alpha=alpha, tolerance=1e-12), abs=1e-6)
    with pytest.raises(ValueError, match="no convergence in 2 rounds"):
        profile.from_lists(lens, np.concatenate(lists), own, lens + own, target, 12, rounds=2)
