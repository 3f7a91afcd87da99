import numpy as np
import pytest
from pyspark.sql import functions as F

from helixtally.operators import cluster, community, database, metrics, profile, quality
from helixtally.plans import demo
from helixtally.sources import tables
from helixtally.streaming import counts as streaming


def units(spark, sets):
    return spark.createDataFrame([(u, int(m)) for u, ms in sets.items() for m in ms], "unit string, marker long")


def sample(spark, counts):
    return spark.createDataFrame([(int(m), int(c)) for m, c in counts.items()], "marker long, copies long")


def calls(spark, sets, counts, **options):
    got = profile.profile(database.build(units(spark, sets)), sample(spark, counts), params=profile.Params(**options))
    return {r.unit: r for r in got.collect()}


def test_database(spark, tmp_path):
    db = database.build(units(spark, {"A": [1, 2, 3, 10], "B": [1, 2, 3, 20], "C": [1, 2, 3, 30]}))
    assert sorted(r.marker for r in database.unique_markers(db).collect()) == [10, 20, 30]
    tables.write_lines(tables.database_lines(db, ["BcgI"]), str(tmp_path / "x.tsv"))
    species, held, unique = tables.read_databases(spark, str(tmp_path / "x.tsv" / "*.txt"))
    again = database.with_unique(database.build(held, "species"), unique, "species")
    assert sorted(r.marker for r in database.unique_markers(again).collect()) == [10, 20, 30]
    assert species.first().enzymes == ["BcgI"]
    s = database.stats(db).first()
    assert (s.n_strains, s.n_markers, s.unique_markers, s.avg_markers_per_strain) == (3, 6, 3, 4.0)


def test_profile_of_a_stored_database_shuffles_the_sample_alone(spark, tmp_path):
    """No exchange above the scan of the database, and the statistics of the same database as a frame."""
    rng = np.random.default_rng(8)
    db = database.build(units(spark, {f"u{k}": rng.integers(0, 5000, 400).tolist() for k in range(30)}).withColumn("species", F.lit("s")), "species")
    some = sample(spark, {m: int(rng.integers(1, 9)) for m in range(0, 5000, 2)})
    tables.store_database(db, "test_db", ["BcgI"], "species", path=str(tmp_path), buckets=8)
    try:
        held, panels = tables.stored_database(spark, "test_db")
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        seen = database.unique_markers(held).join(some, "marker")
        plan = seen._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert plan.count("Exchange hashpartitioning(marker") == 1 and "Bucketed: true" in plan
        assert plan.index("Exchange hashpartitioning") > plan.index("FileScan") or "FileScan" not in plan[plan.index("Exchange hashpartitioning") :]
        order = lambda df: sorted(map(tuple, df.collect()))
        assert order(profile.panel_stats(held, some, "species", panels=panels)) == order(profile.panel_stats(db, some, "species"))
        assert panels.first().enzymes == ["BcgI"]
    finally:
        tables.drop_database(spark, "test_db")


def test_mask_and_bad_hex(spark, tmp_path):
    db = database.build(units(spark, {"A": [1, 2, 10, 99], "B": [1, 2, 20]}))
    masked = database.restrict(db, units(spark, {"x": [1, 2, 10, 20]}).select("marker"))
    assert sorted(r.marker for r in database.unique_markers(masked).collect()) == [10, 20]
    (tmp_path / "s.tsv").write_text("#other-db\t1\tBcgI\n# note\n\nA\tff,zz,1\n")
    _, held, unique = tables.read_databases(spark, str(tmp_path / "s.tsv"))
    assert sorted(r.marker for r in held.collect()) == [1, 255] and unique.isEmpty()


def test_clusters(spark):
    mem, classes, _ = demo.clusters(spark)
    assert {r.gid: r.cluster for r in mem.collect()} == {0: "C0", 1: "C0", 2: "C1", 3: "C1"}
    assert {r["class"]: r.n for r in classes.collect()} == {"core": 200, "cluster_specific": 80, "strain_specific": 12}
    both = spark.createDataFrame([(g, m) for g, n in ((0, 400), (1, 200)) for m in range(n)], "gid long, marker long")
    ids = both.select("gid").distinct()
    n = lambda **k: cluster.single_linkage(ids, both, **k).select("cluster").distinct().count()
    assert n(method="exact") == 2 and n(method="exact", containment=True) == 1
    assert n(method="minhash") == 2 and n(method="minhash", containment=True) == 1 and n(threshold=0.0) == 1


def test_empty_sets_and_chains(spark):
    ids = spark.createDataFrame([(g,) for g in range(8)], "gid long")
    held = spark.createDataFrame([(g, m) for g in range(5) for m in range(g, g + 20)] + [(7, 1000)], "gid long, marker long")
    got = {r.gid: r.cluster_id for r in cluster.single_linkage(ids, held, threshold=0.9, method="exact").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 1, 7: 2}


def overlapping(n, seed):
    """Sets of markers of which many are nearly alike, some equal, some empty, and all hold a few common ones."""
    rng = np.random.default_rng(seed)
    base, sets = [rng.choice(10**6, 60, replace=False) for _ in range(4)], {}
    for g in range(n):
        s = set(base[g % 4][: int(rng.integers(40, 60))].tolist()) if g % 7 else set(base[g % 4].tolist())
        sets[g] = set() if g % 17 == 0 else s - set(rng.choice(base[g % 4], int(rng.integers(0, 3))).tolist()) | {-1, -2}
    return sets


@pytest.mark.parametrize("threshold, containment", [(0.95, False), (0.8, False), (0.95, True), (1.0, False), (1.1, False)])
def test_candidates_lose_no_link(spark, threshold, containment):
    sets = overlapping(60, 3)
    ids = spark.createDataFrame([(g,) for g in sets], "gid long")
    held = spark.createDataFrame([(g, int(m)) for g, s in sets.items() for m in s], "gid long, marker long")
    root = {g: g for g in sets}
    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            near = 1.0 if not x and not y else 0.0 if not x or not y else len(x & y) / (min(len(x), len(y)) if containment else len(x | y))
            if a < b and near >= threshold:
                low, high = sorted((root[a], root[b]))
                root = {g: low if r == high else r for g, r in root.items()}
    number = {r: k for k, r in enumerate(sorted(set(root.values())))}
    got = cluster.single_linkage(ids, held, threshold=threshold, containment=containment, method="exact")
    assert {r.gid: r.cluster_id for r in got.collect()} == {g: number[r] for g, r in root.items()}


def test_each_scope_chooses_its_method(spark, monkeypatch):
    monkeypatch.setattr(cluster, "EXACT_UP_TO", 20)
    asked = {}
    for name in ("linked", "sketch_linked"):
        plain = getattr(cluster, name)
        monkeypatch.setattr(cluster, name, lambda g, m, *scope, _n=name, _f=plain, **k: (asked.setdefault(_n, sorted(r.species for r in g.select("species").distinct().collect())), _f(g, m, *scope, **k))[1])
    sets = {("few", g): s for g, s in overlapping(15, 1).items()} | {("many", g): s for g, s in overlapping(40, 2).items()}
    ids = spark.createDataFrame(list(sets), "species string, gid long")
    held = spark.createDataFrame([(s, g, int(m)) for (s, g), ms in sets.items() for m in ms], "species string, gid long, marker long")
    got = {(r.species, r.gid): r.cluster_id for r in cluster.single_linkage(ids, held, "species").collect()}
    assert asked == {"linked": ["few"], "sketch_linked": ["many"]}
    exact = {(r.species, r.gid): r.cluster_id for r in cluster.single_linkage(ids, held, "species", method="exact").collect()}
    assert got == exact  # the sketches hold these sets whole


def test_sketch_is_the_plain_estimate(spark):
    rng = np.random.default_rng(2)
    sets = [set(rng.choice(3000, n, replace=False).tolist()) for n in (900, 1000, 50)]
    sets[1] |= set(list(sets[0])[:700])
    held = spark.createDataFrame([(g, m) for g, s in enumerate(sets) for m in s], "gid long, marker long")

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    k = 100
    sk = [sorted(mixed(m) for m in s)[:k] for s in sets]
    for r in cluster.sketched(held.select("gid").distinct(), held, k=k).collect():
        a, b = sk[r.a], sk[r.b]
        top = sorted(set(a) | set(b))[:k]
        assert r.jaccard == pytest.approx(sum(x in a and x in b for x in top) / len(top))


def test_quality(spark):
    def judged(rows, **k):
        df = spark.createDataFrame(rows, "name string, n_contigs int, n_tags int")
        return {r.name: (r.status, r.median) for r in quality.assess(df, **k).collect()}

    assert judged([("a", 1, 1000), ("b", 1, 1010), ("c", 1, 990), ("d", 1, 300)])["a"][1] == 1000
    assert [v[0] for v in judged([("a", 1, 1000), ("b", 1, 1000), ("c", 1, 300)]).values()].count("flagged") == 1
    got = judged([("good", 2, 1000), ("good2", 3, 1000), ("incomplete", 4, 200), ("fragmented", 800, 1000)], max_contigs=500, min_tag_fraction=0.5)
    assert {k for k, v in got.items() if v[0] == "kept"} == {"good", "good2"}


def test_mixture(spark):
    got = {r.unit: r.abundance for r in demo.mixture(spark).collect()}
    assert set(got) == {"strain0", "strain2"} and abs(got["strain0"] - 0.7) < 0.06
    naive = profile.naive_profile(database.build(demo.strains(spark)), demo.reads(spark), min_score=1240)
    assert naive.count() == 4


def test_gates(spark):
    a, b = range(1000), range(10_000, 11_000)
    got = calls(spark, {"A": a, "B": b}, {**dict.fromkeys(a, 30), **dict.fromkeys(b[:400], 1)})
    assert set(got) == {"A", "B"} and abs(got["B"].abundance - 0.4 / 30.4) < 0.005
    assert set(calls(spark, {"A": a, "B": b}, {**dict.fromkeys(a, 30), **dict.fromkeys(b[:400], 1)}, min_abundance=0.02)) == {"A"}
    shadow = {**dict.fromkeys(a, 20), **dict.fromkeys(b[:300], 20)}
    assert set(calls(spark, {"A": a, "B": b}, shadow, min_consistency=0.0)) == {"A", "B"}
    assert calls(spark, {"A": a, "B": b}, shadow)["A"].abundance == 1.0
    sparse = {**dict.fromkeys(a, 20), **dict.fromkeys(b[:300], 1)}
    both = calls(spark, {"A": a, "B": b}, sparse)
    assert both["A"].depth == 20 and both["B"].depth == pytest.approx(0.3)
    assert not calls(spark, {"A": a}, dict.fromkeys(range(50_000, 50_100), 1))
    assert not calls(spark, {"A": range(50_000)}, dict.fromkeys(range(1500), 1))


@pytest.mark.parametrize("d", [5, 10, 11, 100, 300])
def test_depth_is_the_plain_mean_of_singletons(spark, d):
    stats = profile.panel_stats(database.build(units(spark, {"A": range(1000)})), sample(spark, dict.fromkeys(range(d), 1))).first()
    assert stats.depth == pytest.approx(d / 1000) and stats.detected1 == d


def test_depth_trims_repeats(spark):
    stats = profile.panel_stats(database.build(units(spark, {"A": range(1000)})), sample(spark, {**dict.fromkeys(range(1000), 20), 7: 5000})).first()
    assert stats.depth == pytest.approx(20.0)


def test_solver():
    x = np.array([[1, 0], [0, 1], [1, 1], [2, 1]], float)
    assert profile.elastic_net(x, np.array([2.0, 3, 5, 7]), alpha=0.0) == pytest.approx([2, 3], abs=1e-3)


def test_regression_over_spark(spark):
    db = units(spark, {"A": range(100), "B": range(50, 200)}).withColumn("species", F.lit("s"))
    got = {r.unit: r.weight for r in profile.regress(db, sample(spark, {m: 2 * (m < 100) + 3 * (m >= 50) for m in range(200)}), "species", alpha=0.0).collect()}
    assert got["A"] == pytest.approx(2, abs=1e-3) and got["B"] == pytest.approx(3, abs=1e-3)


def test_regression_by_blocks(spark):
    """Groups of linked units that are solved in several blocks have the weights of a plain solver; so have small ones beside them."""
    rng = np.random.default_rng(5)
    sets = {f"u{k}": set(rng.choice(120, 15, replace=False).tolist()) for k in range(6)} | {"lone": set(range(1000, 1040))}
    counts = {m: int(rng.integers(0, 9)) for m in [*range(120), *range(1000, 1040)]}
    db = units(spark, sets).withColumn("species", F.lit("s"))
    names, every = sorted(sets), sorted(set().union(*sets.values()))
    x = np.array([[m in sets[n] for n in names] for m in every], float)
    want = dict(zip(names, profile.elastic_net(x, np.array([counts[m] for m in every], float), tolerance=1e-12), strict=True))
    for dense in (3, 100):
        got = {r.unit: r.weight for r in profile.regress(db, sample(spark, counts), "species", dense=dense, tolerance=1e-7).collect()}
        assert got == {n: pytest.approx(w, abs=1e-6) for n, w in want.items()}


def test_regression_says_when_it_has_not_converged(spark):
    x = np.random.default_rng(0).random((30, 8))
    with pytest.raises(ValueError, match="no convergence in 2 rounds"):
        profile.elastic_net(x, x.sum(axis=1), rounds=2)
    solver = profile.Blocks("species", "unit", {}, 0.01, 0.5, 1, 1e-8)
    rows = spark.createDataFrame([("s", "a", "a", 2.0, 4.0, 10), ("s", "a", "b", 1.0, 4.0, 10), ("s", "b", "a", 1.0, 5.0, 10), ("s", "b", "b", 2.0, 5.0, 10)], "species string, unit string, other string, gram double, target double, n int")
    at = lambda a, b: solver.violation(rows, spark.createDataFrame([("s", "a", a), ("s", "b", b)], "species string, unit string, weight double"))
    w = profile.from_gram(np.array([[2.0, 1], [1, 2]]), np.array([4.0, 5]), 10)
    assert at(*map(float, w)) < 1e-7 < 0.1 < at(float(w[0]) + 0.2, float(w[1]))


@pytest.mark.parametrize("present,total,gate,reach,want", [
    (250, 5000, (200, 0.0, 10), 1.0, "resolved"), (50, 5000, (200, 0.0, 10), 1.0, "detected"), (5, 5000, (200, 0.0, 10), 1.0, "absent"),
    (300, 5000, (200, 0.1, 10), 1.0, "detected"), (600, 5000, (200, 0.1, 10), 1.0, "resolved"), (150, 150, (200, 0.0, 10), 1.0, "detected"),
    (60, 5000, (200, 0.0, 10), 1 - np.exp(-0.05), "resolved"), (40, 20000, (200, 0.0, 10), 1 - np.exp(-0.002), "detected"),
    (50, 20000, (200, 0.0, 10), 1 - np.exp(-0.002), "resolved"), (9, 5000, (200, 0.0, 10), 0.0, "absent"), (10, 5000, (200, 0.0, 10), 0.0, "detected"),
])
def test_tiers(spark, present, total, gate, reach, want):
    df = spark.range(1).select(community.tier(F.lit(present), F.lit(total), F.lit(float(reach)), community.Gate(*gate)).alias("t"))
    assert df.first().t == want


def test_community(spark):
    sets = {("A", "a1", 40): range(500), ("A", "a2", 20): range(500, 1000), ("B", "b1", 4): range(2000, 2500), ("B", "b2", 2): range(2500, 3000)}
    db = spark.createDataFrame([(s, u, m) for (s, u, _), ms in sets.items() for m in ms], "species string, unit string, marker long")
    reads = sample(spark, {m: d for (_, _, d), ms in sets.items() for m in ms})
    got, gates = community.community_profile(database.build(db, "species"), reads)
    by = {r.unit: r for r in got.collect()}
    assert {u: round(r.global_abundance * 66, 6) for u, r in by.items()} == {"a1": 40, "a2": 20, "b1": 4, "b2": 2}
    assert by["a1"].species_abundance == pytest.approx(10 * by["b1"].species_abundance)
    for r in by.values():
        assert r.global_abundance == pytest.approx(r.species_abundance * r.abundance)
    assert sum(r.sample_fraction for r in by.values()) == pytest.approx(1.0)
    kept, gates = community.community_profile(database.build(db, "species"), reads, min_global=0.1)
    assert {r.unit for r in kept.collect()} == {"a1", "a2"} and {r.species: r.tier for r in gates.collect()} == {"A": "resolved", "B": "detected"}


def test_uniform_shares_where_depth_is_zero(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "unit string, depth double")
    assert [r.abundance for r in profile.normalise(df).collect()] == [0.5, 0.5]


def test_metrics(spark):
    t = lambda rows: spark.createDataFrame(rows, "name string, abundance double")
    m = metrics.evaluate(t([("A", 0.7), ("B", 0.3)]), t([("A", 0.7), ("B", 0.3)])).first()
    assert (m.precision, m.recall, m.f1, m.l1, m.bray_curtis) == (1, 1, 1, 0, 0)
    m = metrics.evaluate(t([("A", 0.6), ("B", 0.3), ("C", 0.1)]), t([("A", 0.7), ("B", 0.3)]), 0.05).first()
    assert (m.tp, m.fp, m.fn) == (2, 1, 0) and m.precision == pytest.approx(2 / 3) and m.l1 == pytest.approx(0.2)


def test_stream_equals_batch(spark, tmp_path):
    from helixtally.functions.dna import enzyme

    rng = np.random.default_rng(3)
    reads = spark.createDataFrame([("".join(rng.choice(list("ACGT"), 900)),) for _ in range(40)], "seq string")
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    e = [enzyme("BslFI"), enzyme("CjePI")]
    got = streaming.run_to_table(streaming.stream_counts(streaming.reads_stream(spark, str(tmp_path / "in")), e), "streamed", str(tmp_path / "cp"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, streaming.stream_counts(reads, e).collect()))


def test_files_that_arrive(spark, tmp_path):
    """Files that come in batches are counted as one read of all of them would be."""
    from helixtally.functions.dna import RECOMMENDED
    from helixtally.operators import digest
    from helixtally.sources import fastx

    folder, rng = tmp_path / "in", np.random.default_rng(6)
    folder.mkdir()
    put = lambda k: (folder / f"r{k}.fq").write_text("".join(f"@r\n{''.join(rng.choice(list('ACGT'), 3000))}\n+\n-\n" for _ in range(5)))
    for k in range(3):
        put(k)
    run = lambda: streaming.count_files(spark, str(folder), RECOMMENDED, str(tmp_path / "out"), str(tmp_path / "cp"), per_batch=2)
    want = lambda: {(r.enzyme_id, r.tag): r.copies for r in digest.counts(digest.digest(fastx.read_sequences(spark, str(folder)).select("seq"), RECOMMENDED), "enzyme_id").collect()}
    assert {(r.enzyme_id, r.tag): r.copies for r in run().collect()} == want()
    put(3)
    assert {(r.enzyme_id, r.tag): r.copies for r in run().collect()} == want() and len(want()) > 100
