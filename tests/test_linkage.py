"""Linkage by spanning forests: few comparisons, no lost link; containment by size classes; sketches that merge."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixtally.operators import cluster


def frames(spark, sets):
    rows = [(g, int(m)) for g, s in enumerate(sets) for m in s]
    return spark.createDataFrame([(g,) for g in range(len(sets))], "gid long"), spark.createDataFrame(rows, "gid long, marker long")


def roots(n, links):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return [top(x) for x in range(n)]


def near_identical(n, rng):
    """n variants of one set, each without two of its markers."""
    base = rng.choice(10**9, 200, replace=False)
    return [set(np.delete(base, rng.choice(200, 2, replace=False)).tolist()) for _ in range(n)]


@pytest.mark.parametrize("n", [300, 3000])
def test_comparisons_are_near_linear(spark, n):
    ids, held = frames(spark, near_identical(n, np.random.default_rng(n)))
    groups = cluster.groups_of(held, threshold=0.95)
    links, tried = cluster.forest(groups, cluster.exactly(held), threshold=0.95, metric=True)
    assert tried.count() <= 4 * n
    found = cluster.components(ids, links.select("a", "b"))
    assert found.select("root").distinct().count() == 1


@pytest.mark.parametrize("containment", [False, True])
def test_forest_against_all_pairs(spark, containment):
    """Families that share markers, at distances around the threshold."""
    rng, sets = np.random.default_rng(4), []
    common = set(range(10))
    for _ in range(6):
        base = rng.choice(10**6, 80, replace=False)
        sets += [set(base[: int(rng.integers(50, 81))].tolist()) - set(rng.choice(base, int(rng.integers(0, 6))).tolist()) | common for _ in range(15)]
    ids, held = frames(spark, sets)
    size = (lambda x, y: min(len(x), len(y))) if containment else (lambda x, y: len(x | y))
    for threshold in (0.95, 0.85):
        want = roots(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= threshold * size(sets[a], sets[b])])
        groups = cluster.groups_of(held, threshold=threshold, containment=containment)
        links, tried = cluster.forest(groups, cluster.exactly(held, containment=containment), threshold=threshold, containment=containment, metric=not containment, few=1)
        got = {r.gid: r.root for r in cluster.components(ids, links.select("a", "b")).collect()}
        assert [got[g] for g in range(len(sets))] == want
        assert tried.count() == tried.select("a", "b").distinct().count()


def test_containment_by_size_classes(spark):
    """All components that a full join of sketches gives, on sizes of 20 to 4,000 with sketches of 64."""
    rng, sets = np.random.default_rng(9), []
    big = [rng.choice(10**9, 4000, replace=False) for _ in range(3)]
    for b in big:
        for n in (20, 60, 64, 200, 800, 3000, 4000):
            own = b[rng.permutation(4000)[:n]].tolist()
            sets.append(set(own[int(n * rng.choice([0, 0.02, 0.1, 0.3])) :]) | set(rng.choice(10**9, int(n * 0.02)).tolist()))
    ids, held = frames(spark, sets)
    for threshold in (0.9, 0.6):
        full = cluster.sketched(ids, held, k=64).where(F.col("containment") >= threshold).select("a", "b")
        want = {r.gid: r.root for r in cluster.components(ids, full).collect()}
        got = {r.gid: r.root for r in cluster.components(ids, cluster.sketch_linked(ids, held, threshold=threshold, containment=True, k=64)).collect()}
        assert got == want and len(set(want.values())) < len(sets)


def test_sketch_merges(spark, monkeypatch):
    """Any cut into batches, with repeated rows, gives the k least of each genome."""
    rng = np.random.default_rng(1)
    rows = [(int(g), int(m)) for g in range(5) for m in rng.integers(0, 3000, 400 * (g + 1))]
    held = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "gid long, marker long").repartition(7)
    h = cluster.unsigned_order(cluster.splitmix64("marker"))
    want = {}
    for r in held.select("gid", h.alias("h")).distinct().collect():
        want.setdefault(r.gid, []).append(r.h)
    got = {}
    for r in cluster.sketch(held, k=50).orderBy("gid", "rank").collect():
        got.setdefault(r.gid, []).append(r.h)
    assert got == {g: sorted(v)[:50] for g, v in want.items()}
    plan = cluster.sketch(held, k=50)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("MapInArrow")  # ranks are of what tasks have kept


def test_containment_compares_few_that_are_not_linked(spark):
    """300 sets that share common markers in groups, without being contained in each other, beside 40 small ones that are."""
    rng = np.random.default_rng(3)
    sets = [{0, *(rng.choice(60, 12, replace=False) + 1).tolist()} for _ in range(300)]
    sets += [set(list(sets[i])[:11]) for i in range(0, 80, 2)]
    ids, held = frames(spark, sets)
    want = roots(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.95 * min(len(sets[a]), len(sets[b]))])
    links, tried = cluster.forest(cluster.groups_of(held, threshold=0.95, containment=True), cluster.exactly(held, containment=True), threshold=0.95, containment=True)
    got = {r.gid: r.root for r in cluster.components(ids, links.select("a", "b")).collect()}
    assert [got[g] for g in range(len(sets))] == want and 1 < len(set(want)) < len(sets)
    assert tried.count() <= len(sets)


def test_small_sets_are_one_class(spark):
    """Sketches that hold sets whole are not dealt to a class for each size: groups have no more rows than the sets."""
    rng = np.random.default_rng(5)
    sets = [set(rng.choice(80, n, replace=False).tolist()) for n in range(1, 61)]
    ids, held = frames(spark, sets)
    s, n = cluster.sketch(held), cluster.sizes(ids, held)
    assert cluster.size_classes(s, n, threshold=0.95).count() <= held.count()
    want = roots(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.95 * min(len(sets[a]), len(sets[b]))])
    got = {r.gid: r.root for r in cluster.components(ids, cluster.sketch_linked(ids, held, threshold=0.95, containment=True)).collect()}
    assert [got[g] for g in range(len(sets))] == want


def test_sketched_pairs_are_scored_from_the_join_that_finds_them(spark, monkeypatch):
    """The same as sketches joined to the pairs again, without doing that: a row a shared marker, not one a marker of a sketch."""
    rng = np.random.default_rng(8)
    ids, held = frames(spark, [set(rng.choice(60, int(rng.integers(5, 40)), replace=False).tolist()) for _ in range(25)])
    s = cluster.sketch(held, k=16)
    pairs = s.alias("x").join(s.alias("y"), "h").where("x.gid < y.gid").select(F.col("x.gid").alias("a"), F.col("y.gid").alias("b")).distinct()
    want = sorted(map(tuple, cluster.estimates(pairs, s, cluster.sizes(ids, held), k=16).collect()))
    monkeypatch.delattr(cluster, "estimates")
    assert sorted(map(tuple, cluster.sketched(ids, held, k=16).collect())) == want != []


def test_sketches_and_sizes_from_one_pass(spark, monkeypatch):
    """Sizes are exact however tasks cut their rows, with repeated rows, a null and genomes without markers; pairs need no join with them."""
    rng = np.random.default_rng(6)
    rows = [(g % 2, g, int(m)) for g in range(12) for m in rng.integers(0, 60, 15 * (g + 1))] + [(0, 4, None)]
    held = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "species int, gid long, marker long").repartition(5)
    ids = spark.createDataFrame([(g % 2, g) for g in range(14)], "species int, gid long")
    monkeypatch.setattr(cluster, "BUFFER", 16)
    s, n = cluster.sketches(ids, held, "species", k=8)
    assert sorted(map(tuple, n.collect())) == sorted((g % 2, g, len({m for _, x, m in rows if x == g})) for g in range(14))
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, cluster.sketch(held, "species", k=8).collect()))
    assert s.groupBy("gid").agg(F.max("rank").alias("r"), F.count("*").alias("c")).where("r <> 8 OR c <> 8").isEmpty()
    want = sorted(map(tuple, cluster.estimates(s.alias("x").join(s.alias("y"), ["species", "h"]).where("x.gid < y.gid").select("species", F.col("x.gid").alias("a"), F.col("y.gid").alias("b")).distinct(), s, n, "species", k=8).collect()))
    monkeypatch.delattr(cluster, "sizes")
    monkeypatch.delattr(cluster, "scored")
    assert sorted(map(tuple, cluster.sketched(ids, held, "species", k=8).collect())) == want != []
