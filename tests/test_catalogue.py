"""The catalogue of species against a full recount."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixtally.operators.catalogue import Catalogue


@pytest.fixture
def catalogue(spark, tmp_path):
    c = Catalogue(spark, f"cat_{uuid.uuid4().hex}", str(tmp_path / "catalogue"), buckets=4)
    yield c
    c.remove()


def of(spark, markers):
    return spark.createDataFrame([(m,) for m in markers], "marker string")


def recount(held):
    owners: dict = {}
    for s, ms in held.items():
        for m in set(ms):
            owners.setdefault(m, []).append(s)
    return sorted((o[0], m) for m, o in owners.items() if len(o) == 1)


def test_specific_markers_follow_every_change(spark, catalogue):
    """After each of a row of changes, compactions between them, the specific markers are those of a recount; and so is a table that follows by changes alone."""
    rng, held, follow = np.random.default_rng(9), {}, set()
    sets = {s: [f"m{m}" for m in rng.choice(60, 25)] for s in ("A", "B", "C", "D")} | {"E": []}
    steps = ["+A", "+B", "+C", "-B", "compact", "+E", "+D", "-A", "+B", "compact", "-D", "-E"]
    for step in steps:
        if step == "compact":
            catalogue.compact()
        else:
            s, mine = step[1], of(spark, sets[step[1]])
            catalogue.add(s, mine) if step[0] == "+" else catalogue.drop(s, mine)
            held = held | {s: sets[s]} if step[0] == "+" else {k: v for k, v in held.items() if k != s}
            for r in catalogue.changes(s, mine).collect():
                follow.add((r.species, r.marker)) if r.gained else follow.remove((r.species, r.marker))
        got = sorted((r.species, r.marker) for r in catalogue.specific().collect())
        assert got == recount(held) == sorted(follow), step


def test_a_change_touches_its_own_markers_alone(spark, catalogue):
    """A change writes a row a marker; adding up shuffles nothing, and looking markers up shuffles these alone."""
    catalogue.add("A", of(spark, [f"a{k}" for k in range(500)]))
    catalogue.add("B", of(spark, ["a1", "a1", None, "b"]))
    rows = {r.change: r["count"] for r in spark.table(catalogue._table(0)).groupBy("change").count().collect()}
    assert rows == {1: 500, 2: 2}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(catalogue.counts())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        looked = plan(catalogue.touched(of(spark, ["a1", "zz"])))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in looked[looked.index("FileScan") :].split("\n")[0] and looked.count("Exchange hashpartitioning(marker") == 1
    assert [tuple(r) for r in catalogue.touched(of(spark, ["a1", "zz"])).collect()] == [("a1", 2, 3)]


def test_wrong_changes_are_errors(spark, catalogue):
    catalogue.add("A", of(spark, ["x", "y"]))
    with pytest.raises(ValueError, match="is in the catalogue"):
        catalogue.add("A", of(spark, ["z"]))
    with pytest.raises(ValueError, match="not the markers"):
        catalogue.drop("A", of(spark, ["x", "z"]))
    with pytest.raises(ValueError, match="no species B"):
        catalogue.drop("B", of(spark, ["x"]))
    assert sorted(r.marker for r in catalogue.specific().collect()) == ["x", "y"]


def test_a_change_that_stopped_halfway_is_not_read_and_goes(spark, catalogue):
    catalogue.add("A", of(spark, ["x", "y"]))
    catalogue._put(0, 2, of(spark, ["x", "q"]).select("marker", F.lit(1).alias("n"), F.lit(2).alias("owner")))  # and no row in the log
    assert sorted(r.marker for r in catalogue.specific().collect()) == ["x", "y"]
    catalogue.add("B", of(spark, ["y"]))
    assert [tuple(r) for r in catalogue.specific().collect()] == [("A", "x")]


def test_an_empty_catalogue(spark, catalogue):
    assert catalogue.specific().isEmpty() and catalogue.species().isEmpty() and catalogue.counts().isEmpty()
