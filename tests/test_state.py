"""Profiles as state against profiles of everything that has arrived."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixtally.functions.dna import RECOMMENDED
from helixtally.operators import database, digest, profile
from helixtally.sources import fastx, records
from helixtally.streaming import state


def test_state_is_the_batch_profile_after_every_trigger(spark, tmp_path):
    """Two samples whose files arrive in three turns; panels are slices of a few markers; a turn without files changes nothing."""
    rng = np.random.default_rng(4)
    genomes = {f"u{k}": "".join(rng.choice(list("ACGT"), 60000)) for k in range(3)}
    genomes["u3"] = genomes["u2"][:30000] + "".join(rng.choice(list("ACGT"), 30000))
    tags = lambda df: digest.markers(digest.digest(df, RECOMMENDED))
    held = tags(spark.createDataFrame(list(genomes.items()), "unit string, seq string")).select(F.lit("s").alias("species"), "unit", "marker").distinct()
    db = database.build(held, "species").checkpoint()
    panels = database.panels(db, "species").checkpoint()
    folder = tmp_path / "in"
    folder.mkdir()
    spark.dataSource.register(records.Fastx)
    named = lambda df: df.select(F.regexp_extract("file", "([ab])[0-9]*.fq$", 1).alias("sample"), "seq")
    order = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect())
    sizes = []
    for turn in range(4):
        for s, units in (("a", ["u0", "u2"]), ("b", ["u1"] if turn < 1 else ["u0", "u3"])):
            reads = [genomes[u][i : i + 4000] for u in units for i in rng.integers(0, 56000, 12)]
            if turn != 2:
                (folder / f"{s}{turn}.fq").write_text("".join(f"@r\n{r}\n+\n-\n" for r in reads))
        arrived = tags(named(spark.readStream.format("fastx").option("splitBytes", 50000).load(str(folder))))
        state.keep(state.tallies(arrived, db, panels, "species", by=("sample",), slice_size=20), str(tmp_path / "out"), str(tmp_path / "cp"))
        files = tags(named(fastx.read_sequences(spark, str(folder)))).checkpoint()
        want_stats, want_calls = [], []
        for s in "ab":
            sample = digest.counts(files.where(F.col("sample") == s), marker="marker")
            got = profile.panel_stats(db, sample, "species").where("detected1 > 0")
            want_stats += order(got.withColumn("sample", F.lit(s)))
            want_calls += order(profile.profile(db, sample, "species").withColumn("sample", F.lit(s)))
        assert order(state.stats(spark, str(tmp_path / "out"), panels, "species", by=("sample",))) == sorted(want_stats)
        assert order(state.profiles(spark, str(tmp_path / "out"), panels, "species", by=("sample",))) == sorted(want_calls)
        sizes.append(len(want_calls))
    assert max(sizes) >= 4 and panels.agg(F.max("panel_n")).first()[0] > 60
    assert len(state.snapshots(spark, str(tmp_path / "out"))) == 2


def test_tags_of_no_panel_leave_no_state(spark, tmp_path):
    db = database.build(spark.createDataFrame([("u", 1), ("v", 2)], "unit string, marker long"))
    spark.createDataFrame([(7,), (None,)], "marker long").write.parquet(str(tmp_path / "in"))
    tags = spark.readStream.schema("marker long").parquet(str(tmp_path / "in"))
    state.keep(state.tallies(tags, db, database.panels(db)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert state.stats(spark, str(tmp_path / "out"), database.panels(db)).isEmpty()


@pytest.mark.parametrize("turns", [1, 3])
def test_slices_sum_to_the_panel(spark, tmp_path, turns):
    db = database.build(spark.createDataFrame([("u", m) for m in range(500)], "unit string, marker long"))
    panels, seen = database.panels(db), [m for m in range(300) for _ in range(m % 5)]
    for k in range(turns):
        spark.createDataFrame([(m,) for m in seen[k::turns]], "marker long").write.mode("append").parquet(str(tmp_path / "in"))
        tags = spark.readStream.schema("marker long").parquet(str(tmp_path / "in"))
        state.keep(state.tallies(tags, db, panels, slice_size=30), str(tmp_path / "out"), str(tmp_path / "cp"))
    sample = spark.createDataFrame([(m, m % 5) for m in range(300)], "marker long, copies long")
    assert state.stats(spark, str(tmp_path / "out"), panels).collect() == profile.panel_stats(db, sample).collect()


def test_short_panels_share_a_key(spark, tmp_path):
    """60 panels of 5 markers are 3 parts, not 60 keys; a trigger that meets one panel of a part leaves the others as they were."""
    db = database.build(spark.createDataFrame([(f"u{u}", 100 * u + m) for u in range(60) for m in range(5)], "unit string, marker long"))
    panels = database.panels(db).checkpoint()
    parts = state.dealt(panels, slice_size=100)
    assert parts.select("part").distinct().count() <= 3
    assert parts.select("part", "place").distinct().count() == 60 and parts.where("slices <> 1").isEmpty()
    turns = [[100 * u + m for u in range(0, 60, 2) for m in range(4)], [100 * 4 + 1, 100 * 7, 100 * 7, 5000000], []]
    for turn in turns:
        spark.createDataFrame([(m,) for m in turn], "marker long").write.mode("append").parquet(str(tmp_path / "in"))
        tags = spark.readStream.schema("marker long").parquet(str(tmp_path / "in"))
        state.keep(state.tallies(tags, db, panels, slice_size=100), str(tmp_path / "out"), str(tmp_path / "cp"))
    seen = [(m,) for turn in turns for m in turn]
    sample = digest.counts(spark.createDataFrame(seen, "marker long"), marker="marker")
    want = profile.panel_stats(db, sample).where("detected1 > 0")
    assert sorted(map(tuple, state.stats(spark, str(tmp_path / "out"), panels).collect())) == sorted(map(tuple, want.collect()))
