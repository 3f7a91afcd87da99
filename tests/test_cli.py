"""Each command of the command line, on small files."""

import numpy as np
import pytest

from helixtally.plans import cli
from helixtally.sources import fastx


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Genomes of two species (two near-identical pairs each), a sample of one strain of the first, and an empty genome."""
    out, rng = tmp_path_factory.mktemp("cli"), np.random.default_rng(2)
    dna = lambda n: "".join(rng.choice(list("ACGT"), n))
    reads = []
    for species in ("one", "two"):
        (out / species).mkdir()
        shared = dna(60000)
        for strain in "ab":
            own = dna(60000)
            for copy in "12":
                fastx.write_fasta([("c", shared), ("d", own)], str(out / species / f"{strain}{copy}.fa"))
            if (species, strain) == ("one", "a"):
                reads = [shared, own] * 6
    (out / "one" / "nothing.fa").write_text("")
    (out / "s.fq").write_text("".join(f"@r{k}\n{s}\n+\n{'I' * len(s)}\n" for k, s in enumerate(reads)))
    return out


def lines(path):
    return [x for f in sorted(path.glob("part-*")) for x in f.read_text().splitlines()]


def test_cluster_profile_and_info(spark, folder, capsys):
    enzyme = ["--enzyme", "BcgI,BslFI"]
    for species in ("one", "two"):
        assert cli.main(["cluster", "--genomes", str(folder / species), "--out", str(folder / f"{species}.tsv"), "--min-tag-fraction", "0.1", *enzyme]) == 0
    members = lines(folder / "one.members.tsv")
    assert members == ["#genome\tcluster", "a1\tC0", "a2\tC0", "b1\tC1", "b2\tC1"]
    assert "nothing" in capsys.readouterr().out
    assert lines(folder / "one.tsv")[0].endswith("\t2\tBcgI,BslFI")
    assert cli.main(["profile", "--db", str(folder / "one.tsv"), "--sample", str(folder / "s.fq"), "--out", str(folder / "p.tsv")]) == 0
    report = [x.split("\t") for x in lines(folder / "p.tsv")]
    assert report[0][0] == "#strain" and [r[:2] for r in report[1:]] == [["C0", "1.000000"]]
    assert cli.main(["info", "--db", str(folder / "one.tsv")]) == 0
    dbs = folder / "dbs"
    dbs.mkdir()
    (dbs / "two.members.tsv").write_text("not a database")
    (dbs / "one.tsv").write_text("\n".join(lines(folder / "one.tsv")))
    assert cli.main(["cluster", "--genomes", str(folder / "two"), "--out", str(dbs / "two.parquet"), "--min-tag-fraction", "0.1", *enzyme]) == 0
    (dbs / "broken.tsv").write_bytes(b"A\t\xff\xfe\n")
    assert cli.main(["multi-profile", "--dbs", str(dbs), "--sample", str(folder / "s.fq"), "--out", str(folder / "m.tsv"), "--min-species-markers", "20", *enzyme]) == 0
    report = [x.split("\t") for x in lines(folder / "m.tsv")]
    assert report[0][0] == "#species" and [r[:2] for r in report[1:]] == [["one", "C0"]]
    assert "absent" in capsys.readouterr().out
    parquet = folder / "parquet"
    for species in ("one", "two"):
        assert cli.main(["cluster", "--genomes", str(folder / species), "--out", str(parquet / f"{species}.parquet"), "--min-tag-fraction", "0.1", *enzyme]) == 0
    assert cli.main(["multi-profile", "--dbs", str(parquet), "--sample", str(folder / "s.fq"), "--out", str(folder / "n.tsv"), "--min-species-markers", "20", *enzyme]) == 0
    assert lines(folder / "n.tsv") == lines(folder / "m.tsv")


def test_build_to_parquet_and_evaluate(spark, folder, capsys):
    out = str(folder / "built.parquet")
    assert cli.main(["build", "--genomes", str(folder / "two"), "--out", out, "--enzyme", "BcgI"]) == 0
    assert cli.main(["info", "--db", out]) == 0
    (folder / "pred.tsv").write_text("A\t0.6\nB\t0.4\n")
    (folder / "true.tsv").write_text("A\t0.5\nC\t0.5\n")
    assert cli.main(["evaluate", "--pred", str(folder / "pred.tsv"), "--truth", str(folder / "true.tsv")]) == 0
    assert "bray_curtis" in capsys.readouterr().out


@pytest.mark.parametrize("name", ["demo", "cst-demo"])
def test_demonstrations(spark, name):
    assert cli.main([name]) == 0


def test_errors(spark, folder, capsys):
    assert cli.main(["build", "--genomes", str(folder / "missing"), "--out", str(folder / "x")]) == 1
    assert cli.main(["build", "--genomes", str(folder / "one"), "--out", str(folder / "x"), "--enzyme", "nope"]) == 1
    assert "error" in capsys.readouterr().err
