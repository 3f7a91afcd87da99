import gzip
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixtally.functions import dna
from helixtally.operators import digest
from helixtally.sources import fastx, tables


def pattern(n, a, b, c):
    return "".join("ACGT"[(a * i + i // b + i % c) % 4] for i in range(n))


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def tag_counts(spark, seqs, enzymes):
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    return {(r.enzyme_id, r.tag): r.n for r in digest.digest(df, enzymes).groupBy("enzyme_id", "tag").agg(F.count("*").alias("n")).collect()}


def test_enzyme_table():
    assert [e.enzyme_id for e in dna.ENZYMES] == list(range(1, 17))
    assert len(dna.RECOMMENDED) == 14
    for e in dna.ENZYMES:
        for p in e.patterns:
            one = re.sub(r"\[[ACGT]+\]", "N", p)
            size = sum(int(x[1]) if x[1] else 1 for x in re.findall(r"([ACGTN])(?:\{(\d+)\})?", one))
            assert size == e.tag_length


def test_enzyme_sets():
    assert len(dna.enzyme_set("ALL")) == 16 and len(dna.enzyme_set("recommended")) == 14
    assert [e.name for e in dna.enzyme_set("bcgi, 16,BcgI")] == ["BcgI", "BslFI", "BcgI"]
    for bad in ("", "nope", "BcgI,nope"):
        with pytest.raises(ValueError):
            dna.enzyme_set(bad)


def test_site_and_multiplicity(spark):
    window = list("A" * 32)
    window[10:13], window[19:22] = "CGA", "TGC"
    seq = "TTTTT" + "".join(window) + "TTTTT"
    got = digest.sites(spark.createDataFrame([("a", seq), ("b", "\u00e9" + seq.lower()), ("c", None)], "name string, seq string"), [dna.enzyme("BcgI")], canonical=False).collect()
    assert sorted((r.name, r.pos, r.tag) for r in got) == [("a", 5, "".join(window)), ("b", 6, "".join(window))]
    twice = tag_counts(spark, ["".join(window) + "GG" + "".join(window)], [dna.enzyme("BcgI")])
    assert max(twice.values()) >= 2


def test_strands_case_and_brute_force(spark):
    long, other = pattern(8000, 7, 3, 11), pattern(4000, 5, 7, 13)
    assert tag_counts(spark, [long], dna.ENZYMES) == tag_counts(spark, [revcomp(long)], dna.ENZYMES)
    assert tag_counts(spark, [other], dna.ENZYMES) == tag_counts(spark, [other.lower()], dna.ENZYMES)
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("ACGTN"), 6000, p=[0.245] * 4 + [0.02]))
    want = {}
    for e in dna.ENZYMES:
        for i in range(len(text) - e.tag_length + 1):
            t = text[i : i + e.tag_length]
            if re.fullmatch(e.regex, t):
                key = (e.enzyme_id, min(t, revcomp(t)))
                want[key] = want.get(key, 0) + 1
    assert tag_counts(spark, [text], dna.ENZYMES) == want


def test_chunks_meet(monkeypatch):
    rng = np.random.default_rng(1)
    rows = ["".join(rng.choice(list("ACGT"), n)).encode() for n in (700, 3, 0, 900)]
    data, off = np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])
    found = lambda: sorted((e, int(r), int(p), bytes(t)) for e, row, at, tags in dna.Cutter(dna.ENZYMES).sites(data, off) for r, p, t in zip(row, at, tags, strict=True))
    whole = found()
    monkeypatch.setattr(dna, "CHUNK", 50)
    assert found() == whole and len(whole) > 20
    assert whole == sorted((e.enzyme_id, k, i, r[i : i + e.tag_length]) for e in dna.ENZYMES for k, r in enumerate(rows) for i in range(len(r)) if re.fullmatch(e.regex, r[i : i + e.tag_length].decode()))


def test_same_window_counts_for_each_enzyme(spark):
    seq = "ACGTACG" + "GAAC" + "ACGTAC" + "TCC" + "ACGTACG"
    both = tag_counts(spark, [seq], [dna.enzyme("AloI"), dna.enzyme("AloI")])
    assert list(both.values()) == [2]


def test_canonical_columns_match_the_digest(spark):
    tags = ["ACGTT", "AACGT", "ttttt", "GGGCC", "acgnt"]
    df = spark.createDataFrame([(t,) for t in tags], "t string").select("t", dna.canonical(F.col("t")).alias("c"))
    assert {r.t: r.c for r in df.collect()} == {t: min(t.upper(), revcomp(t.upper())) for t in tags}
    cells = np.array([list(t.upper().encode()) for t in tags], np.uint8)
    assert [bytes(x).decode() for x in dna.canonical_cells(cells)] == [min(t.upper(), revcomp(t.upper())) for t in tags]


def test_hashes(spark):
    def fnv(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    texts = ["", "A", "ACGT" * 8, "TTTTTTT", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("m", dna.fnv64("t"))
    got = df.withColumn("hex", dna.to_hex(F.col("m"))).withColumn("back", dna.from_hex(F.col("hex"))).collect()
    for r in got:
        if r.t is None:
            assert r.m is None
        else:
            assert r.m % 2**64 == fnv(r.t) and int(r.hex, 16) == fnv(r.t) and r.back == r.m
    assert spark.createDataFrame([("xyz",), ("12",), ("",)], "h string").select(dna.from_hex(F.col("h"))).collect() == [(None,), (18,), (None,)]


def test_names():
    assert [fastx.stem(p) for p in ("/d/GCF_000001.FNA.GZ", "/d/a.b.c.fasta.gz", "/d/sample.fq.gz")] == ["GCF_000001", "a.b.c", "sample"]
    assert fastx.is_fasta("x.FNA.gz") and not fastx.is_fasta("x.fastq") and fastx.is_fastq("x.fq.GZ") and fastx.is_fastx("a.fa")


def test_files(spark, tmp_path):
    (tmp_path / "w.fa").write_bytes(b">a\r\nACGT  \r\n  GGGG\t\r\n")
    assert [r.seq for r in fastx.read_sequences(spark, str(tmp_path / "w.fa")).collect()] == ["ACGTGGGG"]
    rows = [("a>1", pattern(200, 7, 3, 11)), ("b", pattern(150, 5, 7, 13)), ("c", "")]
    fastx.write_fasta(rows, str(tmp_path / "g.fasta"))
    fastx.write_fasta(rows, str(tmp_path / "g.fasta.gz"))
    plain, packed = (sorted(r.seq for r in fastx.read_sequences(spark, str(tmp_path / f)).collect()) for f in ("g.fasta", "g.fasta.gz"))
    assert plain == packed == sorted(s for _, s in rows if s)
    reads = "".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, (_, s) in enumerate(rows))
    (tmp_path / "r.fq").write_text(reads)
    with gzip.open(tmp_path / "r.fq.gz", "wt") as f:
        f.write(reads)
    for name in ("r.fq", "r.fq.gz"):
        assert sorted(r.seq for r in fastx.read_sequences(spark, str(tmp_path / name)).collect()) == sorted(s for _, s in rows)
    genomes, _ = fastx.read_genomes(spark, str(tmp_path))
    assert [(r.gid, r.name, r.n_contigs) for r in genomes.orderBy("gid").collect()] == [(0, "g", 2), (1, "g", 2), (2, "w", 1)]


def test_streamed_files(spark, tmp_path):
    """Files over many blocks, and gzip ones, give what a whole read gives; broken ones are errors."""
    rng = np.random.default_rng(3)
    reads = ["".join(rng.choice(list("ACGT"), int(rng.integers(0, 90)))) for _ in range(3000)]
    fastq = "".join(f"@r{i}\n{s}\n+\n{'@' * len(s)}\n" for i, s in enumerate(reads))
    fasta = "".join(f">c{i}>x\n{s[:40]}\n{s[40:]}\n" for i, s in enumerate(reads))
    for name, text in (("r.fastq", fastq), ("g one+two.fa", fasta)):
        (tmp_path / name).write_text(text)
        with gzip.open(tmp_path / f"{name}.gz", "wt") as f:
            f.write(text)
    (tmp_path / "empty.fna").write_text("")
    (tmp_path / "names.fna").write_text(">only\n>names")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "x.fa").write_text(">a\nACGT\n")
    (tmp_path / "bare.fa").write_text("ACGT\n>b\nGG\n >c\nTT")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for name in ("r.fastq", "r.fastq.gz"):
            got = fastx.read_sequences(spark, str(tmp_path / name)).collect()
            assert [r.seq for r in sorted(got, key=lambda r: r.seq_no)] == reads
        for name in ("g one+two.fa", "g one+two.fa.gz"):
            df = fastx.read_sequences(spark, str(tmp_path / name))
            assert name.endswith("gz") or df.rdd.getNumPartitions() > 5
            assert [r.seq for r in sorted(df.collect(), key=lambda r: r.seq_no)] == [s for s in reads if s]
        both = fastx.read_sequences(spark, [str(tmp_path / "r.fastq"), str(tmp_path / "bare.fa")])
        assert both.count() == 3003
        genomes, seqs = fastx.read_genomes(spark, str(tmp_path))
        n = sum(map(bool, reads))
        assert [(r.name, r.n_contigs) for r in genomes.orderBy("gid").collect()] == [("bare", 3), ("empty", 0), ("g one+two", n), ("g one+two", n), ("names", 0)]
        assert seqs.where("gid = 0").count() == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "bad.fq.gz").write_bytes((tmp_path / "r.fastq.gz").read_bytes()[:500])
    with pytest.raises(Exception, match="(?i)unexpected end|eof"):
        fastx.read_sequences(spark, str(tmp_path / "bad.fq.gz")).collect()
    with pytest.raises(FileNotFoundError):
        fastx.read_sequences(spark, str(tmp_path / "none.fq"))
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        fastx.read_genomes(spark, str(tmp_path / "none"))


def test_abundance_lines(spark):
    lines = ["#name\tabundance", "A\t0.7", " B\t0.3 ", "", "C\tx", "A\t0.6"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")
    assert {r.name: r.abundance for r in tables.abundances(df).collect()} == {"A": 0.6, "B": 0.3}
