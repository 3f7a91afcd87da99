"""Sequence files by ranges of bytes: every record once, however the file is cut."""

import gzip
import random
import zlib

import pytest
from pyspark.sql import functions as F

from helixtally.functions.dna import RECOMMENDED
from helixtally.operators import digest
from helixtally.sources import fastx, records
from helixtally.streaming import counts as streaming


def block_gzip(data: bytes, size: int) -> bytes:
    """data as gzip members of `size` bytes each, with their lengths in their headers, and an empty one at the end."""
    out = b""
    for part in [*(data[i : i + size] for i in range(0, len(data), size)), b""]:
        pack = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = pack.compress(part) + pack.flush()
        out += records.BLOCK_START + b"\0\0\0\0\0\xff" + records.BLOCK_FIELD + (len(body) + 25).to_bytes(2, "little") + body + zlib.crc32(part).to_bytes(4, "little") + len(part).to_bytes(4, "little")
    return out


def read(path: str, size: int, length: int, by_lines: bool = False) -> list[tuple[int, str]]:
    out = []
    for part in records.pieces_of([(path, length)], size):
        for p in part.pieces:
            for b in records.read_piece(p, by_lines=by_lines):
                out += zip(b["seq_no"].to_pylist(), b["seq"].to_pylist(), strict=True)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_any_cut(tmp_path, monkeypatch, seed):
    """Random files, kinds of compression, ranges and buffers, against plain parsing."""
    rnd = random.Random(seed)
    monkeypatch.setattr(records, "CHUNK", rnd.choice([7, 50, 1000, 1 << 22]))
    fastq, eol = rnd.random() < 0.5, rnd.choice(["\n", "\n", "\r\n"])
    seqs = ["".join(rnd.choice("ACGTN") for _ in range(rnd.choice([0, 1, 5, 40, 200]))) for _ in range(rnd.randint(0, 30))]
    if fastq:
        text = "".join(f"@r{i} x{eol}{s}{eol}+{eol}{''.join(rnd.choice('@+I>') for _ in s)}{eol}" for i, s in enumerate(seqs))
        want = seqs
    else:
        text = "".join(f"{rnd.choice(['>', ' >'])}c{i}>y{eol}" + "".join(f"{s[j : j + 30]}{rnd.choice(['', ' '])}{eol}" for j in range(0, len(s), 30)) for i, s in enumerate(seqs))
        text, want = f"ACGT{eol}{text}", ["ACGT", *(s for s in seqs if s)]
    text = text[: -len(eol)] if text and rnd.random() < 0.3 else text
    kind = rnd.choice(["plain", "gzip", "blocks"])
    data = {"plain": text.encode(), "gzip": gzip.compress(text.encode()), "blocks": block_gzip(text.encode(), rnd.choice([10, 100, 60000]))}[kind]
    path = tmp_path / f"x.{'fq' if fastq else 'fa'}{'' if kind == 'plain' else '.gz'}"
    path.write_bytes(data)
    lines = text.split("\n")
    for size in (rnd.randint(20, 100), rnd.randint(100, 2000), 1 << 27):
        got = read(str(path), size, len(data))
        assert [s for _, s in got] == want and [k for k, _ in got] == sorted({k for k, _ in got})
        assert [s for _, s in read(str(path), size, len(data), by_lines=True)] == (lines[:-1] if lines[-1] == "" else lines)


def sample(n: int, seed: int = 5) -> tuple[list[str], str]:
    rnd = random.Random(seed)
    seqs = ["".join(rnd.choices("ACGT", k=rnd.randint(0, 400))) for _ in range(n)]
    return seqs, "".join(f"@r{i}\n{s}\n+\n{'@' * len(s)}\n" for i, s in enumerate(seqs))


def test_split_sizes(spark, tmp_path):
    """Digests don't depend on the split size, nor on one that changes after the frame is made."""
    seqs, text = sample(4000)
    (tmp_path / "s.fq").write_text(text)
    (tmp_path / "s.fq.gz").write_bytes(gzip.compress(text.encode()))
    tally = lambda df: sorted(map(tuple, digest.counts(digest.digest(df.select("seq"), RECOMMENDED), "enzyme_id").collect()))
    want = tally(spark.createDataFrame([(s,) for s in seqs], "seq string"))
    assert len(want) > 100
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size, other in (("10k", "1m"), ("100k", "10k"), ("128m", "50k")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = fastx.read_sequences(spark, str(tmp_path / "s.fq"))
            spark.conf.set("spark.sql.files.maxPartitionBytes", other)
            assert df.count() == len(seqs) and tally(df) == want
        assert tally(fastx.read_sequences(spark, str(tmp_path / "s.fq.gz"))) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_block_gzip(spark, tmp_path):
    """A block-gzip file is read by many tasks, each record by one."""
    seqs, text = sample(3000)
    data = block_gzip(text.encode(), len(text) // 100)
    (tmp_path / "s.fastq.gz").write_bytes(data)
    df = fastx.read_sequences(spark, str(tmp_path / "s.fastq.gz"), split_bytes=len(data) // 10)
    rows = df.withColumn("task", F.spark_partition_id()).orderBy("seq_no").collect()
    assert [r.seq for r in rows] == seqs and len({r.task for r in rows}) >= 8
    (tmp_path / "cut.fastq.gz").write_bytes(data[: len(data) // 2 + 5])
    with pytest.raises(Exception, match="unexpected end"):
        fastx.read_sequences(spark, str(tmp_path / "cut.fastq.gz"), split_bytes=len(data) // 10).count()


def test_no_silent_loss(spark, tmp_path):
    """What is not FASTQ is read by lines if whole, and is an error in ranges."""
    path = tmp_path / "odd.fq"
    path.write_text("".join(f"r{i}\nACGT\nx\nIIII\n" for i in range(500)))
    assert fastx.read_sequences(spark, str(path)).count() == 500
    with pytest.raises(Exception, match="no FASTQ record at byte 0"):
        fastx.read_sequences(spark, str(path), split_bytes=1000).count()


def test_stream(spark, tmp_path):
    """A stream of files gives what a read of all gives, in one run or several."""
    folder = tmp_path / "in"
    folder.mkdir()
    spark.dataSource.register(records.Fastx)
    texts = [sample(50, k) for k in range(4)]
    files = lambda: spark.readStream.format("fastx").option("splitBytes", 3000).load(str(folder))
    for k in range(4):
        (folder / f"r{k}.fq").write_text(texts[k][1])
        if k % 2:
            streaming.run_to_parquet(streaming.stream_counts(files(), RECOMMENDED, "file"), str(tmp_path / "out"), str(tmp_path / "cp"))
            seqs = spark.createDataFrame([(f"file:{folder}/r{i}.fq", s) for i in range(k + 1) for s in texts[i][0]], "file string, seq string")
            want = sorted(map(tuple, digest.counts(digest.digest(seqs, RECOMMENDED), "file").collect()))
            assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want and len(want) > 100
    assert spark.read.format("fastx").load(str(folder)).count() == 200


def test_broken_database_is_empty(spark, tmp_path):
    """A database that is cut short counts as an empty one, not as what came before the cut."""
    from helixtally.sources import tables

    text = "#helixtally-db\t2000\tBcgI\n" + "".join(f"u{i}\t{i:x},{i + 7:x}\n" for i in range(2000))
    packed = gzip.compress(text.encode())
    (tmp_path / "good.db.gz").write_bytes(packed)
    (tmp_path / "half.db.gz").write_bytes(packed[: len(packed) // 2])
    head, units, _ = tables.read_databases(spark, str(tmp_path))
    assert {r.species for r in head.collect()} == {"good.db", "half.db"}
    assert {(r.species, r["count"]) for r in units.groupBy("species").count().collect()} == {("good.db", 4000)}


def test_small_files_are_dealt_among_tasks():
    """Files that would fit one range are as many partitions as can run at a time; gzip counts for what it holds; none is lost or cut."""
    files = [(f"/x/{k}.fq.gz" if k % 2 else f"/x/{k}.fa", 1 << 22) for k in range(24)]
    for tasks in (1, 6, 100):
        got = records.pieces_of(files, 1 << 27, tasks)
        assert [(p.path, p.start, p.end) for part in got for p in part.pieces] == [(p, 0, n) for p, n in files]
        assert len(got) >= min(tasks, len(files))
        heavy = [sum(records.weight(p.path, p.end - p.start) for p in part.pieces) for part in got]
        assert max(heavy) <= max(2 * sum(heavy) / min(tasks, 24), 1 << 27 if tasks == 1 else 0)


def test_texts_of_records_are_read_back(spark, tmp_path):
    """FASTA and gzip FASTQ by species, more of them than a task keeps open, with letters for bases, null and empty sequences."""
    rows = [(f"s{k % 20}", k, "0123456789abcdef"[k % 16 :] * (k % 3)) for k in range(200)] + [("s1", 900, None)]
    seqs = spark.createDataFrame(rows, "species string, gid long, seq string").repartition(3)
    letters = ("0123456789abcdef", "ACGTACGTACGTACGT")
    want = [(s, x.translate(str.maketrans(*letters))) for s, _, x in rows if x is not None]
    for name, fastq in (("fasta", False), ("fastq", True)):
        texts = fastx.record_texts(seqs, "gid", fastq=fastq, letters=letters)
        if fastq:
            texts = texts.withColumn("species", F.concat("species", F.lit(".fq")))
            assert sorted(v for v in texts.toPandas()["value"] if v)[:1] == ["@0\n\n+\n"]
        fastx.write_texts(texts.where("value IS NOT NULL"), str(tmp_path / name), "species", gzipped=fastq)
        assert spark.conf.get(fastx.WRITERS) == "0"
        got = fastx.read_sequences(spark, str(tmp_path / name / "species=*")).select(F.regexp_extract("file", "species=([^/.]*)", 1), "seq")
        assert sorted(map(tuple, got.collect())) == sorted(x for x in want if fastq or x[1])


def test_texts_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    """A task keeps the files of a few species open: with one file at a time, long texts would be sorted first."""
    seen, write = [], type(spark.range(1).write).text
    monkeypatch.setattr(type(spark.range(1).write), "text", lambda self, path: (seen.append(spark.conf.get(fastx.WRITERS)), write(self, path))[1])
    fastx.write_texts(spark.createDataFrame([("a", "x"), ("b", "y")], "species string, value string"), str(tmp_path / "o"), "species")
    assert seen == [fastx.OPEN] or seen == [str(fastx.OPEN)]
