"""FASTA and FASTQ readers, plain or gzip."""

from __future__ import annotations

import gzip
import io
import json
import re
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from helixtally.functions.arrow import buffers
from helixtally.sources import records

FASTA, FASTQ = (".fa", ".fasta", ".fna"), (".fq", ".fastq")
#: Spark's setting for how many files a task writes at a time, and what it is here.
WRITERS, OPEN = "spark.sql.maxConcurrentOutputFileWriters", 16
EDGES = r"^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$"


def logical_name(path: str) -> str:
    """The lower-case file name without .gz."""
    name = PurePosixPath(path).name.lower()
    return name[:-3] if name.endswith(".gz") else name


def is_gzipped(path: str) -> bool:
    return path.lower().endswith(".gz")


def is_fastq(path: str) -> bool:
    return logical_name(path).endswith(FASTQ)


def is_fasta(path: str) -> bool:
    return logical_name(path).endswith(FASTA)


def is_fastx(path: str) -> bool:
    return is_fasta(path) or is_fastq(path)


def stem(path: str) -> str:
    """The file name without .gz and one further extension."""
    name = PurePosixPath(path).name
    name = name[:-3] if name.lower().endswith(".gz") else name
    return re.sub(r"(?<=.)\.[^.]*$", "", name)


def fasta_records(text: Column) -> Column:
    """The sequences of a FASTA text: lines trimmed, wrapped ones joined, empty records left out."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, EDGES, ""))
    marked = F.array_join(F.transform(lines, lambda x: F.when(x.startswith(">"), F.lit(">")).otherwise(x)), "")
    return F.array_remove(F.split(marked, ">", -1), "")


def fastq_records(text: Column) -> Column:
    """The second line of every four, empty ones too."""
    lines = F.split(text, "\n", -1)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)  # the last line ends the file
    return F.transform(F.filter(lines, lambda x, i: i % 4 == 1), lambda x: F.regexp_replace(x, EDGES, ""))


def files_of(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The files that a path or pattern names, empty ones too, with those in folders that it names, but not below them."""
    sc, out = spark.sparkContext, []
    for p in [path] if isinstance(path, str) else path:
        where = sc._jvm.org.apache.hadoop.fs.Path(p)
        fs = where.getFileSystem(sc._jsc.hadoopConfiguration())
        found = [s for s in fs.globStatus(where) or []]
        if not found:
            raise FileNotFoundError(f"no file at {p}")
        for s in found:
            out += [x.getPath().toString() for x in (fs.listStatus(s.getPath()) if s.isDirectory() else [s]) if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
    return sorted(out)


def source_name(path: str) -> str:
    """The name of the file at a path, or of the folder that Spark wrote it into as a part."""
    parts = path.split("/")
    return parts[-2] if parts[-1].startswith("part-") and len(parts) > 1 else parts[-1]


def source_name_of(path: Column) -> Column:
    """The same of a column of paths."""
    return F.regexp_extract(F.regexp_replace(path, "/part-[^/]*$", ""), "[^/]*$", 0)


def read_sequences(spark: SparkSession, path: str | list[str], split_bytes: int | None = None) -> DataFrame:
    """(file, seq_no, seq) of every record of FASTA and FASTQ files, plain or gzip.

    Tasks read ranges of `split_bytes` (spark.sql.files.maxPartitionBytes if not given) of plain and block-gzip files, each
    the records that begin in it, and other gzip files whole; small files share a task while there are enough for all cores. A name that ends in neither is FASTA. seq_no is the number of
    the byte at which a record begins, so it follows the order in the file. A missing file, a broken archive, and a
    file of several ranges with something else than FASTQ records in it, are errors. Files of a scheme that Arrow
    doesn't know are read through Spark, each by one task.
    """
    paths = files_of(spark, path)
    if not paths:
        raise FileNotFoundError(f"no file at {path}")
    return read_ranges(spark, paths, split_bytes)


def read_lines(spark: SparkSession, path: str | list[str], unreadable: str = "error") -> DataFrame:
    """(file, no, value) of every line of text files, plain or gzip; no is the number of the byte at which a line begins.

    unreadable: "empty" makes a gzip file that can't be unpacked to its end an empty one.
    """
    return read_ranges(spark, files_of(spark, path), None, lines="true", unreadable=unreadable).select("file", F.col("seq_no").alias("no"), F.col("seq").alias("value"))


def read_ranges(spark: SparkSession, paths: list[str], split_bytes: int | None, **options: str) -> DataFrame:
    known, other = [p for p in paths if records.readable(p)], [p for p in paths if not records.readable(p)]
    out = []
    if known or not other:
        spark.dataSource.register(records.Fastx)
        size = split_bytes or int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
        out.append(spark.read.format("fastx").options(**options).option("files", json.dumps(records.sizes(known))).option("splitBytes", size).option("tasks", spark.sparkContext.defaultParallelism).load())
    if other:
        out.append(spark.read.format("binaryFile").load(other).select("path", "content").mapInArrow(whole_files(**options), records.SCHEMA))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def whole_files(lines: str = "", unreadable: str = ""):
    """The same for files whose bytes are a column."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                held = content.as_buffer()
                p, opening = records.Piece(path, 0, len(held), len(held)), lambda _, held=held: io.BytesIO(held)
                if unreadable != "empty" or not is_gzipped(path) or records.sound(p, opening):
                    yield from records.read_piece(p, opening, lines == "true")

    return run


def read_genomes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(genomes, sequences) of the FASTA files of a folder, not of those below it.

    genomes: gid (by file name), name, n_contigs, which is 0 for a file without sequences; sequences: gid, seq_no, seq.
    """
    paths = [p for p in files_of(spark, folder) if is_fasta(p)]
    if not paths:
        raise FileNotFoundError(f"no FASTA file in {folder}")
    names = sorted(PurePosixPath(p).name for p in paths)
    listed = spark.createDataFrame([(k, n, stem(n)) for k, n in enumerate(names)], "gid long, file string, name string")  # a row per file
    seqs = read_sequences(spark, paths).withColumn("file", F.regexp_extract("file", "[^/]*$", 0))
    seqs = seqs.join(listed.select("gid", "file"), "file").select("gid", "seq_no", "seq")
    n = seqs.groupBy("gid").agg(F.count("*").alias("n_contigs"))
    return listed.join(n, "gid", "left").select("gid", "name", F.coalesce("n_contigs", F.lit(0)).alias("n_contigs")), seqs


def record_texts(sequences: DataFrame, name: str, fastq: bool = False, letters: tuple[str, str] | None = None) -> DataFrame:
    """(the other columns, value): each seq as the text of a FASTA record, or of a FASTQ record whose qualities are all I.

    letters: characters of the sequences (ASCII), and the bases they stand for, which are put in their place here.
    """
    keep, table = [c for c in sequences.columns if c not in (name, "seq")], bytes.maketrans(*(x.encode() for x in letters or ("", "")))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, off = buffers(b["seq"])
            known = pc.is_valid(b["seq"])
            put = lambda x: pc.if_else(known, pa.StringArray.from_buffers(b.num_rows, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(x)), None)  # noqa: B023, E731
            bases = data.tobytes().translate(table)
            rest = ["\n+\n", put(b"I" * len(bases))] if fastq else []
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pc.binary_join_element_wise("@" if fastq else ">", b[name].cast(pa.string()), "\n", put(bases), *rest, "")], [*keep, "value"])

    return sequences.select(*keep, name, "seq").mapInArrow(run, StructType([*(sequences.schema[c] for c in keep), StructField("value", StringType())]))


def write_texts(texts: DataFrame, path: str, by: str, gzipped: bool = False) -> None:
    """The column value of (by, value) as text files in a folder for each value of by, gzip ones packed for speed.

    Tasks keep a file open for each of up to OPEN values, so that long texts are not sorted; with more, Spark sorts.
    """
    spark = texts.sparkSession
    before = spark.conf.get(WRITERS, None)
    spark.conf.set(WRITERS, OPEN)
    try:
        out = texts.write.partitionBy(by)
        (out.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED") if gzipped else out).text(path)
    finally:
        spark.conf.unset(WRITERS) if before is None else spark.conf.set(WRITERS, before)


def write_fasta(rows: list[tuple[str, str]], path: str, width: int = 60) -> None:
    """A small FASTA file, for tests and demonstrations."""
    body = "".join(f">{n}\n" + "".join(f"{s[i : i + width]}\n" for i in range(0, len(s), width)) for n, s in rows)
    with gzip.open(path, "wt") if is_gzipped(path) else open(path, "w") as f:
        f.write(body)
