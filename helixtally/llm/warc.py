"""WARC: serialise pages to WARC records and files, and audit replicas with Merkle trees.

A replica is a table of records (file, part, offset, length, page_id, record), made from pages or read from WARC files.
Leaves are the digests of records; a node of the first level covers a range of offsets of a file, whose borders are records
that their ids single out, so that a lost, added or damaged record touches one branch only, even where it moves all
offsets behind it. Roots are compared first, then only the children of nodes that differ, and records themselves only
below first-level nodes that differ.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixtally.sources.records import local_path, opened

from .common import settle, table

#: One record id in so many begins a range of offsets; groups of ranges in a file at most.
BORDER, FANOUT = 16, 16
RECORDS_PER_FILE = 256
#: The date of records that are made from pages, which have none of their own.
DATE = "1970-01-01T00:00:00Z"
FILE = ["file", "part"]
END = "\r\n\r\n"


def number_of(text: Column) -> Column:
    """A number from 0 on that depends on a text, and that SQL can give too."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def records(pages: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """(page_id, file, part, offset, length, record) of every page: a WARC/1.0 resource record in UTF-8.

    A null url or html is empty, a null id stands as an empty record id; pages with equal ids, and repeated rows, each get
    a record, in the order of their bytes. The file is page_id div per_file (null ids: file -1), part 0; a file of more
    than 4 * per_file rows is dealt to parts of about so many by a hash of the record and, so that copies spread too, the number of
    the copy. So a part depends on nothing but the rows of its file. A very long page is one record. Other columns of
    pages don't come out, so their names can't clash.
    """
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    size = F.octet_length(html)
    head = F.concat(
        F.lit(f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"),
    )
    file, limit = F.coalesce(F.floor(F.col("page_id") / per_file), F.lit(-1)).cast("long"), 4 * per_file
    counts = pages.groupBy(file.alias("file")).agg(F.count("*").alias("n")).where(F.col("n") > limit).select("file", F.ceil(F.col("n") / limit).alias("parts"))
    every = pages.select("page_id", file.alias("file"), F.concat(head, html, F.lit(END)).alias("record")).join(counts, "file", "left")
    few = every.where("parts IS NULL").withColumn("copies", F.lit(1).cast("long"))  # at most `limit` rows a file, copies too
    many = every.where("parts IS NOT NULL").groupBy("page_id", "file", "record", "parts").agg(F.count("*").alias("copies"))
    out = few.unionByName(many).withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / limit))))
    n = F.least(F.lit(limit), F.col("copies") - F.col("block") * limit)
    part = F.coalesce(F.pmod(number_of(F.col("record")) + F.col("block"), F.col("parts")), F.lit(0)).cast("int")
    out = out.select("page_id", "file", part.alias("part"), "block", n.alias("n"), F.octet_length("record").cast("long").alias("length"), "record")
    order = Window.partitionBy(*FILE).orderBy("page_id", "record", "block").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("offset", F.coalesce(F.sum(F.col("length") * F.col("n")).over(order), F.lit(0)))
    out = out.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return out.select("page_id", *FILE, (F.col("offset") + F.col("i") * F.col("length")).cast("long").alias("offset"), "length", "record")


def leaves(replica: DataFrame) -> DataFrame:
    """(file, part, node, offset, length, page_id, record_sha256, digest): the record digests of a replica.

    A node is a range of offsets from a border record on. A record is a border if its id says so, one of BORDER ids, so
    that ranges begin at the same records in every replica, whatever is lost, added or moved before them; the node is
    named by that record's id and its place among equal ids. A replica that was read from a file after a loss
    has other offsets behind it, so that digests are of lengths and contents in their order, and not of offsets.
    """
    slim = replica.select(*FILE, "offset", "length", "page_id", F.sha2(F.col("record").cast("binary"), 256).alias("record_sha256"))
    mark = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.col("record_sha256")).cast("binary")), 1, 2)
    start = F.when(F.conv(mark, 16, 10).cast("int") % BORDER == 0, F.coalesce(F.col("page_id").cast("string"), F.col("record_sha256")))
    order = Window.partitionBy(*FILE).orderBy("offset", "record_sha256").rowsBetween(Window.unboundedPreceding, 0)
    slim = slim.withColumn("node", F.coalesce(F.last(start, ignorenulls=True).over(order), F.lit("")))
    return slim.withColumn("digest", F.sha2(F.concat_ws(":", "length", "record_sha256"), 256))


def tree(leaf: DataFrame) -> DataFrame:
    """(file, part, level, node, digest): the nodes of four levels: ranges (1), groups of them by their names' digests (2),
    files (3), and one root (4).

    Equal leaves count as one with their number, so a range's list is short, whatever is repeated.
    """
    some = leaf.groupBy(*FILE, "node", "digest").agg(F.count("*").alias("n"), F.min("offset").alias("at"))
    first = some.groupBy(*FILE, "node").agg(F.sort_array(F.collect_list(F.struct("at", "digest", "n"))).alias("c"))
    first = settle(first.select(*FILE, F.lit(1).alias("level"), "node", F.sha2(F.to_json(F.transform("c", lambda x: F.struct(x["digest"], x["n"]))), 256).alias("digest")))
    up = lambda df, level, *names: df.groupBy(*[n.alias(c) for n, c in zip(names, [*FILE, "node"], strict=True)]).agg(F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("c")).select(*FILE, F.lit(level).alias("level"), "node", F.sha2(F.to_json("c"), 256).alias("digest"))
    second = up(first, 2, F.col("file"), F.col("part"), group_of(F.col("node")))
    third = up(second, 3, F.col("file"), F.col("part"), F.lit(""))
    root = third.agg(F.sha2(F.concat_ws("", F.sum(F.xxhash64(*FILE, "digest").cast("decimal(38,0)")).cast("string"), F.bit_xor(F.xxhash64("digest", *FILE)).cast("string")), 256).alias("digest"))  # sums: files are many
    return first.unionByName(second).unionByName(third).unionByName(root.select(F.lit(-1).cast("long").alias("file"), F.lit(-1).alias("part"), F.lit(4).alias("level"), F.lit("").alias("node"), "digest"))


def group_of(node: Column) -> Column:
    """The group of a range: FANOUT at most in a file."""
    return F.substring(F.md5(node.cast("binary")), 3, 1)


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """(file, part, node): the ranges that differ between two replicas' leaf tables.

    Roots meet first; each level below keeps only the children of nodes that differ or that one replica lacks.
    """
    a, b = settle(tree(one)), settle(tree(two))
    level = lambda t, k, c: t.where(F.col("level") == k).select(*FILE, "node", F.col("digest").alias(c))
    differ = lambda x, y: x.join(y, [*FILE, "node"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(*FILE, "node")
    if differ(level(a, 4, "a"), level(b, 4, "b")).isEmpty():
        return differ(level(a, 1, "a"), level(b, 1, "b")).limit(0)
    files = differ(level(a, 3, "a"), level(b, 3, "b")).select(*FILE)
    groups = differ(*(level(t, 2, c).join(files, FILE, "left_semi") for t, c in ((a, "a"), (b, "b")))).withColumnRenamed("node", "group")
    return settle(differ(*(level(t, 1, c).withColumn("group", group_of(F.col("node"))).join(groups, [*FILE, "group"], "left_semi").drop("group") for t, c in ((a, "a"), (b, "b")))))


def fixity(one: DataFrame, two: DataFrame) -> DataFrame:
    """Every record of either replica with its state: sound, corrupt, missing (not in two) or extra (not in one).

    Columns: file, part, page_id, offset, length, record_sha256 (of the replica that has it, the first if both), state.
    In ranges that differ, records of a file meet by their digests first, copies one by one; of what is left, those of one id
    meet in the order of their offsets, and are corrupt. An empty replica makes every record of the other missing
    or extra; two empty ones give no rows.
    """
    a, b = settle(leaves(one)), settle(leaves(two))
    bad, at = audit(a, b), [*FILE, "node"]
    kept = ["page_id", "offset", "length", "record_sha256"]
    sound = a.join(bad, at, "left_anti").select(*FILE, *kept, F.lit("sound").alias("state"))

    def meet(x: DataFrame, y: DataFrame, *keys: str) -> DataFrame:
        by = [*FILE, *(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_{k}") for k in keys)]
        own = [*FILE, *(f"_{k}" for k in keys), "nth"]
        nth = F.row_number().over(Window.partitionBy(*FILE, *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)).orderBy("offset", "record_sha256")).alias("nth")
        one, two = (t.select(*by, nth, F.struct(*kept).alias(c)) for t, c in ((x, "a"), (y, "b")))
        return settle(one.join(two, own, "full_outer").select(*FILE, "a", "b"))

    below = [t.join(bad, at, "left_semi").select(*FILE, *kept) for t in (a, b)]
    same = meet(*below, "page_id", "record_sha256")
    alone = lambda c, other: same.where(F.col(other).isNull()).select(*FILE, f"{c}.*")
    rest = meet(alone("a", "b"), alone("b", "a"), "page_id")
    both = same.where("a IS NOT NULL AND b IS NOT NULL").unionByName(rest)
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a.record_sha256") != F.col("b.record_sha256"), "corrupt").otherwise("sound")
    pick = F.coalesce("a", "b")
    return sound.unionByName(both.select(*FILE, *(pick[c].alias(c) for c in kept), state.alias("state")))


def member(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each record as a gzip member of its own, by which it can be sought."""
    for pdf in it:
        yield pdf.assign(member=[gzip.compress(r.encode(), mtime=0) for r in pdf["record"]])[["file", "part", "offset", "member"]]


def write_warc(recs: DataFrame, folder: str) -> None:
    """The records as WARC files folder/file=../part=../part-*.warc.gz, in the order of offsets, a gzip member each.

    A file is written by one task, which streams it; members are held one at a time.
    """
    spark = recs.sparkSession
    rows = recs.select(*FILE, "offset", "record").mapInPandas(member, "file long, part int, offset long, member binary")
    rows = rows.repartition(*FILE).sortWithinPartitions(*FILE, "offset")
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(folder)
    uri = where.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(where).toString()
    rows.mapInPandas(lambda it: written(it, uri), "path string, records long").write.format("noop").mode("overwrite").save()


def written(it: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    """Writes sorted members to their files; a file appears when it is whole, so that a task that is run again replaces it."""
    out, at, n = None, None, 0

    def close() -> pd.DataFrame:
        out.close()
        return pd.DataFrame({"path": [f"{folder}/file={at[0]}/part={at[1]}"], "records": [n]})

    for pdf in it:
        for key, own in pdf.groupby(["file", "part"], sort=False):
            if key != at:
                if out is not None:
                    yield close()
                out, at, n = Sink(f"{folder}/file={key[0]}/part={key[1]}/records.warc.gz"), key, 0
            for m in own["member"]:
                out.write(m)
                n += 1
    if out is not None:
        yield close()


class Sink:
    """A file under a name of its own until it is closed."""

    def __init__(self, path: str):
        from pyarrow import fs

        here = local_path(path)
        self.fs, name = (fs.LocalFileSystem(), here) if here is not None else fs.FileSystem.from_uri(path)
        self.name, self.temporary = name, f"{name}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(name.rpartition("/")[0], recursive=True)
        self.file = self.fs.open_output_stream(self.temporary)

    def write(self, data: bytes) -> None:
        self.file.write(data)

    def close(self) -> None:
        self.file.close()
        self.fs.move(self.temporary, self.name)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, file, part, offset, length, record) of the WARC files below folder: resource and response records.

    Offsets and lengths are those of the unpacked bytes, headers and the two line ends after a record included. Records of other types
    (warcinfo, request, metadata and so on) take their place but don't come out. page_id is the number that ends the record id
    of urn:page:, else null. Files are read record by record, of whichever gzip members. What is no WARC record is an error.
    """
    from helixtally.sources.fastx import files_of

    sc = spark.sparkContext
    paths = files_of(spark, f"{folder}/file=*/part=*") if spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/file=*").getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/file=*")) else files_of(spark, folder)
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))  # a row per file

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path in pdf["path"]:
                place = re.search(r"file=(-?\d+)/part=(\d+)", path)
                file, part = (int(place[1]), int(place[2])) if place else (0, 0)
                with opened(path) as raw:
                    rows, size = [], 0
                    for at, page, record in records_of(raw, path):
                        rows.append((page, file, part, at, len(record), record.decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode()))
                        size += len(record)
                        if size > 1 << 24:
                            yield framed(rows)
                            rows, size = [], 0
                    yield framed(rows)

    return listed.mapInPandas(read, "page_id long, file long, part int, offset long, length long, record string")


def framed(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "file", "part", "offset", "length", "record"])
    return out.assign(page_id=out["page_id"].astype("Int64"))


def records_of(raw, path: str) -> Iterator[tuple[int, int | None, bytes]]:
    """(offset, page_id, record) of the resource and response records of an open file."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if path.lower().endswith(".gz") else io.BufferedReader(raw)
    at = 0
    while line := f.readline():
        if line in (b"\r\n", b"\n"):  # more line ends than two
            at += len(line)
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at} of {path}")
        head, fields = [line], {}
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            head.append(line)
            name, _, value = line.partition(b":")
            fields[name.strip().lower()] = value.strip()
        head.append(line)
        if b"content-length" not in fields:
            raise ValueError(f"no length in the WARC record at byte {at} of {path}")
        body = f.read(int(fields[b"content-length"]))
        if len(body) < int(fields[b"content-length"]):
            raise EOFError(f"unexpected end of the WARC record at byte {at} of {path}")
        record = b"".join(head) + body
        ends = f.peek(4)[:4]
        tail = next((e for e in (b"\r\n\r\n", b"\n\n") if ends.startswith(e)), b"")
        record += f.read(len(tail))
        if fields.get(b"warc-type") in (b"resource", b"response"):
            page = re.fullmatch(rb"<urn:page:(-?\d+)>", fields.get(b"warc-record-id", b""))
            yield at, int(page[1]) if page else None, record
        at += len(record)


def flip(recs: DataFrame, first_hex: str = "00") -> DataFrame:
    """A damaged copy: records whose digest begins with first_hex get their last byte changed (length stays)."""
    hit = F.sha2(F.col("record").cast("binary"), 256).startswith(first_hex)
    return recs.withColumn("record", F.when(hit, F.concat(F.expr("substring(record, 1, char_length(record) - 1)"), F.lit("#"))).otherwise(F.col("record")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit two replicas of all pages: records with a digest of 00.. are damaged in the second, 01.. lost in it, 02.. in the first."""
    recs = settle(records(table(spark, sf_dir, "pages")))
    without = lambda hex_: ~F.sha2(F.col("record").cast("binary"), 256).startswith(hex_)
    return fixity(recs.where(without("02")), flip(recs).where(without("01"))).select("page_id", *FILE, "offset", "length", "record_sha256", "state")


SQL = """
WITH r AS (SELECT page_id, coalesce(floor(page_id / 256)::BIGINT, -1) AS file, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10)
  || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
  || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
  || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
m AS (SELECT 1024 AS most),
p AS (SELECT file, ceil(count(*) / most) AS parts FROM r, m GROUP BY file, most HAVING count(*) > most),
s AS (SELECT page_id, file, CASE WHEN parts IS NULL THEN 0 END::INT AS part, strlen(record)::BIGINT AS length, sha256(record) AS record_sha256, record FROM r LEFT JOIN p USING (file))
SELECT page_id, file, part, (coalesce(sum(length) OVER (PARTITION BY file, part ORDER BY page_id, record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset",
  length, record_sha256, CASE substr(record_sha256, 1, 2) WHEN '00' THEN 'corrupt' WHEN '01' THEN 'missing' WHEN '02' THEN 'extra' ELSE 'sound' END AS state FROM s
"""
