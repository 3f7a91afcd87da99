"""Text forms of databases, abundance tables and reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixtally.functions.dna import from_hex, to_hex
from helixtally.operators import database
from helixtally.sources import fastx

# The header words and columns of the text formats.
DB_HEADER, UNIQUE_HEADER = "#helixtally-db", "#unique"
#: The header of a database by any tool that writes this form: a name, the number of units, the enzymes.
ANY_HEADER = r"^#[^\t]*-db\t\d+"
PROFILE_COLUMNS = ("#strain", "abundance", "coverage", "support", "depth", "n_markers")
COMMUNITY_COLUMNS = ("#species", "cluster", "abundance", "coverage", "support", "depth", "global_abundance", "sample_fraction", "n_markers")


def database_lines(db: DataFrame, enzymes: list[str]) -> DataFrame:
    """(line) of a database (unit, marker, is_unique): a header, its unique markers, and a line per unit.

    The exchange form, for databases of a size at which a line may hold a unit's markers; save_database has no such bound.
    """
    units = db.groupBy("unit").agg(F.array_join(F.sort_array(F.collect_list(to_hex(F.col("marker")))), ",").alias("m"))
    head = units.agg(F.count("*").alias("n")).select(F.lit(0).alias("k"), F.concat(F.lit(f"{DB_HEADER}\t"), F.col("n"), F.lit("\t" + ",".join(enzymes))).alias("line"))
    unique = db.where("is_unique").agg(F.array_join(F.sort_array(F.collect_set(to_hex(F.col("marker")))), ",").alias("m")).where("m <> ''")
    lines = head.union(unique.select(F.lit(1), F.concat(F.lit(f"{UNIQUE_HEADER}\t"), "m")))
    return lines.union(units.select(F.lit(2), F.concat_ws("\t", "unit", "m"))).orderBy("k", "line").select("line")


def save_database(db: DataFrame, path: str, enzymes: list[str]) -> None:
    """A database (unit, marker, is_unique) as a Parquet table, with the enzymes beside; rows of a unit are kept together."""
    db.select("unit", "marker", "is_unique", F.array(*map(F.lit, enzymes)).cast("array<string>").alias("enzymes")).sortWithinPartitions("unit", "marker").write.mode("overwrite").parquet(path)


def load_database(spark: SparkSession, path: str, species: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same three tables as read_databases, of a Parquet database; the species is the folder's stem if none is given."""
    held = spark.read.parquet(path)
    name = F.lit(species or fastx.stem(path))
    head = held.agg(F.first("enzymes").alias("enzymes")).select(name.alias("species"), "enzymes")  # one row
    return head, held.select(name.alias("species"), "unit", "marker").distinct(), held.where("is_unique").select(name.alias("species"), "marker").distinct()


def store_database(db: DataFrame, name: str, enzymes: list[str], *scope: str, path: str | None = None, buckets: int = 64) -> None:
    """A finished database (scope, unit, marker, degree, is_unique) as two tables: `name`, laid out in buckets by marker, and
    `name`_panels, a row per unit.

    A profile joins the first on the marker, so that only the sample is shuffled, and reads panel sizes from the second.
    path: the folder of the tables; that of the warehouse if not given. Buckets should be as many as a profile has tasks.
    """
    held = db.select(*scope, "unit", "marker", "degree", "is_unique")
    put = lambda df, table: (df if path is None else df.option("path", f"{path}/{table}")).mode("overwrite").saveAsTable(table)
    put(held.repartition(buckets, "marker").write.bucketBy(buckets, "marker").sortBy("marker"), name)
    panels = database.panels(db.sparkSession.table(name), *scope).withColumn("enzymes", F.array(*map(F.lit, enzymes)).cast("array<string>"))
    put(panels.write, f"{name}_panels")


def stored_database(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    """(database, panels) of tables that store_database wrote."""
    return spark.table(name), spark.table(f"{name}_panels")


def drop_database(spark: SparkSession, name: str) -> None:
    for table in (name, f"{name}_panels"):
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def databases_in(spark: SparkSession, folder: str) -> list[str]:
    """The text (.tsv) and Parquet (.parquet) databases of a folder, by path."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise FileNotFoundError(f"no folder {folder}")
    found = [x.getPath().toString() for x in fs.listStatus(where)]
    return sorted(p for p in found if p.endswith((".tsv", ".parquet")) and not p.endswith(".members.tsv"))


def read_databases(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(species, units, unique) of text database files; the species is the file's stem.

    Files are read by lines. Lines that begin with # and blank ones are left out, and so are markers that are no
    hexadecimal number. A file that holds nothing is an empty database, and so is one that can't be read as UTF-8 text.
    """
    names = sorted({fastx.source_name(p) for p in fastx.files_of(spark, path)})
    listed = spark.createDataFrame([(re.sub(r"\.[^.]*$", "", n),) for n in names if ".members." not in n], "species string").distinct()
    raw = fastx.read_lines(spark, path, unreadable="empty").select("value", fastx.source_name_of(F.col("file")).alias("file"))
    raw = raw.where(~F.col("file").contains(".members.")).select(F.regexp_replace("file", r"\.[^.]*$", "").alias("species"), F.regexp_replace("value", r"\r$", "").alias("line"))
    broken = raw.where(~F.is_valid_utf8("line")).select("species").distinct()
    lines = raw.join(broken, "species", "left_anti")
    parts = F.split("line", "\t")
    many = lambda df, col: df.withColumn("marker", from_hex(F.trim("h"))).where("marker IS NOT NULL").select("species", *col, "marker").distinct()
    body = lines.where("line NOT LIKE '#%' AND trim(line) <> ''").select("species", parts[0].alias("unit"), F.explode(F.split(F.coalesce(F.get(parts, 1), F.lit("")), ",")).alias("h"))
    named = lines.where(F.col("line").startswith(f"{UNIQUE_HEADER}\t")).select("species", F.explode(F.split(F.coalesce(F.get(parts, 1), F.lit("")), ",")).alias("h"))
    head = lines.where(F.col("line").rlike(ANY_HEADER)).select("species", F.split(F.get(parts, 2), ",").alias("enzymes"))
    return listed.join(head, "species", "left"), many(body, ["unit"]), many(named, [])


def read_abundances(spark: SparkSession, path: str) -> DataFrame:
    """(name, abundance) of the first two columns; the last of a repeated name holds, odd numbers are left out."""
    lines = fastx.read_lines(spark, path)
    return abundances(lines.select(F.col("no").alias("line_no"), F.col("value").alias("line")))


def abundances(lines: DataFrame) -> DataFrame:
    """The same of (line_no, line)."""
    clean = lines.withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).where("line <> '' AND line NOT LIKE '#%'")
    parts = F.split("line", "\t")
    rows = clean.select("line_no", parts[0].alias("name"), F.get(parts, 1).try_cast("double").alias("abundance")).where("abundance IS NOT NULL")
    return rows.groupBy("name").agg(F.max_by("abundance", "line_no").alias("abundance"))


def read_predictions(spark: SparkSession, path: str | list[str], column: str = "global_abundance") -> DataFrame:
    """(sample, species, value): the chosen column by its header, the largest of a species' clusters."""
    lines = fastx.read_lines(spark, path).withColumn("value", F.regexp_replace("value", r"\r$", ""))
    head = F.split(F.regexp_replace("value", "^#", ""), "\t")
    heads = lines.where("no = 0").select("file", F.array_position(head, "species").alias("s"), F.array_position(head, column).alias("c")).where("s > 0 AND c > 0")
    parts = F.split("value", "\t")
    rows = lines.where("no > 0 AND value <> ''").join(heads, "file")  # a row per file
    sample = F.split(fastx.source_name_of(F.col("file")), r"\.")[0]
    got = rows.select(sample.alias("sample"), F.get(parts, (F.col("s") - 1).cast("int")).alias("species"), F.get(parts, (F.col("c") - 1).cast("int")).try_cast("double").alias("value"))
    return got.where("value IS NOT NULL").groupBy("sample", "species").agg(F.max("value").alias("value"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(sample, species): one column is the truth of all samples (a null sample), two are a sample and its species."""
    parts = F.split(F.trim("value"), "\t")
    rows = spark.read.text(path).where("trim(value) <> '' AND value NOT LIKE '#%'")
    return rows.select(F.when(F.size(parts) > 1, parts[0]).alias("sample"), F.when(F.size(parts) > 1, F.get(parts, 1)).otherwise(parts[0]).alias("species"))


def membership_lines(genomes: DataFrame, membership: DataFrame) -> DataFrame:
    """(line): a genome's name and its cluster, by genome."""
    return genomes.join(membership, "gid").orderBy("gid").select(F.concat_ws("\t", "name", "cluster").alias("line"))


def profile_lines(calls: DataFrame) -> DataFrame:
    """(line) of a one-species report, the most abundant first."""
    number = lambda f, c: F.format_string(f, c)
    return calls.orderBy(F.desc("abundance"), "unit").select(F.concat_ws("\t", "unit", number("%.6f", "abundance"), number("%.4f", "coverage"), number("%.0f", "support"), number("%.4f", "depth"), F.col("n_markers").cast("string")).alias("line"))


def community_lines(calls: DataFrame) -> DataFrame:
    """(line) of a many-species report, by species, the most abundant first."""
    number = lambda f, c: F.format_string(f, c)
    return calls.orderBy("species", F.desc("abundance"), "unit").select(F.concat_ws("\t", "species", "unit", number("%.6f", "abundance"), number("%.4f", "coverage"), number("%.0f", "support"), number("%.4f", "depth"), number("%.6f", "global_abundance"), number("%.6f", "sample_fraction"), F.col("n_markers").cast("string")).alias("line"))


def write_database(db: DataFrame, path: str, enzymes: list[str]) -> None:
    """A database as text in a folder: parts in order, each by its own task, which are the whole file one after another."""
    database_lines(db, enzymes).write.mode("overwrite").text(path)


def write_lines(lines: DataFrame, path: str, header: str = "") -> None:
    """A report as one text file on storage that Spark writes to; reports are a row per call."""
    spark = lines.sparkSession
    if header:
        first = spark.createDataFrame([(0, 0, header)], "k int, n long, line string")
        rows = lines.withColumn("n", F.monotonically_increasing_id()).select(F.lit(1).alias("k"), "n", "line")
        lines = first.union(rows).withColumn("r", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("k", "n"))).orderBy("r").select("line")
    lines.coalesce(1).write.mode("overwrite").text(path)
