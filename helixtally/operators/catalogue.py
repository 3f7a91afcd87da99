"""An incremental catalogue of species: by marker, how many species hold it, kept up to date as species come and go.

A marker's row is (n, owner): the number of species that hold it, and the sum of their numbers. Where n is 1, the sum is the
number of the one species, so that a species that goes gives its shared markers back to those that are left, without reading
these. A change appends its own markers' rows, and nothing else is read or written; rows of a marker add up. Tables are laid
out in buckets by marker, so that adding up shuffles nothing, and a change looks its markers up by shuffling them alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixtally.sources.store import discard, settle

LOG = "change long, species string, number long, sign int, n_markers long, digest long"


@dataclass(frozen=True)
class Catalogue:
    """The catalogue `name` in a folder that all executors share. One change at a time.

    A change counts once its row is in the log; rows of one that didn't get so far are never read. The log is a row per change.
    """

    spark: SparkSession
    name: str
    folder: str
    buckets: int = 64

    def _path(self, part: str) -> str:
        return f"{self.folder}/{self.name}_{part}"

    def _exists(self, path: str) -> bool:
        sc = self.spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(sc._jsc.hadoopConfiguration()).exists(where)

    def log(self) -> DataFrame:
        """(change, species, number, sign, n_markers, digest) of all changes; sign 0 is a compaction."""
        path = self._path("log")
        return self.spark.read.schema(LOG).parquet(path) if self._exists(path) else self.spark.createDataFrame([], LOG)

    def species(self) -> DataFrame:
        """(species, number, n_markers, digest) of the species that are in."""
        last = self.log().where("sign <> 0").groupBy("species").agg(F.max_by(F.struct("number", "sign", "n_markers", "digest"), "change").alias("x"))
        return last.where("x.sign > 0").select("species", "x.number", "x.n_markers", "x.digest")

    def _next(self) -> int:
        return (self.log().agg(F.max("change")).first()[0] or 0) + 1

    def _base(self) -> int:
        """The change whose table holds all before it."""
        return self.log().where("sign = 0").agg(F.max("change")).first()[0] or 0

    def _table(self, base: int) -> str:
        return f"{self.name}_{base}"

    def rows(self) -> DataFrame:
        """(marker, n, owner) as changes left them: they are to be added up by marker."""
        base = self._base()
        if not self.spark.catalog.tableExists(self._table(base)):
            return self.spark.createDataFrame([], "marker string, n int, owner long")
        held = self.spark.table(self._table(base))
        done = [r.change for r in self.log().where(F.col("change") >= base).select("change").collect()]  # since the last compaction
        return held.where(F.col("change").isin(done)).drop("change")

    def counts(self) -> DataFrame:
        """(marker, n, owner): the number of species that hold a marker, and the sum of their numbers."""
        return self.rows().groupBy("marker").agg(F.sum("n").alias("n"), F.sum("owner").alias("owner")).where("n > 0")

    def specific(self) -> DataFrame:
        """(species, marker): the markers that one species alone holds."""
        names = self.species().select("species", F.col("number").alias("owner"))
        return self.counts().where("n = 1").join(names, "owner").select("species", "marker")

    def _put(self, base: int, change: int, rows: DataFrame, mode: str = "append") -> None:
        out = rows.select(F.col("marker"), F.col("n").cast("int").alias("n"), F.col("owner").cast("long").alias("owner"), F.lit(change).cast("long").alias("change"))
        table = self._table(base)
        out.repartition(self.buckets, "marker").write.mode(mode).option("path", self._path(str(base))).partitionBy("change").bucketBy(self.buckets, "marker").sortBy("marker").saveAsTable(table)

    def _note(self, change: int, species: str | None, number: int, sign: int, n: int, digest: int) -> None:
        self.spark.createDataFrame([(change, species, number, sign, n, digest)], LOG).coalesce(1).write.mode("append").parquet(self._path("log"))

    def _apply(self, species: str, number: int, sign: int, own: DataFrame, n: int, digest: int) -> None:
        base, change = self._base(), self._next()
        table = self._table(base)
        if self.spark.catalog.tableExists(table):  # what a change of the same number left that stopped halfway
            left = self.spark.table(table).where(F.col("change") == change)
            if not left.isEmpty():
                self.spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (change = {change})")
                discard(self.spark.sparkContext, f"{self._path(str(base))}/change={change}")
        self._put(base, change, own.select("marker", F.lit(sign).alias("n"), F.lit(sign * number).alias("owner")))
        self._note(change, species, number, sign, n, digest)

    @staticmethod
    def _summary(own: DataFrame) -> tuple[int, int]:
        """The number of markers, and a hash that tells sets apart."""
        n, digest = own.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("marker")), F.lit(0))).first()
        return n, digest

    def add(self, species: str, markers: DataFrame) -> None:
        """A species with its (marker); null and repeated markers don't count. One that is in already is an error."""
        if not self.species().where(F.col("species") == species).isEmpty():
            raise ValueError(f"species {species} is in the catalogue")
        own = settle(markers.select("marker").where("marker IS NOT NULL").distinct())
        number = (self.log().agg(F.max("number")).first()[0] or 0) + 1
        self._apply(species, number, 1, own, *self._summary(own))

    def drop(self, species: str, markers: DataFrame) -> None:
        """A species goes. markers: those it came with, from its own database; any others are an error."""
        had = self.species().where(F.col("species") == species).first()
        if had is None:
            raise ValueError(f"no species {species} in the catalogue")
        own = settle(markers.select("marker").where("marker IS NOT NULL").distinct())
        if self._summary(own) != (had.n_markers, had.digest):
            raise ValueError(f"these are not the markers that {species} came with")
        self._apply(species, had.number, -1, own, had.n_markers, had.digest)

    def touched(self, markers: DataFrame) -> DataFrame:
        """(marker, n, owner) of some markers alone: these are shuffled, and the catalogue is read where it lies."""
        own = markers.select("marker").where("marker IS NOT NULL").distinct()
        return self.rows().join(own, "marker", "left_semi").groupBy("marker").agg(F.sum("n").alias("n"), F.sum("owner").alias("owner")).where("n > 0")

    def changes(self, species: str, markers: DataFrame) -> DataFrame:
        """(species, marker, gained): what the last change of this species did to the sets of specific markers, its own and others'.

        To be asked before the next change: so a stored table of specific markers follows without a recount.
        """
        number = self.log().where(F.col("species") == species).agg(F.max_by("number", "change")).first()[0]
        if number is None:
            raise ValueError(f"no species {species} was ever in the catalogue")
        inside = not self.species().where(F.col("species") == species).isEmpty()
        own = markers.select("marker").where("marker IS NOT NULL").distinct()
        now = own.join(self.touched(own), "marker", "left").na.fill(0, ["n", "owner"])
        others = now.select("marker", (F.col("n") - int(inside)).alias("n"), (F.col("owner") - int(inside) * number).alias("owner"))
        mine = others.where("n = 0").select(F.lit(species).alias("species"), "marker", F.lit(inside).alias("gained"))
        names = self.log().where("sign > 0").select("species", F.col("number").alias("owner"))
        theirs = others.where("n = 1").join(names, "owner").select("species", "marker", F.lit(not inside).alias("gained"))
        return mine.unionByName(theirs)

    def compact(self) -> None:
        """All rows added up into a table of its own; the one before goes. The log stays."""
        base, change = self._base(), self._next()
        if self.spark.catalog.tableExists(self._table(change)):  # left by a compaction that stopped halfway
            self.spark.sql(f"DROP TABLE {self._table(change)}")
        discard(self.spark.sparkContext, self._path(str(change)))
        self._put(change, change, self.counts(), mode="overwrite")
        self._note(change, None, 0, 0, 0, 0)
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(base)}")
        discard(self.spark.sparkContext, self._path(str(base)))

    def remove(self) -> None:
        """Delete the catalogue."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(self._base())}")
        discard(self.spark.sparkContext, self.folder)
