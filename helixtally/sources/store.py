"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go as soon as the query that wrote them has ended, and not only when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(sc) -> str:
    """The session's checkpoint folder. Where none is set, local mode gets a temporary one and a cluster an error."""
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="helixtally-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(sc, name: str = "tables") -> str:
    """A new folder for tables of one run."""
    return f"{shared_folder(sc)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run inside lose their shuffle files at their end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def settle(df: DataFrame) -> DataFrame:
    """df computed once, with its lineage cut by a checkpoint, so that lost executors cost no more than reading it."""
    shared_folder(df.sparkSession.sparkContext)
    with cleaning(df.sparkSession):
        return df.select("*").checkpoint()


def stored(df: DataFrame, path: str) -> DataFrame:
    """The same by a Parquet table at `path`: many small rows take less space there than in a checkpoint."""
    spark, schema = df.sparkSession, df.schema
    with cleaning(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(sc, path: str) -> None:
    """Delete what is at `path`, which nothing reads any more."""
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
