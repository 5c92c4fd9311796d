"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Folders that this process made for sessions without a shared one, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder that ``spark.checkpoint.dir`` names.

    A local master without that setting gets a folder of its own, removed when the
    process ends; any other master must name one. The session isn't changed.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="idsift-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        base = _OWN[app]
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")


@contextmanager
def released(spark: SparkSession):
    """Removes what a query has shuffled to local disks when it ends, for queries that write
    a table and are not run again; else it stays until the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, own)


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write once to the shared folder and read back, so that a lost executor
    re-reads files instead of recomputing the whole lineage. Zstandard packs digests in
    hex to half their size, which Spark's default leaves as they are."""
    path = shared_dir(df.sparkSession, purpose)
    with released(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Folders of tables that `kept` wrote, with their schemas.
_KEPT: dict[tuple, tuple] = {}


def kept(spark: SparkSession, sf: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table made of those in folder ``sf``, written once per application and folder."""
    at = (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None), sf, name)
    if at not in _KEPT:
        rows, path = make(), shared_dir(spark, name)
        with released(spark):
            rows.write.option("compression", "zstd").parquet(path)
        _KEPT[at] = (path, rows.schema)
    path, schema = _KEPT[at]
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a table that ``materialize`` wrote, once nothing reads it."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
