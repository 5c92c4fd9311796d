"""Text expressions and tables in the shared folder that the corpus operators have in common."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idsift.session import released

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def crc_of_id(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def folder(spark: SparkSession, purpose: str) -> str:
    """A new path below the folder that all executors share (spark.checkpoint.dir).

    A local master without that setting gets a temporary folder, which is removed
    when the process ends; any other master must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        app = spark.sparkContext.applicationId
        if app not in _own_folder:
            _own_folder[app] = tempfile.mkdtemp(prefix="idsift-")
            atexit.register(shutil.rmtree, _own_folder[app], ignore_errors=True)
        base = _own_folder[app]
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a lost executor costs one
    table scan instead of everything before it, and later reads see the same rows."""
    path = folder(df.sparkSession, purpose)
    with released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables that `stored` wrote, once nothing reads them any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder_of in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder_of)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, names: set[str]) -> list[Column]:
    """Columns of df whose names an operator's own columns don't replace."""
    taken = {n.lower() for n in names}
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in taken]
