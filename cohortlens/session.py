"""Session helpers: making this package importable on executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(), f"{top.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a local master, as in tests, gets a temporary one; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if folder is None and (folder := sc.getCheckpointDir()) is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"checkpoints-{os.getpid()}")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for as long as the block runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def passing(df: DataFrame) -> DataFrame:
    """df as a plan of its own whose shuffle files Spark removes as soon as an action on it has ended."""
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return df.select("*")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and goes on from there: a lost executor then costs no recomputation, and the shuffles behind it are dropped."""
    shared_dir(df.sparkSession)
    return passing(df).checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """cut() for wide or long tables: written to the shared folder by columns and compressed, where checkpoints are rows as they are in memory."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    passing(df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more from the shared folder's file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
