"""Writers that never overwrite, publish in one step, and can be resumed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def immutable(df: DataFrame, path: str) -> None:
    """Fails if the path exists."""
    df.write.mode("errorifexists").parquet(path)


def published(df: DataFrame, path: str) -> None:
    """Written to a staging folder beside the path, read once, then renamed; a reader sees all or nothing, and an existing path is kept."""
    spark = df.sparkSession
    stage = f"{path.rstrip('/')}_staging-{uuid.uuid4().hex}"
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    df.write.parquet(stage)
    spark.read.schema(df.schema).parquet(stage).count()
    if not fs.rename(_fs(spark, stage)[1], target):
        raise OSError(f"{stage} can't be renamed")


def resume(todo: DataFrame, path: str, key: str, identity: str) -> DataFrame:
    """The rows of todo that path doesn't hold yet. Rows written under another identity are an error."""
    spark = todo.sparkSession
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return todo
    done = spark.read.parquet(path)
    if not done.filter(done["identity"] != identity).isEmpty():
        raise ValueError("the folder holds results of another run")
    return todo.join(done.select(key), key, "left_anti")
