"""What the corpus operators share: reading tables, Arrow batch sizes, the shared folder, surrogate row keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, passing, shared_dir, ship

#: Stands for a null identifier inside an operator; outputs carry the null again.
NULL_ID = -(2**63)
#: The characters of [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch.
BATCH_BYTES = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few bytes: texts may be long, and each Python worker holds a batch or two. Numbers of rows stay as the session has them. Workers get the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = shared_path(df.sparkSession, name)
    passing(df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, with more underscores before them where df has such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns (id, key, th, text): key is id with null replaced; (key, th) names a row up to equal texts under one id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("key"), F.xxhash64(text).alias("th"), text.alias("text"))


__all__ = ["ASCII_SPACE", "LOWER", "NULL_ID", "UPPER", "cut", "keyed", "shared_path", "small_batches", "table", "unused", "written"]
