"""Text tables as they come: declared schemas, odd separators and encodings, several files at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def csv(spark: SparkSession, path: str | Sequence[str], schema: str | StructType, sep: str = ",", header: bool = True, encoding: str = "UTF-8", pattern: str | None = None) -> DataFrame:
    """A declared schema and no inference; a malformed row is an error."""
    r = spark.read.schema(schema).option("header", header).option("sep", sep).option("encoding", encoding).option("mode", "FAILFAST").option("enforceSchema", True)
    if pattern:
        r = r.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return r.csv(path)


def text_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", columns: Sequence[str] | None = None) -> DataFrame:
    """Every column a string and empty fields empty strings, never null. Header names lose blanks and a byte-order mark; columns names them where there is no header."""
    def read(schema, header):
        return spark.read.schema(schema).option("sep", sep).option("header", header).option("encoding", encoding).option("nullValue",
            "\u0000").option("emptyValue", "").option("mode", "FAILFAST").csv(path)

    names = list(columns) if columns else [c.strip().removeprefix("﻿").strip() for c in spark.read.option("sep", sep).option("header",
        True).option("encoding", encoding).option("inferSchema", False).csv(path).columns]
    return read(StructType([StructField(c, StringType()) for c in names]), not columns).fillna("")  # the reader takes unquoted empty fields as null


def first_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The first columns under new names; the scan reads no others."""
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=False)])


def chunks(spark: SparkSession, path: str, schema: str, skip: Sequence[str] = ("_staging",)) -> DataFrame:
    """All per_image_results.csv under path but those in skipped folders, with the file each row came from."""
    df = csv(spark, path, schema, pattern="per_image_results.csv").withColumn("file", F.input_file_name())
    for s in skip:
        df = df.filter(~F.col("file").contains(f"/{s}/"))
    return df


def listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, length, modificationTime) of matching files, without their contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """(name) of a text file's lines, without comments and blank ones."""
    return spark.read.text(path).select(F.trim(F.split_part("value", F.lit("#"), F.lit(1))).alias("name")).filter("name <> ''")


def digests(listed: DataFrame, cached: DataFrame, contents: DataFrame) -> DataFrame:
    """(path, length, modificationTime, sha256, reused) of listed files: a cached digest holds while length and time are as they were, the others are computed from contents (path, content), which is read for no other file."""
    same = ["path", "length", "modificationTime"]
    known = listed.join(cached.select(*same, "sha256"), same, "left")
    new = known.filter("sha256 IS NULL").drop("sha256").join(contents.select("path", F.sha2("content", 256).alias("sha256")), "path").select(*same, "sha256", F.lit(False).alias("reused"))
    return known.filter("sha256 IS NOT NULL").select(*same, "sha256", F.lit(True).alias("reused")).unionByName(new)
