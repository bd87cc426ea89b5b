"""Joins with the guards that cohort assembly needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """(on, n) for keys that occur more than once."""
    return df.groupBy(*on).agg(F.count("*").alias("n")).filter("n > 1")


def coverage(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """One row: rows on the left, and how many found a partner. right must be unique in on."""
    marked = left.join(right.select(on).withColumn("_m", F.lit(1)), on, "left")
    return marked.agg(F.count("*").alias("rows"), F.count("_m").alias("matched"), (F.count("*") - F.count("_m")).alias("missing"))


def reconcile(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """(side, n): both, left only, right only."""
    a, b = left.select(on, F.lit(1).alias("_a")), right.select(on, F.lit(1).alias("_b"))
    side = F.when(F.col("_a").isNull(), "right_only").when(F.col("_b").isNull(), "left_only").otherwise("both")
    return a.join(b, on, "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def exact_cover(seen: DataFrame, expected: DataFrame, on: str, label: str) -> DataFrame:
    """One row: missing, unexpected, relabelled."""
    j = seen.select(on, F.col(label).alias("_s")).join(expected.select(on, F.col(label).alias("_e")), on, "full")
    return j.agg(F.count_if(F.col("_s").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("unexpected"), F.count_if(F.col("_s") != F.col("_e")).alias("relabelled"))


def exclude_conflicts(df: DataFrame, key: str, label: str, split: str = "split") -> DataFrame:
    """df with status: 'conflict' where rows of one key disagree on the label, else 'leak' for training rows whose key is in validation, else 'kept'. Conflicts go first: their rows don't count as leaks' other side."""
    w = Window.partitionBy(key)
    conflict = F.min(label).over(w) != F.max(label).over(w)
    step = df.withColumn("_c", conflict)
    held = F.max(((F.col(split) == "validation") & ~F.col("_c")).cast("int")).over(w) == 1
    return step.withColumn("status", F.when(F.col("_c"), "conflict").when((F.col(split) == "train") & held, "leak").otherwise("kept")).drop("_c")


def crossing(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n): groups that hold more than one value."""
    return df.groupBy(group).agg(F.count_distinct(value).alias("n")).filter("n > 1")


def first_existing(df: DataFrame, key: str, rank: Column, value: str) -> DataFrame:
    """(key, value) of the candidate with the lowest rank."""
    return df.groupBy(key).agg(F.min_by(value, rank).alias(value))
