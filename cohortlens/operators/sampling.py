"""Seeded samples, folds and splits. Every draw is an md5 of seed and key, so any engine can repeat it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hash_order
from .indexing import in_hash_order


def per_group(df: DataFrame, by: Sequence[str], key: str, n: int, seed: str) -> DataFrame:
    """n random rows of each group."""
    w = Window.partitionBy(*by).orderBy(hash_order(seed, F.col(key)), key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: str) -> DataFrame:
    """df with fold, evenly within each label."""
    placed = in_hash_order(df, [label], hash_order(seed, F.col(key)), key)
    return placed.withColumn("fold", (F.col("_place") % k).cast("int")).drop("_place")


def cluster_folds(df: DataFrame, cluster: str, source: str, k: int, seed: str) -> DataFrame:
    """(source, cluster, fold): whole clusters dealt in turn within each source. A cluster in two sources is an error: filter crossing() first."""
    return stratified_folds(df.select(source, cluster).distinct(), source, cluster, k, seed)


def carve(df: DataFrame, group: str, source: str, fraction: float, seed: str) -> DataFrame:
    """(source, group, held_out): of each source's groups the rounded fraction, at least one. The seed is joined with the source's crc32."""
    g = df.select(source, group).distinct()
    own = hash_order(F.concat_ws("|", F.lit(seed), F.crc32(F.col(source)).cast("string")), F.col(group))
    return held_out(g, group, source, fraction, own)


def held_out(groups: DataFrame, group: str, source: str, fraction: float, order: Column) -> DataFrame:
    """(source, group, held_out): the first groups of each source in the order of a hash, the rounded fraction, at least one."""
    n = groups.groupBy(F.col(source).alias("_source")).agg(F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(fraction)).cast("long")).alias("_most"))
    placed = in_hash_order(groups, [source], order, group).join(n, F.col(source).eqNullSafe(F.col("_source")))
    return placed.select(source, group, (F.col("_place") < F.col("_most")).alias("held_out"))


def greedy_prefix(df: DataFrame, group: str, by: str, limit: int, seed: str) -> DataFrame:
    """(by, group, size): shuffled groups until limit rows are reached; the one that crosses it is in."""
    g = df.groupBy(by, group).agg(F.count("*").alias("size"))
    placed = in_hash_order(g, [by], hash_order(seed, F.col(group)), group, F.col("size"))
    return placed.filter(F.col("_before") < limit).drop("_before", "_place")


def pinned_split(df: DataFrame, cluster: str, fraction: float, seed: str) -> DataFrame:
    """(cluster, size, part): the largest cluster trains; others go to validation until the fraction of rows is reached."""
    g = df.groupBy(cluster).agg(F.count("*").alias("size"))
    top = g.agg(F.max_by(cluster, F.struct("size", -F.col(cluster))).alias("_top"), F.sum("size").alias("_total"))
    g = g.crossJoin(F.broadcast(top)).withColumn("_big", F.col(cluster) == F.col("_top"))  # one row
    placed = in_hash_order(g, ["_big"], hash_order(seed, F.col(cluster)), cluster, F.col("size"))
    valid = ~F.col("_big") & (F.col("_before") < F.col("_total") * fraction)
    return placed.select(cluster, "size", F.when(valid, "valid").otherwise("train").alias("part"))


def enriched(df: DataFrame, by: Sequence[str], positive: Column, key: str, n_pos: int, n_neg: int, seed: str) -> DataFrame:
    """n_pos positive and n_neg other rows of each group."""
    d = df.withColumn("_p", positive)
    w = Window.partitionBy(*by, "_p").orderBy(hash_order(seed, F.col(key)), key)
    d = d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max(n_pos, n_neg))  # which bounds what is shuffled
    return d.filter(F.col("_r") <= F.when(F.col("_p"), n_pos).otherwise(n_neg)).drop("_r", "_p")


def sampling_weights(df: DataFrame, source: str, label: str, source_power: float = 0.5) -> DataFrame:
    """(source, label, n, weight): a row's weight. Classes are even within a source, a source counts as size^power, all sum to 1 over rows."""
    g = df.groupBy(source, label).agg(F.count("*").alias("n"))
    w, whole = Window.partitionBy(source), Window.partitionBy(F.lit(1))
    g = g.withColumns({"size": F.sum("n").over(w), "classes": F.count("*").over(w)})
    g = g.withColumn("mass", F.pow("size", F.lit(source_power)) / F.col("classes"))
    return g.select(source, label, "n", (F.col("mass") / F.sum("mass").over(whole) / F.col("n")).alias("weight"))


def standardised(df: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """value as z-score within by, by the population's deviation; a group without spread counts as deviation 1."""
    sd = F.stddev_pop(value)
    g = df.groupBy(F.col(by).alias("_by")).agg(F.avg(value).alias("_mean"), F.when((sd == 0) | sd.isNull(), 1.0).otherwise(sd).alias("_sd"))
    return df.join(g, F.col(by).eqNullSafe(F.col("_by"))).withColumn(out, (F.col(value) - F.col("_mean")) / F.col("_sd")).drop("_by", "_mean", "_sd")
