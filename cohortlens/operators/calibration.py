"""Calibration: binned errors, proper scores, temperature and coverage-risk tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio


def left_closed_bin(p: Column, bins: int) -> Column:
    """Bins [k/b, (k+1)/b); 1 falls into the last."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def right_closed_bin(p: Column, bins: int) -> Column:
    """Bins (k/b, (k+1)/b]; 0 falls into the first."""
    return F.greatest(F.ceil(p * bins) - 1, F.lit(0)).cast("int")


def bin_table(df: DataFrame, p: Column, outcome: Column, which: Column, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, count, mean_confidence, accuracy) for all bins, empty ones with nulls."""
    n = df.groupBy(*by, which.alias("bin")).agg(F.count("*").alias("count"), F.avg(p).alias("mean_confidence"), F.avg(outcome.cast("double")).alias("accuracy"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    if by:
        grid = df.select(*by).distinct().join(F.broadcast(grid))  # as many rows as bins
    return grid.join(n, [*by, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def ece(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, ece) of a bin table."""
    return bins.groupBy(*by).agg(ratio(F.sum(F.col("count") * F.abs(F.col("accuracy") - F.col("mean_confidence"))), F.sum("count")).alias("ece"))


def brier(p: Column, outcome: Column) -> Column:
    return F.avg((p - outcome.cast("double")) * (p - outcome.cast("double")))


def multiclass_brier(p: Column, label: Column) -> Column:
    """Mean over rows of the squared distance to the label's unit vector."""
    d = F.transform(p, lambda v, i: (v - (i == label).cast("double")) * (v - (i == label).cast("double")))
    return F.avg(F.aggregate(d, F.lit(0.0), lambda a, x: a + x))


def multiclass_nll(p: Column, label: Column, clip: float = 1e-12) -> Column:
    return F.avg(-F.ln(F.greatest(F.element_at(p, label.cast("int") + 1), F.lit(clip))))


def coverage_risk(df: DataFrame, confidence: Column, correct: Column, grid: Sequence[float]) -> DataFrame:
    """(threshold, accepted, coverage, risk): what is kept at each confidence and how much of it is wrong. One pass; the grid is a literal array."""
    per = df.select(confidence.alias("c"), correct.alias("ok"), F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("threshold"))
    kept = F.col("c") >= F.col("threshold")
    return per.groupBy("threshold").agg(F.count_if(kept).alias("accepted"), F.avg(kept.cast("double")).alias("coverage"),
        ratio(F.count_if(kept & ~F.col("ok")), F.count_if(kept)).alias("risk"))
