"""Score histograms by class. They add up over images and partitions, so every metric here is one small aggregate on top."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio

BINS = 1000


def histogram(df: DataFrame, truth: Column, p: Column, by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """(by, bin, pos, neg)."""
    return df.groupBy(*by, F.least(F.floor(p * bins), F.lit(bins - 1)).alias("bin")).agg(F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"))


def tails(h: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """With tp and fp called from each bin on, and the totals."""
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    down = part.orderBy(F.col("bin").desc())
    return h.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down), "all_pos": F.sum("pos").over(part), "all_neg": F.sum("neg").over(part)})


def histogram_ranking(h: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, aupr, auc); pairs within a bin count half."""
    t = tails(h, by)
    share = ratio(F.col("pos"), F.col("all_pos"))
    return t.groupBy(*by).agg(F.sum(share * ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("aupr"),
        F.sum(share * F.try_divide(F.col("all_neg") - F.col("fp") + F.col("neg") / 2.0, F.col("all_neg"))).alias("auc"))


def best_dice(h: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, best_bin, best_dice, best_iou): the first of the best cuts."""
    t = tails(h, by)
    dice = ratio(2 * F.col("tp"), F.col("all_pos") + F.col("tp") + F.col("fp"))
    return t.groupBy(*by).agg(F.max_by("bin", F.struct(F.round(dice, 9), -F.col("bin"))).alias("best_bin"), F.max(dice).alias("best_dice"),
        F.max(ratio(F.col("tp"), F.col("all_pos") + F.col("fp"))).alias("best_iou"))
