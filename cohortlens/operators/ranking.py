"""Ranking metrics over a table of distinct scores with counts of positives and negatives; ties are grouped first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio


#: Scores in a slice of this width are ordered by one task; what lies before comes from one sum a slice.
SLICE = 1 / 64


def _line(by: Sequence[str], *order) -> Window:
    return Window.partitionBy(*by, "_slice").orderBy(*order)


def running(scores: DataFrame, by: Sequence[str], score: str, columns: Sequence[str], descending: bool = False) -> DataFrame:
    """scores with, for each column, cum_ (its sum up to and with each score) and all_ (its sum).

    Scores are cut into slices of equal width. Windows over slices see one row each, windows over scores one slice each, so
    no task holds all distinct scores.
    """
    rows = scores.withColumn("_slice", F.floor(F.col(score).cast("double") / SLICE))
    held = rows.groupBy(*by, "_slice").agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])
    step = F.col("_slice").desc() if descending else F.col("_slice").asc()
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))  # a row a slice
    ahead = whole.orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_slice").alias("_at"),
        *[x for c in columns for x in (F.coalesce(F.sum(f"_s_{c}").over(ahead), F.lit(0)).alias(f"_0_{c}"), F.sum(f"_s_{c}").over(whole).alias(f"all_{c}"))])
    same = F.col("_slice").eqNullSafe(F.col("_at"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    line = _line(by, F.col(score).desc() if descending else F.col(score).asc())
    out = rows.join(held, same)
    return out.select(*scores.columns, *[x for c in columns for x in ((F.sum(c).over(line) + F.col(f"_0_{c}")).alias(f"cum_{c}"), F.col(f"all_{c}"))])


def score_table(df: DataFrame, truth: Column, score: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """(by, score, pos, neg)."""
    w = F.lit(1) if weight is None else weight
    return df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.when(truth, w).otherwise(0)).alias("pos"), F.sum(F.when(~truth, w).otherwise(0)).alias("neg"))


def roc_table(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """score_table with tp, fp (called at score and above), all_pos, all_neg."""
    return running(scores, by, "score", ["pos", "neg"], descending=True).withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"})


def auc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_pos, n_neg, auc): the share of pairs in order, ties as half; null with one class."""
    t = running(scores, by, "score", ["neg"]).withColumn("wins", F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0))
    return t.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), ratio(F.sum("wins"), F.sum("pos") * F.sum("neg")).alias("auc"))


def average_precision(roc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, average_precision): precision at each cut weighted by the recall it adds."""
    return roc.groupBy(*by).agg(F.sum(ratio(F.col("pos"), F.col("all_pos")) * ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("average_precision"))


def sensitivity_at(roc: DataFrame, specificity: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, value): the largest sensitivity at a cut of that specificity or more; calling nothing counts as a cut."""
    ok = F.try_divide(F.col("all_neg") - F.col("fp"), F.col("all_neg")) >= F.lit(specificity)
    return roc.groupBy(*by).agg(F.when((F.max("all_pos") > 0) & (F.max("all_neg") > 0), F.coalesce(F.max(F.when(ok, ratio(F.col("tp"), F.col("all_pos")))), F.lit(0.0))).alias("value"))


def specificity_at(roc: DataFrame, sensitivity: float, by: Sequence[str] = ()) -> DataFrame:
    ok = F.try_divide(F.col("tp"), F.col("all_pos")) >= F.lit(sensitivity)
    return roc.groupBy(*by).agg(F.max(F.when(ok, ratio(F.col("all_neg") - F.col("fp"), F.col("all_neg")))).alias("value"))


def specificity_at_quantile(df: DataFrame, truth: Column, score: str, sensitivity: float) -> DataFrame:
    """The other estimator: the cut is the positives' (1 - sensitivity) quantile, interpolated; the share of negatives below it."""
    cut = df.filter(truth).agg(F.percentile(F.col(score), F.lit(1 - sensitivity)).alias("cut"))
    return df.filter(~truth).crossJoin(F.broadcast(cut)).agg(F.avg((F.col(score) < F.col("cut")).cast("double")).alias("value"))  # one row


def selection_value(roc: DataFrame, by: Sequence[str] = (), targets: Sequence[float] = (0.80, 0.85, 0.90)) -> DataFrame:
    """Mean sensitivity at the specificity targets."""
    spec = F.try_divide(F.col("all_neg") - F.col("fp"), F.col("all_neg"))
    best = [F.coalesce(F.max(F.when(spec >= F.lit(t), ratio(F.col("tp"), F.col("all_pos")))), F.lit(0.0)) for t in targets]
    return roc.groupBy(*by).agg((sum(best[1:], best[0]) / float(len(targets))).alias("selection_value"))


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, rho): Pearson's correlation of average ranks. Ranks come from counts of distinct values, so no task sees all rows."""
    def ranked(c):
        n = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, c).agg(F.count("*").alias("m"))
        return running(n, by, c, ["m"]).select(*by, c, (F.col("cum_m") - (F.col("m") - 1) / 2.0).alias(f"r_{c}"))

    both = df.join(ranked(a), [*by, a]).join(ranked(b), [*by, b])
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.corr(f"r_{a}", f"r_{b}").alias("rho"))
