"""Decision thresholds under sensitivity and specificity targets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from .ranking import running


def boundary(df: DataFrame, positive: Column, score: str, target: float, by: Sequence[str] = (), least: int = 5, fallback: float | None = None) -> DataFrame:
    """(by, n_pos, cut): the (floor((1 - target) n) + 1)-th lowest positive score, minus 1e-9. Groups with fewer positives than least get the fallback."""
    p = df.filter(positive).groupBy(*by, F.col(score).alias("s")).agg(F.count("*").alias("n"))
    k = F.floor(F.lit(1 - target) * F.col("all_n")) + 1
    p = running(p, by, "s", ["n"]).filter(F.col("cum_n") >= k).groupBy(*by).agg(F.min("s").alias("s"), F.first("all_n").alias("n_pos"))
    return p.select(*by, "n_pos", F.when(F.col("n_pos") >= least, F.col("s") - 1e-9).otherwise(F.lit(fallback).cast("double")).alias("cut"))


def source_roc(df: DataFrame, positive: Column, score: str, source: str) -> DataFrame:
    """(score, source, sens, spec) for every distinct score as a cut and every source. As many rows as scores times sources."""
    n = df.groupBy(F.col(score).alias("score"), source).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    grid = n.select("score").distinct().crossJoin(F.broadcast(n.select(source).distinct()))  # a row a source
    n = grid.join(n, ["score", source], "left").fillna(0, ["pos", "neg"])
    n = running(n, [source], "score", ["pos", "neg"], descending=True)
    return n.select("score", source, ratio(F.col("cum_pos"), F.col("all_pos")).alias("sens"), ratio(F.col("all_neg") - F.col("cum_neg"), F.col("all_neg")).alias("spec"))


def balanced_threshold(roc: DataFrame, target: float) -> DataFrame:
    """(cut, sens, spec): of the cuts whose mean sensitivity over sources reaches the target, that of the best mean specificity; of equal ones the highest."""
    m = roc.groupBy("score").agg(F.avg("sens").alias("sens"), F.avg("spec").alias("spec")).filter(F.col("sens") >= F.lit(target))
    best = F.max(F.struct(F.round("spec", 9).alias("k"), F.col("score").alias("cut"), F.col("sens").alias("sens"), F.col("spec").alias("spec")))
    return m.agg(best.alias("b")).select("b.cut", "b.sens", "b.spec")


def youden_threshold(roc: DataFrame) -> DataFrame:
    """(cut, youden): the best mean of sensitivity plus specificity minus one; of equal ones the highest cut."""
    m = roc.groupBy("score").agg((F.avg("sens") + F.avg("spec") - 1).alias("youden"))
    return m.agg(F.max(F.struct(F.round("youden", 9).alias("k"), F.col("score").alias("cut"), F.col("youden").alias("youden"))).alias("b")).select("b.cut", "b.youden")


def worst_source_threshold(roc: DataFrame, target: float) -> DataFrame:
    """(cut, worst): the highest cut at which every source reaches the target sensitivity."""
    m = roc.groupBy("score").agg(F.min("sens").alias("worst")).filter(F.col("worst") >= F.lit(target))
    return m.agg(F.max(F.struct(F.col("score").alias("cut"), F.col("worst").alias("worst"))).alias("b")).select("b.cut", "b.worst")


def floor_threshold(roc_rows: DataFrame, floor: float) -> DataFrame:
    """(cut, sens, spec) of a roc table: the largest sensitivity whose specificity keeps the floor, then the best specificity. The cut lies midway to the next lower score."""
    sens, spec = ratio(F.col("tp"), F.col("all_pos")), ratio(F.col("all_neg") - F.col("fp"), F.col("all_neg"))
    best = roc_rows.agg(F.max(F.when(spec >= F.lit(floor), F.struct(F.round(sens, 9).alias("a"), F.round(spec, 9).alias("b"), F.col("score").alias("s")))).alias("x"))
    below = roc_rows.crossJoin(F.broadcast(best.select("x.*"))).agg(F.max(F.when(F.col("score") < F.col("s"), F.col("score"))).alias("p"),
        F.first("a").alias("sens"), F.first("b").alias("spec"), F.first("s").alias("s"))  # one row
    return below.select(((F.col("s") + F.coalesce("p", "s")) / 2).alias("cut"), "sens", "spec")


def select_rule(rules: DataFrame, preference: Sequence[str], tolerance: float = 0.02, least_sensitivity: float = 0.89) -> DataFrame:
    """(rule, p_both, worst, constrained) of rules (site, rule, p_both, sensitivity): of the rules whose mean sensitivity reaches the least at every site, the first in order of preference within tolerance of the best mean p_both; if none does, the rule with the highest worst sensitivity."""
    m = rules.groupBy("rule").agg(F.avg("p_both").alias("p_both"), F.min("sensitivity").alias("worst"))
    whole = Window.partitionBy(F.lit(1))  # a row a rule
    m = m.withColumn("fits", F.round("worst", 9) >= least_sensitivity).withColumns({"constrained": F.max("fits").over(whole),
        "best": F.max(F.when(F.col("fits"), F.col("p_both"))).over(whole)})
    rank = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col("rule")).cast("double")
    fit = F.col("fits") & (F.round(F.col("p_both") - F.col("best"), 9) >= -tolerance)
    key = F.when(F.col("constrained"), F.when(fit, -rank)).otherwise(F.round("worst", 9))
    return m.withColumn("key", key).filter("key IS NOT NULL").agg(F.max_by(F.struct("rule", "p_both", "worst", "constrained"), F.struct("key", -rank)).alias("x")).select("x.*")


def clopper_pearson_upper(k: int, n: int, level: float = 0.95) -> float:
    """The exact one-sided upper bound of a share: where the binomial tail up to k falls to 1 - level, by bisection."""
    if k >= n:
        return 1.0
    log_choose = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    low, high = k / n, 1.0
    for _ in range(100):
        p = (low + high) / 2
        tail = sum(math.exp(c + i * math.log(p) + (n - i) * math.log1p(-p)) for i, c in enumerate(log_choose)) if 0 < p < 1 else 0.0
        low, high = (p, high) if tail > 1 - level else (low, p)
    return (low + high) / 2
