"""Classification metrics: confusion matrices, rates, agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio, wilson


def confusion(df: DataFrame, truth: str, pred: str, classes: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """(by, truth, pred, n) on the complete grid of classes; rows outside the grid don't count.

    Cells are numbered and joined null-safely: a filter on them, or the one that a plain equality brings, would be pushed
    to the scan and there compute whatever the grades derive from again, once for each time they are named.
    """
    inside = F.col(truth).between(0, classes - 1) & F.col(pred).between(0, classes - 1)
    cell = F.when(inside, F.col(truth).cast("int") * classes + F.col(pred).cast("int")).cast("long")
    n = df.groupBy(*by, cell.alias("_cell")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(classes * classes)
    if by:
        grid = n.select(*by).distinct().join(F.broadcast(grid))  # classes squared rows
    n = n.select(*[F.col(c).alias(f"_{c}") for c in by], "_cell", "n")
    same = F.col("id").eqNullSafe(F.col("_cell"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return grid.join(n, same, "left").select(*by, F.floor(F.col("id") / classes).cast("int").alias("truth"),
        (F.col("id") % classes).cast("int").alias("pred"), F.coalesce("n", F.lit(0)).alias("n"))


def qwk(matrix: DataFrame, classes: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, qwk): quadratic weighted kappa of a matrix over a fixed range; null where chance leaves no disagreement."""
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    m = matrix.withColumns({"r": F.sum("n").over(Window.partitionBy(*by, "truth")), "c": F.sum("n").over(Window.partitionBy(*by, "pred")), "t": F.sum("n").over(part)})
    w = (F.col("truth") - F.col("pred")) * (F.col("truth") - F.col("pred")) / float((classes - 1) ** 2)
    chance = F.sum(w * ratio(F.col("r") * F.col("c"), F.col("t")))
    return m.groupBy(*by).agg(F.sum("n").alias("n"), (1 - ratio(F.sum(w * F.col("n")), chance)).alias("qwk"))


def qwk_observed(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Kappa over the range from the smallest to the largest grade seen, so weights differ where grades are missing; null with one grade."""
    both = df.agg(F.min(F.least(truth, pred)).alias("low"), F.max(F.greatest(truth, pred)).alias("high"))
    n = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(both))  # one row
    rows = n.groupBy("t").agg(F.sum("n").alias("r"), F.max("high").alias("high"), F.max("low").alias("low"))
    cols = n.groupBy("p").agg(F.sum("n").alias("c"))
    w = lambda a, b: F.try_divide((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)), (F.col("high") - F.col("low")) * (F.col("high") - F.col("low")))
    seen = n.agg(F.sum(w("t", "p") * F.col("n")).alias("o"), F.sum("n").alias("n"))
    chance = rows.crossJoin(cols).agg(F.sum(w("t", "p") * F.col("r") * F.col("c")).alias("e"))  # at most one row a grade on each side
    return seen.crossJoin(chance).select("n", (1 - ratio(F.col("o") * F.col("n"), F.col("e"))).alias("qwk"))


def per_class(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, grade, support, recall, precision, specificity, f1): f1 is 0 where recall and precision are both 0, null only where both are undefined."""
    total = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    m = matrix.withColumn("t", F.sum("n").over(total))
    rows = m.groupBy(*by, F.col("truth").alias("grade")).agg(F.sum("n").alias("support"),
        F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"), F.max("t").alias("t"))
    cols = matrix.groupBy(*by, F.col("pred").alias("grade")).agg(F.sum("n").alias("called"))
    out = rows.join(cols, [*by, "grade"])
    fp = F.col("called") - F.col("tp")
    recall, precision = ratio(F.col("tp"), F.col("support")), ratio(F.col("tp"), F.col("called"))
    f1 = F.when(recall.isNull() & precision.isNull(), None).otherwise(F.coalesce(ratio(2 * F.col("tp"), F.col("support") + F.col("called")), F.lit(0.0)))
    return out.select(*by, "grade", "support", recall.alias("recall"), precision.alias("precision"),
        ratio(F.col("t") - F.col("support") - fp, F.col("t") - F.col("support")).alias("specificity"), f1.alias("f1"))


def macro_f1(per_class_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The mean over classes that are defined."""
    return per_class_rows.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def rates(df: DataFrame, truth: Column, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, tp, fn, tn, fp, sensitivity, specificity, ppv, npv, accuracy, f1) in one aggregate."""
    count = lambda c: F.count_if(c)
    n = df.groupBy(*by).agg(count(truth & positive).alias("tp"), count(truth & ~positive).alias("fn"), count(~truth & ~positive).alias("tn"), count(~truth & positive).alias("fp"))
    return with_rates(n)


def with_rates(n: DataFrame) -> DataFrame:
    tp, fn, tn, fp = (F.col(c) for c in ("tp", "fn", "tn", "fp"))
    return n.withColumns({"sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "ppv": ratio(tp, tp + fp), "npv": ratio(tn, tn + fn),
        "accuracy": ratio(tp + tn, tp + fn + tn + fp), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def agreement(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, accuracy, mae, within_one, off_by_two)."""
    d = F.abs(F.col(truth) - F.col(pred))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg((d == 0).cast("double")).alias("accuracy"), F.avg(d.cast("double")).alias("mae"),
        F.avg((d <= 1).cast("double")).alias("within_one"), F.count_if(d >= 2).alias("off_by_two"))


def verification(rates_row: DataFrame, sensitivity: float, specificity: float) -> DataFrame:
    """Rates with Wilson intervals and pass flags, by the point and by the lower bound."""
    slo, shi = wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    plo, phi = wilson(F.col("tn"), F.col("tn") + F.col("fp"))
    return rates_row.withColumns({"sens_low": slo, "sens_high": shi, "spec_low": plo,
        "spec_high": phi}).withColumns({"passes": (F.col("sensitivity") >= sensitivity) & (F.col("specificity") >= specificity),
        "passes_low": (F.col("sens_low") >= sensitivity) & (F.col("spec_low") >= specificity)})


def batch_summary(df: DataFrame) -> DataFrame:
    """One row: status counts, coverage, and how the whole cohort was resolved. Needs status, true_grade, pred, head."""
    ok = F.col("status") == "success"
    ref, called, head = F.col("true_grade") >= 2, F.col("pred") >= 2, F.col("head")
    clear = ok & ~called & ~head
    return df.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.count_if(F.col("status") == "error").alias("errors"),
        F.avg(ok.cast("double")).alias("coverage"), F.count_if(clear).alias("auto_clear"), F.count_if(clear & ref).alias("missed_referable"), F.count_if(ok & called & head).alias("referred"),
        F.count_if(ok & (called != head)).alias("disagreements"), F.count_if(ok & (called == head) & (F.col("pred") == F.col("true_grade"))).alias("concordant_correct"),
        ratio(F.count_if(ok & ref & (called | head)), F.count_if(ref)).alias("cohort_sensitivity"), ratio(F.count_if(clear), F.count("*")).alias("clear_rate"),
    )
