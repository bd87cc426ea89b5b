"""A model's whole report on a cohort as (metric, value) rows, and the evaluation that a lock allows once."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from . import calibration as C
from . import governance as G
from . import metrics as M
from . import ranking as R


def _long(row: DataFrame) -> DataFrame:
    """The columns of a one-row table as (metric, value)."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])).alias("x")).select("x.*")


def grading_report(df: DataFrame, truth: str, pred: str, score: str, probability: Column, head: Column, referable: int = 2, bins: int = 15) -> DataFrame:
    """(metric, value): counts, rates, agreement, ranking, operating points, recall by grade, calibration, and where the head disagrees with the grade. Undefined values are null."""
    y, call = F.col(truth) >= referable, F.col(pred) >= referable
    roc = R.roc_table(R.score_table(df, y, score))
    points = R.sensitivity_at(roc, 0.85).select(F.col("value").alias("sens_at_spec85")).crossJoin(R.specificity_at(roc, 0.85).select(F.col("value").alias("spec_at_sens85")))  # single rows
    matrix = M.confusion(df, truth, pred)
    grades = M.per_class(matrix).select(F.concat(F.lit("recall_"), F.col("grade")).alias("metric"), F.col("recall").alias("value"))
    held = C.ece(C.bin_table(df, probability, y, C.right_closed_bin(probability, bins), bins))
    rates = M.rates(df, y, call).select("tp", "fn", "tn", "fp", "sensitivity", "specificity")
    agreement = M.agreement(df, truth, pred).select("n", "accuracy", "mae", "within_one")
    other = df.agg(C.brier(probability, y).alias("brier"), F.count_if(head != call).alias("head_disagreements"))
    parts = [rates, agreement, other, held, points, M.qwk(matrix).select("qwk"), M.macro_f1(M.per_class(matrix)), R.auc(R.score_table(df, y, score)).select("auc"), R.average_precision(roc)]
    out = grades
    for p in parts:
        out = out.unionByName(_long(p))
    return out


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def evaluate_locked(report: DataFrame, folder: str, lock: Mapping, tables: Mapping[str, tuple[DataFrame, str]]) -> str:
    """Writes a lock's report under its digest, once: "written"; "changed" if an input isn't what was frozen, "refused" if the report is there.

    The claim is a file that is created without overwriting before anything is computed, so of two runs at a time one is
    refused; whoever finds a claim without a report knows that a run broke off.
    """
    spark = report.sparkSession
    if G.broken_bindings(dict(lock), tables):
        return "changed"
    claim, target = f"{folder}/{lock['sha256']}.claim", f"{folder}/{lock['sha256']}"
    fs, at = _place(spark, claim)
    if fs.exists(at) or not fs.createNewFile(at):
        return "refused"
    report.coalesce(1).write.json(target)
    return "written"


def read_report(spark: SparkSession, folder: str, lock: Mapping) -> DataFrame:
    return spark.read.schema("metric string, value double").json(f"{folder}/{lock['sha256']}")


def passport(parts: Mapping[str, Mapping], rules: Mapping[str, tuple[str, str]]) -> dict:
    """Reports bound together: each one's digest, and for each rule (a path in one report, a path in another) whether both hold the same value; paths are "report.key.key". Raises on a broken rule."""
    import hashlib

    def at(path: str):
        name, *keys = path.split(".")
        value = parts[name]
        for k in keys:
            value = value[k]
        return value

    broken = [r for r, (a, b) in rules.items() if at(a) != at(b)]
    if broken:
        raise ValueError(f"reports disagree: {', '.join(broken)}")
    return {"digests": {n: hashlib.sha256(json.dumps(p, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for n, p in sorted(parts.items())}, "rules": sorted(rules)}
