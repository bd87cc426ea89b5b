"""The library's front door: queries by name, a model's report on a table of predictions, and a small command line."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import decode, sigmoid
from .operators import contracts
from .operators.report import grading_report
from .plans import catalogue


@dataclass(frozen=True)
class Config:
    """Columns of a table of predictions, and the policy that turns scores into grades."""

    truth: str = "grade"
    score: str = "score"
    referral_logit: str = "referral"
    thresholds: tuple[float, ...] = (0.5, 1.5, 2.5, 3.5)
    referable: int = 2

    def __post_init__(self):
        if not contracts.ordinal_thresholds(self.thresholds):
            raise ValueError("thresholds must be four increasing numbers in [0, 4]")


def predict(df: DataFrame, config: Config = Config()) -> DataFrame:
    """df with pred, head and status: "error" where a score or logit is missing or not a number."""
    s, z = F.col(config.score), F.col(config.referral_logit)
    bad = s.isNull() | F.isnan(s) | z.isNull() | F.isnan(z)
    return df.withColumns({"pred": F.when(~bad, decode(s, config.thresholds)), "head": F.when(~bad, z >= 0), "status": F.when(bad, "error").otherwise("success")})


def evaluate(df: DataFrame, config: Config = Config()) -> DataFrame:
    """(metric, value) of the rows that could be predicted; missing columns, and grades beyond the scale, are errors."""
    if lacking := contracts.missing_columns(df, [config.truth, config.score, config.referral_logit]):
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    bad = contracts.contract(df, contracts.rules_of_grades(config.truth)).filter("violations > 0").collect()  # a row a rule
    if bad:
        raise ValueError(f"grades beyond the scale: {bad[0]['violations']}")
    ok = predict(df, config).filter("status = 'success'")
    return grading_report(ok, config.truth, "pred", config.score, sigmoid(F.col(config.referral_logit)), F.col("head"), config.referable)


def run(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    """A registered query."""
    if name not in catalogue.QUERIES:
        raise KeyError(f"no query {name!r}")
    return catalogue.QUERIES[name](spark, sf_dir)


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """doctor | queries | run NAME TABLES [--out PATH] | evaluate PREDICTIONS [--out PATH]. Results go to standard output, or as Parquet to a path that doesn't exist yet."""
    p = argparse.ArgumentParser(prog="cohortlens", description=main.__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("doctor")
    sub.add_parser("queries")
    r = sub.add_parser("run")
    r.add_argument("name")
    r.add_argument("tables")
    e = sub.add_parser("evaluate")
    e.add_argument("predictions")
    for x in (r, e):
        x.add_argument("--out")
    a = p.parse_args(args)
    if a.command == "queries":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "doctor":
        print(f"Spark {spark.version}, {spark.range(10).count()} of 10 rows, {len(catalogue.QUERIES)} queries, {len(catalogue.SQL)} with SQL")
        return 0
    df = run(spark, a.name, a.tables) if a.command == "run" else evaluate(spark.read.parquet(a.predictions))
    if a.out:
        df.write.mode("errorifexists").parquet(a.out)
    else:
        for row in df.toLocalIterator():
            print("\t".join(map(str, row)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
