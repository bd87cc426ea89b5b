"""Contracts: rules on rows, counted in one aggregate instead of raised one by one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def contract(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): how many rows each rule's condition, which describes a violation, holds for."""
    row = df.agg(*[F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values())])
    return row.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"r{i}").alias("violations")) for i, r in enumerate(rules)])).alias("x")).select("x.*")


def rules_of_grades(grade: str, probabilities: str | None = None, tolerance: float = 1e-6, top: int = 4) -> dict[str, Column]:
    """A grade is a whole number from 0 to top; probabilities lie in [0, 1] and sum to 1."""
    g = F.col(grade)
    out = {"grade": g.isNull() | (g != F.floor(g)) | ~g.between(0, top)}
    if probabilities:
        p = F.col(probabilities)
        total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
        out["probabilities"] = ~F.forall(p, lambda v: (v >= 0) & (v <= 1)) | (F.abs(total - 1) > tolerance)
    return out


def rules_of_ids(column: str) -> dict[str, Column]:
    c = F.col(column).cast("string")
    return {"id_missing": c.isNull() | (F.trim(c) == ""), "id_padded": c != F.trim(c)}


def ordinal_thresholds(values: Sequence[float], top: float = 4.0) -> bool:
    """Four finite thresholds, strictly increasing, in [0, top]."""
    return len(values) == 4 and all(v == v and 0 <= v <= top for v in values) and all(a < b for a, b in zip(values, values[1:], strict=False))


def boolean(c: Column) -> Column:
    """Tolerant spellings; unknown ones give null, to be counted by a contract."""
    t = F.lower(F.trim(c))
    return F.when(t.isin("1", "1.0", "true"), True).when(t.isin("0", "0.0", "false"), False)
