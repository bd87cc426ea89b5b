"""Nested documents: reports as rows, canonical digests, publication without NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType


def leaves(schema: StructType, prefix: str = "", path: str = "") -> list[tuple[str, str]]:
    """(metric name, column path) of all numbers; a field named _ stands for the struct itself."""
    out = []
    for f in schema.fields:
        at = f"{path}.{f.name}" if path else f.name
        name = (prefix if f.name == "_" else f"{prefix}.{f.name}" if prefix else f.name)
        if isinstance(f.dataType, StructType):
            out += leaves(f.dataType, name, at)
        elif isinstance(f.dataType, NumericType):
            out.append((name, at))
    return out


def flatten(row: DataFrame) -> DataFrame:
    """(metric, value) of a row's nested numbers."""
    pairs = [F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for n, c in leaves(row.schema)]
    return row.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def published(c: Column) -> Column:
    """A number as JSON can hold it: NaN and infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def canonical(*columns: str) -> Column:
    """JSON with sorted keys, as input of a digest."""
    return F.to_json(F.struct(*sorted(columns)))


def validated(rows: DataFrame, text: str, schema: str, version: int, required: tuple[str, ...]) -> DataFrame:
    """rows with `document`, parsed by schema (which has a `version`), and `problem`: "not json", "version", "missing: names", or null."""
    d = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    parsed = rows.withColumn("document", d)
    missing = F.filter(F.array(*[F.when(F.col(f"document.{r}").isNull(), F.lit(r)) for r in required]), lambda x: x.isNotNull())
    broken = F.get_json_object(text, "$").isNull()
    problem = F.when(broken, "not json").when(~F.col("document.version").eqNullSafe(F.lit(version)), "version").when(F.size(missing) > 0,
        F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    return parsed.withColumn("problem", problem)
