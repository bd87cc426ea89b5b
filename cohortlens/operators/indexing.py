"""Row numbers over whole tables and large groups without bringing them into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def dense_index(df: DataFrame, order: str, name: str = "idx") -> DataFrame:
    """df with each row's place from 0 in the order of a column without ties.

    Rows are range-partitioned and sorted; a row's place is its place in the partition plus the rows of the partitions
    before, of which there is one count each. The sorted rows are cut, as their places are read twice.
    """
    rows = cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id()))
    rows = rows.withColumns({"_part": F.shiftright("_m", 33), "_at": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row a partition
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_m", "_part", "_at", "_before")


def in_hash_order(df: DataFrame, by: Sequence[str], order: Column, tie: str, size: Column | None = None, buckets_hex: int = 3) -> DataFrame:
    """df with _place, from 0, of each row among those with equal `by`, in the order of a hexadecimal hash; with size, also _before, the sum of size over the rows ahead.

    The hash's first digits cut each group into even buckets. What stands before a bucket comes from one count a bucket, and
    windows only order rows inside a bucket, so a group may hold any share of the table.
    """
    rows = df.withColumns({"_h": order, "_size": F.lit(1).cast("long") if size is None else size})
    rows = rows.withColumn("_bucket", F.substring("_h", 1, buckets_hex))
    ahead = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"), F.sum("_size").alias("_s"))
    held = held.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_bucket").alias("_at"),
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_s0"))
    same = F.col("_bucket") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_h", tie)
    out = rows.join(held, same).withColumn("_place", F.row_number().over(inside) - 1 + F.col("_n0"))
    if size is not None:
        out = out.withColumn("_before", F.coalesce(F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_s0"))
    return out.drop("_h", "_size", "_bucket", "_at", "_n0", "_s0", *[f"_by{i}" for i in range(len(by))])
