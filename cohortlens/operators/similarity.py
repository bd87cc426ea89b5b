"""Similarity joins on bit patterns and vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hamming


def _blocks(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of distance + 1 bit blocks over 64 bits; the first ones are a bit wider."""
    n = distance + 1
    widths = [64 // n + (k < 64 % n) for k in range(n)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def hamming_join(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """(a, b, distance) for all patterns at most so far apart. left: (a, x), right: (b, y); patterns are longs.

    Of distance + 1 blocks at least one agrees, so rows meet by block; exact, and without a cross join. A pair that meets in
    several blocks is taken in the first one only, so no distinct is needed.
    """
    def keyed(df, v):
        keys = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(F.col(v), s).bitwiseAND(F.lit((1 << w) - 1)).alias("bits")) for k, (s, w) in enumerate(_blocks(distance))]
        return df.select("*", F.explode(F.array(*keys)).alias("k")).select("*", "k.block", "k.bits").drop("k")

    pairs = keyed(left, "x").join(keyed(right, "y"), ["block", "bits"])
    same = [F.shiftrightunsigned(F.col("x").bitwiseXOR(F.col("y")), s).bitwiseAND(F.lit((1 << w) - 1)) == 0 for s, w in _blocks(distance)]
    first = F.coalesce(*[F.when(c, F.lit(k)) for k, c in enumerate(same)])
    return pairs.filter((hamming(F.col("x"), F.col("y")) <= distance) & (first == F.col("block"))).select("a", "b", hamming(F.col("x"), F.col("y")).alias("distance"))


def closest(pairs: DataFrame, n: int) -> DataFrame:
    """The n closest pairs, ties by (a, b)."""
    return pairs.orderBy("distance", "a", "b").limit(n)


#: Vectors in a block of queries or of rows; a task multiplies two blocks at a time.
BLOCK = 4096


def mirrored(v: Column, width: int) -> Column:
    """A vector read as rows of so many values, each row turned round."""
    n = F.size(v)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(v, i - i % width + (width - 1) - i % width))


def _matrix(values: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(values.to_pylist(), np.float64).reshape(len(values), -1)


def _similarity(x: np.ndarray, y: np.ndarray, width: int | None) -> np.ndarray:
    """Rounded dot products; with a width, the larger of the plain and the mirrored one."""
    s = x @ y.T
    if width:
        s = np.maximum(s, x @ y.reshape(len(y), -1, width)[:, :, ::-1].reshape(len(y), -1).T)
    return np.round(s, 6)


def _blocks_of(df: DataFrame, name: str, most: int) -> tuple[DataFrame, int]:
    """df with a block by the identifier's hash, so many that a block holds about `most` rows."""
    blocks = max(1, -(-df.count() // most))
    return df.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), blocks


def top_k(queries: DataFrame, reference: DataFrame, k: int, width: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query, ref, similarity, rank): the k references with the largest dot product, ties by reference; (id, v) on both sides. With a width, mirrored vectors count too.

    A stated query set against all rows: blocks of queries meet blocks of references, each meeting keeps its best k, and the
    best of those are taken by query. Any number of queries; an identical identifier is not its own neighbour.
    """
    q, queries_blocks = _blocks_of(queries.select("id", "v"), "qb", block)
    r, blocks = _blocks_of(reference.select("id", "v"), "rb", block)
    at_ref = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("rb")
    at_query = F.explode(F.sequence(F.lit(0), F.lit(queries_blocks - 1))).alias("qb")

    def best(key, own: pa.Table, rows: pa.Table) -> pa.Table:
        if not (own.num_rows and rows.num_rows):
            return pa.table({"query": pa.array([], pa.int64()), "ref": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        ids, ref = own.column("id").to_numpy(), rows.column("id").to_numpy()
        m, out = _matrix(rows.column("v")), []
        for a in range(0, len(ids), 512):
            x = _matrix(own.column("v").slice(a, 512))
            s = _similarity(x, m, width)
            s = np.where(ids[a : a + 512, None] == ref[None, :], -np.inf, s)
            order = np.lexsort((np.broadcast_to(ref, s.shape), -s), axis=1)[:, :k]
            top = np.take_along_axis(s, order, 1)
            there = np.isfinite(top)
            out.append((np.repeat(ids[a : a + 512], order.shape[1]).reshape(order.shape)[there], ref[order][there], top[there]))
        a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"query": pa.array(a), "ref": pa.array(b), "similarity": pa.array(s)})

    part = q.select("id", "v", "qb", at_ref).groupBy("qb", "rb").cogroup(r.select("id", "v", "rb", at_query).groupBy("qb", "rb")).applyInArrow(best,
        "query long, ref long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("similarity").desc(), "ref"))
    return part.withColumn("rank", rank).filter(F.col("rank") <= k)


def similar_pairs(df: DataFrame, threshold: float, width: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b, similarity) with a < b for all vectors (id, v) whose dot product reaches the threshold. With a width, the larger of the plain and the mirrored product counts.

    Rows go to blocks of bounded size, and each pair of blocks is one task: memory doesn't grow with the table, the work with
    its square, and the result as the threshold lets through.
    """
    rows, blocks = _blocks_of(df.select("id", "v"), "own", block)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select("id", "v", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"))

    def multiply(rows: pa.Table) -> pa.Table:
        ids, v = rows.column("id").to_numpy(), _matrix(rows.column("v"))
        left, right = np.flatnonzero(rows.column("left").to_numpy()), np.flatnonzero(rows.column("right").to_numpy())
        same = np.array_equal(left, right)
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for k in range(0, len(left), 1024):
            own = left[k : k + 1024]
            if not len(right):
                break
            s = _similarity(v[own], v[right], width)
            x, y = np.nonzero(s >= threshold)
            a, b = ids[own[x]], ids[right[y]]
            keep = (a < b) if same else (a != b)
            out.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], s[x, y][keep]))
        a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"a": pa.array(a), "b": pa.array(b), "similarity": pa.array(s)})

    return rows.groupBy("lo", "hi").applyInArrow(multiply, "a long, b long, similarity double")
