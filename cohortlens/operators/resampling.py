"""Bootstraps as weights: clusters are reduced to their counts first, draws give each replicate's cluster multiplicities, and every statistic is a weighted sum.

Draws are made by vectors and travel as packed weights of a block of clusters, half a byte a cluster and replicate, so no row
is made by draw. A block meets its draws in one task, where sums are a product of matrices. Only ranking statistics attach to
each score group its cluster's weights under all replicates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import leading32
from ..functions.scalar import hash_order, ratio
from ..session import cut, ship, stored
from .indexing import dense_index, in_hash_order


#: Draws that a task makes in a row, and clusters whose draws meet in one task.
STRETCH, BLOCK = 1 << 22, 1 << 14
#: Slices of scores, each ordered by one task.
SLICES = 64


def cluster_counts(df: DataFrame, cluster: str, counts: dict[str, Column], strata: Sequence[str] = ()) -> DataFrame:
    """(strata, cluster, idx, n_clusters, counts...): each cluster's counts under its place from 0, in the order of clusters, or within strata in the order of their hash. One row a cluster."""
    return placed_clusters(df.groupBy(*strata, cluster).agg(*[F.sum(c.cast("long")).alias(n) for n, c in counts.items()]), cluster, strata)


def placed_clusters(g: DataFrame, cluster: str, strata: Sequence[str] = ()) -> DataFrame:
    """g, one row a cluster, with idx and n_clusters as cluster_counts() gives them. Both are written, as they are read more than once."""
    if not strata:
        g = dense_index(g, cluster)
        return g.crossJoin(F.broadcast(g.agg(F.count("*").alias("n_clusters"))))  # one row
    g = cut(g)
    sizes = g.groupBy(*[F.col(s).alias(f"_of_{s}") for s in strata]).agg(F.count("*").alias("n_clusters"))
    placed = in_hash_order(g, strata, hash_order("idx", F.col(cluster)), cluster).withColumnRenamed("_place", "idx")
    same = F.lit(True)
    for s in strata:
        same = same & F.col(s).eqNullSafe(F.col(f"_of_{s}"))
    return cut(placed.join(sizes, same).drop(*[f"_of_{s}" for s in strata]))


def _packed(at: np.ndarray) -> tuple[bool, bytes]:
    """Sorted places in a block with repeats: as their numbers in half bytes, or as they are where few are drawn or one is very often."""
    if len(at) * 4 >= BLOCK and (n := np.bincount(at, minlength=BLOCK)).max() < 16:
        return True, (n[::2] | n[1::2] << 4).astype(np.uint8).tobytes()
    return False, at.astype("<u2").tobytes()


def _unpacked(packed: bool, data: bytes) -> np.ndarray:
    if not packed:
        return np.bincount(np.frombuffer(data, "<u2"), minlength=BLOCK)
    n, two = np.empty(BLOCK, np.int64), np.frombuffer(data, np.uint8)
    n[::2], n[1::2] = two & 15, two >> 4
    return n


def draws(clusters: DataFrame, replicates: int, seed: str, strata: Sequence[str] = ()) -> DataFrame:
    """(strata, _block, r, packed, data): the clusters of each block that a replicate draws; as many draws as clusters, within strata. The j-th draw takes place (first 32 bits of md5(seed|strata|r|j)) modulo their number.

    Replicates are dealt evenly to a stated number of tasks in stretches of draws: their rows are so few and small that Spark
    would else put all of them into one task.
    """
    spark = clusters.sparkSession
    ship(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    d = clusters.select(*strata, "n_clusters").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("r"))
    d = d.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_clusters") - 1, F.lit(STRETCH).cast("long"))).alias("_from"))
    before = F.concat_ws("|", F.lit(seed), *[F.col(s).cast("string") for s in strata], F.col("r").cast("string"), F.lit(""))
    d = d.select(*strata, "r", "_from", "n_clusters", before.alias("_before")).repartition(tasks)
    k = len(strata)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r, start, n, prefix = (b.column(k + c)[i].as_py() for c in range(4))
                idx = np.sort(leading32(prefix.encode(), start, min(start + STRETCH, n)) % n)
                edges = np.append(np.flatnonzero(np.diff(idx >> 14, prepend=-1)), len(idx))
                rows = [(int(idx[x]) >> 14, *_packed(idx[x:y] & (BLOCK - 1))) for x, y in pairwise(edges)]
                own = [pa.concat_arrays([b.column(c).slice(i, 1)] * len(rows)) for c in range(k + 1)]
                blocks, packed, data = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*own[:k], pa.array(blocks, pa.int64()), own[k], pa.array(packed), pa.array(data, pa.binary())],
                    [*strata, "_block", "r", "packed", "data"])

    kinds = dict(d.dtypes)
    return d.mapInArrow(run, ", ".join([*[f"`{s}` {kinds[s]}" for s in strata], "_block long, r int, packed boolean, data binary"]))


def _met(clusters: DataFrame, replicates: int, seed: str, strata: Sequence[str], columns: Sequence[str], make: Callable, schema: str) -> DataFrame:
    """What make(weights, table) gives for each block: weights by replicate and place, and the block's clusters with columns in the order of places. Strata stand before its columns."""
    own = clusters.select(*strata, F.shiftright("idx", 14).alias("_block"), F.col("idx").bitwiseAND(F.lit(BLOCK - 1)).alias("_at"), *columns)
    keys, kinds = [*strata, "_block"], dict(clusters.dtypes)

    def run(key, table: pa.Table, drawn: pa.Table) -> pa.Table:
        w = np.zeros((replicates, BLOCK), np.int64)
        for r, packed, data in zip(*(drawn.column(c).to_pylist() for c in ("r", "packed", "data")), strict=True):
            w[r] += _unpacked(packed, data)
        table = table.sort_by("_at")
        out = make(w[:, table.column("_at").to_numpy()], table)
        n = len(next(iter(out.values())))
        return pa.table({s: pa.array([key[i].as_py()] * n, key[i].type) for i, s in enumerate(strata)} | out)

    return own.groupBy(*keys).cogroup(draws(clusters, replicates, seed, strata).groupBy(*keys)).applyInArrow(run, ", ".join([*[f"`{s}` {kinds[s]}" for s in strata], schema]))


def stratum_sums(clusters: DataFrame, replicates: int, seed: str, counts: Sequence[str], strata: Sequence[str] = ()) -> DataFrame:
    """(strata, r, counts...): weighted sums of each replicate and stratum."""
    kinds = dict(clusters.dtypes)

    def make(w: np.ndarray, table: pa.Table) -> dict:
        x = w.astype(float) @ np.column_stack([table.column(c).to_numpy().astype(float) for c in counts])  # whole numbers stay exact below 2^53
        return {"r": pa.array(np.arange(replicates, dtype=np.int32))} | {c: pa.array(x[:, i]) for i, c in enumerate(counts)}

    got = _met(clusters, replicates, seed, strata, counts, make, ", ".join(["r int", *[f"`{c}` double" for c in counts]]))
    return got.groupBy(*strata, "r").agg(*[F.sum(F.col(c).cast(kinds[c])).alias(c) for c in counts])


def resampled(clusters: DataFrame, replicates: int, seed: str, counts: Sequence[str], strata: Sequence[str] = ()) -> DataFrame:
    """(r, counts...): weighted sums of each replicate."""
    s = stratum_sums(clusters, replicates, seed, counts, strata)
    return s.groupBy("r").agg(*[F.sum(c).alias(c) for c in counts]) if strata else s


def weight_vectors(clusters: DataFrame, cluster: str, replicates: int, seed: str, strata: Sequence[str] = ()) -> DataFrame:
    """(strata, cluster, w): how often each replicate draws a cluster, in half bytes. A cluster drawn over 15 times has further rows for the rest, one never drawn has none."""
    kind = dict(clusters.dtypes)[cluster]

    def make(w: np.ndarray, table: pa.Table) -> dict:
        names, out = table.column(cluster).combine_chunks(), []
        w = np.vstack([w, np.zeros((replicates % 2, w.shape[1]), w.dtype)]).T
        while len(at := np.flatnonzero(w.any(axis=1))):
            part = np.minimum(w, 15)
            data = (part[:, ::2] | part[:, 1::2] << 4).astype(np.uint8)
            out.append((names.take(pa.array(at)), [data[i].tobytes() for i in at]))
            w = w - part
        return {cluster: pa.concat_arrays([names.slice(0, 0), *[x for x, _ in out]]), "w": pa.array([x for _, own in out for x in own], pa.binary())}

    return _met(clusters, replicates, seed, strata, [cluster], make, f"`{cluster}` {kind}, w binary")


def bootstrap(df: DataFrame, cluster: str, counts: dict[str, Column], statistics: dict[str, Callable[[Callable[[str], Column]], Column]],
    replicates: int, seed: str, level: float = 0.95) -> DataFrame:
    """(metric, point, low, high, valid) of statistics of summed counts: each is a function of `total`, which gives a count's sum, and is evaluated on all clusters and on every resample. Undefined replicates don't count."""
    a = (1 - level) / 2
    clusters = cluster_counts(df, cluster, counts)
    sums = resampled(clusters, replicates, seed, list(counts)).withColumn("_all", F.lit(False))
    whole = clusters.agg(*[F.sum(c).alias(c) for c in counts]).withColumns({"r": F.lit(-1), "_all": F.lit(True)})
    rows = sums.unionByName(whole, allowMissingColumns=True)
    each = F.array(*[F.struct(F.lit(n).alias("metric"), f(lambda c: F.col(c)).cast("double").alias("v")) for n, f in statistics.items()])
    long = rows.select("_all", F.explode(each).alias("x")).select("_all", "x.*")
    drawn = F.when(~F.col("_all"), F.col("v"))
    return long.groupBy("metric").agg(F.max(F.when(F.col("_all"), F.col("v"))).alias("point"), F.percentile(drawn, F.lit(a)).alias("low"),
        F.percentile(drawn, F.lit(1 - a)).alias("high"), F.count(drawn).alias("valid"))


def weighted_auc(scores: DataFrame, vectors: DataFrame, cluster: str, replicates: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, r, auc) of scores (by, cluster, score, pos, neg) under weight_vectors() of the same strata.

    Rows are dealt to slices of scores between quantiles, each put in order by one task; what lies below a slice comes from
    its sums. Equal scores share a slice, and their rows are only summed up.
    """
    ship(scores.sparkSession)
    scores = stored(scores.withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(float("-inf")))))  # as a null ranks below all
    cuts = scores.agg(F.percentile_approx("score", [i / SLICES for i in range(1, SLICES)], 10000)).first()[0] or []
    cuts = sorted(set(cuts))
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("score"))) if cuts else F.lit(0)
    # Spark takes what Python makes for small, and would broadcast it.
    rows = scores.join(vectors.hint("merge"), [*by, cluster]).select(*by, at.alias("_slice"), "score", "pos", "neg", "w")
    keys, k = [*by, "_slice"], len(by)
    kinds = dict(rows.dtypes)

    def run(batches):
        now, key, last, below = None, None, None, None

        def ended():
            pos, neg, wins, p, q = now
            wins += p * (2 * neg + q)
            own = [pa.array([x.as_py()] * replicates, x.type) for x in key]
            return pa.RecordBatch.from_arrays([*own, pa.array(np.arange(replicates, dtype=np.int32)), *[pa.array(x[:replicates]) for x in (pos + p, neg + q, wins)]],
                [*keys, "r", "pos", "neg", "wins"])

        for b in batches:
            names = [tuple(b.column(c)[i].as_py() for c in range(k + 1)) for i in (0, b.num_rows - 1)] if b.num_rows else []
            if not names:
                continue
            group = [b.column(c) for c in range(k + 1)]
            new = np.zeros(b.num_rows, bool)
            if names[0] != names[1]:
                for c in group:
                    code = np.asarray(c.dictionary_encode(null_encoding="encode").indices)
                    new[1:] |= code[1:] != code[:-1]
            new[0] = names[0] != below
            score = np.asarray(b.column(k + 1).to_numpy(zero_copy_only=False))
            pos, neg = (b.column(k + c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
            two = np.frombuffer(b"".join(b.column(k + 4).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            for lo, hi in pairwise([*np.flatnonzero(new | (np.arange(b.num_rows) % 512 == 0)), b.num_rows]):
                if new[lo]:
                    if now is not None:
                        yield ended()
                    key = [c[int(lo)] for c in group]
                    now, last = [np.zeros(2 * two.shape[1], np.int64) for _ in range(5)], None
                w = np.empty((hi - lo, 2 * two.shape[1]), np.int64)
                w[:, ::2], w[:, 1::2] = two[lo:hi] & 15, two[lo:hi] >> 4
                first = np.append(0, np.flatnonzero(score[lo + 1 : hi] != score[lo : hi - 1]) + 1)
                p, q = (np.add.reduceat(w * x[lo:hi, None], first, axis=0) for x in (pos, neg))
                if last == score[lo]:  # the open score goes on
                    p[0] += now[3]
                    q[0] += now[4]
                else:
                    p, q = np.vstack([now[3], p]), np.vstack([now[4], q])
                under = now[1] + np.cumsum(q, axis=0) - q
                now[2] = now[2] + (p[:-1] * (2 * under[:-1] + q[:-1])).sum(axis=0)
                now = [now[0] + p[:-1].sum(axis=0), under[-1], now[2], p[-1], q[-1]]
                last = score[hi - 1]
            below = names[1]
        if now is not None:
            yield ended()

    own = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    t = rows.repartition(*keys).sortWithinPartitions(*keys, "score").mapInArrow(run, f"{own}, r int, pos long, neg long, wins long")
    line = Window.partitionBy(*by, "r").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    t = t.withColumn("wins", F.col("wins") / 2.0 + F.col("pos") * F.coalesce(F.sum("neg").over(line), F.lit(0)))
    return t.groupBy(*by, "r").agg(ratio(F.sum("wins"), F.sum("pos") * F.sum("neg")).alias("auc"))


def drawn_clusters(df: DataFrame, cluster: str, size: int, draws: int, seed: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, r, cluster): for each draw, whole clusters in a shuffled order until size rows are reached; the one that crosses it is in.

    A cluster has a row at least, so the first `size` of each draw suffice; Spark keeps no more of them before it shuffles.
    """
    g = df.groupBy(*by, cluster).agg(F.count("*").alias("n")).select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("r"))
    g = g.withColumn("_h", hash_order(seed, F.col("r"), F.col(cluster)))
    w = Window.partitionBy(*by, "r").orderBy("_h", cluster)
    first = g.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= size)
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("_before", before).filter(F.col("_before") < size).select(*by, "r", cluster)


def calibration_draws(df: DataFrame, cluster: str, positive: Column, score: str, size: int, draws: int, seed: str,
    rules: dict[str, tuple[float, bool]], frozen: float, by: Sequence[str], least: int = 5, keep_specificity: float = 0.85) -> DataFrame:
    """(by, r, rule, cut, sensitivity, specificity): a cut is fitted on each drawn sample by each rule, and judged on the group's other rows.

    A rule is (target, keep): the highest cut whose sample sensitivity reaches the target, a hair below a positive's score;
    with keep, the frozen cut stays if it reaches the target and keep_specificity on the sample. Samples with fewer than
    `least` positives or others keep the frozen cut. Only samples are made by draw, whose size is given. The other rows are
    counted as all rows of the group, from its table of distinct scores, less the sample's; a draw that takes all of them
    gives no row.
    """
    d = df.select(*by, cluster, F.col(score).alias("score"), positive.alias("pos"))
    picked = drawn_clusters(d, cluster, size, draws, seed, by).join(d, [*by, cluster])
    values = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("score"))))
    s = picked.groupBy(*by, "r").agg(values(F.col("pos")).alias("p"), values(~F.col("pos")).alias("q"))
    reach = lambda c, cut: F.size(F.filter(c, lambda x: x >= cut))

    def fitted(target: float, keep: bool) -> Column:
        own = F.get("p", F.floor(F.lit(1 - target) * F.size("p")).cast("int")) - 1e-9
        if keep:
            passes = (ratio(reach("p", F.lit(frozen)), F.size("p")) >= target) & (1 - ratio(reach("q", F.lit(frozen)), F.size("q")) >= keep_specificity)
            own = F.when(passes, F.lit(frozen)).otherwise(own)
        return F.when((F.size("p") < least) | (F.size("q") < least), F.lit(frozen)).otherwise(own)

    s = s.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), fitted(*rule).alias("cut")) for n,
        rule in rules.items()])).alias("x")).select(*by, "r", "x.rule", "x.cut", "p", "q")
    s = s.select(*by, "r", "rule", "cut", F.size("p").alias("n_p"), F.size("q").alias("n_q"), reach("p", F.col("cut")).alias("c_p"), reach("q", F.col("cut")).alias("c_q"))
    # Distinct scores and cuts in one line, scores first where they tie: at a cut, what is called so far.
    table = d.groupBy(*by, F.col("score").alias("x")).agg(F.count_if("pos").alias("pos"), F.count_if(~F.col("pos")).alias("neg"))
    line = Window.partitionBy(*by).orderBy(F.col("x").desc(), "kind")
    whole = Window.partitionBy(*by)
    at = table.withColumn("kind", F.lit(0)).unionByName(s.select(*by, F.col("cut").alias("x"), F.lit(0).alias("pos"), F.lit(0).alias("neg"), F.lit(1).alias("kind")).distinct())
    at = at.withColumns({"a_p": F.sum("pos").over(line), "a_q": F.sum("neg").over(line), "t_p": F.sum("pos").over(whole),
        "t_q": F.sum("neg").over(whole)}).filter("kind = 1").select(*by, F.col("x").alias("cut"), "a_p", "a_q", "t_p", "t_q")
    out = s.join(at, [*by, "cut"]).filter(F.col("n_p") + F.col("n_q") < F.col("t_p") + F.col("t_q"))
    sensitivity = ratio(F.col("a_p") - F.col("c_p"), F.col("t_p") - F.col("n_p"))
    specificity = 1 - ratio(F.col("a_q") - F.col("c_q"), F.col("t_q") - F.col("n_q"))
    return out.select(*by, "r", "rule", "cut", sensitivity.alias("sensitivity"), specificity.alias("specificity"))
