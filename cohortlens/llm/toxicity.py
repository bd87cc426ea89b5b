"""Operator 3: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are hashed byte n-grams of the lower-cased text, counted once a document. From a bounded sample of labelled rows
come each feature's document counts by class and so its log-count ratio; the features that tell the classes apart most
surely enter a logistic regression whose inputs are present ratios. Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, table

#: Lengths of the n-grams in bytes, number of hash buckets, features kept for the regression.
LENGTHS, BUCKETS_LOG2, KEPT = (3, 4, 5, 6), 20, 2048
#: At most so many labelled rows of each class are taken for the fit; which ones depends on a hash of the identifier.
FIT_ROWS_PER_CLASS = 20_000
#: Weight of the squared coefficients.
L2 = 3.0
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def buckets(text: str | None) -> np.ndarray:
    """Hash buckets of the text's n-grams, with repeats; a space is put before and behind, and runs of white space count as one."""
    data = np.frombuffer((" " + " ".join((text or "").lower().split()) + " ").encode(), np.uint8).astype(np.uint64) + np.uint64(1)
    out, h = [], np.zeros(0, np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        if len(data) < n:
            break
        h = (h[: len(data) - n + 1] if n > 1 else np.zeros(len(data), np.uint64)) + data[n - 1 :] * _MULTIPLIERS[n - 1]
        if n in LENGTHS:
            x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((x >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


@dataclass
class Model:
    """place: of each bucket among the features, or -1. weight: a feature's ratio times its coefficient."""

    place: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        at = self.place[buckets(text)]
        z = self.bias + float(self.weight[np.unique(at[at >= 0])].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _count(batches):
    """Document counts of this task by class and bucket, in slices."""
    counts = np.zeros((2, 1 << BUCKETS_LOG2), np.int32)
    for b in batches:
        for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            counts[y, np.unique(buckets(text))] += 1
    step = 1 << 15
    for k in range(0, counts.shape[1], step):
        if (own := np.ascontiguousarray(counts[:, k : k + step])).any():
            yield pa.RecordBatch.from_arrays([pa.array([k // step], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["slice", "counts"])


def _add(key, batches_or_table):
    total = sum(np.frombuffer(x, np.int32) for x in batches_or_table.column("counts").to_pylist())
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.asarray(total, np.int32).tobytes()], pa.binary())})


def fit(labelled: DataFrame, rows: dict[int, int], l2: float = L2, steps: int = 150, rate: float = 0.02) -> Model:
    """labelled: (y, w, text) with y 0 or 1 and a weight that undoes the sampling of y's class; rows: how many of each class.

    With one class only, every score is that class's share; without rows it is 0.
    """
    small_batches(labelled.sparkSession)
    dims = 1 << BUCKETS_LOG2
    if not rows.get(0) or not rows.get(1):
        return Model(np.full(dims, -1, np.int32), np.zeros(0), 30.0 if rows.get(1) else -30.0)
    counts = np.zeros((2, dims))
    for r in labelled.select("y", "text").mapInArrow(_count, "slice int, counts binary").groupBy("slice").applyInArrow(_add,
        "slice int, counts binary").collect():  # 2**20 counts a class, whatever the input
        own = np.frombuffer(r["counts"], np.int32).reshape(2, -1)
        counts[:, r["slice"] * own.shape[1] : (r["slice"] + 1) * own.shape[1]] = own
    share = np.array([[rows[0]], [rows[1]]], float)
    p = (counts + share / share.sum()) / (share + 1)  # smoothed towards no difference
    ratio = np.log(p[1] / p[0])
    pooled = (counts.sum(0) + 0.5) / (share.sum() + 1)
    apart = counts[1] / rows[1] - counts[0] / rows[0]
    sure = np.abs(apart) / np.sqrt(pooled * (1 - pooled) * (1 / rows[0] + 1 / rows[1]))
    chosen = np.argsort(-sure, kind="stable")[:KEPT]
    place = np.full(dims, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    r = ratio[chosen]

    def features(batches):
        for b in batches:
            own = [place[buckets(t)] for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.unique(x[x >= 0]).astype(np.uint16).tobytes() for x in own], pa.binary())], ["y", "w", "at"])

    got = labelled.select("y", "w", "text").mapInArrow(features, "y int, w double, at binary").toArrow()  # the bounded sample, at most KEPT numbers a row
    at = [np.frombuffer(x, np.uint16) for x in got.column("at").to_pylist()]
    y, w = got.column("y").to_numpy().astype(float), got.column("w").to_numpy()
    row, col = np.repeat(np.arange(len(at)), [len(x) for x in at]), np.concatenate([np.zeros(0, np.int64), *at]).astype(np.int64)
    w = w / w.sum()
    rc = r[col]
    n_row = len(at)
    x, m, v = np.append(np.zeros(len(r)), np.log((w @ y) / (1 - w @ y))), np.zeros(len(r) + 1), np.zeros(len(r) + 1)
    for k in range(1, steps + 1):  # Adam's steps on all rows
        e = w * (1 / (1 + np.exp(-np.clip(x[-1] + np.bincount(row, rc * x[col], n_row), -30, 30))) - y)
        g = np.append(np.bincount(col, rc * e[row], len(r)) + l2 / n_row * x[:-1], e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (1 - k / (steps + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    beta, bias = x[:-1], float(x[-1])
    return Model(place, r * beta, bias)


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = FIT_ROWS_PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """(y, w, text) of the sample, and its rows by class.

    Held-out rows never enter. Only labels count whose document is there; of conflicting labels of a document the larger,
    and of several texts under one identifier the one with the largest hash. Without such labels there are no rows.
    """
    usable = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("y")).filter(~held_out(F.col("_id")))
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("_there")).agg(F.count("*").alias("copies"))
    there = cut(ids.join(usable, F.col("_there") == F.col("_id")).select("_id", "y", "copies"))
    n = {r["y"]: r["n"] for r in there.groupBy("y").agg(F.count("*").alias("n")).collect()}
    part = F.lit(0.0)
    for y, c in n.items():
        part = F.when(F.col("y") == y, F.lit(min(1.0, per_class / c))).otherwise(part)
    place = F.pmod(F.xxhash64(F.col("_id"), F.lit("fit")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = there.filter(place < part).withColumn("w", 1 / part)
    taken = {r["y"]: (r["n"], r["most"]) for r in chosen.groupBy("y").agg(F.count("*").alias("n"), F.max("copies").alias("most")).collect()}
    # About per_class rows of four numbers each: a bounded broadcast.
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    if any(most > 1 for _, most in taken.values()):
        own = own.groupBy("_id").agg(F.first("y").alias("y"), F.first("w").alias("w"), F.max(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("y", "w", "t.text")
    return own.select("y", "w", "text"), {y: c for y, (c, _) in taken.items()}


def held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string")), F.lit(0)) % 5 == 0


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score in [0, 1]. Null counts as empty; an empty text gets the score of no features."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB of places and KEPT weights, whatever the input

    def run(batches):
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t) for t in b.column(1).to_pylist()], pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, score double")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores below 0.5."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([m.score(t) < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, train_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """id, held_out, score, predicted for docs, learned from train_docs and labels."""
    model = fit(*training_rows(train_docs, labels))
    return score(docs, model).select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, docs, table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
