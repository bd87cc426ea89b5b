"""Grade decoders that keep a referral decision fixed, fitted on bounded histograms: boundaries by coordinate search, biases by class, cross-fitting.

Every search runs on counts by source and grade over candidate boundaries, or over the places where a candidate bias changes a
decision. They are one aggregate each and as large as the candidate grids, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Quantile levels of candidate boundaries, the grid of biases, the classes that get one.
LEVELS = np.linspace(0.01, 0.99, 150)
BIASES = np.arange(-12, 13) / 4
BIASED = (1, 3, 4)
PASSES = 2


def macro_f1(m: np.ndarray) -> float:
    """Of a matrix truth x call: the mean F1 over classes that occur on either side; nan without rows."""
    tp, rows, cols = np.diag(m), m.sum(1), m.sum(0)
    seen = rows + cols > 0
    return float((2 * tp[seen] / (rows + cols)[seen]).mean()) if seen.any() else float("nan")


def balanced_macro_f1(by_source: np.ndarray) -> float:
    """The mean of the sources' macro-F1."""
    values = [v for v in map(macro_f1, by_source) if v == v]
    return float(np.mean(values)) if values else float("nan")


def kappa(by_source: np.ndarray) -> float:
    """Quadratic weighted kappa of all sources together; nan where chance leaves no disagreement."""
    m = by_source.sum(0)
    w = np.subtract.outer(np.arange(5), np.arange(5)) ** 2 / 16
    chance = (w * np.outer(m.sum(1), m.sum(0))).sum() / max(m.sum(), 1)
    return float(1 - (w * m).sum() / chance) if chance else float("nan")


class Boundaries:
    """Counts (source, grade) by how many of the edges a score reaches."""

    def __init__(self, edges: Sequence[float], counts: np.ndarray):
        """counts: (sources, edges + 1, grades)."""
        self.edges = np.asarray(edges, float)
        self.below = np.concatenate([np.zeros((counts.shape[0], 1, 5)), counts.cumsum(1)], 1)  # below[:, k]: scores that reach fewer than k edges

    def matrices(self, at: Sequence[int]) -> np.ndarray:
        """(source, truth, call) if the boundaries are these edges."""
        stops = [0, *(k + 1 for k in at), self.below.shape[1] - 1]
        return np.stack([self.below[:, b] - self.below[:, a] for a, b in zip(stops, stops[1:], strict=False)], 2)

    def search(self, start: Sequence[float], candidates: Sequence[float], value: Callable[[np.ndarray], float]) -> tuple[list[float], float]:
        """The other boundaries around the second, which stays: each in turn takes the first best candidate between its neighbours, twice over."""
        place = {float(e): k for k, e in enumerate(self.edges)}
        now = [place[float(t)] for t in start]
        free = [place[float(c)] for c in candidates]
        best = value(self.matrices(now))
        for _ in range(PASSES):
            for i in (0, 2, 3):
                low, high = (self.edges[now[i - 1]] if i else 0.0), (self.edges[now[i + 1]] if i < 3 else 4.0)
                for c in free:
                    if low < self.edges[c] < high:
                        trial = [*now[:i], c, *now[i + 1 :]]
                        if (v := value(self.matrices(trial))) > best + 1e-12:
                            best, now = v, trial
        return [float(self.edges[k]) for k in now], best


def first_boundaries(referral: float) -> list[float]:
    """Where searches begin: halves and thirds around the referral boundary."""
    return [referral / 2, referral, referral + (4 - referral) / 3, referral + 2 * (4 - referral) / 3]


def bias_places(p: Column) -> list[Column]:
    """How many candidate biases turn each of the decisions 1 over 0, 3 over 2, 4 over 2, and how many differences of two biases turn 4 over 3."""
    z = F.transform(p, lambda x: F.ln(F.least(F.greatest(x, F.lit(1e-12)), F.lit(1.0))))
    gap = lambda a, b: F.round(z[a] - z[b], 9)
    steps = [float(b) for b in BIASES]
    wide = [k / 4 for k in range(-24, 25)]
    count = lambda d, grid: F.size(F.filter(F.array(*[F.lit(b) for b in grid]), lambda b: d + b > 0))
    return [count(gap(1, 0), steps), count(gap(3, 2), steps), count(gap(4, 2), steps), count(gap(4, 3), wide)]


class Biases:
    """Counts by source, grade, side of the referral boundary and bias_places()."""

    def __init__(self, rows: np.ndarray, sources: int):
        """rows: columns source, grade, referable, the four places, n."""
        self.rows, self.sources = rows.astype(int), sources

    def calls(self, bias: dict[int, float]) -> np.ndarray:
        _, _, ref, one, three, four, over, _ = self.rows.T
        on = lambda places, b, grid: places >= len(grid) - np.searchsorted(grid, b)  # noqa: E731  the bias is among the highest that turn the decision
        b1, b3, b4 = (bias[k] for k in BIASED)
        wide = np.arange(-24, 25) / 4
        three, four, over = on(three, b3, BIASES), on(four, b4, BIASES), on(over, b4 - b3, wide)
        high = np.where(four & (over | ~three), 4, np.where(three, 3, 2))
        return np.where(ref == 1, high, np.where(on(one, b1, BIASES), 1, 0))

    def matrices(self, bias: dict[int, float]) -> np.ndarray:
        out = np.zeros((self.sources, 5, 5))
        np.add.at(out, (self.rows[:, 0], self.rows[:, 1], self.calls(bias)), self.rows[:, 7])
        return out

    def search(self) -> tuple[dict[int, float], float]:
        """Biases of the classes 1, 3 and 4, each in turn the first best of the grid, twice over."""
        now = dict.fromkeys(BIASED, 0.0)
        best = balanced_macro_f1(self.matrices(now))
        for _ in range(PASSES):
            for k in BIASED:
                for b in BIASES.tolist():
                    trial = now | {k: b}
                    if (v := balanced_macro_f1(self.matrices(trial))) > best + 1e-12:
                        best, now = v, trial
        return now, best


def cross_fit(df: DataFrame, p: Column, score: str, truth: str, source: str, fold: str, policy: Sequence[float]) -> dict:
    """Decoders that differ in grades only, fitted on the other folds and called on their own.

    A: the policy's boundaries. A_cv: boundaries for kappa. B: the likeliest grade on the row's side of the referral boundary.
    C: the same with biases by class. E: boundaries for the mean of the sources' macro-F1. Returns {"matrices": {decoder:
    (source, truth, call)}, "sources": [...], "boundaries": {fold: ...}, "biases": {fold: ...}, "changes": {decoder: rows whose
    referral decision is another}}; a decoder that changes any is an error. Without rows everything is empty.
    """
    referral = float(policy[1])
    rows = df.select(F.col(source).alias("source"), F.col(fold).alias("fold"), F.col(score).alias("s"), F.col(truth).cast("int").alias("g"), F.array(*bias_places(p)).alias("b"))
    rows = cut(rows.groupBy("source", "fold", "s", "g", "b").agg(F.count("*").alias("n")))
    groups = rows.select("source", "fold").distinct().collect()  # sources x folds
    sources, folds = sorted({r["source"] for r in groups}), sorted({r["fold"] for r in groups})
    spark, start = df.sparkSession, first_boundaries(referral)
    if not folds:
        return {"matrices": {}, "sources": [], "boundaries": {}, "biases": {}, "changes": {}}
    for_fold = F.explode(F.array(*[F.lit(k) for k in folds])).alias("held")
    others = rows.select("*", for_fold).filter("held <> fold") if len(folds) > 1 else rows.select("*", for_fold)
    levels = {r["held"]: sorted({float(x) for x in r["q"]}) for r in others.groupBy("held").agg(F.percentile("s", [float(x) for x in LEVELS], F.col("n")).alias("q")).collect()}
    edges = {k: sorted({*q, *start, *map(float, policy)}) for k, q in levels.items()}
    kind = dict(rows.dtypes)["fold"]
    grid = F.broadcast(spark.createDataFrame([(k, e) for k, e in edges.items()], f"held {kind}, edges array<double>"))  # a row a fold
    binned = rows.select("*", for_fold).join(grid, "held").withColumn("e", F.size(F.filter("edges", lambda x: x <= F.col("s")))).withColumn("own", F.col("held") == F.col("fold"))
    at = {s: i for i, s in enumerate(sources)}
    hist = {(k, o): np.zeros((len(sources), len(edges[k]) + 1, 5)) for k in folds for o in (True, False)}
    for r in binned.groupBy("held", "own", "source", "e", "g").agg(F.sum("n").alias("n")).collect():  # folds x sources x edges x grades
        hist[r["held"], r["own"]][at[r["source"]], r["e"], r["g"]] = r["n"]
    places = rows.groupBy("fold", "source", "g", (F.col("s") >= referral).alias("ref"), "b").agg(F.sum("n").alias("n")).collect()  # bounded by the places
    table = {k: np.array([(at[r["source"]], r["g"], r["ref"], *r["b"], r["n"]) for r in places if r["fold"] == k]).reshape(-1, 8) for k in folds}
    matrices = {n: np.zeros((len(sources), 5, 5)) for n in ("A", "A_cv", "B", "C", "E")}
    boundaries, biases = {}, {}
    for k in folds:
        fit = Boundaries(edges[k], hist[k, False] if len(folds) > 1 else hist[k, True])
        own = Boundaries(edges[k], hist[k, True])
        place = {e: i for i, e in enumerate(edges[k])}
        call = lambda t: own.matrices([place[float(x)] for x in t])  # noqa: B023, E731
        kappa_cut, _ = fit.search(start, levels[k], kappa)
        f1_cut, _ = fit.search(start, levels[k], balanced_macro_f1)
        seen = Biases(np.concatenate([table[j] for j in folds if j != k or len(folds) == 1]), len(sources))
        bias, _ = seen.search()
        mine = Biases(table[k], len(sources))
        boundaries[k], biases[k] = {"A_cv": kappa_cut, "E": f1_cut}, bias
        for name, m in (("A", call(policy)), ("A_cv", call(kappa_cut)), ("B", mine.matrices(dict.fromkeys(BIASED, 0.0))), ("C", mine.matrices(bias)), ("E", call(f1_cut))):
            matrices[name] += m
    referable = np.zeros((len(sources), 5))
    for k in folds:
        for s, g, ref, *_, n in table[k].astype(int):
            referable[s, g] += ref * n
    changes = {n: int(np.abs(m[:, :, 2:].sum(2) - referable).sum()) for n, m in matrices.items()}
    if any(changes.values()):
        raise AssertionError(f"referral decisions changed: {changes}")
    return {"matrices": matrices, "sources": sources, "boundaries": boundaries, "biases": biases, "changes": changes}
