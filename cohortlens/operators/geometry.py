"""Sequential operators on small groups: matching and suppression, one image at a time."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship


def maximum_matching(edges: list[tuple]) -> dict:
    """A largest set of edges without a common end, as right -> left, by augmenting paths."""
    near = defaultdict(list)
    for a, b in sorted(edges):
        near[a].append(b)
    match: dict = {}

    def augment(a, seen) -> bool:
        for b in near[a]:
            if b not in seen:
                seen.add(b)
                if b not in match or augment(match[b], seen):
                    match[b] = a
                    return True
        return False

    for a in list(near):
        augment(a, set())
    return match


def match_by_image(edges: DataFrame) -> DataFrame:
    """(image, left, right) of a maximum one-to-one matching of edges (image, left, right)."""
    ship(edges.sparkSession)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        m = maximum_matching(list(zip(g["left"], g["right"], strict=True)))
        return pd.DataFrame({"image": g["image"].iloc[0], "left": list(m.values()), "right": list(m)})

    return edges.groupBy("image").applyInPandas(run, "image long, left long, right long")


def hit_trace(edges: list[tuple]) -> list[tuple[float, int]]:
    """(score, hits) of edges (left, right, score): the size of the largest matching among lefts of that score and above, after each distinct score. Each left in turn looks for one augmenting path, so the whole trace costs one matching."""
    near: dict = defaultdict(list)
    score: dict = {}
    for a, b, s in edges:
        near[a].append(b)
        score[a] = s
    match: dict = {}

    def augment(a, seen) -> bool:
        for b in near[a]:
            if b not in seen:
                seen.add(b)
                if b not in match or augment(match[b], seen):
                    match[b] = a
                    return True
        return False

    out: list[tuple[float, int]] = []
    hits = 0
    for a in sorted(near, key=lambda a: (-score[a], a)):
        hits += augment(a, set())
        if out and out[-1][0] == score[a]:
            out[-1] = (score[a], hits)
        else:
            out.append((score[a], hits))
    return out


def trace_by_image(edges: DataFrame) -> DataFrame:
    """(image, score, hits) for edges (image, left, right, score)."""
    ship(edges.sparkSession)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows = hit_trace(list(zip(g["left"], g["right"], g["score"], strict=True)))
        return pd.DataFrame({"image": g["image"].iloc[0], "score": [s for s, _ in rows], "hits": [h for _, h in rows]})

    return edges.groupBy("image").applyInPandas(run, "image long, score double, hits long")


def suppress(points: DataFrame, spacing: float, most: int) -> DataFrame:
    """(image, id, score) of points (image, id, x, y, score) that are kept, best first: none within spacing of a better kept one, at most so many an image. Kept points are looked up by grid cell."""
    ship(points.sparkSession)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        cells, kept = defaultdict(list), []
        for p in g.sort_values(["score", "id"], ascending=[False, True]).itertuples(index=False):
            cx, cy = int(p.x // spacing), int(p.y // spacing)
            if all((p.x - x) ** 2 + (p.y - y) ** 2 >= spacing**2 for i in (-1, 0, 1) for j in (-1, 0, 1) for x, y in cells[cx + i, cy + j]):
                cells[cx, cy].append((p.x, p.y))
                kept.append((p.image, p.id, p.score))
                if len(kept) == most:
                    break
        return pd.DataFrame(kept, columns=["image", "id", "score"])

    return points.groupBy("image").applyInPandas(run, "image long, id long, score double")
