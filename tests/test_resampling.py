"""Draws in vectors against plain ones, and plans without a row by draw."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from cohortlens.functions.digests import leading32
from cohortlens.operators import resampling as B
from cohortlens.plans import catalogue

SF = "/root/testdata/sf0.001"
#: Queries whose draws were rows, which Spark took for few, and broadcast.
DRAWN = ["bootstrap_mean_by_site", "lesion_summary", "stratified_bootstrap_ci", "bootstrap_auc", "site_logreg", "site_gain_rule", "paired_bootstrap_ci", "cluster_bootstrap_ci", "reject_threshold"]


def plain32(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("before", ["", "boot|7|", "x" * 50, "y" * 61, "z" * 64, "ü|" * 65])
def test_digests(before):
    for lo, hi in ((0, 1200), (9_990, 10_020), (4_294_967_290, 4_294_967_300)):
        assert leading32(before.encode(), lo, hi).tolist() == [plain32(f"{before}{j}") for j in range(lo, hi)]


def test_sums_of_draws(spark, monkeypatch):
    """Several blocks and stretches, strata of far sizes, one of them null."""
    monkeypatch.setattr(B, "STRETCH", 7000)
    sizes = {"a": 20_000, None: 3, "c": 1}
    rows = [(s, f"{s}{i}", i % 7, i * 0.5) for s, n in sizes.items() for i in range(n)]
    c = B.placed_clusters(spark.createDataFrame(rows, "s string, g string, x long, y double"), "g", ["s"])
    got = {(r["s"], r["r"]): (r["x"], r["y"]) for r in B.stratum_sums(c, 3, "t", ["x", "y"], ["s"]).collect()}
    at = {(r["s"], r["idx"]): (r["x"], r["y"]) for r in c.collect()}
    want = {}
    for s, n in sizes.items():
        for r in range(3):
            before = f"t|{s}|{r}|" if s else f"t|{r}|"
            own = [at[s, plain32(f"{before}{j}") % n] for j in range(n)]
            want[s, r] = (sum(x for x, _ in own), sum(y for _, y in own))
    assert got == want and isinstance(got["a", 0][0], int)


def test_weights_of_half_bytes(spark, monkeypatch):
    """A cluster that is drawn 40 times in each replicate has three rows."""
    monkeypatch.setattr(B, "leading32", lambda before, start, stop: np.zeros(stop - start, np.int64))
    c = B.placed_clusters(spark.createDataFrame([(i,) for i in range(40)], "g long"), "g")
    rows = B.weight_vectors(c, "g", 3, "t").collect()
    assert [r["g"] for r in rows] == [0, 0, 0]
    total = Counter()
    for r in rows:
        total.update({i: r["w"][i // 2] >> 4 * (i % 2) & 15 for i in range(3)})
    assert total == {0: 40, 1: 40, 2: 40}


@pytest.mark.parametrize("name", DRAWN)
def test_no_row_by_draw(spark, name):
    """Rows made by draw went through joins whose size Spark took for that of a few rows."""
    assert "explode(sequence(_from" not in catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
