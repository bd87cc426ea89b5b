"""Queries that SQL can't express, each against a plain recomputation of its own result on the smallest tables."""

import collections
import hashlib
import heapq
import itertools
import math
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import models
from cohortlens.plans import catalogue, decisions
from cohortlens.plans.cohort import CASES, THRESHOLDS

SF = "/root/testdata/sf0.001"


def result(spark, name):
    return catalogue.QUERIES[name](spark, SF).collect()


def draw(tag, *key):
    return int(hashlib.md5("|".join([tag, *map(str, key)]).encode()).hexdigest()[:8], 16)


@pytest.fixture(scope="module")
def cohort():
    con = duckdb.connect()
    for t in ("orders", "customer", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = con.execute(CASES + " SELECT * FROM ok ORDER BY image_id").df()
    z = -((df.score.to_numpy()[:, None] - np.arange(5)) ** 2)
    e = np.exp(z - z.max(1, keepdims=True))
    return df, e / e.sum(1, keepdims=True)


def decode(score, t):
    return (score[:, None] >= np.asarray(t)[None, :]).sum(1)


def plain_matrix(y, c):
    m = np.zeros((5, 5))
    np.add.at(m, (y, c), 1)
    return m


def plain_f1(y, c):
    values = []
    for k in range(5):
        tp, a, b = ((y == k) & (c == k)).sum(), (y == k).sum(), (c == k).sum()
        if a + b:
            values.append(2 * tp / (a + b))
    return np.mean(values)


def balanced(y, c, source):
    return np.mean([plain_f1(y[source == s], c[source == s]) for s in np.unique(source)])


def plain_kappa(y, c):
    m, w = plain_matrix(y, c), np.subtract.outer(np.arange(5), np.arange(5)) ** 2
    return 1 - (w * m).sum() / (w * np.outer(m.sum(1), m.sum(0)) / m.sum()).sum()


def plain_boundaries(score, value):
    t = [0.75, 1.5, 1.5 + 2.5 / 3, 1.5 + 5 / 3]
    best = value(decode(score, t))
    for _ in range(2):
        for i in (0, 2, 3):
            low, high = (t[i - 1] if i else 0.0), (t[i + 1] if i < 3 else 4.0)
            for c in np.unique(np.quantile(score, np.linspace(0.01, 0.99, 150))):
                if low < c < high:
                    trial = [*t[:i], c, *t[i + 1 :]]
                    if (v := value(decode(score, trial))) > best + 1e-12:
                        best, t = v, trial
    return t


def side_call(p, ref, bias=(0, 0, 0)):
    z = np.log(np.clip(p, 1e-12, 1)).round(12)
    b = np.array([0, bias[0], 0, bias[1], bias[2]])
    gap = lambda i, j: np.round(z[:, i] - z[:, j], 9) + b[i] - b[j]
    three, four, over = gap(3, 2) > 0, gap(4, 2) > 0, gap(4, 3) > 0
    return np.where(ref, np.where(four & (over | ~three), 4, np.where(three, 3, 2)), np.where(gap(1, 0) > 0, 1, 0))


def plain_biases(p, ref, value):
    bias = [0.0, 0.0, 0.0]
    best = value(side_call(p, ref, bias))
    for _ in range(2):
        for i in range(3):
            for c in np.arange(-3, 3.01, 0.25):
                trial = [*bias[:i], c, *bias[i + 1 :]]
                if (v := value(side_call(p, ref, trial))) > best + 1e-12:
                    best, bias = v, trial
    return bias


def test_cross_fitted_decoders(spark, cohort):
    df, p = cohort
    score, y, source, ref = df.score.to_numpy(), df.true_grade.to_numpy(), df.source.to_numpy(), df.score.to_numpy() >= 1.5
    fold = np.array([draw("xf", g) % 10000 % 5 for g in df.group_id])
    calls = {n: np.zeros(len(df), int) for n in ("A", "A_cv", "B", "C", "E")}
    calls["A"], calls["B"] = decode(score, THRESHOLDS), side_call(p, ref)
    for k in range(5):
        a, b = fold != k, fold == k
        calls["A_cv"][b] = decode(score[b], plain_boundaries(score[a], lambda c: plain_kappa(y[a], c)))  # noqa: B023
        calls["E"][b] = decode(score[b], plain_boundaries(score[a], lambda c: balanced(y[a], c, source[a])))  # noqa: B023
        calls["C"][b] = side_call(p[b], ref[b], plain_biases(p[a], ref[a], lambda c: balanced(y[a], c, source[a])))  # noqa: B023
    got = {r["decoder"]: r for r in result(spark, "cross_fitted_decoders")}
    assert set(got) == set(calls)
    for n, c in calls.items():
        want = (len(y), np.mean(c == y), plain_f1(y, c), balanced(y, c, source), plain_kappa(y, c))
        assert np.allclose([got[n][x] for x in ("n", "accuracy", "macro_f1", "balanced_macro_f1", "qwk")], want, atol=2e-6), n
        assert got[n]["referral_changes"] == 0 == ((c >= 2) != ref).sum()


def test_threshold_search(spark, cohort):
    df, p = cohort
    score, y, source = df.score.to_numpy(), df.true_grade.to_numpy(), df.source.to_numpy()
    got = {r["objective"]: r for r in result(spark, "threshold_search")}
    for n, value in (("qwk", lambda c: plain_kappa(y, c)), ("balanced_macro_f1", lambda c: balanced(y, c, source))):
        t = plain_boundaries(score, value)
        assert np.allclose([got[n][f"t{i}"] for i in range(4)], t, atol=1e-9) and math.isclose(got[n]["value"], value(decode(score, t)), abs_tol=2e-6)
    bias = plain_biases(p, score >= 1.5, lambda c: balanced(y, c, source))
    assert [got["bias"][f"t{i}"] for i in (1, 2, 3)] == bias


def plain_logistic(x, y, c):
    mean, std = x.mean(0), x.std(0)
    std[std == 0] = 1
    z, w = np.hstack([(x - mean) / std, np.ones((len(x), 1))]), c * np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    b, ridge = np.zeros(z.shape[1]), np.append(np.ones(x.shape[1]), 0)
    for _ in range(60):
        q = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (w * q * (1 - q))[:, None]).T @ z + np.diag(ridge), z.T @ (w * (q - y)) + ridge * b)
    return lambda v: np.hstack([(v - mean) / std, np.ones((len(v), 1))]) @ b


def plain_auc(y, s, w=None):
    w = np.ones(len(y)) if w is None else w
    order = np.argsort(s, kind="stable")
    y, s, w = y[order], s[order], w[order]
    _, at = np.unique(s, return_inverse=True)
    pos, neg = np.bincount(at, w * y), np.bincount(at, w * (1 - y))
    return (pos * (np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum())


@pytest.fixture(scope="module")
def heads(spark):
    df = decisions.heads(spark, SF).orderBy("image_id").toPandas()
    return df, np.array(df.x.tolist())


def test_penalties_and_stacking(spark, heads):
    df, x = heads
    fold, got = df.fold.to_numpy(), collections.defaultdict(dict)
    for r in result(spark, "regularisation_choice"):
        got[r["head"]][r["penalty"]] = (r["auc"], r["chosen"])
    final = np.zeros((len(df), 3))
    for k, h in enumerate(decisions.HEADS):
        y, trials = df[h].to_numpy().astype(float), {}
        for c in decisions.PENALTIES:
            s = np.zeros(len(df))
            for f in range(5):
                s[fold == f] = plain_logistic(x[fold != f], y[fold != f], c)(x[fold == f])
            trials[c] = (plain_auc(y, s.round(9)), s)
            assert math.isclose(got[h][c][0], trials[c][0], abs_tol=2e-6)
        best = max(trials, key=lambda c: trials[c][0])
        assert [c for c, (_, chosen) in got[h].items() if chosen] == [best]
        final[:, k] = trials[best][1]
    y, s = df.ungradable.to_numpy().astype(float), np.zeros(len(df))
    for f in range(5):
        s[fold == f] = plain_logistic(final[fold != f], y[fold != f], 1.0)(final[fold == f])
    rows = {r["head"]: r for r in result(spark, "stacked_heads")}
    assert math.isclose(rows["final"]["auc"], plain_auc(y, s.round(9)), abs_tol=2e-6) and math.isclose(rows["final"]["cut"], np.quantile(s[y == 0], 0.95), abs_tol=1e-5)


def test_gains_by_site(spark, heads):
    df, x = heads
    source, y, score = df.source.to_numpy(), df.referable.to_numpy().astype(float), df.score.to_numpy()
    fused, alone = np.zeros(len(df)), np.zeros(len(df))
    for s in np.unique(source):
        a, b = source != s, source == s
        fused[b], alone[b] = plain_logistic(x[a], y[a], 1.0)(x[b]), plain_logistic(x[a][:, 1:], y[a], 1.0)(x[b][:, 1:])
    fused, alone = fused.round(6), alone.round(6)
    gains, above = [], 0
    for r in result(spark, "site_logreg"):
        b = source == r["site"]
        want = [plain_auc(y[b], v[b]) for v in (score, alone, fused)]
        assert r["n"] == b.sum() and np.allclose([r["score"], r["features"], r["fused"]], want, atol=2e-6)
        ids = sorted(set(df.group_id[b]), key=lambda g: (hashlib.md5(f"idx|{g}".encode()).hexdigest(), g))
        at = {g: i for i, g in enumerate(ids)}
        own, draws = np.array([at[g] for g in df.group_id[b]]), []
        for rep in range(decisions.REPLICATES):
            n = np.bincount([draw("gain", r["site"], rep, j) % len(ids) for j in range(len(ids))], minlength=len(ids))[own]
            if (n * y[b]).sum() and (n * (1 - y[b])).sum():
                draws.append(plain_auc(y[b], fused[b], n) - plain_auc(y[b], score[b], n))
        assert np.allclose([r["gain"], r["low"], r["high"]], [want[2] - want[0], *np.quantile(draws, [0.025, 0.975])], atol=3e-6)
        gains.append(r["gain"])
        above += r["low"] > 0
    rule = result(spark, "site_gain_rule")[0]
    assert math.isclose(rule["mean_gain"], np.mean(gains), abs_tol=2e-6) and rule["sites_above"] == above and rule["worst"] == min(gains)
    assert rule["success"] == (np.mean(gains) >= 0.010 and above >= 2 and min(gains) >= -0.005)


def test_nested_stacking(spark, heads):
    df, x = heads
    source, y, score, fx = df.source.to_numpy(), df.referable.to_numpy().astype(float), df.score.to_numpy(), x[:, 1:]
    rows = {r["site"]: r for r in result(spark, "nested_stacking")}
    for t in np.unique(source):
        test, oof = source == t, np.zeros(len(y))
        oof[test] = plain_logistic(fx[~test], y[~test], 0.05)(fx[test])
        for s in set(source) - {t}:
            inner = source == s
            oof[inner] = plain_logistic(fx[~test & ~inner], y[~test & ~inner], 0.05)(fx[inner])
        both = np.column_stack([score, oof])
        stack = plain_logistic(both[~test], y[~test], 1.0)(both[test])
        want = [plain_auc(y[test], v) for v in (score[test], oof[test].round(6), stack.round(6))]
        r = rows[t]
        assert r["n"] == test.sum() and np.allclose([r["score"], r["probe"], r["stack"], r["stack_gain"]], [*want, want[2] - want[0]],
            atol=3e-6) and r["probe_gains"] == (round(want[1] - want[0], 6) >= 0.02)


class PlainGuard:
    """Ledoit and Wolf's estimator from its definition, over single rows."""

    def __init__(self, x):
        n, k = x.shape
        self.mean = x.mean(0)
        c = x - self.mean
        cov = c.T @ c / n
        mu = np.trace(cov) / k
        d2 = np.sum((cov - mu * np.eye(k)) ** 2) / k
        b2 = min(sum(np.sum((np.outer(v, v) - cov) ** 2) for v in c) / k / n**2, d2)
        self.shrinkage = b2 / d2
        self.precision = np.linalg.inv(self.shrinkage * mu * np.eye(k) + (1 - self.shrinkage) * cov)

    def score(self, x):
        c = x - self.mean
        return np.sqrt(np.einsum("ij,jk,ik->i", c, self.precision, c))


def test_guards(spark):
    rows = duckdb.sql(f"SELECT label, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    label, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    guard = PlainGuard(x[label < 7])
    s = guard.score(x)
    cut = np.quantile(s[label < 7], 0.999)
    for r in result(spark, "mahalanobis_guard"):
        own = (label >= 7) == r["outside"]
        assert (r["n"], r["beyond"]) == (own.sum(), (s[own] > cut).sum()) and math.isclose(r["mean_distance"], s[own].mean(),
            abs_tol=1e-3) and math.isclose(r["shrinkage"], guard.shrinkage, abs_tol=2e-6)
    got, source, worst = {(r["margin"], r["source"]): r for r in result(spark, "guard_margin")}, label % 4, collections.defaultdict(float)
    for h in range(4):
        g = PlainGuard(x[source != h])
        q, own = np.quantile(g.score(x[source != h]), 0.999), g.score(x[source == h])
        for m in decisions.MARGINS:
            n = int((own > m * q).sum())
            assert (got[m, h]["n"], got[m, h]["rejected"]) == (len(own), n)
            worst[m] = max(worst[m], n / len(own))
    best = next((m for m in decisions.MARGINS if worst[m] <= decisions.LIMIT), decisions.MARGINS[-1])
    assert all(r["chosen"] == (m == best) and math.isclose(r["worst"], worst[m], abs_tol=2e-6) for (m, _), r in got.items())


def test_guard_without_rows_and_with_a_large_mean(spark):
    df = spark.createDataFrame([(i, [100.0 + (i * 7 % 5), 50.0 - i % 3, float(i % 4)]) for i in range(40)], "id long, v array<double>")
    none = models.Guard.fit(df.limit(0), "v")
    assert none.n == 0 and {r["distance"] for r in none.score(df, "v").collect()} == {None}
    x = np.array([r["v"] for r in df.collect()])
    assert math.isclose(models.Guard.fit(df, "v").shrinkage, PlainGuard(x).shrinkage, rel_tol=1e-9)


def test_logistic_with_one_class(spark):
    df = spark.createDataFrame([(i % 3, int(i % 3 == 0 and i % 2 == 0), [float(i), 1.0]) for i in range(30)], "g int, y int, x array<double>")
    fit = models.fit_logistic(df, "g", ["y"], "x", [0, 1, None], [1.0])
    assert fit.weights[0, 0, 1.0] is None and fit.weights[0, 1, 1.0] is not None
    out = fit.decision(df, "x", "g", 0, 1.0, "s").collect()
    assert all((r["s"] is None) == (r["g"] != 1) for r in out)


def test_balanced_folds_of_text_groups(spark):
    df = spark.createDataFrame([(f"g{i // 3}", i % 5) for i in range(900)] + [("solo", 4)], "g string, y int")
    out = models.balanced_group_folds(df, "g", "y", 5, "s")
    assert out.groupBy("g").agg(F.count_distinct("part").alias("n")).filter("n > 1").isEmpty()
    n = {(r["part"], r["y"]): r["count"] for r in out.groupBy("part", "y").count().collect()}
    assert len(n) == 15 and all(abs(n["selection", y] - n["calibration", y]) <= 6 and abs(n["fit", y] / 3 - n["selection", y]) <= 6 for y in range(5))


def largest_matching(edges):
    """Hopcroft and Karp's phases."""
    near, left, right = collections.defaultdict(list), {}, {}
    for a, b in edges:
        near[a].append(b)
    while True:
        level, queue, found = {a: 0 for a in near if a not in left}, collections.deque(a for a in near if a not in left), False
        while queue:
            a = queue.popleft()
            for b in near[a]:
                if b not in right:
                    found = True
                elif right[b] not in level:
                    level[right[b]] = level[a] + 1
                    queue.append(right[b])
        if not found:
            return len(left)

        def extend(a):
            for b in near[a]:
                o = right.get(b)
                if o is None or (level.get(o) == level[a] + 1 and extend(o)):  # noqa: B023
                    left[a], right[b] = b, a
                    return True
            level[a] = None  # noqa: B023
            return False

        for a in [a for a in near if a not in left]:
            extend(a)


def test_matchings(spark):
    rows = duckdb.sql(f"SELECT DISTINCT l_suppkey, l_partkey, l_orderkey % 50 FROM '{SF}/lineitem.parquet'").fetchall()
    edges, got = collections.defaultdict(list), collections.defaultdict(list)
    for i, a, b in rows:
        edges[i].append((a, b))
    for r in result(spark, "bipartite_match"):
        got[r["image"]].append((r["left"], r["right"]))
    assert set(got) == set(edges)
    for i, own in got.items():
        assert set(own) <= set(edges[i]) and len({a for a, _ in own}) == len({b for _, b in own}) == len(own) == largest_matching(edges[i])
    trace = collections.defaultdict(dict)
    for r in result(spark, "match_trace"):
        trace[r["image"]][r["score"]] = r["hits"]
    for i in itertools.islice(sorted(edges), 4):
        score = {a: draw("mt", i, a) % 10000 / 10000 for a, _ in edges[i]}
        assert set(trace[i]) == set(score.values())
        for s in sorted(set(score.values()))[:: max(1, len(score) // 6)]:
            assert trace[i][s] == largest_matching([(a, b) for a, b in edges[i] if score[a] >= s])


def test_suppression(spark):
    rows = duckdb.sql(f"SELECT user_id, event_id, value % 40, CAST((event_id * 7) % 100 AS DOUBLE), value FROM '{SF}/events.parquet'").fetchall()
    want = set()
    for image, own in itertools.groupby(sorted(rows, key=lambda r: (r[0], -r[4], r[1])), key=lambda r: r[0]):
        kept = []
        for _, i, x, y, s in own:
            if len(kept) < 300 and all((x - a) ** 2 + (y - b) ** 2 >= 25 for a, b in kept):
                kept.append((x, y))
                want.add((image, i, s))
    assert {(r["image"], r["id"], r["score"]) for r in result(spark, "nms")} == want


def plain_workflow(n, reject, abandon):
    """Patients' steps in order of time, each server as the time at which it is free."""
    horizon, service = 72.0 * n, {"acquire": 45.0, "recapture": 120.0, "upload": 56.0, "infer": 3.5, "review": 30.0}
    u = lambda *key: int(hashlib.md5("|".join(map(str, ("w", *key))).encode()).hexdigest()[:8], 16) % 10000 / 10000
    free, out, inside, waits = dict.fromkeys(service, 0.0), collections.Counter(), 0, []
    steps = [(72.0 * i, i, "acquire", i, 1) for i in range(n)]
    heapq.heapify(steps)
    tick = n
    while steps:
        t, _, where, who, attempt = heapq.heappop(steps)
        if t > horizon:
            inside += 1
            continue
        start = t if where == "recapture" else max(t, free[where])
        end = start + service[where]
        if where != "recapture":
            free[where] = end
        if where == "acquire":
            out["generated"] += attempt == 1
            out["attempts_started"] += start <= horizon
        if where == "review" and start <= horizon:
            waits.append(start - t)
        if end > horizon:
            inside += 1
            continue
        to = None
        if where == "acquire":
            out["quality_checks"] += 1
            if u("quality", who, attempt) >= reject:
                to = ("upload", attempt)
            elif attempt > 2:
                out["exhausted"] += 1
            elif u("abandon", who, attempt) < abandon:
                out["abandoned"] += 1
            else:
                to = ("recapture", attempt)
        elif where == "recapture":
            out["recapture_returns"] += 1
            to = ("acquire", attempt + 1)
        elif where == "upload":
            to = ("infer", attempt)
        elif where == "infer" and u("route", who) >= 1 - 0.08 - 0.0123:
            to = ("review", attempt)
        else:
            out["completed"] += 1
            out["reviewed"] += where == "review"
        if to:
            tick += 1
            heapq.heappush(steps, (end, tick, to[0], who, to[1]))
    return out, inside, waits


def test_retry_workflow(spark):
    n = duckdb.sql(f"SELECT count(*) FROM '{SF}/events.parquet'").fetchall()[0][0]
    got = {r["scenario"]: r for r in result(spark, "retry_workflow")}
    for i, (reject, abandon) in enumerate(itertools.product((0.05, 0.1, 0.2, 0.4), (0.0, 0.1, 0.3))):
        want, inside, waits = plain_workflow(n, reject, abandon)
        r = got[i]
        assert all(r[c] == want[c] for c in ("generated", "completed", "reviewed", "abandoned", "exhausted", "attempts_started", "quality_checks", "recapture_returns")), i
        assert r["in_system"] == inside == r["generated"] - r["completed"] - r["abandoned"] - r["exhausted"]
        assert math.isclose(r["review_wait"] or 0.0, np.mean(waits) if waits else 0.0, abs_tol=1e-9)


def test_conservation_holds(spark):
    assert all(r["holds"] and r["in_system"] >= 0 for r in result(spark, "conservation"))


def protobuf(number, value):
    """A field of a message: bytes, text or a whole number."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_session_scoring(spark):
    """A model file that multiplies rows by (1, 2), scored in sessions on the workers; a row of the wrong width is an error row."""
    tensor = lambda name, dims: protobuf(1, name) + protobuf(2, protobuf(1, protobuf(1, 1) + protobuf(2, b"".join(protobuf(1, d) for d in dims))))
    rows, fixed = protobuf(2, "n"), lambda k: protobuf(1, k)
    weights = protobuf(1, 2) + protobuf(1, 1) + protobuf(2, 1) + protobuf(8, "w") + protobuf(9, struct.pack("<2f", 1.0, 2.0))
    node = protobuf(1, "x") + protobuf(1, "w") + protobuf(2, "y") + protobuf(4, "MatMul")
    graph = protobuf(1, node) + protobuf(2, "g") + protobuf(5, weights) + protobuf(11, tensor("x", [rows, fixed(2)])) + protobuf(12, tensor("y", [rows, fixed(1)]))
    data = protobuf(1, 8) + protobuf(7, graph) + protobuf(8, protobuf(1, "") + protobuf(2, 13))
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 0.5]), (3, [1.0])], "id long, x array<double>").coalesce(1)
    got = {r["id"]: (r["y"], r["status"]) for r in models.predict_with(df, models.onnx_model(data)).collect()}
    assert got[1] == (5.0, "success") and got[2] == (4.0, "success") and got[3][0] is None and got[3][1].startswith("error")
