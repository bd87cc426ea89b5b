"""Operators on small examples with known answers."""

import io
import math
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import scalar as S
from cohortlens.operators import calibration, contracts, geometry, governance, graph, indexing, linking, metrics, models, policy, queueing, ranking, sampling, similarity
from cohortlens.plans.workflow import FIXTURES
from cohortlens.sources import archives, documents, sinks, tables


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_operating_points(spark):
    df = spark.createDataFrame([(t, s) for t, s in zip([0, 0, 0, 0, 0, 1, 1, 1, 1, 1], [0.1, 0.2, 0.3, 0.4, 0.55, 0.5, 0.6, 0.7, 0.8, 0.9], strict=True)], "t int, s double")
    roc = ranking.roc_table(ranking.score_table(df, F.col("t") == 1, "s"))
    assert one(ranking.sensitivity_at(roc, 1.0))["value"] == 0.8
    assert one(ranking.sensitivity_at(roc, 0.8))["value"] == 1.0
    assert one(ranking.specificity_at(roc, 1.0))["value"] == 0.8


def test_one_class_is_undefined(spark):
    df = spark.createDataFrame([(0.1,), (0.2,)], "s double")
    table = ranking.score_table(df, F.lit(True), "s")
    assert one(ranking.auc(table))["auc"] is None
    assert one(ranking.specificity_at(ranking.roc_table(table), 0.5))["value"] is None
    assert one(metrics.rates(df, F.lit(True), F.col("s") > 0.15))["specificity"] is None


def test_auc_is_the_share_of_ordered_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.random() < 0.4, round(rng.random(), 1)) for _ in range(200)]
    pos, neg = [s for t, s in rows if t], [s for t, s in rows if not t]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "t boolean, s double")
    assert math.isclose(one(ranking.auc(ranking.score_table(df, F.col("t"), "s")))["auc"], want)


#: A fixed value: counts of a 733-row confusion matrix with published results.
MATRIX = """
360,1,0,0,0
1,44,26,3,0
0,15,138,47,0
0,0,7,22,10
0,0,11,13,35
"""


def test_published_matrix(spark):
    rows = [(t, p, int(n)) for t, line in enumerate(MATRIX.strip().splitlines()) for p, n in enumerate(line.split(","))]
    m = spark.createDataFrame(rows, "truth int, pred int, n long")
    q = one(metrics.qwk(m))
    assert q["n"] == 733 and math.isclose(q["qwk"], 0.9297035745, abs_tol=1e-9)
    assert math.isclose(one(metrics.macro_f1(metrics.per_class(m)))["macro_f1"], 0.6808750113, abs_tol=1e-9)
    flat = m.filter("n > 0").select("truth", "pred", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    r = one(metrics.rates(flat, F.col("truth") >= 2, F.col("pred") >= 2))
    assert math.isclose(r["sensitivity"], 0.9496644295, abs_tol=1e-9) and math.isclose(r["specificity"], 0.9333333333, abs_tol=1e-9)
    a = one(metrics.agreement(flat, "truth", "pred"))
    assert math.isclose(a["accuracy"], 0.8171896317, abs_tol=1e-9) and math.isclose(a["mae"], 0.2019099591, abs_tol=1e-9)


def test_two_kappas_differ_where_a_grade_is_missing(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 3), (3, 1)], "t int, p int")
    fixed, seen = one(metrics.qwk(metrics.confusion(df, "t", "p")))["qwk"], one(metrics.qwk_observed(df, "t", "p"))["qwk"]
    assert math.isclose(fixed, seen)  # the weights' scale cancels ...
    assert one(metrics.qwk_observed(spark.createDataFrame([(2, 2)], "t int, p int"), "t", "p"))["qwk"] is None  # ... but one class has no range


def test_calibration_examples(spark):
    df = spark.range(100).select((F.col("id") % 2 == 0).alias("y"))
    for p, want in ((0.9, 0.4), (0.5, 0.0)):
        e = calibration.ece(calibration.bin_table(df, F.lit(p), F.col("y"), calibration.left_closed_bin(F.lit(p), 15), 15))
        assert math.isclose(one(e)["ece"], want, abs_tol=1e-9)
    assert one(df.agg(calibration.brier(F.lit(0.5), F.col("y")).alias("b")))["b"] == 0.25
    both = one(spark.range(1).select(calibration.left_closed_bin(F.lit(0.2), 5).alias("l"), calibration.right_closed_bin(F.lit(0.2), 5).alias("r"),
        calibration.right_closed_bin(F.lit(0.0), 5).alias("z"), calibration.left_closed_bin(F.lit(1.0), 5).alias("o")))
    assert tuple(both) == (1, 0, 0, 4)


def test_scalars(spark):
    p = F.array(*[F.lit(x) for x in (0.1, 0.2, 0.3, 0.25, 0.15)])
    row = one(spark.range(1).select(
        S.expected_grade(p).alias("e"), S.arg_max(p).alias("m"), S.restricted_arg_max(p,
            F.lit(False)).alias("low"), S.tail_probability(p).alias("t"), S.decode(F.lit(1.5), (0.5, 1.5, 2.5, 3.5)).alias("d"),
        S.sigmoid(F.lit(-800.0)).alias("s"), S.triage(F.lit(True), F.lit(True), F.lit(False)).alias("a"), S.triage(F.lit(False), F.lit(True),
            F.lit(False)).alias("b"), S.nearest_index(F.lit(0.26), (0.0, 0.25, 0.5)).alias("n"),
        S.crossed_threshold(F.lit(1.4), F.lit(2.6), (0.5, 1.5, 2.5, 3.5)).alias("c"), S.acceptance_probability(F.lit(0.1), F.lit(0.1), 2,
            F.lit(0.0)).alias("acc"), S.hamming(F.lit(0).cast("long"), F.lit(-1).cast("long")).alias("h"),
        S.ratio(F.lit(1), F.lit(0)).alias("r"), S.ratio_floor(F.lit(0),
            F.lit(0)).alias("rf"), S.finite(F.lit(float("nan"))).alias("nan"), F.array_sort(S.monotone_thresholds((0.5, 1.5, 2.5, 3.5),
            F.lit(2.7))).alias("mono"), S.monotone_thresholds((0.5, 1.5, 2.5, 3.5), F.lit(2.7)).alias("t4")))
    assert math.isclose(row["e"], 2.15) and (row["m"], row["low"], row["d"], row["n"], row["h"]) == (2, 1, 2, 1, 64)
    assert math.isclose(row["t"], 0.7) and row["s"] == 0.0 and (row["a"], row["b"]) == ("recapture", "uncertain_human_review")
    assert row["c"] == 1.5 and math.isclose(row["acc"], 0.999) and row["r"] is None and row["rf"] == 0 and row["nan"] is None and row["mono"] == row["t4"]


def test_text_helpers(spark):
    row = one(spark.range(1).select(S.utc_iso(F.lit("2026-01-02 03:04:05").cast("timestamp")).alias("t"),
        S.explanation_flags(F.lit(0.3), F.lit(0.05), F.lit(0.1)).alias("f"), S.explanation_flags(F.lit(0.1), F.lit(0.5), F.lit(0.1)).alias("n")))
    assert tuple(row) == ("2026-01-02T03:04:05Z", "border; off_field", "")


def test_contract(spark):
    df = spark.createDataFrame([(1.0, [0.5, 0.5]), (1.5, [0.5, 0.6]), (None, [1.0, 0.0])], "g double, p array<double>")
    got = {r["rule"]: r["violations"] for r in contracts.contract(df, contracts.rules_of_grades("g", "p")).collect()}
    assert got == {"grade": 2, "probabilities": 1}
    assert contracts.missing_columns(df, ["g", "x"]) == ["x"]
    assert contracts.ordinal_thresholds([0.5, 1.5, 2.5, 3.5]) and not contracts.ordinal_thresholds([0.5, 0.5, 2.5, 3.5])


def test_hamming_join(spark):
    bits = lambda *b: sum(1 << i for i in b)
    left = spark.createDataFrame([("a", 0), ("b", -1)], "a string, x long")
    right = spark.createDataFrame([("c", 0b1111), ("d", -0x5555555555555556), ("e", bits(0, 13, 26, 39))], "b string, y long")
    got = [tuple(r) for r in similarity.hamming_join(left, right, 7).orderBy("a", "b").collect()]
    assert got == [("a", "c", 4), ("a", "e", 4)]


def test_similar_pairs_and_top_k(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    dot = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)), 6)
    want = {(i, j) for i, a in rows for j, b in rows if i < j and dot(a, b) >= 4}
    got = [(r["a"], r["b"]) for r in similarity.similar_pairs(df, 4.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    top = similarity.top_k(df.filter("id < 3"), df, 4).collect()
    for q in range(3):
        best = sorted(((-dot(rows[q][1], v), i) for i, v in rows if i != q))[:4]
        assert [r["ref"] for r in sorted((r for r in top if r["query"] == q), key=lambda r: r["rank"])] == [i for _, i in best]


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(50, 51), (60, 60), (51, 50)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 51: 50}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    df = spark.createDataFrame([(1, "p", "x"), (2, "q", "x"), (3, "q", None), (4, "r", None)], "n long, g string, h string")
    assert {r["node"]: r["component"] for r in graph.shared_key_components(df, "n", ["g", "h"]).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_exclusions_come_in_order(spark):
    df = spark.createDataFrame([("h", 1, "train"), ("h", 2, "validation"), ("k", 1, "train"), ("k", 1, "validation"), ("z", 0, "train")], "h string, g int, split string")
    got = sorted((r["h"], r["split"], r["status"]) for r in linking.exclude_conflicts(df, "h", "g").collect())
    assert got == [("h", "train", "conflict"), ("h", "validation", "conflict"), ("k", "train", "leak"), ("k", "validation", "kept"), ("z", "train", "kept")]


def test_splits_keep_groups_whole(spark):
    df = spark.range(500).select("id", (F.col("id") % 60).alias("g"), F.lit("s").alias("src"))
    assert sampling.cluster_folds(df, "g", "src", 5, "x").groupBy("fold").count().select(F.max("count") - F.min("count")).first()[0] == 0
    assert sampling.carve(df, "g", "src", 0.1, "x").filter("held_out").count() == 6
    took = sampling.greedy_prefix(df, "g", "src", 100, "x").agg(F.sum("size"), F.max("size")).first()
    assert 100 <= took[0] < 100 + took[1]
    w = sampling.sampling_weights(df, "src", "g").agg(F.sum(F.col("weight") * F.col("n"))).first()[0]
    assert math.isclose(w, 1)


def test_dense_index(spark):
    df = spark.range(0, 5000, 7).select((F.col("id") * 31 % 5003).alias("k")).repartition(7)
    got = indexing.dense_index(df, "k").orderBy("k").collect()
    assert [r["idx"] for r in got] == list(range(len(got))) and [r["k"] for r in got] == sorted(r["k"] for r in got)
    assert indexing.dense_index(df.limit(0), "k").count() == 0


def test_queue(spark):
    df = spark.createDataFrame([(i, 0.0) for i in range(3)], "i long, t double").withColumn("k", F.lit(1))
    got = [tuple(r) for r in queueing.station(df, ["k"], "t", "i", F.lit(30.0), 2).orderBy("i").select("start", "finish").collect()]
    assert got == [(0, 30), (0, 30), (30, 60)]
    rng = random.Random(2)
    arrivals = sorted(rng.random() * 50 for _ in range(80))
    for c in (1, 3):
        free = [0.0] * c
        want = []
        for a in arrivals:
            j = free.index(min(free))
            want.append(max(a, free[j]))
            free[j] = want[-1] + 2.0
        q = queueing.station(spark.createDataFrame(list(enumerate(arrivals)), "i long, t double").withColumn("k", F.lit(1)), ["k"], "t", "i", F.lit(2.0), c)
        assert all(math.isclose(r["start"], w, abs_tol=1e-9) for r, w in zip(q.orderBy("i").collect(), want, strict=True))
        long = queueing.long_station(spark.createDataFrame(list(enumerate(arrivals)), "i long, t double").withColumn("k", F.lit(1)).repartition(4), ["k"], "t", "i", F.lit(2.0), c)
        assert all(math.isclose(r["start"], w, abs_tol=1e-9) for r, w in zip(long.orderBy("i").collect(), want, strict=True))
        waiting = max(max(0, i + 1 - sum(s <= a for s in want)) for i, a in enumerate(arrivals))
        assert one(queueing.max_waiting(q, ["k"], "t", "start"))["max_waiting"] == waiting


@pytest.mark.parametrize(("name", "settings", "want"), FIXTURES)
def test_retry_fixtures(name, settings, want):
    r = queueing.simulate(queueing.Workflow(**settings))
    assert tuple(r[k] for k in ("generated", "completed", "abandoned", "exhausted", "in_system", "attempts_started", "quality_checks", "recapture_returns")) == want
    if name == "cutoff_mid_recapture":
        assert r["recapture_pending"] == 1
    if name == "clinician_congestion":
        assert r["reviewed"] == 2 and r["review_wait"] == 7 and r["max_review_queue"] >= 7 and math.isclose(r["clinician_utilisation"], 0.9)


def test_boundary_and_rules(spark):
    df = spark.createDataFrame([(float(i), True) for i in range(20)] + [(0.5, False)], "s double, y boolean")
    r = one(policy.boundary(df, F.col("y"), "s", 0.9))
    assert r["n_pos"] == 20 and math.isclose(r["cut"], math.floor((1 - 0.9) * 20) - 1e-9)  # 1 - 0.9 is below a tenth
    rows = [("a", "R1", 0.80, 0.95), ("b", "R1", 0.70, 0.90), ("a", "R3", 0.82, 0.93), ("b", "R3", 0.70, 0.89), ("a", "R2", 0.99, 0.99), ("b", "R2", 0.99, 0.80)]
    rules = spark.createDataFrame(rows, "site string, rule string, p_both double, sensitivity double")
    pick = lambda df: one(policy.select_rule(df, ["R1", "R3", "R2"]))
    assert pick(rules)["rule"] == "R1" and pick(rules)["constrained"]  # R2 is too insensitive at b, R3 only 0.01 better
    assert pick(rules.filter("rule <> 'R1'"))["rule"] == "R3" and pick(rules.filter("rule = 'R2'"))["rule"] == "R2" and not pick(rules.filter("rule = 'R2'"))["constrained"]
    assert math.isclose(policy.clopper_pearson_upper(0, 50), 1 - 0.05 ** (1 / 50), abs_tol=1e-9)


def test_matching_and_suppression(spark):
    edges = spark.createDataFrame([(1, 1, 10), (1, 1, 11), (1, 2, 10), (1, 3, 10)], "image long, left long, right long")
    assert geometry.match_by_image(edges).count() == 2
    pts = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.9), (1, 2, 1.0, 0.0, 0.8), (1, 3, 20.0, 0.0, 0.7)], "image long, id long, x double, y double, score double")
    assert sorted(r["id"] for r in geometry.suppress(pts, 14.0, 10).collect()) == [1, 3]


def test_hit_trace_matches_a_fresh_matching_at_each_score():
    rng = random.Random(8)
    for _ in range(20):
        score = {a: rng.randint(0, 5) / 5 for a in range(12)}
        edges = sorted({(a, rng.randrange(8)) for a in range(12) for _ in range(2)})
        trace = geometry.hit_trace([(a, b, score[a]) for a, b in edges])
        assert trace == [(s, len(geometry.maximum_matching([e for e in edges if score[e[0]] >= s]))) for s in sorted({score[a] for a, _ in edges}, reverse=True)]


def test_predictions_are_isolated(spark):
    def model(rows):
        if any(r < 0 for r in rows):
            raise ValueError("negative")
        return [2 * r for r in rows]

    got = {r["id"]: (r["y"], r["status"]) for r in models.predict(spark.createDataFrame([(1, 1.0), (2, -1.0), (3, 3.0)], "id long, x double").coalesce(1), model).collect()}
    assert got == {1: (2.0, "success"), 2: (None, "error: negative"), 3: (6.0, "success")}


def test_governance(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k long, v double")
    lock, done = governance.freeze({"t": (df, "k")}, 7, 100), set()
    governance.evaluate_once(lock, {"t": (df.orderBy(F.col("k").desc()), "k")}, done)
    with pytest.raises(ValueError, match="evaluated"):
        governance.evaluate_once(lock, {"t": (df, "k")}, done)
    with pytest.raises(ValueError, match="changed"):
        governance.evaluate_once(lock, {"t": (df.withColumn("v", F.col("v") + 1), "k")}, set())
    assert governance.report_problems({"tier": "fresh", "statement": "s", "limitations": ["l"]}) == ["lock"]
    assert governance.is_reserved("/a/b/c", ["/a/b"]) and not governance.is_reserved("/a/bc", ["/a/b"])
    assert not governance.may_claim_fresh({"x": "locked"}, "x") and governance.exposed({}, "x", "locked") == {"x": "locked"}
    with pytest.raises(ValueError, match="locked"):
        governance.exposed({"x": "locked"}, "x", "development")


def test_archives(spark, tmp_path):
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w") as t:
        info = tarfile.TarInfo("deep/a.PNG")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("b.png", b"abc")
        z.writestr("labels.csv", b"secret")
        z.writestr("more.tar", inner.getvalue())
    a = archives.release(spark.read.format("binaryFile").load(str(tmp_path / "x.zip")), r"(?i)\.png$", "img_")
    assert sorted((r["member"], r["sealed"]) for r in a.collect()) == [("b.png", False), ("labels.csv", True), ("more.tar/deep/a.PNG", False)]
    assert one(archives.distinct_contents(a))["copies"] == 2
    with pytest.raises(ValueError, match="unsafe"):
        archives.safe("../x")


def test_tables_and_sinks(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("﻿ id ;name\n007;\n8;é\n".encode())
    rows = tables.text_csv(spark, str(tmp_path / "l.csv"), sep=";").collect()
    assert [tuple(r) for r in rows] == [("007", ""), ("8", "é")]
    (tmp_path / "n.txt").write_text("# c\n a \n\nb # d\n")
    assert [r["name"] for r in tables.name_list(spark, str(tmp_path / "n.txt")).collect()] == ["a", "b"]
    (tmp_path / "h.txt").write_text("x 1\ny 2\n")
    assert tables.csv(spark, str(tmp_path / "h.txt"), "a string, b int", sep=" ", header=False).count() == 2
    df = spark.range(3).withColumn("identity", F.lit("v"))
    sinks.published(df, str(tmp_path / "out"))
    with pytest.raises(FileExistsError):
        sinks.published(df, str(tmp_path / "out"))
    assert [r["id"] for r in sinks.resume(spark.range(5), str(tmp_path / "out"), "id", "v").orderBy("id").collect()] == [3, 4]
    with pytest.raises(ValueError, match="another run"):
        sinks.resume(spark.range(5), str(tmp_path / "out"), "id", "w")
    row = spark.range(1).select(F.struct(F.lit(1).alias("a"), F.struct(F.lit(2.5).alias("b")).alias("c")).alias("r"))
    assert [tuple(r) for r in documents.flatten(row).collect()] == [("r.a", 1.0), ("r.c.b", 2.5)]
