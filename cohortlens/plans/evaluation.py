"""Queries on grades, decisions, rankings and calibration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import calibration as C
from ..operators import metrics as M
from ..operators import ranking as R
from .cohort import CASES, PROBS, TEMPERATURE, cases, evaluated, head_probability, logits

QUERIES, SQL = {}, {}


def ref():
    return F.col("true_grade") >= 2


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def r6(c, name):
    return F.round(c, 6).alias(name)




@query(CASES + ", g AS (SELECT CAST(a.range AS INT) AS truth, CAST(b.range AS INT) AS pred FROM range(5) a, range(5) b) "
    "SELECT truth, g.pred AS pred, count(image_id) AS n FROM g LEFT JOIN ok ON true_grade = truth AND ok.pred = g.pred "
    "GROUP BY ALL")
def confusion_matrix(spark, d):
    return M.confusion(evaluated(spark, d), "true_grade", "pred")


_M = CASES + ", g AS (SELECT CAST(a.range AS INT) AS truth, CAST(b.range AS INT) AS pred FROM range(5) a, range(5) b), m AS (SELECT truth, g.pred AS pred, count(image_id) AS n FROM g LEFT JOIN ok ON true_grade = truth AND ok.pred = g.pred GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY truth) AS r, sum(n) OVER (PARTITION BY pred) AS c, sum(n) OVER () AS total FROM m)"


@query(_M + " SELECT CAST(sum(n) AS BIGINT) AS n, round(1 - sum((truth - pred) ** 2 / 16.0 * n) / sum((truth - pred) ** 2 / 16.0 * CAST(r AS DOUBLE) * c / total), 6) AS qwk "
    "FROM t")
def confusion_qwk(spark, d):
    return M.qwk(M.confusion(evaluated(spark, d), "true_grade", "pred")).select("n", r6("qwk", "qwk"))


@query(CASES + """, h AS (SELECT min(least(true_grade, pred)) AS lo, max(greatest(true_grade, pred)) AS hi, count(*) AS n FROM ok), t AS (SELECT true_grade AS t, count(*) AS r FROM ok GROUP BY 1), p AS (SELECT pred AS p, count(*) AS c FROM ok GROUP BY 1)
SELECT n, round(1 - (SELECT sum(power(true_grade - pred, 2) / power(hi - lo, 2)) FROM ok, h) * n / (SELECT sum(power(t - p, 2) / power(hi - lo, 2) * CAST(r AS DOUBLE) * c) FROM t, p, h), 6) AS qwk FROM h""")
def confusion_qwk_observed(spark, d):
    """Kappa over the range of grades that were seen."""
    return M.qwk_observed(evaluated(spark, d), "true_grade", "pred").select("n", r6("qwk", "qwk"))


_PER = _M + """, k AS (SELECT a.truth AS grade, max(a.r) AS support, max(b.c) AS called, max(CASE WHEN a.pred = a.truth THEN a.n END) AS tp, max(a.total) AS total FROM t a JOIN t b ON a.truth = b.pred GROUP BY 1),
q AS (SELECT grade, CAST(support AS BIGINT) AS support, tp / nullif(CAST(support AS DOUBLE), 0) AS recall, tp / nullif(CAST(called AS DOUBLE), 0) AS prec, (total - support - called + tp) / nullif(CAST(total - support AS DOUBLE), 0) AS spec, CASE WHEN support = 0 AND called = 0 THEN NULL ELSE coalesce(2.0 * tp / nullif(CAST(support + called AS DOUBLE), 0), 0) END AS f1 FROM k)"""


@query(_PER + " SELECT grade, support, round(recall, 6) AS recall, round(prec, 6) AS precision, round(spec, 6) AS specificity, round(f1, 6) AS f1 FROM q")
def per_grade_metrics(spark, d):
    return M.per_class(M.confusion(evaluated(spark, d), "true_grade", "pred")).select("grade", "support", *[r6(c, c) for c in ("recall", "precision", "specificity", "f1")])


@query(_PER + " SELECT round(avg(f1), 6) AS macro_f1 FROM q")
def macro_f1(spark, d):
    return M.macro_f1(M.per_class(M.confusion(evaluated(spark, d), "true_grade", "pred"))).select(r6("macro_f1", "macro_f1"))


@query(CASES + ", x AS (SELECT source, CAST(true_grade AS INT) AS grade, pred FROM ok), u AS (SELECT DISTINCT source, grade "
    "FROM (SELECT source, unnest([0,1,2,3,4]) AS grade FROM x)), k AS (SELECT u.source, u.grade, count(CASE WHEN x.grade = u.grade AND pred = u.grade THEN 1 END) AS tp, count(CASE WHEN x.grade = u.grade THEN 1 END) AS s, count(CASE WHEN pred = u.grade THEN 1 END) AS c "
    "FROM u JOIN x ON u.source = x.source GROUP BY 1, 2), f AS (SELECT source, avg(CASE WHEN s = 0 AND c = 0 THEN NULL ELSE coalesce(2.0 * tp / nullif(CAST(s + c AS DOUBLE), 0), 0) END) AS f "
    "FROM k GROUP BY 1) SELECT round(avg(f), 6) AS balanced_macro_f1, count(*) AS sources FROM f")
def source_balanced_macro_f1(spark, d):
    m = M.confusion(evaluated(spark, d), "true_grade", "pred", by=["source"])
    return M.macro_f1(M.per_class(m, ["source"]), ["source"]).agg(r6(F.avg("macro_f1"), "balanced_macro_f1"), F.count("*").alias("sources"))


_RATES = "count(*) FILTER (WHERE true_grade >= 2 AND pred >= 2) AS tp, count(*) FILTER (WHERE true_grade >= 2 AND pred < 2) AS fn, count(*) FILTER (WHERE true_grade < 2 AND pred < 2) AS tn, count(*) FILTER (WHERE true_grade < 2 AND pred >= 2) AS fp"
_RATIOS = ", ".join(f"round(CAST({a} AS DOUBLE) / nullif({b}, 0), 6) AS {n}" for n, a, b in (("sensitivity", "tp", "tp + fn"),
    ("specificity", "tn", "tn + fp"), ("ppv", "tp", "tp + fp"), ("npv", "tn", "tn + fn"), ("accuracy", "tp + tn", "tp + fn + tn + fp"),
    ("f1", "2 * tp", "2 * tp + fp + fn")))
_RN = ("sensitivity", "specificity", "ppv", "npv", "accuracy", "f1")


@query(CASES + f", k AS (SELECT source, {_RATES} FROM ok GROUP BY 1) SELECT source, tp, fn, tn, fp, {_RATIOS} FROM k")
def binary_rates_by_source(spark, d):
    return M.rates(evaluated(spark, d), ref(), F.col("pred") >= 2, ["source"]).select("source", "tp", "fn", "tn", "fp", *[r6(c, c) for c in _RN])


@query(CASES + f", k AS (SELECT source, camera, CAST(grouping(source, camera) AS BIGINT) AS level, {_RATES} "
    f"FROM ok GROUP BY GROUPING SETS ((source, camera), (source), ())) SELECT source, camera, level, tp, fn, tn, fp, CASE WHEN tp + fn + tn + fp < 50 OR tp + fn < 5 THEN 'too few' ELSE 'ok' END AS support, round(CASE WHEN tp + fn + tn + fp < 50 OR tp + fn < 5 THEN NULL ELSE CAST(tp AS DOUBLE) / nullif(tp + fn, 0) END, 6) AS sensitivity "
    f"FROM k")
def grouped_rates_grouping_sets(spark, d):
    evaluated(spark, d).select("source", "camera", ref().alias("t"), (F.col("pred") >= 2).alias("p")).createOrReplaceTempView("rated")
    k = spark.sql("SELECT source, camera, grouping_id(source, camera) AS level, count_if(t AND p) AS tp, count_if(t AND NOT p) AS fn, count_if(NOT t AND NOT p) AS tn, count_if(NOT t AND p) AS fp FROM rated GROUP BY GROUPING SETS ((source, camera), (source), ())")
    few = (F.col("tp") + F.col("fn") + F.col("tn") + F.col("fp") < 50) | (F.col("tp") + F.col("fn") < 5)
    return k.withColumns({"support": F.when(few, "too few").otherwise("ok"), "sensitivity": F.round(F.when(~few, S.ratio(F.col("tp"), F.col("tp") + F.col("fn"))), 6)})


@query(CASES + """ SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) FILTER (WHERE status = 'error') AS errors,
round(avg(CAST(status = 'success' AS DOUBLE)), 6) AS coverage, count(*) FILTER (WHERE status = 'success' AND pred < 2 AND NOT head) AS auto_clear, count(*) FILTER (WHERE status = 'success' AND pred < 2 AND NOT head AND true_grade >= 2) AS missed_referable,
count(*) FILTER (WHERE status = 'success' AND pred >= 2 AND head) AS referred, count(*) FILTER (WHERE status = 'success' AND (pred >= 2) <> head) AS disagreements, count(*) FILTER (WHERE status = 'success' AND (pred >= 2) = head AND pred = true_grade) AS concordant_correct,
round(CAST(count(*) FILTER (WHERE status = 'success' AND true_grade >= 2 AND (pred >= 2 OR head)) AS DOUBLE) / count(*) FILTER (WHERE true_grade >= 2), 6) AS cohort_sensitivity, round(CAST(count(*) FILTER (WHERE status = 'success' AND pred < 2 AND NOT head) AS DOUBLE) / count(*), 6) AS clear_rate FROM cases""")
def batch_aggregate(spark, d):
    row = M.batch_summary(cases(spark, d))
    return row.select(*[r6(c, c) if c in ("coverage", "cohort_sensitivity", "clear_rate") else c for c in row.columns])


@query(CASES + " SELECT source, count(*) AS n, round(avg(CAST(pred = true_grade AS DOUBLE)), 6) AS accuracy, round(avg(CAST(abs(true_grade - pred) AS DOUBLE)), 6) AS mae, round(avg(CAST(abs(true_grade - pred) <= 1 AS DOUBLE)), 6) AS within_one, count(*) FILTER (WHERE abs(true_grade - pred) >= 2) AS off_by_two "
    "FROM ok GROUP BY 1")
def agreement_by_source(spark, d):
    return M.agreement(evaluated(spark, d), "true_grade", "pred", ["source"]).select("source", "n", r6("accuracy", "accuracy"), r6("mae", "mae"),
        r6("within_one", "within_one"), "off_by_two")


@query(CASES + " SELECT CASE WHEN status = 'rejected' THEN 'recapture' WHEN (pred >= 2) <> head THEN 'uncertain_human_review' WHEN pred >= 2 THEN 'refer' ELSE 'auto_clear' END AS action, count(*) AS n, count(*) FILTER (WHERE true_grade >= 2) AS referable "
    "FROM cases WHERE status <> 'error' GROUP BY 1")
def triage_counts(spark, d):
    action = S.triage(F.col("status") == "rejected", F.col("pred") >= 2, F.col("head"))
    return cases(spark, d).filter("status <> 'error'").groupBy(action.alias("action")).agg(F.count("*").alias("n"), F.count_if(ref()).alias("referable"))


_AUC = """, st AS (SELECT source, score, count(*) FILTER (WHERE true_grade >= 2) AS pos, count(*) FILTER (WHERE true_grade < 2) AS neg FROM ok GROUP BY 1, 2),
rt AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER (PARTITION BY source) AS ap, sum(neg) OVER (PARTITION BY source) AS an, coalesce(sum(neg) OVER (PARTITION BY source ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM st WINDOW d AS (PARTITION BY source ORDER BY score DESC))"""


@query(CASES + _AUC + " SELECT source, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round(sum(pos * (below + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 6) AS auc "
    "FROM rt GROUP BY 1")
def roc_auc_by_source(spark, d):
    return R.auc(R.score_table(evaluated(spark, d), ref(), "score", ["source"]), ["source"]).select("source", "n_pos", "n_neg", r6("auc", "auc"))


@query(CASES + _AUC + " SELECT source, round(sum(CAST(pos AS DOUBLE) / ap * tp / (tp + fp)), 6) AS average_precision FROM rt GROUP BY 1")
def average_precision(spark, d):
    return R.average_precision(R.roc_table(R.score_table(evaluated(spark, d), ref(), "score", ["source"]), ["source"]), ["source"]).select("source",
        r6("average_precision", "average_precision"))


@query(CASES + _AUC + """ SELECT source, round(coalesce(max(CASE WHEN CAST(an - fp AS DOUBLE) / an >= CAST(0.9 AS DOUBLE) THEN CAST(tp AS DOUBLE) / ap END), 0), 6) AS sens_at_90, round(max(CASE WHEN CAST(tp AS DOUBLE) / ap >= CAST(0.9 AS DOUBLE) THEN CAST(an - fp AS DOUBLE) / an END), 6) AS spec_at_90,
round((coalesce(max(CASE WHEN CAST(an - fp AS DOUBLE) / an >= CAST(0.8 AS DOUBLE) THEN CAST(tp AS DOUBLE) / ap END), 0) + coalesce(max(CASE WHEN CAST(an - fp AS DOUBLE) / an >= CAST(0.85 AS DOUBLE) THEN CAST(tp AS DOUBLE) / ap END), 0) + coalesce(max(CASE WHEN CAST(an - fp AS DOUBLE) / an >= CAST(0.9 AS DOUBLE) THEN CAST(tp AS DOUBLE) / ap END), 0)) / 3, 6) AS selection_value FROM rt GROUP BY 1""")
def operating_points(spark, d):
    roc = R.roc_table(R.score_table(evaluated(spark, d), ref(), "score", ["source"]), ["source"])
    out = R.sensitivity_at(roc, 0.9, ["source"]).withColumnRenamed("value", "sens").join(R.specificity_at(roc, 0.9, ["source"]), "source").join(R.selection_value(roc, ["source"]), "source")
    return out.select("source", r6("sens", "sens_at_90"), r6("value", "spec_at_90"), r6("selection_value", "selection_value"))


@query(CASES + " SELECT round(avg(CAST(score < (SELECT quantile_cont(score, 0.1) FROM ok WHERE true_grade >= 2) AS DOUBLE)), 6) AS value FROM ok WHERE true_grade < 2")
def specificity_by_quantile(spark, d):
    return R.specificity_at_quantile(evaluated(spark, d), ref(), "score", 0.9).select(r6("value", "value"))


@query(CASES + _AUC + ", a AS (SELECT source, sum(pos * (below + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc "
    "FROM rt GROUP BY 1) SELECT count(*) AS sources, round(avg(auc), 6) AS mean_auc, round(min(auc), 6) AS worst_auc, min_by(source, auc) AS worst_source "
    "FROM a")
def mean_auc_over_sources(spark, d):
    a = R.auc(R.score_table(evaluated(spark, d), ref(), "score", ["source"]), ["source"])
    return a.agg(F.count("auc").alias("sources"), r6(F.avg("auc"), "mean_auc"), r6(F.min("auc"), "worst_auc"), F.min_by("source", "auc").alias("worst_source"))


_W = CASES + ", w AS (SELECT *, score / 4 AS p FROM ok)"


@query(_W + ", b AS (SELECT least(CAST(floor(p * 15) AS INT), 14) AS bin, count(*) AS n, avg(p) AS c, avg(CAST(true_grade >= 2 AS DOUBLE)) AS a "
    "FROM w GROUP BY 1) SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b")
def ece_left_closed(spark, d):
    p = F.col("score") / 4
    return C.ece(C.bin_table(evaluated(spark, d), p, ref(), C.left_closed_bin(p, 15), 15)).select(r6("ece", "ece"))


@query(_W + ", g AS (SELECT CAST(range AS INT) AS bin FROM range(15)), b AS (SELECT greatest(CAST(ceil(p * 15) AS INT) - 1, 0) AS bin, count(*) AS n, avg(p) AS c, avg(CAST(true_grade >= 2 AS DOUBLE)) AS a "
    "FROM w GROUP BY 1) SELECT g.bin, coalesce(n, 0) AS \"count\", round(c, 6) AS mean_confidence, round(a, 6) AS accuracy "
    "FROM g LEFT JOIN b ON g.bin = b.bin")
def reliability_bins(spark, d):
    p = F.col("score") / 4
    return C.bin_table(evaluated(spark, d), p, ref(), C.right_closed_bin(p, 15), 15).select("bin", "count", r6("mean_confidence", "mean_confidence"), r6("accuracy", "accuracy"))


_P = CASES + PROBS
_PL = "[p0, p1, p2, p3, p4]"


@query(_P + f", x AS (SELECT round(greatest(p0, p1, p2, p3, p4), 9) AS conf, CAST(list_position({_PL}, greatest(p0, p1, p2, p3, p4)) - 1 = true_grade AS DOUBLE) AS hit "
    f"FROM probs), b AS (SELECT least(CAST(floor(conf * 15) AS INT), 14) AS bin, count(*) AS n, avg(conf) AS c, avg(hit) AS a "
    f"FROM x GROUP BY 1) SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b")
def multiclass_ece(spark, d):
    p = S.grade_probabilities(logits())
    df = evaluated(spark, d).withColumn("p", p).select(F.round(F.array_max("p"), 9).alias("conf"), (S.arg_max(F.col("p")) == F.col("true_grade")).alias("hit"))
    return C.ece(C.bin_table(df, F.col("conf"), F.col("hit"), C.left_closed_bin(F.col("conf"), 15), 15)).select(r6("ece", "ece"))


@query(_P + f" SELECT source, count(*) AS n, round(avg((1 / (1 + exp(-z5)) - CAST(true_grade >= 2 AS DOUBLE)) ** 2), 6) AS brier, round(avg({' + '.join(f'(p{k} - CAST(true_grade = {k} AS DOUBLE)) ** 2' for k in range(5))}), 6) AS multiclass_brier, round(avg(-ln(greatest({_PL}[true_grade + 1], 1e-12))), 6) AS nll "
    f"FROM probs GROUP BY 1")
def brier_nll(spark, d):
    df = evaluated(spark, d).withColumn("p", S.grade_probabilities(logits()))
    return df.groupBy("source").agg(F.count("*").alias("n"), r6(C.brier(head_probability(), ref()), "brier"),
        r6(C.multiclass_brier(F.col("p"), F.col("true_grade")), "multiclass_brier"), r6(C.multiclass_nll(F.col("p"), F.col("true_grade")), "nll"))


@query(_P + f" SELECT true_grade, count(*) AS n, round(avg(p1 + 2 * p2 + 3 * p3 + 4 * p4), 6) AS expected, round(avg(p2 + p3 + p4), 6) AS tail, round(avg(1 - p0), 6) AS any_disease, round(avg(1 / (1 + exp(-z5))), 6) AS referral "
    f"FROM probs GROUP BY 1")
def expected_grade_from_logits(spark, d):
    df = evaluated(spark, d).withColumn("p", S.grade_probabilities(logits()))
    return df.groupBy("true_grade").agg(F.count("*").alias("n"), r6(F.avg(S.expected_grade(F.col("p"))), "expected"),
        r6(F.avg(S.tail_probability(F.col("p"))), "tail"), r6(F.avg(S.any_disease(F.col("p"))), "any_disease"), r6(F.avg(S.sigmoid_clipped(F.col("z5"))), "referral"))


def _temp(t):
    e = [f"exp(z{k} / CAST({t} AS DOUBLE))" for k in range(5)]
    return f"[{', '.join(e)}][true_grade + 1] / ({' + '.join(e)})"


_TEMPS = (0.25, 0.5, TEMPERATURE, 1.0, 2.0, 5.0)


@query(_P + ", n AS (" + " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS temperature, round(avg(-ln(greatest({_temp(t)}, 1e-12))), 6) AS nll "
    f"FROM probs" for t in _TEMPS) + ") SELECT temperature, nll, nll = (SELECT min(nll) FROM n) AS best "
    "FROM n")
def temperature_grid(spark, d):
    """All temperatures in one pass: an array of losses, exploded after the aggregate."""
    z = F.slice(logits(), 1, 5)
    losses = [r6(C.multiclass_nll(S.temperature_logits(z, t), F.col("true_grade")), f"t{i}") for i, t in enumerate(_TEMPS)]
    row = evaluated(spark, d).agg(*losses)
    flat = row.select(F.explode(F.array(*[F.struct(F.lit(t).alias("temperature"), F.col(f"t{i}").alias("nll")) for i, t in enumerate(_TEMPS)])).alias("x")).select("x.*")
    return flat.withColumn("best", F.col("nll") == F.min("nll").over(Window.partitionBy(F.lit(1))))  # one row a temperature


@query(_P + ", t AS (SELECT true_grade, " + ", ".join(f"exp(ln(greatest(p{k} / (p0 + p1 + p2 + p3 + p4), 1e-12)) / CAST({TEMPERATURE} AS DOUBLE)) AS a{k}, exp(ln(p{k} + 1e-10) / CAST({TEMPERATURE} AS DOUBLE)) AS b{k}" for k in range(5)) + " "
    "FROM probs) SELECT true_grade, round(avg((a1 + 2 * a2 + 3 * a3 + 4 * a4) / (a0 + a1 + a2 + a3 + a4)), 6) AS normalised, round(avg((b1 + 2 * b2 + 3 * b3 + 4 * b4) / (b0 + b1 + b2 + b3 + b4)), 6) AS shifted "
    "FROM t GROUP BY 1")
def temperature_of_probabilities(spark, d):
    df = evaluated(spark, d).withColumn("p", S.grade_probabilities(logits()))
    return df.groupBy("true_grade").agg(r6(F.avg(S.expected_grade(S.temperature_probabilities(F.col("p"), TEMPERATURE))), "normalised"),
        r6(F.avg(S.expected_grade(S.temperature_probabilities_shifted(F.col("p"), TEMPERATURE))), "shifted"))


_CONF = (0.0, 0.3, 0.5, 0.6, 0.7)


@query(_P + f", g AS (SELECT unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in _CONF)}]) AS threshold), "
    f"x AS (SELECT round({_PL}[pred + 1], 9) AS c, pred = true_grade AS ok FROM probs) SELECT threshold, count(*) FILTER (WHERE c >= threshold) AS accepted, round(avg(CAST(c >= threshold AS DOUBLE)), 6) AS coverage, round(CAST(count(*) FILTER (WHERE c >= threshold AND NOT x.ok) AS DOUBLE) / nullif(count(*) FILTER (WHERE c >= threshold), 0), 6) AS risk "
    f"FROM g, x GROUP BY 1")
def coverage_risk_curve(spark, d):
    conf = F.round(F.element_at(S.grade_probabilities(logits()), F.col("pred") + 1), 9)
    out = C.coverage_risk(evaluated(spark, d), conf, F.col("pred") == F.col("true_grade"), _CONF)
    return out.select("threshold", "accepted", r6("coverage", "coverage"), r6("risk", "risk"))


@query(CASES + """, v AS (SELECT 'grade' AS variant, true_grade, pred >= 2 AS called, FALSE AS abstain FROM ok UNION ALL SELECT 'grade_and_head', true_grade, pred >= 2, (pred >= 2) <> head FROM ok UNION ALL SELECT 'quality_gate', true_grade, pred >= 2, iqs < CAST(0.3 AS DOUBLE) OR (pred >= 2) <> head FROM ok)
SELECT variant, count(*) AS n, count(*) FILTER (WHERE NOT abstain) AS auto, count(*) FILTER (WHERE abstain AND true_grade >= 2) AS unresolved_referable, count(*) FILTER (WHERE abstain AND true_grade < 2) AS unresolved_other,
round(CAST(count(*) FILTER (WHERE NOT abstain AND called AND true_grade >= 2) AS DOUBLE) / nullif(count(*) FILTER (WHERE NOT abstain AND true_grade >= 2), 0), 6) AS sensitivity, round(CAST(count(*) FILTER (WHERE NOT abstain AND NOT called AND true_grade < 2) AS DOUBLE) / nullif(count(*) FILTER (WHERE NOT abstain AND true_grade < 2), 0), 6) AS specificity FROM v GROUP BY 1""")
def routing_ablation(spark, d):
    called = F.col("pred") >= 2
    split = called != F.col("head")
    variants = F.array(*[F.struct(F.lit(n).alias("variant"), a.alias("abstain")) for n, a in (("grade", F.lit(False)), ("grade_and_head", split),
        ("quality_gate", (F.col("iqs") < 0.3) | split))])
    v = evaluated(spark, d).select("true_grade", called.alias("called"), F.explode(variants).alias("v")).select("true_grade", "called", "v.*")
    auto, bad, c = ~F.col("abstain"), ref(), F.col("called")
    return v.groupBy("variant").agg(F.count("*").alias("n"), F.count_if(auto).alias("auto"), F.count_if(~auto & bad).alias("unresolved_referable"),
        F.count_if(~auto & ~bad).alias("unresolved_other"), r6(S.ratio(F.count_if(auto & c & bad), F.count_if(auto & bad)), "sensitivity"),
        r6(S.ratio(F.count_if(auto & ~c & ~bad), F.count_if(auto & ~bad)), "specificity"))


_Z = 1.959963984540054


@query(CASES + f", k AS (SELECT source, {_RATES} FROM ok GROUP BY 1), w AS (SELECT source, tp, tp + fn AS n, CAST(tp AS DOUBLE) / (tp + fn) AS p "
    f"FROM k) SELECT source, n, round(p, 6) AS sensitivity, round((p + {_Z}**2 / (2 * n)) / (1 + {_Z}**2 / n) - {_Z} * sqrt(p * (1 - p) / n + {_Z}**2 / (4.0 * n * n)) / (1 + {_Z}**2 / n), 6) AS low, round((p + {_Z}**2 / (2 * n)) / (1 + {_Z}**2 / n) + {_Z} * sqrt(p * (1 - p) / n + {_Z}**2 / (4.0 * n * n)) / (1 + {_Z}**2 / n), 6) AS high "
    f"FROM w")
def wilson_by_site(spark, d):
    k = M.verification(M.rates(evaluated(spark, d), ref(), F.col("pred") >= 2, ["source"]), 0.85, 0.8)
    return k.select("source", (F.col("tp") + F.col("fn")).alias("n"), r6("sensitivity", "sensitivity"), r6("sens_low", "low"), r6("sens_high", "high"))


@query(CASES + f", k AS (SELECT source, {_RATES} FROM ok GROUP BY 1) SELECT source, CAST(tp AS DOUBLE) / (tp + fn) >= CAST(0.85 AS DOUBLE) AND CAST(tn AS DOUBLE) / (tn + fp) >= CAST(0.8 AS DOUBLE) AS passes, CASE WHEN tp + fn < 5 THEN 'refused' WHEN tp + fn < 40 OR tp + fn + tn + fp < 150 THEN 'warned' ELSE 'ok' END AS support "
    f"FROM k")
def verification_flags(spark, d):
    k = M.verification(M.rates(evaluated(spark, d), ref(), F.col("pred") >= 2, ["source"]), 0.85, 0.8)
    pos, n = F.col("tp") + F.col("fn"), F.col("tp") + F.col("fn") + F.col("tn") + F.col("fp")
    return k.select("source", "passes", F.when(pos < 5, "refused").when((pos < 40) | (n < 150), "warned").otherwise("ok").alias("support"))


@query(CASES + ", r AS (SELECT source, rank() OVER (PARTITION BY source ORDER BY score) + (count(*) OVER (PARTITION BY source, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY source ORDER BY second) + (count(*) OVER (PARTITION BY source, second) - 1) / 2.0 AS b "
    "FROM ok) SELECT source, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1")
def spearman(spark, d):
    return R.spearman(evaluated(spark, d), "score", "second", ["source"]).select("source", "n", r6("rho", "rho"))


_Q = (0.1, 0.5, 0.9, 0.95, 0.99, 0.999)


@query(CASES + " SELECT true_grade >= 2 AS referable, count(*) AS n, round(avg(score), 6) AS mean, " + ", ".join(f"round(quantile_cont(score, {q}), 6) AS p{i}" for i, q in enumerate(_Q)) + " "
    "FROM ok GROUP BY 1")
def score_percentiles(spark, d):
    g = evaluated(spark, d).groupBy(ref().alias("referable")).agg(F.count("*").alias("n"), r6(F.avg("score"), "mean"), F.percentile("score", list(_Q)).alias("q"))
    return g.select("referable", "n", "mean", *[F.round(F.col("q")[i], 6).alias(f"p{i}") for i in range(len(_Q))])


@query(CASES + " SELECT true_grade, count(*) AS n, round(avg(score), 6) AS score_mean, round(median(score), 6) AS score_median, round(avg(iqs), 6) AS iqs_mean, round(median(iqs), 6) AS iqs_median "
    "FROM ok GROUP BY 1")
def median_by_grade(spark, d):
    """Mean and median of several columns, with flattened names."""
    return evaluated(spark, d).groupBy("true_grade").agg(F.count("*").alias("n"), *[r6(f(c), f"{c}_{n}") for c in ("score", "iqs") for n, f in (("mean", F.avg), ("median", F.median))])


@query(CASES + " SELECT source, count(*) AS n, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.95), 6) AS p95, round(max(d), 6) AS max "
    "FROM (SELECT source, abs(score - second) AS d FROM ok) GROUP BY 1")
def difference_statistics(spark, d):
    diff = F.abs(F.col("score") - F.col("second"))
    return evaluated(spark, d).groupBy("source").agg(F.count("*").alias("n"), r6(F.avg(diff), "mean"), r6(F.percentile(diff, F.lit(0.95)), "p95"), r6(F.max(diff), "max"))


@query(CASES + ", h AS (SELECT camera, true_grade >= 2 AS pos, least(CAST(floor(score / 4 * 1000) AS BIGINT), 999) AS bin, count(*) AS n "
    "FROM ok GROUP BY ALL), t AS (SELECT camera, bin, sum(CASE WHEN pos THEN n ELSE 0 END) AS p, sum(CASE WHEN pos THEN 0 ELSE n END) AS q "
    "FROM h GROUP BY 1, 2), c AS (SELECT camera, bin, p, q, sum(p) OVER d AS tp, sum(q) OVER d AS fp, sum(p) OVER (PARTITION BY camera) AS ap, sum(q) OVER (PARTITION BY camera) AS an "
    "FROM t WINDOW d AS (PARTITION BY camera ORDER BY bin DESC)), x AS (SELECT *, 2.0 * tp / (ap + tp + fp) AS dice "
    "FROM c) SELECT camera, round(sum(CAST(p AS DOUBLE) / ap * tp / (tp + fp)), 6) AS aupr, round(sum(CAST(p AS DOUBLE) / ap * (an - fp + q / 2.0) / an), 6) AS auc, max_by(bin, (round(dice, 9), -bin)) AS best_bin, round(max(dice), 6) AS best_dice, round(max(CAST(tp AS DOUBLE) / (ap + fp)), 6) AS best_iou "
    "FROM x GROUP BY 1")
def histogram_auc_dice(spark, d):
    """All from 1000-bin histograms by class, which add up over images and partitions."""
    from ..operators.histograms import best_dice, histogram, histogram_ranking

    h = histogram(evaluated(spark, d), ref(), F.col("score") / 4, ["camera"])
    return histogram_ranking(h, ["camera"]).join(best_dice(h, ["camera"]), "camera").select("camera", r6("aupr", "aupr"), r6("auc", "auc"),
        "best_bin", r6("best_dice", "best_dice"), r6("best_iou", "best_iou"))


@query(CASES + " SELECT source, count(*) FILTER (WHERE pred = 0) AS called_0, round(avg(CASE WHEN true_grade = 0 THEN CAST(pred = 0 AS DOUBLE) END), 6) AS recall_0, round(coalesce(CAST(count(*) FILTER (WHERE pred = 9) AS DOUBLE) / nullif(count(*) FILTER (WHERE pred = 9), 0), 0), 6) AS precision_9, round(CAST(count(*) FILTER (WHERE pred = 9) AS DOUBLE) / greatest(count(*) FILTER (WHERE pred = 9), 1), 6) AS floor_9 "
    "FROM ok GROUP BY 1")
def zero_division_variants(spark, d):
    """Three conventions for an empty denominator, side by side: a class that is never called."""
    never = F.count_if(F.col("pred") == 9)
    return evaluated(spark, d).groupBy("source").agg(F.count_if(F.col("pred") == 0).alias("called_0"),
        r6(S.ratio(F.count_if((F.col("true_grade") == 0) & (F.col("pred") == 0)), F.count_if(F.col("true_grade") == 0)), "recall_0"),
        r6(S.ratio_zero(never, never), "precision_9"), r6(S.ratio_floor(never, never), "floor_9"))


@query(CASES + " SELECT true_grade, CASE WHEN iqs < CAST(0.3 AS DOUBLE) THEN 'reject' WHEN iqs < CAST(0.7 AS DOUBLE) THEN 'usable' ELSE 'good' END AS quality, count(*) AS n, round(avg(CAST(pred = true_grade AS DOUBLE)), 6) AS accuracy "
    "FROM ok GROUP BY 1, 2")
def retention_by_quality(spark, d):
    return evaluated(spark, d).groupBy("true_grade", S.cut_classes(F.col("iqs"), 0.3, 0.7).alias("quality")).agg(F.count("*").alias("n"),
        r6(F.avg((F.col("pred") == F.col("true_grade")).cast("double")), "accuracy"))


@query(CASES + " SELECT source, count(*) AS images, count(DISTINCT group_id) AS patients, max(worst) AS worst, count(*) FILTER (WHERE worst >= 2) AS images_of_referable "
    "FROM (SELECT source, group_id, max(true_grade) OVER (PARTITION BY source, group_id) AS worst "
    "FROM ok) GROUP BY 1")
def worst_grade_per_patient(spark, d):
    g = evaluated(spark, d).groupBy("source", "group_id").agg(F.count("*").alias("n"), F.max("true_grade").alias("worst"))
    return g.groupBy("source").agg(F.sum("n").alias("images"), F.count("*").alias("patients"), F.max("worst").alias("worst"),
        F.sum(F.when(F.col("worst") >= 2, F.col("n")).otherwise(0)).alias("images_of_referable"))


@query(_P + ", x AS (SELECT true_grade, pred, CASE WHEN head THEN CASE WHEN round(p4, 9) > round(greatest(p2, p3), 9) THEN 4 WHEN round(p3, 9) > round(p2, 9) THEN 3 ELSE 2 END ELSE CASE WHEN round(p1, 9) > round(p0, 9) THEN 1 ELSE 0 END END AS g "
    "FROM probs) SELECT CAST(g AS INT) AS grade, count(*) AS n, count(*) FILTER (WHERE g = true_grade) AS correct, count(*) FILTER (WHERE g <> pred) AS changed "
    "FROM x GROUP BY 1")
def restricted_arg_max(spark, d):
    p = F.transform(S.grade_probabilities(logits()), lambda v: F.round(v, 9))
    df = evaluated(spark, d).select("true_grade", "pred", S.restricted_arg_max(p, F.col("head")).alias("grade"))
    return df.groupBy("grade").agg(F.count("*").alias("n"), F.count_if(F.col("grade") == F.col("true_grade")).alias("correct"), F.count_if(F.col("grade") != F.col("pred")).alias("changed"))


@query(CASES + ", e AS (SELECT true_grade, (score + second) / 2 AS s, (z5 + y5) / 2 AS z FROM ok) "
    "SELECT true_grade, count(*) AS n, round(avg(s), 6) AS score, round(avg(z), 6) AS referral, round(avg(ln(greatest(least(s / 4, 1 - 1e-6), 1e-6) / (1 - greatest(least(s / 4, 1 - 1e-6), 1e-6)))), 6) AS log_odds "
    "FROM e GROUP BY 1")
def ensemble_mean(spark, d):
    """Two models' aligned vectors averaged by key, and log-odds of the clipped score."""
    both = evaluated(spark, d).withColumn("v", F.zip_with(F.array("score", "z5"), F.array("second", "y5"), lambda a, b: (a + b) / 2))
    return both.groupBy("true_grade").agg(F.count("*").alias("n"), r6(F.avg(F.col("v")[0]), "score"), r6(F.avg(F.col("v")[1]), "referral"),
        r6(F.avg(S.log_odds(F.col("v")[0] / 4)), "log_odds"))


@query(CASES + " SELECT CASE WHEN iqs < CAST(0.5 AS DOUBLE) THEN CASE WHEN iqs < CAST(0.3 AS DOUBLE) THEN 'refocus; add light' ELSE 'refocus' END ELSE '' END AS advice, count(*) AS n, round(avg(0.40 * iqs + 0.35 * score / 4 + 0.25), 6) AS quality "
    "FROM ok GROUP BY 1")
def quality_feedback(spark, d):
    advice = S.feedback([(F.col("iqs") < 0.5, "refocus"), (F.col("iqs") < 0.3, "add light")])
    return evaluated(spark, d).groupBy(advice.alias("advice")).agg(F.count("*").alias("n"), r6(F.avg(S.quality_index(F.col("iqs"), F.col("score") / 4, F.lit(1.0))), "quality"))


@query(CASES + " SELECT 'A' AS model, count(*) AS n, count(*) FILTER (WHERE pred = true_grade) AS correct, count(*) FILTER (WHERE (pred >= 2) = (true_grade >= 2)) AS referral_correct "
    "FROM ok UNION ALL SELECT 'B', count(*), count(*) FILTER (WHERE pred2 = true_grade), count(*) FILTER (WHERE (pred2 >= 2) = (true_grade >= 2)) "
    "FROM ok UNION ALL SELECT 'both', count(*), count(*) FILTER (WHERE pred2 = true_grade AND pred = true_grade), count(*) FILTER (WHERE (pred2 >= 2) = (true_grade >= 2) AND (pred >= 2) = (true_grade >= 2)) "
    "FROM ok")
def decision_comparison(spark, d):
    a, b, t = F.col("pred"), F.col("pred2"), F.col("true_grade")
    ra, rb = (a >= 2) == (t >= 2), (b >= 2) == (t >= 2)
    row = evaluated(spark, d).agg(F.array(*[F.struct(F.lit(n).alias("model"), F.count("*").alias("n"), F.count_if(x).alias("correct"),
        F.count_if(y).alias("referral_correct")) for n, x, y in (("A", a == t, ra), ("B", b == t, rb), ("both", (a == t) & (b == t), ra & rb))]).alias("x"))
    return row.select(F.explode("x").alias("x")).select("x.*")


