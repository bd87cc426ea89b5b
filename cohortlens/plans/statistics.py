"""Queries on resampling, thresholds, parity, chunk merges and small models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import geometry as G
from ..operators import metrics as M
from ..operators import policy as P
from ..operators import ranking as R
from ..operators import resampling as B
from .cohort import CASES, THRESHOLDS, cases, evaluated, logits, read, sql_draw

QUERIES, SQL = {}, {}
REPLICATES = 200
#: Each rule's target and whether a frozen cut that passes is kept; the order of preference; the targets on the other rows.
RULES = {"R1": (0.92, False), "R2": (0.95, False), "R3": (0.92, True), "R4": (0.95, True)}
PREFERENCE = ("R1", "R3", "R2", "R4")
BOTH = (0.90, 0.85)
DRAWS, SAMPLE = 200, 200


def ref():
    return F.col("true_grade") >= 2


def call():
    return F.col("pred") >= 2


def call2():
    return F.col("pred2") >= 2


def query(sql: str | None = None, queries: dict | None = None, sqls: dict | None = None):
    """Registers a query, here or in another module's tables, with its SQL."""

    def add(f):
        (QUERIES if queries is None else queries)[f.__name__] = f
        if sql:
            (SQL if sqls is None else sqls)[f.__name__] = sql
        return f

    return add


def r6(c, name):
    return F.round(c, 6).alias(name)


def sql_draw32(tag: str, key: str) -> str:
    return f"CAST(CAST(concat('0x', substr(md5(concat_ws('|', '{tag}', {key})), 1, 8)) AS UBIGINT) AS BIGINT)"


def counts():
    return {"pos": ref(), "neg": ~ref(), "tp": ref() & call(), "tn": ~ref() & ~call(), "tp2": ref() & call2(), "tn2": ~ref() & ~call2(),
        "ok": F.col("pred") == F.col("true_grade"), "n": F.lit(True)}

_SQLC = "count(*) FILTER (WHERE true_grade >= 2) AS pos, count(*) FILTER (WHERE true_grade < 2) AS neg, count(*) FILTER (WHERE true_grade >= 2 AND pred >= 2) AS tp, count(*) FILTER (WHERE true_grade < 2 AND pred < 2) AS tn, count(*) FILTER (WHERE true_grade >= 2 AND pred2 >= 2) AS tp2, count(*) FILTER (WHERE true_grade < 2 AND pred2 < 2) AS tn2, count(*) FILTER (WHERE pred = true_grade) AS ok_, count(*) AS n"
_BOOT = CASES + f""", g AS (SELECT group_id, {_SQLC} FROM ok GROUP BY 1), cl AS (SELECT *, row_number() OVER (ORDER BY group_id) - 1 AS idx, count(*) OVER () AS nc FROM g),
w AS (SELECT r.range AS r, {sql_draw32('boot', "r.range, j.range")} % m.nc AS idx, count(*) AS w FROM range({REPLICATES}) r, (SELECT count(*) AS nc FROM g) m, range(0, (SELECT count(*) FROM g)) j GROUP BY 1, 2),
b AS (SELECT r, sum(pos * w) AS pos, sum(neg * w) AS neg, sum(tp * w) AS tp, sum(tn * w) AS tn, sum(tp2 * w) AS tp2, sum(tn2 * w) AS tn2, sum(ok_ * w) AS ok_, sum(n * w) AS n FROM w JOIN cl USING (idx) GROUP BY 1)"""


def _boot(spark, d):
    c = B.cluster_counts(evaluated(spark, d), "group_id", counts())
    return c, B.resampled(c, REPLICATES, "boot", list(counts()))


@query(_BOOT + ", p AS (SELECT CAST(sum(tp) AS DOUBLE) / sum(pos) AS sens, CAST(sum(tn) AS DOUBLE) / sum(neg) AS spec, CAST(sum(ok_) AS DOUBLE) / sum(n) AS acc "
    "FROM cl), s AS (SELECT 'sensitivity' AS metric, CAST(tp AS DOUBLE) / pos AS v FROM b UNION ALL SELECT 'specificity', CAST(tn AS DOUBLE) / neg "
    "FROM b UNION ALL SELECT 'accuracy', CAST(ok_ AS DOUBLE) / n FROM b) SELECT metric, round(CASE metric WHEN 'sensitivity' THEN any_value(sens) WHEN 'specificity' THEN any_value(spec) ELSE any_value(acc) END, 6) AS point, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(v) AS valid "
    "FROM s, p GROUP BY metric")
def cluster_bootstrap_ci(spark, d):
    stats = {"sensitivity": ("tp", "pos"), "specificity": ("tn", "neg"), "accuracy": ("ok", "n")}
    named = {k: (lambda total, x=x, y=y: S.ratio(total(x), total(y))) for k, (x, y) in stats.items()}
    out = B.bootstrap(evaluated(spark, d), "group_id", counts(), named, REPLICATES, "boot")
    return out.select("metric", *[r6(c, c) for c in ("point", "low", "high")], "valid")


@query(_BOOT + ", s AS (SELECT CAST(tp2 AS DOUBLE) / pos - CAST(tp AS DOUBLE) / pos AS ds, CAST(tn2 AS DOUBLE) / neg - CAST(tn AS DOUBLE) / neg AS dp "
    "FROM b) SELECT round(quantile_cont(ds, 0.025), 6) AS sens_low, round(quantile_cont(ds, 0.975), 6) AS sens_high, round(quantile_cont(dp, 0.025), 6) AS spec_low, round(quantile_cont(dp, 0.975), 6) AS spec_high, quantile_cont(ds, 0.025) > 0 AS better "
    "FROM s")
def paired_bootstrap_ci(spark, d):
    """Differences of two models on the same resamples, and the rule that the interval lies above 0."""
    _, b = _boot(spark, d)
    ds = S.ratio(F.col("tp2"), F.col("pos")) - S.ratio(F.col("tp"), F.col("pos"))
    dp = S.ratio(F.col("tn2"), F.col("neg")) - S.ratio(F.col("tn"), F.col("neg"))
    q = b.select(ds.alias("ds"), dp.alias("dp")).agg(F.percentile("ds", [0.025, 0.975]).alias("a"), F.percentile("dp", [0.025, 0.975]).alias("b"))
    return q.select(*[r6(F.col(c)[i], f"{n}_{e}") for c, n in (("a", "sens"), ("b", "spec")) for i, e in enumerate(("low", "high"))], (F.col("a")[0] > 0).alias("better"))


_STRAT = CASES + f""", g AS (SELECT true_grade, image_id, CAST(pred = true_grade AS INT) AS ok_, CAST(pred >= 2 AS INT) AS called FROM ok), cl AS (SELECT *, row_number() OVER (PARTITION BY true_grade ORDER BY md5(concat_ws('|', 'idx', image_id)), image_id) - 1 AS idx, count(*) OVER (PARTITION BY true_grade) AS nc FROM g),
w AS (SELECT true_grade, r.range AS r, {sql_draw32('strat', "true_grade, r.range, idx")} % nc AS idx, count(*) AS w FROM range({REPLICATES}) r, cl GROUP BY 1, 2, 3), b AS (SELECT r, CAST(sum(ok_ * w) AS DOUBLE) / sum(w) AS acc, CAST(sum(CASE WHEN true_grade >= 2 THEN called * w END) AS DOUBLE) / sum(CASE WHEN true_grade >= 2 THEN w END) AS sens FROM w JOIN cl USING (true_grade, idx) GROUP BY 1)"""


@query(_STRAT + " SELECT round(quantile_cont(acc, 0.025), 6) AS acc_low, round(quantile_cont(acc, 0.975), 6) AS acc_high, round(quantile_cont(sens, 0.025), 6) AS sens_low, round(quantile_cont(sens, 0.975), 6) AS sens_high, count(acc) AS valid "
    "FROM b")
def stratified_bootstrap_ci(spark, d):
    """Images are drawn within their grade."""
    c = B.cluster_counts(evaluated(spark, d), "image_id", {"ok": F.col("pred") == F.col("true_grade"), "rp": ref() & call(), "ref": ref(), "n": F.lit(True)}, ["true_grade"])
    b = B.resampled(c, REPLICATES, "strat", ["ok", "rp", "ref", "n"], ["true_grade"])
    q = b.agg(F.percentile(S.ratio(F.col("ok"), F.col("n")), [0.025, 0.975]).alias("a"), F.percentile(S.ratio(F.col("rp"), F.col("ref")),
        [0.025, 0.975]).alias("b"), F.count("n").alias("valid"))
    return q.select(*[r6(F.col(c)[i], f"{n}_{e}") for c, n in (("a", "acc"), ("b", "sens")) for i, e in enumerate(("low", "high"))], "valid")


@query(_BOOT + ", sc AS (SELECT idx, score, count(*) FILTER (WHERE true_grade >= 2) AS p, count(*) FILTER (WHERE true_grade < 2) AS q "
    "FROM ok JOIN cl USING (group_id) GROUP BY 1, 2), t AS (SELECT r, score, sum(p * w) AS p, sum(q * w) AS q "
    "FROM w JOIN sc USING (idx) GROUP BY 1, 2), u AS (SELECT r, p, q, p * (sum(q) OVER (PARTITION BY r ORDER BY score) - q / 2.0) AS wins "
    "FROM t), a AS (SELECT r, sum(wins) / (CAST(sum(p) AS DOUBLE) * sum(q)) AS auc FROM u GROUP BY 1) "
    "SELECT round(avg(auc), 6) AS mean_auc, round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.975), 6) AS high, count(auc) AS valid "
    "FROM a")
def bootstrap_auc(spark, d):
    """The interval of the AUC, each replicate's from weighted score groups."""
    df = evaluated(spark, d)
    c = B.placed_clusters(df.select("group_id").distinct(), "group_id")
    scores = df.groupBy("group_id", "score").agg(F.count_if(ref()).alias("pos"), F.count_if(~ref()).alias("neg"))
    a = B.weighted_auc(scores, B.weight_vectors(c, "group_id", REPLICATES, "boot"), "group_id", REPLICATES)
    return a.agg(r6(F.avg("auc"), "mean_auc"), r6(F.percentile("auc", F.lit(0.025)), "low"), r6(F.percentile("auc", F.lit(0.975)), "high"), F.count("auc").alias("valid"))


def sql_draws(size: str, sizes: str, draws: int, seed: str) -> str:
    """The draws of calibration_draws() and its cuts by rule, with every row by draw; `sizes` is a table of sample sizes (size)."""
    values = ", ".join(f"('{n}', CAST({t} AS DOUBLE), {str(k).lower()})" for n, (t, k) in RULES.items())
    return CASES + f""", z AS ({sizes}), g AS (SELECT source, group_id, count(*) AS n FROM ok GROUP BY 1, 2),
dr AS (SELECT source, size, group_id, r.range AS r, coalesce(sum(n) OVER (PARTITION BY source, size, r.range ORDER BY md5(concat_ws('|', {seed}, r.range, group_id)), group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < size AS drawn FROM g, z, range({draws}) r),
rw AS (SELECT ok.source, size, r, drawn, score, true_grade >= 2 AS pos FROM ok JOIN dr USING (source, group_id)),
sm AS (SELECT source, size, r, list_sort(coalesce(list(score) FILTER (WHERE pos), [])) AS p, coalesce(list(score) FILTER (WHERE NOT pos), []) AS q FROM rw WHERE drawn GROUP BY 1, 2, 3),
ft AS (SELECT source, size, r, rule, CASE WHEN len(p) < 5 OR len(q) < 5 THEN CAST(1.5 AS DOUBLE) WHEN keep AND CAST(len(list_filter(p, lambda x: x >= CAST(1.5 AS DOUBLE))) AS DOUBLE) / len(p) >= target AND 1 - CAST(len(list_filter(q, lambda x: x >= CAST(1.5 AS DOUBLE))) AS DOUBLE) / len(q) >= CAST(0.85 AS DOUBLE) THEN CAST(1.5 AS DOUBLE) ELSE p[CAST(floor((1 - target) * len(p)) AS BIGINT) + 1] - CAST(1e-9 AS DOUBLE) END AS cut FROM sm, (VALUES {values}) t(rule, target, keep)),
jd AS (SELECT source, size, r, rule, any_value(cut) AS cut, CAST(count(*) FILTER (WHERE pos AND score >= cut) AS DOUBLE) / nullif(count(*) FILTER (WHERE pos), 0) AS sens, 1 - CAST(count(*) FILTER (WHERE NOT pos AND score >= cut) AS DOUBLE) / nullif(count(*) FILTER (WHERE NOT pos), 0) AS spec FROM rw JOIN ft USING (source, size, r) WHERE NOT drawn GROUP BY 1, 2, 3, 4),
ru AS (SELECT source, size, rule, count(*) AS draws, avg(CAST(sens >= CAST({BOTH[0]} AS DOUBLE) AND spec >= CAST({BOTH[1]} AS DOUBLE) AS DOUBLE)) AS p_both, avg(sens) AS mean_sens, quantile_cont(sens, 0.1) AS p10_sens, min(sens) AS worst_sens, avg(spec) AS mean_spec, avg(CAST(cut <> CAST(1.5 AS DOUBLE) AS DOUBLE)) AS changed FROM jd GROUP BY 1, 2, 3)"""


_DRAWS = sql_draws("size", f"SELECT {SAMPLE} AS size", DRAWS, "'cal'")


def calibration_summary(df, size=SAMPLE, draws=DRAWS, seed="cal", rules=RULES):
    """(source, rule, draws, p_both, mean_sens, p10_sens, worst_sens, mean_spec, changed) of cuts fitted on samples of whole patients."""
    both = (F.col("sensitivity") >= BOTH[0]) & (F.col("specificity") >= BOTH[1])
    c = B.calibration_draws(df, "group_id", ref(), "score", size, draws, seed, rules, THRESHOLDS[1], ["source"])
    return c.groupBy("source", "rule").agg(F.count("*").alias("draws"), F.avg(both.cast("double")).alias("p_both"),
        F.avg("sensitivity").alias("mean_sens"), F.percentile("sensitivity", F.lit(0.1)).alias("p10_sens"), F.min("sensitivity").alias("worst_sens"),
        F.avg("specificity").alias("mean_spec"), F.avg((F.col("cut") != THRESHOLDS[1]).cast("double")).alias("changed"))


@query(_DRAWS + " SELECT source, rule, draws, round(p_both, 6) AS p_both, round(mean_sens, 6) AS mean_sens, round(p10_sens, 6) AS p10_sens, round(mean_spec, 6) AS mean_spec, round(changed, 6) AS changed "
    "FROM ru")
def calibration_draws(spark, d):
    """Whole patients are drawn at every site, cuts are fitted by the four rules, and judged on the site's other cases."""
    return calibration_summary(evaluated(spark, d)).select("source", "rule", "draws", *[r6(c, c) for c in ("p_both", "mean_sens", "p10_sens", "mean_spec", "changed")])


@query(_DRAWS + ", m AS (SELECT rule, avg(p_both) AS p_both, min(mean_sens) AS worst, round(min(mean_sens), 9) >= CAST(0.89 AS DOUBLE) AS fits, list_position(['R1', 'R3', 'R2', 'R4'], rule) AS o "
    "FROM ru GROUP BY 1), b AS (SELECT bool_or(fits) AS c, max(p_both) FILTER (WHERE fits) AS best "
    "FROM m) SELECT rule, round(p_both, 6) AS p_both, round(worst, 6) AS worst, c AS constrained "
    "FROM m, b WHERE NOT c OR (fits AND round(p_both - best, 9) >= CAST(-0.02 AS DOUBLE)) ORDER BY CASE WHEN c THEN 0 ELSE -round(worst, 9) END, o LIMIT 1")
def rule_selection(spark, d):
    """The rule that is kept: sensitive enough at every site, then most often within both targets, ties by preference."""
    rows = calibration_summary(evaluated(spark, d)).select(F.col("source").alias("site"), "rule", "p_both", F.col("mean_sens").alias("sensitivity"))
    return P.select_rule(rows, PREFERENCE).select("rule", r6("p_both", "p_both"), r6("worst", "worst"), "constrained")


@query(CASES + ", p AS (SELECT source, score, count(*) OVER (PARTITION BY source) AS n_pos, row_number() OVER (PARTITION BY source ORDER BY score) AS i "
    "FROM ok WHERE true_grade >= 2), c AS (SELECT source, n_pos, score - CAST(1e-9 AS DOUBLE) AS cut "
    "FROM p WHERE i = floor((1 - CAST(0.9 AS DOUBLE)) * n_pos) + 1) SELECT source, n_pos, round(cut, 6) AS cut, round(least(CAST(0.5 AS DOUBLE), cut - CAST(1e-6 AS DOUBLE)), 6) AS t0, round(greatest(CAST(2.5 AS DOUBLE), cut + CAST(1e-6 AS DOUBLE)), 6) AS t2, round(greatest(CAST(3.5 AS DOUBLE), greatest(CAST(2.5 AS DOUBLE), cut + CAST(1e-6 AS DOUBLE)) + CAST(1e-6 AS DOUBLE)), 6) AS t3 "
    "FROM c")
def site_boundary(spark, d):
    """A referral cut for each site, and the other thresholds moved out of its way."""
    b = P.boundary(evaluated(spark, d), ref(), "score", 0.9, ["source"]).withColumn("t", S.monotone_thresholds(THRESHOLDS, F.col("cut")))
    return b.select("source", "n_pos", r6("cut", "cut"), *[r6(F.col("t")[i], f"t{i}") for i in (0, 2, 3)])


_SROC = CASES + ", n AS (SELECT score, source, count(*) FILTER (WHERE true_grade >= 2) AS pos, count(*) FILTER (WHERE true_grade < 2) AS neg FROM ok GROUP BY 1, 2), gr AS (SELECT a.score, b.source, coalesce(n.pos, 0) AS pos, coalesce(n.neg, 0) AS neg FROM (SELECT DISTINCT score FROM ok) a CROSS JOIN (SELECT DISTINCT source FROM ok) b LEFT JOIN n ON n.score = a.score AND n.source = b.source), rc AS (SELECT score, source, CAST(sum(pos) OVER d AS DOUBLE) / sum(pos) OVER w AS sens, CAST(sum(neg) OVER w - sum(neg) OVER d AS DOUBLE) / sum(neg) OVER w AS spec FROM gr WINDOW w AS (PARTITION BY source), d AS (PARTITION BY source ORDER BY score DESC)), mn AS (SELECT score, avg(sens) AS sens, avg(spec) AS spec, min(sens) AS worst FROM rc GROUP BY 1)"


def _source_roc(spark, d):
    return P.source_roc(evaluated(spark, d), ref(), "score", "source")


@query(_SROC + " SELECT score AS cut, round(sens, 6) AS sens, round(spec, 6) AS spec FROM mn "
    "WHERE sens >= CAST(0.9 AS DOUBLE) ORDER BY round(spec, 9) DESC, score DESC LIMIT 1")
def balanced_threshold(spark, d):
    return P.balanced_threshold(_source_roc(spark, d), 0.9).select("cut", r6("sens", "sens"), r6("spec", "spec"))


@query(_SROC + " SELECT score AS cut, round(sens + spec - 1, 6) AS youden FROM mn ORDER BY round(sens + spec - 1, 9) DESC, score DESC LIMIT 1")
def youden_threshold(spark, d):
    return P.youden_threshold(_source_roc(spark, d)).select("cut", r6("youden", "youden"))


@query(_SROC + " SELECT score AS cut, round(worst, 6) AS worst FROM mn WHERE worst >= CAST(0.9 AS DOUBLE) ORDER BY score DESC LIMIT 1")
def worst_source_threshold(spark, d):
    return P.worst_source_threshold(_source_roc(spark, d), 0.9).select("cut", r6("worst", "worst"))


@query(CASES + ", n AS (SELECT score, count(*) FILTER (WHERE true_grade >= 2) AS pos, count(*) FILTER (WHERE true_grade < 2) AS neg "
    "FROM ok GROUP BY 1), t AS (SELECT score, CAST(sum(pos) OVER d AS DOUBLE) / sum(pos) OVER () AS sens, CAST(sum(neg) OVER () - sum(neg) OVER d AS DOUBLE) / sum(neg) OVER () AS spec, (score + coalesce(lag(score) OVER (ORDER BY score), score)) / 2 AS mid "
    "FROM n WINDOW d AS (ORDER BY score DESC)) SELECT round(mid, 6) AS cut, round(sens, 6) AS sens, round(spec, 6) AS spec "
    "FROM t WHERE spec >= CAST(0.9 AS DOUBLE) ORDER BY round(sens, 9) DESC, round(spec, 9) DESC, mid DESC LIMIT 1")
def spec_floor_threshold(spark, d):
    return P.floor_threshold(R.roc_table(R.score_table(evaluated(spark, d), ref(), "score")), 0.9).select(r6("cut", "cut"), r6("sens", "sens"), r6("spec", "spec"))


@query(CASES + " SELECT source, round(quantile_cont(iqs, 0.05), 6) AS reject_cut, round(max(score) FILTER (WHERE score < 1.5), 6) AS midpoint_from, round((max(score) FILTER (WHERE score < 1.5) + 1.5) / 2, 6) AS midpoint "
    "FROM ok WHERE true_grade < 2 GROUP BY 1")
def false_reject_threshold(spark, d):
    """The reject cut from the accepted class's quantile, and the midpoint below a cut."""
    below = F.max(F.when(F.col("score") < 1.5, F.col("score")))
    return evaluated(spark, d).filter(~ref()).groupBy("source").agg(r6(F.percentile("iqs", F.lit(0.05)), "reject_cut"), r6(below, "midpoint_from"), r6((below + 1.5) / 2, "midpoint"))


@query(CASES + """, b AS (SELECT image_id, status, pred AS g, score AS s, head FROM cases WHERE image_id % 50 <> 0), c AS (SELECT image_id, CASE WHEN image_id % 211 = 0 THEN 'error' ELSE status END AS status, CASE WHEN image_id % 97 = 0 THEN pred2 ELSE pred END AS g, CASE WHEN image_id % 97 = 0 THEN second WHEN image_id % 31 = 0 THEN score + CAST(0.00001 AS DOUBLE) ELSE score END AS s, head FROM cases WHERE image_id % 60 <> 0),
j AS (SELECT b.image_id AS l, c.image_id AS r, b.status = 'success' AND c.status = 'success' AS paired, b.status = c.status AS st, b.g = c.g AS gr, abs(b.s - c.s) AS d, b.g AS bg, c.g AS cg FROM b FULL JOIN c USING (image_id))
SELECT count(*) FILTER (WHERE r IS NULL) AS only_left, count(*) FILTER (WHERE l IS NULL) AS only_right, count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL AND NOT st) AS status_differs, count(*) FILTER (WHERE paired) AS compared, count(*) FILTER (WHERE paired AND NOT gr) AS grade_differs, count(*) FILTER (WHERE paired AND d > CAST(0.0001 AS DOUBLE)) AS beyond_tolerance, count(*) FILTER (WHERE paired AND bg <> cg AND abs(bg - cg) = 1) AS one_edge, round(quantile_cont(d, 0.95) FILTER (WHERE paired), 6) AS p95, round(max(d) FILTER (WHERE paired), 6) AS largest, bool_and(gr) FILTER (WHERE paired) AS passes FROM j""")
def runtime_parity(spark, d):
    """Two exports reconciled: only rows that both have and that succeeded in both are compared."""
    c = cases(spark, d)
    i = F.col("image_id")
    left = c.filter(i % 50 != 0).select("image_id", F.lit(1).alias("l"), F.col("status").alias("ls"), F.col("pred").alias("lg"), F.col("score").alias("lv"))
    right = c.filter(i % 60 != 0).select("image_id", F.lit(1).alias("r"), F.when(i % 211 == 0, "error").otherwise(F.col("status")).alias("rs"),
        F.when(i % 97 == 0, F.col("pred2")).otherwise(F.col("pred")).alias("rg"), F.when(i % 97 == 0, F.col("second")).when(i % 31 == 0,
        F.col("score") + 0.00001).otherwise(F.col("score")).alias("rv"))
    j = left.join(right, "image_id", "full")
    paired = F.col("l").isNotNull() & F.col("r").isNotNull()
    both = paired & (F.col("ls") == "success") & (F.col("rs") == "success")
    diff = F.abs(F.col("lv") - F.col("rv"))
    edge = F.abs(F.col("lg") - F.col("rg"))
    return j.agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"),
        F.count_if(paired & (F.col("ls") != F.col("rs"))).alias("status_differs"), F.count_if(both).alias("compared"),
        F.count_if(both & (edge > 0)).alias("grade_differs"), F.count_if(both & (diff > 0.0001)).alias("beyond_tolerance"),
        F.count_if(both & (edge == 1)).alias("one_edge"), r6(F.percentile(F.when(both, diff), F.lit(0.95)), "p95"),
        r6(F.max(F.when(both, diff)), "largest"), F.bool_and(F.when(both, edge == 0)).alias("passes"))


@query(CASES + ", j AS (SELECT score AS a, second AS b, list_filter([0.5, 1.5, 2.5, 3.5], lambda t: CAST(t AS DOUBLE) > least(score, second) AND CAST(t AS DOUBLE) <= greatest(score, second)) AS ts "
    "FROM ok WHERE pred <> pred2), n AS (SELECT list_sort(list_transform(ts, lambda t: [abs((a + b) / 2 - CAST(t AS DOUBLE)), CAST(t AS DOUBLE)]))[1][2] AS threshold "
    "FROM j) SELECT threshold, count(*) AS n FROM n GROUP BY 1")
def crossed_thresholds(spark, d):
    """For decisions that differ, the threshold between the two scores that is nearest to their middle."""
    df = evaluated(spark, d).filter("pred <> pred2").select(S.crossed_threshold(F.col("score"), F.col("second"), THRESHOLDS).alias("threshold"))
    return df.groupBy("threshold").agg(F.count("*").alias("n"))


@query(CASES + ", ch AS (SELECT *, image_id % 8 AS chunk, sha256('v1|score|' || CASE WHEN image_id % 8 = 5 THEN 'b' ELSE 'a' END) AS identity "
    "FROM cases), m AS (SELECT * FROM ch WHERE identity = (SELECT mode(identity) FROM ch)) SELECT (SELECT count(DISTINCT identity) "
    "FROM ch) AS identities, (SELECT count(DISTINCT chunk) FROM m) AS chunks, count(*) AS rows, count(*) - count(DISTINCT image_id) AS duplicates, (SELECT count(*) "
    "FROM cases) - count(*) AS missing, round(avg(CAST(pred = true_grade AS DOUBLE)) FILTER (WHERE status = 'success'), 6) AS accuracy "
    "FROM m")
def chunk_merge(spark, d):
    """Chunks are merged if their identities agree; the odd one stays out and shows up as missing rows. Metrics are computed anew."""
    tag = F.concat(F.lit("v1|score|"), F.when(F.col("image_id") % 8 == 5, "b").otherwise("a"))
    ch = cases(spark, d).withColumns({"chunk": F.col("image_id") % 8, "identity": F.sha2(tag, 256)})
    ids = ch.groupBy("identity").agg(F.count("*").alias("n"))
    main = ids.orderBy(F.col("n").desc(), "identity").limit(1).select("identity")
    m = ch.join(F.broadcast(main), "identity", "left_semi")  # one row
    out = m.agg(F.count_distinct("chunk").alias("chunks"), F.count("*").alias("rows"),
        (F.count("*") - F.count_distinct("image_id")).alias("duplicates"),
        r6(F.avg(F.when(F.col("status") == "success", (F.col("pred") == F.col("true_grade")).cast("double"))), "accuracy"))
    return out.crossJoin(ids.agg(F.count("*").alias("identities"), F.sum("n").alias("total"))).select("identities", "chunks", "rows", "duplicates",
        (F.col("total") - F.col("rows")).alias("missing"), "accuracy")  # single rows


@query(CASES + " SELECT source, sha256(to_json({'n': count(*), 'source': source, 'sum': CAST(sum(image_id) AS BIGINT)})) AS identity FROM cases GROUP BY source")
def run_identity(spark, d):
    """The digest of a canonical JSON document: keys sorted, whole numbers."""
    return cases(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum("image_id").alias("sum")).select("source",
        F.sha2(F.to_json(F.struct("n", "source", "sum")), 256).alias("identity"))


@query("SELECT metric, round(value, 4) AS value FROM (SELECT unnest(['orders', 'orders.open', 'orders.price.mean', 'orders.price.max']) AS metric, unnest([CAST(count(*) AS DOUBLE), CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE), avg(o_totalprice), max(o_totalprice)]) AS value "
    "FROM orders)")
def flattened_metrics(spark, d):
    """A nested report as (metric, value) rows."""
    from ..sources.documents import flatten

    row = read(spark, d, "orders").agg(F.struct(F.count("*").alias("_"), F.count_if(F.col("o_orderstatus") == "O").alias("open"),
        F.struct(F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("max")).alias("price")).alias("orders"))
    return flatten(row).select("metric", F.round("value", 4).alias("value"))


@query("WITH e AS (SELECT * FROM (VALUES ('region', 5), ('nation', 25), ('customer', 1)) t(name, expected)), "
    "s AS (SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) "
    "FROM nation UNION ALL SELECT 'customer', count(*) FROM customer) SELECT e.name, expected, n, CASE WHEN n = expected THEN 'ready' WHEN n > expected THEN 'unexpected' ELSE 'incomplete' END AS status "
    "FROM e JOIN s ON e.name = s.name")
def dataset_audit(spark, d):
    seen = None
    for name in ("region", "nation", "customer"):
        one = read(spark, d, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        seen = one if seen is None else seen.unionByName(one)
    expected = spark.createDataFrame([("region", 5), ("nation", 25), ("customer", 1)], "name string, expected int")
    return expected.join(seen, "name").withColumn("status", F.when(F.col("n") == F.col("expected"), "ready").when(F.col("n") > F.col("expected"), "unexpected").otherwise("incomplete"))


@query(CASES + " SELECT source, count(*) AS screened, count(*) FILTER (WHERE status = 'success' AND pred >= 2) AS referred, round_even(count(*) * CAST(1.5 AS DOUBLE), 0) AS minutes, round_even(CAST(count(*) FILTER (WHERE status = 'success' AND pred >= 2) AS DOUBLE) * CAST(12.5 AS DOUBLE), 0) AS cost "
    "FROM cases GROUP BY 1")
def workload_summary(spark, d):
    ref = F.count_if((F.col("status") == "success") & call())
    return cases(spark, d).groupBy("source").agg(F.count("*").alias("screened"), ref.alias("referred"),
        F.bround(F.count("*") * F.lit(1.5)).alias("minutes"), F.bround(ref * F.lit(12.5)).alias("cost"))


@query(CASES + ", f AS (SELECT image_id % 20 AS img, t.v AS threshold, count(*) FILTER (WHERE true_grade >= 2 AND score >= t.v) AS hits, count(*) FILTER (WHERE true_grade < 2 AND score >= t.v) AS fps, count(*) FILTER (WHERE true_grade >= 2) AS truth "
    "FROM ok, (SELECT unnest([CAST(0.5 AS DOUBLE), CAST(1.0 AS DOUBLE), CAST(1.5 AS DOUBLE), CAST(2.5 AS DOUBLE)]) AS v) t "
    "GROUP BY 1, 2) SELECT threshold, count(*) AS images, CAST(sum(hits) AS BIGINT) AS hits, round(avg(fps), 6) AS fp_per_image, round(CAST(sum(hits) AS DOUBLE) / sum(truth), 6) AS sensitivity "
    "FROM f GROUP BY 1")
def froc(spark, d):
    """Hits and false positives an image over a grid of thresholds."""
    t = F.explode(F.array(*[F.lit(x) for x in (0.5, 1.0, 1.5, 2.5)]))
    f = evaluated(spark, d).select((F.col("image_id") % 20).alias("img"), "true_grade", "score", t.alias("threshold"))
    on = F.col("score") >= F.col("threshold")
    f = f.groupBy("img", "threshold").agg(F.count_if(ref() & on).alias("hits"), F.count_if(~ref() & on).alias("fps"), F.count_if(ref()).alias("truth"))
    return f.groupBy("threshold").agg(F.count("*").alias("images"), F.sum("hits").alias("hits"), r6(F.avg("fps"), "fp_per_image"), r6(S.ratio(F.sum("hits"), F.sum("truth")), "sensitivity"))


@query("WITH s AS (SELECT user_id AS k, CAST(row_number() OVER w - 1 AS DOUBLE) / nullif(count(*) OVER (PARTITION BY user_id) - 1, 0) AS x, value AS y "
    "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), l AS (SELECT k, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py "
    "FROM s WINDOW w AS (PARTITION BY k ORDER BY x)) SELECT k, count(*) AS points, round(sum((x - px) * (y + py) / 2), 6) AS area "
    "FROM l GROUP BY 1")
def deletion_area(spark, d):
    """Trapezoid areas under each user's whole curve, its events spread evenly from 0 to 1; null with one event."""
    w = Window.partitionBy("k").orderBy("event_id")
    s = read(spark, d, "events").select(F.col("user_id").alias("k"), "event_id", F.col("value").alias("y"))
    x = F.try_divide((F.row_number().over(w) - 1).cast("double"), (F.count("*").over(Window.partitionBy("k")) - 1).cast("double"))
    s = s.withColumn("x", x).withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)})
    return s.groupBy("k").agg(F.count("*").alias("points"), r6(F.sum((F.col("x") - F.col("px")) * (F.col("y") + F.col("py")) / 2), "area"))


@query(CASES + ", q AS (SELECT CASE WHEN iqs < CAST(0.2 AS DOUBLE) THEN 0 WHEN iqs < CAST(0.6 AS DOUBLE) THEN 1 ELSE 2 END AS t, least(greatest(iqs + (CAST(" + sql_draw("qn", "image_id") + " AS DOUBLE) / 10000 - CAST(0.5 AS DOUBLE)) / 5, 0), 1) AS s "
    "FROM ok), b AS (SELECT least(CAST(floor(s * 20) AS INT), 19) AS b, t, count(*) AS n FROM q "
    "GROUP BY 1, 2), p AS (SELECT x.range AS lo, y.range AS hi FROM range(1, 19) x, range(2, 20) y "
    "WHERE x.range < y.range), m AS (SELECT lo, hi, t, CASE WHEN b < lo THEN 0 WHEN b < hi THEN 1 ELSE 2 END AS c, sum(n) AS n "
    "FROM p, b GROUP BY ALL), f AS (SELECT lo, hi, k.range AS k, 2.0 * coalesce(sum(CASE WHEN t = k.range AND c = k.range THEN n END), 0) / (coalesce(sum(CASE WHEN t = k.range THEN n END), 0) + coalesce(sum(CASE WHEN c = k.range THEN n END), 0)) AS f1 "
    "FROM m, range(3) k GROUP BY ALL), a AS (SELECT lo, hi, round(avg(f1), 9) AS v FROM f GROUP BY 1, 2) "
    "SELECT CAST(lo AS DOUBLE) / 20 AS reject_cut, CAST(hi AS DOUBLE) / 20 AS good_cut, round(v, 6) AS macro_f1 "
    "FROM a ORDER BY v DESC, lo, hi LIMIT 1")
def quality_cut_points(spark, d):
    """Two ordered cuts that maximise macro-F1, exhaustively over a grid; the scores are a histogram of 20 bins by class, so the search costs the same at any size."""
    i = F.col("image_id")
    s = F.least(F.greatest(F.col("iqs") + (S.draw("qn", i) / 10000.0 - 0.5) / 5, F.lit(0.0)), F.lit(1.0))
    t = F.when(F.col("iqs") < 0.2, 0).when(F.col("iqs") < 0.6, 1).otherwise(2)
    b = evaluated(spark, d).groupBy(F.least(F.floor(s * 20), F.lit(19)).alias("b"), t.alias("t")).agg(F.count("*").alias("n"))
    pairs = F.array(*[F.struct(F.lit(x).alias("lo"), F.lit(y).alias("hi")) for x in range(1, 19) for y in range(x + 1, 20)])
    m = b.select("b", "t", "n", F.explode(pairs).alias("p")).select("b", "t", "n", "p.*")
    c = F.when(F.col("b") < F.col("lo"), 0).when(F.col("b") < F.col("hi"), 1).otherwise(2)
    part = lambda x: F.sum(F.when(x, F.col("n")).otherwise(0))
    f1 = [F.coalesce(S.ratio(2 * part((F.col("t") == k) & (c == k)), part(F.col("t") == k) + part(c == k)), F.lit(0.0)) for k in range(3)]
    a = m.groupBy("lo", "hi").agg(F.round((f1[0] + f1[1] + f1[2]) / 3, 9).alias("v"))
    return a.orderBy(F.col("v").desc(), "lo", "hi").limit(1).select((F.col("lo") / 20.0).alias("reject_cut"), (F.col("hi") / 20.0).alias("good_cut"), r6("v", "macro_f1"))


def sql_nll(t: str) -> str:
    """The mean loss at temperature t over counts n of (score, true_grade), whose logits are minus squared distances."""
    z = lambda k: f"-(score - {k}) * (score - {k}) / {t}"
    top = f"greatest({', '.join(z(k) for k in range(5))})"
    return f"sum(n * -ln(greatest(exp(-(score - true_grade) * (score - true_grade) / {t} - {top}) / ({' + '.join(f'exp({z(k)} - {top})' for k in range(5))}), CAST(1e-12 AS DOUBLE)))) / sum(n)"


@query(CASES + f", h AS (SELECT score, true_grade, count(*) AS n FROM ok GROUP BY 1, 2), c AS (SELECT CAST(t.range AS DOUBLE) / 4 AS t "
    f"FROM range(1, 41) t), l AS (SELECT t, round({sql_nll('t')}, 9) AS v FROM h, c GROUP BY 1), "
    f"b AS (SELECT t FROM l ORDER BY v, t LIMIT 1), e AS (SELECT greatest(CAST(0.05 AS DOUBLE), b.t + CAST(x.range AS DOUBLE) / 100) AS t "
    f"FROM b, range(-25, 26) x), m AS (SELECT t, round({sql_nll('t')}, 9) AS v FROM h, (SELECT DISTINCT t "
    f"FROM e) GROUP BY 1), o AS (SELECT {sql_nll('CAST(1 AS DOUBLE)')} AS v FROM h) SELECT round(m.t, 2) AS temperature, round(m.v, 6) AS nll, round(o.v, 6) AS before "
    f"FROM m, o ORDER BY m.v, m.t LIMIT 1")
def temperature_fit(spark, d):
    """The temperature from 0.05 to 10 of the smallest loss: quarters first, then hundredths around the best, each one aggregate over counts of equal logits."""
    h = evaluated(spark, d).groupBy("score", "true_grade").agg(F.count("*").alias("n")).withColumn("z",
        F.array(*[-(F.col("score") - float(k)) * (F.col("score") - float(k)) for k in range(5)]))

    def losses(grid):
        p = S.softmax(F.transform("z", lambda v: v / F.col("t")))
        own = -F.ln(F.greatest(F.element_at(p, F.col("true_grade") + 1), F.lit(1e-12)))
        return grid.groupBy("t").agg(F.round(F.sum(F.col("n") * own) / F.sum("n"), 9).alias("v"))

    best = lambda m: m.agg(F.min(F.struct("v", "t")).alias("b")).select("b.*")
    coarse = best(losses(h.withColumn("t", F.explode(F.array(*[F.lit(k / 4) for k in range(1, 41)])))))
    steps = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(-25), F.lit(25)), lambda x: F.greatest(F.lit(0.05), F.col("t0") + x / F.lit(100.0)))))
    fine = best(losses(h.crossJoin(F.broadcast(coarse.select(F.col("t").alias("t0")))).withColumn("t", steps)))  # one row
    one = losses(h.withColumn("t", F.lit(1.0))).select(F.col("v").alias("v1"))
    return fine.crossJoin(one).select(F.round("t", 2).alias("temperature"), r6("v", "nll"), r6("v1", "before"))  # single rows


@query(CASES + ", k AS (SELECT source, count(*) FILTER (WHERE true_grade >= 2 AND pred < 2) AS misses, count(*) FILTER (WHERE true_grade >= 2) AS n "
    "FROM ok GROUP BY 1), i AS MATERIALIZED (SELECT source, i.range AS i, lgamma(n + 1) - lgamma(i.range + 1) - lgamma(n - i.range + 1) AS c "
    "FROM k, range(0, (SELECT max(misses) + 1 FROM k)) i WHERE i.range <= misses), s0 AS (SELECT source, misses, n, CAST(misses AS DOUBLE) / n AS lo, CAST(1 AS DOUBLE) AS hi "
    "FROM k), " + ", ".join(f"t{j} AS MATERIALIZED (SELECT s.source, any_value(misses) AS misses, any_value(n) AS n, any_value(lo) AS lo, any_value(hi) AS hi, sum(exp(c + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2))) > CAST(0.05 AS DOUBLE) AS up "
    f"FROM s{j} s JOIN i ON i.source = s.source GROUP BY 1), s{j + 1} AS (SELECT source, misses, n, CASE WHEN up THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN up THEN hi ELSE (lo + hi) / 2 END AS hi "
    f"FROM t{j})" for j in range(40)) + " SELECT source, misses, n, round((lo + hi) / 2, 6) AS upper "
    "FROM s40")
def clopper_pearson(spark, d):
    """Exact upper bounds of each source's miss rate; a row a source reaches the driver."""
    rows = M.rates(evaluated(spark, d), ref(), call(), ["source"]).select("source", "fn", (F.col("fn") + F.col("tp")).alias("n")).collect()
    return spark.createDataFrame([(r["source"], r["fn"], r["n"], round(P.clopper_pearson_upper(r["fn"], r["n"]), 6)) for r in rows], "source string, misses long, n long, upper double")


@query()
def bipartite_match(spark, d):
    """Detections and truths of an image, one to one and as many as possible."""
    li = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("image"), F.col("l_partkey").alias("left"), (F.col("l_orderkey") % 50).alias("right")).distinct()
    return G.match_by_image(li)


@query()
def nms(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("image"), F.col("event_id").alias("id"), (F.col("value") % 40).alias("x"),
        ((F.col("event_id") * 7) % 100).cast("double").alias("y"), F.col("value").alias("score"))
    return G.suppress(e, 5.0, 300)
