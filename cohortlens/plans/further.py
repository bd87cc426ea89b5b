"""Further queries: subgroup endpoints, searches over small grids, splits and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import linking as L
from ..operators import metrics as M
from ..operators import ranking as R
from ..operators import resampling as B
from .cohort import CASES, PROBS, cases, evaluated, logits, read, sql_draw
from .statistics import RULES, calibration_summary, sql_draws

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def ref():
    return F.col("true_grade") >= 2


def r6(c, name):
    return F.round(c, 6).alias(name)


@query(CASES + " SELECT count(*) AS n, round(avg(CASE WHEN true_grade >= 2 THEN CAST(pred >= 2 AS DOUBLE) END), 6) AS disease_called, round(avg(CASE WHEN true_grade = 0 THEN CAST(pred = 0 AS DOUBLE) END), 6) AS normal_cleared, round(avg(CASE WHEN true_grade < 2 AND iqs < CAST(0.2 AS DOUBLE) THEN CAST(pred >= 2 AS DOUBLE) END), 6) AS other_called "
    "FROM ok")
def endpoint_statistics(spark, d):
    """Conditional averages of a multi-label cohort; other disease is played by low quality."""
    avg = lambda cond, x: F.avg(F.when(cond, x.cast("double")))
    return evaluated(spark, d).agg(F.count("*").alias("n"), r6(avg(ref(), F.col("pred") >= 2), "disease_called"),
        r6(avg(F.col("true_grade") == 0, F.col("pred") == 0), "normal_cleared"), r6(avg(~ref() & (F.col("iqs") < 0.2), F.col("pred") >= 2), "other_called"))


@query(CASES + f", s AS (SELECT *, CASE WHEN {sql_draw('half', 'group_id')} < 8000 THEN 'train' ELSE 'test' END AS split "
    f"FROM ok) SELECT source, split, count(*) FILTER (WHERE true_grade >= 2) AS pos, count(*) FILTER (WHERE true_grade < 2) AS neg, count(*) FILTER (WHERE true_grade >= 2) >= 150 AS enough "
    f"FROM s GROUP BY 1, 2")
def split_coverage(spark, d):
    """Support of each source in each split against a minimum."""
    s = evaluated(spark, d).withColumn("split", F.when(S.draw("half", F.col("group_id")) < 8000, "train").otherwise("test"))
    return s.groupBy("source", "split").agg(F.count_if(ref()).alias("pos"), F.count_if(~ref()).alias("neg"), (F.count_if(ref()) >= 150).alias("enough"))


@query(CASES + ", e AS (SELECT camera, CASE WHEN iqs > CAST(0.05 AS DOUBLE) THEN abs(score - true_grade) END AS v "
    "FROM ok) SELECT camera, count(*) AS n, count(*) - count(v) AS unlocalised, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90 "
    "FROM e GROUP BY 1")
def localisation_summary(spark, d):
    v = F.when(F.col("iqs") > 0.05, F.abs(F.col("score") - F.col("true_grade")))
    return evaluated(spark, d).withColumn("v", v).groupBy("camera").agg(F.count("*").alias("n"), (F.count("*") - F.count("v")).alias("unlocalised"),
        r6(F.avg("v"), "mean"), r6(F.median("v"), "median"), r6(F.percentile("v", F.lit(0.9)), "p90"))


@query(CASES + ", t AS (SELECT source, x.v AS threshold, count(*) FILTER (WHERE true_grade >= 2 AND score >= x.v) AS tp, count(*) FILTER (WHERE true_grade >= 2) AS p, count(*) FILTER (WHERE true_grade < 2 AND score < x.v) AS tn, count(*) FILTER (WHERE true_grade < 2) AS n "
    "FROM ok, (SELECT unnest([" + ", ".join(f"CAST({i} AS DOUBLE) / 20" for i in range(10, 60, 2)) + "]) AS v) x "
    "GROUP BY 1, 2), k AS (SELECT *, round(CAST(tp AS DOUBLE) / p, 9) AS sens, round(CAST(tn AS DOUBLE) / n, 9) AS spec "
    "FROM t) SELECT source, bool_or(sens >= CAST(0.85 AS DOUBLE) AND spec >= CAST(0.8 AS DOUBLE)) AS attainable, max_by(threshold, {'a': least(sens, spec), 'b': sens, 'c': -threshold}) AS best, round(max(CASE WHEN sens >= CAST(0.85 AS DOUBLE) THEN spec END), 6) AS best_spec "
    "FROM k GROUP BY 1")
def site_oracle(spark, d):
    """Whether any threshold of a grid meets both targets, the best one by a lexicographic rule, and the best specificity at the sensitivity target."""
    grid = F.explode(F.array(*[F.lit(i / 20) for i in range(10, 60, 2)]))
    t = evaluated(spark, d).select("source", "score", ref().alias("y"), grid.alias("threshold"))
    on = F.col("score") >= F.col("threshold")
    k = t.groupBy("source", "threshold").agg(F.round(S.ratio(F.count_if(F.col("y") & on), F.count_if("y")), 9).alias("sens"),
        F.round(S.ratio(F.count_if(~F.col("y") & ~on), F.count_if(~F.col("y"))), 9).alias("spec"))
    ok = (F.col("sens") >= 0.85) & (F.col("spec") >= 0.8)
    return k.groupBy("source").agg(F.bool_or(ok).alias("attainable"), F.max_by("threshold",
        F.struct(F.least("sens", "spec"), "sens", -F.col("threshold"))).alias("best"), r6(F.max(F.when(F.col("sens") >= 0.85, F.col("spec"))), "best_spec"))


@query(CASES + ", x AS (SELECT m.v AS margin, source, avg(CAST(score >= 1.5 - m.v AS DOUBLE)) FILTER (WHERE true_grade >= 2) AS sens "
    "FROM ok, (SELECT unnest([CAST(0 AS DOUBLE), CAST(0.1 AS DOUBLE), CAST(0.2 AS DOUBLE), CAST(0.3 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.8 AS DOUBLE)]) AS v) m "
    "GROUP BY 1, 2), w AS (SELECT margin, min(sens) AS worst FROM x GROUP BY 1) SELECT coalesce(min(margin) FILTER (WHERE worst >= CAST(0.85 AS DOUBLE)), max(margin)) AS margin, count(*) AS tried "
    "FROM w")
def smallest_margin(spark, d):
    """The smallest parameter whose worst case meets a bound, else the last."""
    m = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.1, 0.2, 0.3, 0.5, 0.8)]))
    x = evaluated(spark, d).filter(ref()).select("source", "score", m.alias("margin"))
    w = x.groupBy("margin", "source").agg(F.avg((F.col("score") >= 1.5 - F.col("margin")).cast("double")).alias("sens")).groupBy("margin").agg(F.min("sens").alias("worst"))
    return w.agg(F.coalesce(F.min(F.when(F.col("worst") >= 0.85, F.col("margin"))), F.max("margin")).alias("margin"), F.count("*").alias("tried"))


_ORDER = "md5(concat_ws('|', 'hs', r.range, group_id)), group_id"


@query(CASES + f", g AS (SELECT DISTINCT group_id FROM ok), h AS (SELECT r.range AS r, group_id, row_number() OVER (PARTITION BY r.range ORDER BY {_ORDER}) <= count(*) OVER (PARTITION BY r.range) // 2 AS fit "
    f"FROM g, range(5) r) SELECT CAST(r AS INT) AS r, fit, count(*) AS n, round(avg(CAST(pred = true_grade AS DOUBLE)), 6) AS accuracy "
    f"FROM ok JOIN h USING (group_id) GROUP BY 1, 2")
def repeated_half_splits(spark, d):
    """Half the patients, five times."""
    ok = evaluated(spark, d)
    g = ok.select("group_id").distinct().select("group_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("r"))
    w = Window.partitionBy("r")
    g = g.withColumn("fit", F.row_number().over(w.orderBy(S.hash_order("hs", F.col("r"), F.col("group_id")), "group_id")) <= F.floor(F.count("*").over(w) / 2))
    return ok.join(g, "group_id").groupBy("r", "fit").agg(F.count("*").alias("n"), r6(F.avg((F.col("pred") == F.col("true_grade")).cast("double")), "accuracy"))


@query(CASES + ", p AS (SELECT source, group_id, max(true_grade) AS worst, count(*) AS n FROM ok "
    "GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY source, worst >= 2 ORDER BY md5(concat_ws('|', 'kd', group_id)), group_id) AS r "
    "FROM p) SELECT source, worst >= 2 AS diseased, count(*) AS patients, CAST(sum(n) AS BIGINT) AS images "
    "FROM k WHERE worst >= 2 OR r <= 40 GROUP BY 1, 2")
def keep_diseased(spark, d):
    """Every diseased patient, and a sample of the others."""
    p = evaluated(spark, d).groupBy("source", "group_id").agg(F.max("true_grade").alias("worst"), F.count("*").alias("n")).withColumn("diseased", F.col("worst") >= 2)
    r = F.row_number().over(Window.partitionBy("source", "diseased").orderBy(S.hash_order("kd", F.col("group_id")), "group_id"))
    return p.withColumn("r", r).filter(F.col("diseased") | (F.col("r") <= 40)).groupBy("source", "diseased").agg(F.count("*").alias("patients"), F.sum("n").alias("images"))


@query(CASES + f", f AS (SELECT *, {sql_draw('xf', 'group_id')} % 5 AS fold FROM ok), c AS (SELECT k.range AS fold, (SELECT max_by(t.v, {{'a': round(t.acc, 9), 'b': -t.v}}) "
    f"FROM (SELECT x.v AS v, avg(CAST((score >= x.v) = (true_grade >= 2) AS DOUBLE)) AS acc FROM f, (SELECT unnest([CAST(1.0 AS DOUBLE), CAST(1.25 AS DOUBLE), CAST(1.5 AS DOUBLE), CAST(1.75 AS DOUBLE), CAST(2.0 AS DOUBLE)]) AS v) x "
    f"WHERE fold <> k.range GROUP BY 1) t) AS cut FROM range(5) k) SELECT fold, cut, count(*) AS n, round(avg(CAST((score >= cut) = (true_grade >= 2) AS DOUBLE)), 6) AS accuracy "
    f"FROM f JOIN c USING (fold) GROUP BY 1, 2")
def cross_fitted_cut(spark, d):
    """A cut is chosen on the other folds and judged on its own; all folds' choices come from one aggregate."""
    f = evaluated(spark, d).select("score", ref().alias("y"), (S.draw("xf", F.col("group_id")) % 5).alias("fold"))
    cand = f.select("fold", "y", "score", F.explode(F.array(*[F.lit(x) for x in (1.0, 1.25, 1.5, 1.75, 2.0)])).alias("v"))
    per = cand.groupBy("v", "fold").agg(F.count_if((F.col("score") >= F.col("v")) == F.col("y")).alias("ok"), F.count("*").alias("n"))
    w = Window.partitionBy("v")
    rest = per.select("v", "fold", F.round((F.sum("ok").over(w) - F.col("ok")) / (F.sum("n").over(w) - F.col("n")), 9).alias("acc"))
    cut = rest.groupBy("fold").agg(F.max_by("v", F.struct(F.col("acc"), -F.col("v"))).alias("cut"))
    return f.join(F.broadcast(cut), "fold").groupBy("fold", "cut").agg(F.count("*").alias("n"),
        r6(F.avg(((F.col("score") >= F.col("cut")) == F.col("y")).cast("double")), "accuracy"))  # five rows


@query(CASES + ", x AS (SELECT t.v AS threshold, count(*) FILTER (WHERE iqs < CAST(0.3 AS DOUBLE) AND s < t.v) AS hit, count(*) FILTER (WHERE iqs < CAST(0.3 AS DOUBLE)) AS bad, count(*) FILTER (WHERE iqs >= CAST(0.3 AS DOUBLE) AND s < t.v) AS lost, count(*) FILTER (WHERE iqs >= CAST(0.3 AS DOUBLE)) AS good "
    "FROM (SELECT iqs, least(greatest(iqs + (CAST(" + sql_draw("rj", "image_id") + " AS DOUBLE) / 10000 - CAST(0.5 AS DOUBLE)) / 5, 0), 1) AS s "
    "FROM ok), (SELECT unnest([" + ", ".join(f"CAST({i} AS DOUBLE) / 20" for i in range(2, 12)) + f"]) AS v) t "
    f"GROUP BY 1), w AS (SELECT threshold, CAST(hit AS DOUBLE) / bad AS recall, CAST(lost AS DOUBLE) / good AS false_reject, (hit / CAST(bad AS DOUBLE) + {1.6448536269514722}**2 / (2 * bad)) / (1 + {1.6448536269514722}**2 / bad) - {1.6448536269514722} * sqrt(hit / CAST(bad AS DOUBLE) * (1 - hit / CAST(bad AS DOUBLE)) / bad + {1.6448536269514722}**2 / (4.0 * bad * bad)) / (1 + {1.6448536269514722}**2 / bad) AS low "
    f"FROM x) SELECT threshold, round(recall, 6) AS recall, round(greatest(low, 0), 6) AS low, round(false_reject, 6) AS false_reject, low >= CAST(0.8 AS DOUBLE) AS admissible "
    f"FROM w")
def reject_threshold_grid(spark, d):
    """Recall of bad quality with its one-sided lower bound, over a grid of reject cuts."""
    s = F.least(F.greatest(F.col("iqs") + (S.draw("rj", F.col("image_id")) / 10000.0 - 0.5) / 5, F.lit(0.0)), F.lit(1.0))
    x = evaluated(spark, d).select((F.col("iqs") < 0.3).alias("bad"), s.alias("s"), F.explode(F.array(*[F.lit(i / 20) for i in range(2, 12)])).alias("threshold"))
    on = F.col("s") < F.col("threshold")
    k = x.groupBy("threshold").agg(F.count_if(F.col("bad") & on).alias("hit"), F.count_if("bad").alias("n"), S.ratio(F.count_if(~F.col("bad") & on), F.count_if(~F.col("bad"))).alias("fr"))
    low, _ = S.wilson(F.col("hit"), F.col("n"), 1.6448536269514722)
    return k.select("threshold", r6(S.ratio(F.col("hit"), F.col("n")), "recall"), r6(low, "low"), r6("fr", "false_reject"), (low >= 0.8).alias("admissible"))


@query(CASES + ", a AS (SELECT group_id, max(score) AS s, max(second) AS s2, max(true_grade) AS g "
    "FROM ok GROUP BY 1) SELECT count(*) AS patients, count(*) FILTER (WHERE g >= 2) AS referable, round(avg(CAST((s >= 1.5) = (g >= 2) AS DOUBLE)), 6) AS accuracy_a, round(avg(CAST((s2 >= 1.5) = (g >= 2) AS DOUBLE)), 6) AS accuracy_b, avg(CAST((s >= 1.5) = (g >= 2) AS DOUBLE)) >= CAST(0.7 AS DOUBLE) AND avg(CAST((s >= 1.5) = (g >= 2) AS DOUBLE)) >= avg(CAST((s2 >= 1.5) = (g >= 2) AS DOUBLE)) AS passes "
    "FROM a")
def patient_level_verdict(spark, d):
    """Worst eye decides; a pass rule set in advance."""
    p = evaluated(spark, d).groupBy("group_id").agg(F.max("score").alias("s"), F.max("second").alias("s2"), F.max("true_grade").alias("g"))
    hit = lambda c: F.avg(((F.col(c) >= 1.5) == (F.col("g") >= 2)).cast("double"))
    return p.agg(F.count("*").alias("patients"), F.count_if(F.col("g") >= 2).alias("referable"), r6(hit("s"), "accuracy_a"),
        r6(hit("s2"), "accuracy_b"), ((hit("s") >= 0.7) & (hit("s") >= hit("s2"))).alias("passes"))


@query(CASES + PROBS + " SELECT true_grade, round(avg(power(1 - [p0, p1, p2, p3, p4][true_grade + 1], 2) * -ln(greatest([p0, p1, p2, p3, p4][true_grade + 1], 1e-12))), 6) AS focal, round(avg((1 - power([p0, p1, p2, p3, p4][true_grade + 1], CAST(0.7 AS DOUBLE))) / CAST(0.7 AS DOUBLE)), 6) AS gce, round(avg(" + " + ".join("power(" + " + ".join(f"p{i}" for i in range(k + 1)) + f" - CAST(true_grade <= {k} AS DOUBLE), 2)" for k in range(5)) + "), 6) AS squared_emd "
    "FROM probs GROUP BY 1")
def loss_shapes(spark, d):
    """Focal, generalised cross-entropy and squared earth mover's losses as array expressions."""
    df = evaluated(spark, d).withColumn("p", S.grade_probabilities(logits()))
    p = F.element_at("p", F.col("true_grade") + 1)
    cum = [sum((F.col("p")[i] for i in range(k + 1)), F.lit(0.0)) - (F.col("true_grade") <= k).cast("double") for k in range(5)]
    return df.groupBy("true_grade").agg(r6(F.avg(F.pow(1 - p, F.lit(2.0)) * -F.ln(F.greatest(p, F.lit(1e-12)))), "focal"),
        r6(F.avg((1 - F.pow(p, F.lit(0.7))) / 0.7), "gce"), r6(F.avg(sum((c * c for c in cum), F.lit(0.0))), "squared_emd"))


@query("WITH x AS (SELECT s_suppkey, s_acctbal, lower(s_name) AS n, row_number() OVER (ORDER BY lower(s_name) DESC, s_suppkey) AS r "
    "FROM supplier) SELECT s_suppkey, n, CAST(r AS INT) AS r FROM x WHERE r <= 10")
def sorted_names(spark, d):
    """A report of the last ten names whatever their case."""
    s = read(spark, d, "supplier").select("s_suppkey", F.lower("s_name").alias("n")).orderBy(F.col("n").desc(), "s_suppkey").limit(10)
    return s.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("n").desc(), "s_suppkey")))  # ten rows


@query("SELECT p_partkey % 100 AS image, count(*) AS points, CAST(sum(CAST(floor(p_size * 10.5) AS BIGINT)) AS BIGINT) AS x_sum, count(*) FILTER (WHERE p_size * 10.5 >= 256 AND p_retailprice / 8 < 256) AS upper_right, round(avg(least(greatest(p_retailprice / 2000, 0), 1)), 6) AS clipped "
    "FROM part GROUP BY 1")
def coordinates_and_quadrants(spark, d):
    """Frame transforms by truncation, quadrants, clipped features."""
    x, y = F.col("p_size") * F.lit(10.5), F.col("p_retailprice") / 8
    return read(spark, d, "part").groupBy((F.col("p_partkey") % 100).alias("image")).agg(F.count("*").alias("points"),
        F.sum(F.floor(x).cast("long")).alias("x_sum"), F.count_if((x >= 256) & (y < 256)).alias("upper_right"),
        r6(F.avg(S.clip(F.col("p_retailprice") / 2000, 0.0, 1.0)), "clipped"))


@query(CASES + ", e AS (SELECT image_id FROM ok WHERE image_id % 40 = 0), p AS (SELECT o_orderkey AS x, o_orderkey + 7 AS y "
    "FROM orders WHERE o_orderkey % 11 = 0), c AS (SELECT a.image_id AS x, b.image_id AS y FROM p JOIN ok a ON p.x = a.image_id JOIN ok b ON p.y = b.image_id "
    "WHERE a.true_grade <> b.true_grade) SELECT count(*) AS n, count(*) FILTER (WHERE image_id IN (SELECT x "
    "FROM c UNION SELECT y FROM c)) AS conflicting, count(*) FILTER (WHERE image_id IN (SELECT image_id "
    "FROM e)) AS listed FROM ok")
def excluded_pairs(spark, d):
    """Near copies with different grades exclude both ends; a list excludes more."""
    ok = evaluated(spark, d)
    k = read(spark, d, "orders").filter("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("x"), (F.col("o_orderkey") + 7).alias("y"))
    g = ok.select("image_id", "true_grade")
    c = k.join(g.select(F.col("image_id").alias("x"), F.col("true_grade").alias("gx")), "x").join(g.select(F.col("image_id").alias("y"),
        F.col("true_grade").alias("gy")), "y").filter("gx <> gy")
    ends = c.select(F.col("x").alias("image_id")).union(c.select("y")).distinct().withColumn("c", F.lit(1))
    return ok.join(ends, "image_id", "left").agg(F.count("*").alias("n"), F.count("c").alias("conflicting"), F.count_if(F.col("image_id") % 40 == 0).alias("listed"))


@query("SELECT (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)) AS repeated_keys, (SELECT count(*) "
    "FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS kept, (SELECT round(sum(p), 2) "
    "FROM (SELECT min_by(l_extendedprice, (l_shipdate, l_partkey, l_suppkey, l_extendedprice)) AS p "
    "FROM lineitem GROUP BY l_orderkey, l_linenumber)) AS first_prices")
def first_of_duplicates(spark, d):
    """Repeated keys after a union: the guard, and the first row of each by a stated order."""
    li = read(spark, d, "lineitem")
    first = li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min_by("l_extendedprice", F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")).alias("p"))
    return first.agg(F.count_if(F.col("n") > 1).alias("repeated_keys"), F.count("*").alias("kept"), F.round(F.sum("p"), 2).alias("first_prices"))


@query(CASES + ", u AS (SELECT source, 'A' AS model, score AS s, true_grade FROM ok UNION ALL SELECT source, 'B', second, true_grade "
    "FROM ok), st AS (SELECT source, model, s, count(*) FILTER (WHERE true_grade >= 2) AS p, count(*) FILTER (WHERE true_grade < 2) AS n "
    "FROM u GROUP BY 1, 2, 3), w AS (SELECT *, sum(n) OVER (PARTITION BY source, model ORDER BY s) - n AS below "
    "FROM st), a AS (SELECT source, model, sum(p * (below + n / 2.0)) / (CAST(sum(p) AS DOUBLE) * sum(n)) AS auc "
    "FROM w GROUP BY 1, 2) SELECT source, round(max(auc) FILTER (WHERE model = 'A'), 6) AS a, round(max(auc) FILTER (WHERE model = 'B'), 6) AS b, round(max(auc) FILTER (WHERE model = 'B') - max(auc) FILTER (WHERE model = 'A'), 6) AS gain "
    "FROM a GROUP BY 1")
def model_table(spark, d):
    """Models side by side for each source, in one aggregate."""
    both = F.array(F.struct(F.lit("A").alias("model"), F.col("score").alias("s")), F.struct(F.lit("B").alias("model"), F.col("second").alias("s")))
    u = evaluated(spark, d).select("source", ref().alias("y"), F.explode(both).alias("m")).select("source", "y", "m.*")
    a = R.auc(R.score_table(u, F.col("y"), "s", ["source", "model"]), ["source",
        "model"]).groupBy("source").agg(F.max(F.when(F.col("model") == "A", F.col("auc"))).alias("a"), F.max(F.when(F.col("model") == "B", F.col("auc"))).alias("b"))
    return a.select("source", r6("a", "a"), r6("b", "b"), r6(F.col("b") - F.col("a"), "gain"))


@query(CASES + ", c AS (SELECT source, group_id, sum(score) AS s, count(*) AS n FROM ok GROUP BY 1, 2), "
    "i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', 'idx', group_id)), group_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS nc "
    "FROM c), w AS (SELECT source, r.range AS r, CAST(CAST(concat('0x', substr(md5(concat_ws('|', 'mean', source, r.range, idx)), 1, 8)) AS UBIGINT) AS BIGINT) % nc AS idx "
    "FROM i, range(200) r), b AS (SELECT source, r, sum(s) / sum(n) AS v FROM w JOIN i USING (source, idx) "
    "GROUP BY 1, 2) SELECT source, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(v) AS valid "
    "FROM b GROUP BY 1")
def bootstrap_mean_by_site(spark, d):
    """Intervals of a mean for every site at once: strata in one set of draws."""
    c = evaluated(spark, d).groupBy("source", "group_id").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    b = B.stratum_sums(B.placed_clusters(c, "group_id", ["source"]), 200, "mean", ["s", "n"], ["source"]).select("source", (F.col("s") / F.col("n")).alias("v"))
    return b.groupBy("source").agg(r6(F.percentile("v", F.lit(0.025)), "low"), r6(F.percentile("v", F.lit(0.975)), "high"), F.count("v").alias("valid"))


@query(CASES + ", x AS (SELECT status, camera, source FROM cases WHERE status <> 'error'), m AS (SELECT * "
    "FROM (VALUES ('1-URGENT', 'cam_a'), ('2-HIGH', 'cam_b'), ('3-MEDIUM', 'cam_a')) t(camera, code)) "
    "SELECT coalesce(code, 'unknown') AS code, count(*) AS n, count(*) FILTER (WHERE code IS NULL) AS rejected "
    "FROM x LEFT JOIN m ON x.camera = m.camera GROUP BY 1")
def recoded_cameras(spark, d):
    """A dictionary recode whose unknown keys are counted."""
    code = F.create_map(*[F.lit(x) for kv in {"1-URGENT": "cam_a", "2-HIGH": "cam_b", "3-MEDIUM": "cam_a"}.items() for x in kv])
    x = cases(spark, d).filter("status <> 'error'").withColumn("code", F.try_element_at(code, F.col("camera")))
    return x.groupBy(F.coalesce("code", F.lit("unknown")).alias("code")).agg(F.count("*").alias("n"), F.count_if(F.col("code").isNull()).alias("rejected"))


@query("SELECT d.doc_id % 10 AS k, count(*) AS pairs, count(*) FILTER (WHERE l.quality = 1) AS good, bool_and(l.toxic IN (0, 1)) AS valid "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def one_to_one_join(spark, d):
    """An inner join after both sides were found unique."""
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    if not (L.duplicate_keys(docs, ["doc_id"]).isEmpty() and L.duplicate_keys(labels, ["doc_id"]).isEmpty()):
        raise ValueError("keys repeat")
    j = docs.select("doc_id").join(labels, "doc_id")
    return j.groupBy((F.col("doc_id") % 10).alias("k")).agg(F.count("*").alias("pairs"), F.count_if(F.col("quality") == 1).alias("good"),
        F.bool_and(F.col("toxic").isin(0, 1)).alias("valid"))


@query(CASES + ", r AS (SELECT source, count(*) FILTER (WHERE true_grade >= 2 AND pred >= 2) AS tp, count(*) FILTER (WHERE true_grade >= 2) AS p "
    "FROM ok GROUP BY 1) SELECT source, 'locked' AS tier, CAST(to_json({'source': source, 'sensitivity': CASE WHEN p = 0 THEN NULL ELSE CAST(round(1000 * CAST(tp AS DOUBLE) / p, 0) AS BIGINT) END}) AS VARCHAR) AS report "
    "FROM r")
def json_reports(spark, d):
    """A report a site as canonical JSON, undefined values as null."""
    k = M.rates(evaluated(spark, d), ref(), F.col("pred") >= 2, ["source"])
    body = F.to_json(F.struct("source", F.round(1000 * F.col("sensitivity")).cast("long").alias("sensitivity")), {"ignoreNullFields": "false"})
    return k.select("source", F.lit("locked").alias("tier"), body.alias("report"))


@query(sql_draws("size", "SELECT unnest([100, 200, 400]) AS size", 200, "concat('cc', size)") + " SELECT source, CAST(size AS INT) AS size, draws, round(mean_sens, 6) AS mean_sens, round(worst_sens, 6) AS worst_sens "
    "FROM ru WHERE rule = 'R2'")
def calibration_curves(spark, d):
    """How a site's fitted cut holds as its calibration sample grows."""
    ok, out = evaluated(spark, d), None
    for size in (100, 200, 400):
        own = calibration_summary(ok, size, 200, f"cc{size}", {"R2": RULES["R2"]}).withColumn("size", F.lit(size))
        out = own if out is None else out.unionByName(own)
    return out.select("source", "size", "draws", r6("mean_sens", "mean_sens"), r6("worst_sens", "worst_sens"))


@query()
def match_trace(spark, d):
    """How many truths are found as candidates come in by score."""
    from ..operators.geometry import trace_by_image

    e = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("image"), F.col("l_partkey").alias("left"), (F.col("l_orderkey") % 50).alias("right"))
    e = e.groupBy("image", "left", "right").agg(F.lit(1).alias("o")).withColumn("score", S.draw("mt", F.col("image"), F.col("left")) / 10000.0).drop("o")
    return trace_by_image(e)
