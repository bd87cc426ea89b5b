"""Queries on queues: single stations, the capacity sweep over scenarios, retries."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import queueing as Q
from .cohort import read, sql_draw

QUERIES, SQL = {}, {}
HORIZON = 250 * 8 * 3600.0
#: Fixed values of the sweep: bandwidths in Mbit/s, reviewers, rejection rates; seconds of each station; routing rates.
BANDWIDTHS, CLINICIANS, REJECTS = (0.25, 1.0, 5.0), (1, 2), (0.05, 0.10, 0.20)
ACQUIRE, RECAPTURE, INFER, REVIEW, MEGABITS = 45.0, 120.0, 3.5, 30.0, 56.0
REFER, UNCERTAIN, ESCALATE = 0.08, 0.0123, 86400.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _arrivals(spark, d):
    e = read(spark, d, "events")
    # Microseconds of a wall-clock time, whatever the session's zone.
    e = e.withColumn("us", F.expr("(unix_date(date(ts)) * 86400L + hour(ts) * 3600 + minute(ts) * 60) * 1000000L + cast(extract(SECOND FROM ts) * 1000000 AS bigint)"))
    first = e.agg(F.min("us").alias("us0"))
    return e.crossJoin(F.broadcast(first)).select("event_id", "user_id", "event_type", ((F.col("us") - F.col("us0")) / 1e6).alias("t"))  # one row


_ARR = "WITH a AS (SELECT event_id, user_id, event_type, CAST(epoch_us(ts) - min(epoch_us(ts)) OVER () AS DOUBLE) / 1e6 AS t FROM events)"


def _sql_station(src: str, by: str, arrival: str, tie: str, service: str, servers: str, out: str) -> str:
    p = f"PARTITION BY {by}" if by else ""
    lane = f"PARTITION BY {by + ', ' if by else ''}z_i % ({servers}) ORDER BY z_k ROWS UNBOUNDED PRECEDING"
    start = f"max({arrival} - z_k * CAST({service} AS DOUBLE)) OVER ({lane}) + z_k * CAST({service} AS DOUBLE)"
    return f"""{out}_zi AS (SELECT *, row_number() OVER ({p} ORDER BY {arrival}, {tie}) - 1 AS z_i FROM {src}),
{out}_zk AS (SELECT *, z_i // ({servers}) AS z_k FROM {out}_zi),
{out} AS (SELECT * EXCLUDE (z_i, z_k), {start} AS {out}_start, {start} + CAST({service} AS DOUBLE) AS {out}_finish FROM {out}_zk)"""


_S1 = _ARR + ", " + _sql_station("a", "event_type", "t", "event_id", "300", "1", "q")
_SC = _ARR + ", " + _sql_station("a", "event_type", "t", "event_id", "900", "3", "q")


@query(_S1 + " SELECT event_type, count(*) AS n, round(avg(q_start - t), 6) AS mean_wait, round(max(q_finish), 6) AS last_finish FROM q GROUP BY 1")
def queue_single(spark, d):
    """By the form for long queues, which spreads each over tasks."""
    q = Q.long_station(_arrivals(spark, d), ["event_type"], "t", "event_id", F.lit(300.0))
    return q.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(F.col("start") - F.col("t")), 6).alias("mean_wait"), F.round(F.max("finish"), 6).alias("last_finish"))


@query(_SC + " SELECT event_type, count(*) AS n, round(avg(q_start - t), 6) AS mean_wait, round(quantile_cont(q_start - t, 0.5), 6) AS p50, round(quantile_cont(q_start - t, 0.9), 6) AS p90, round(quantile_cont(q_start - t, 0.95), 6) AS p95 "
    "FROM q GROUP BY 1")
def queue_multi(spark, d):
    q = Q.long_station(_arrivals(spark, d), ["event_type"], "t", "event_id", F.lit(900.0), 3).withColumn("w", F.col("start") - F.col("t"))
    return q.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("w"), 6).alias("mean_wait"),
        F.percentile("w", [0.5, 0.9, 0.95]).alias("p")).select("event_type", "n", "mean_wait",
        *[F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate(("p50", "p90", "p95"))])


@query(_S1 + ", e AS (SELECT event_type, t, 1 AS o, 1 AS d FROM q UNION ALL SELECT event_type, q_start, 0, -1 "
    "FROM q), w AS (SELECT event_type, o, sum(d) OVER (PARTITION BY event_type ORDER BY t, o, d ROWS UNBOUNDED PRECEDING) AS n "
    "FROM e) SELECT event_type, CAST(max(greatest(n, 0)) AS BIGINT) AS max_waiting FROM w WHERE o = 1 "
    "GROUP BY 1")
def queue_max_waiting(spark, d):
    return Q.max_waiting(Q.long_station(_arrivals(spark, d), ["event_type"], "t", "event_id", F.lit(300.0)), ["event_type"], "t", "start")


@query(_SC + ", h AS (SELECT max(t) AS h FROM a) SELECT event_type, round(sum(greatest(least(q_finish, h) - q_start, 0)) / (any_value(h) * 3), 6) AS utilisation, count(*) FILTER (WHERE q_finish > h) AS unfinished "
    "FROM q, h GROUP BY 1")
def queue_utilization(spark, d):
    a = _arrivals(spark, d)
    q = Q.long_station(a, ["event_type"], "t", "event_id", F.lit(900.0), 3).crossJoin(F.broadcast(a.agg(F.max("t").alias("h"))))  # one row
    return q.groupBy("event_type").agg(F.round(Q.utilisation(F.col("start"), F.col("finish"), F.col("h"), F.lit(3.0)), 6).alias("utilisation"),
        F.count_if(F.col("finish") > F.col("h")).alias("unfinished"))


@query(_ARR + ", s AS (SELECT user_id AS k, t, count(*) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) % 5 AS v "
    "FROM (SELECT *, row_number() OVER (PARTITION BY user_id, t ORDER BY event_id) AS r FROM a) "
    "WHERE r = 1), n AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY k ORDER BY t), CAST(7200000 AS DOUBLE)) - t AS w "
    "FROM s) SELECT k, round(sum(v * w) / sum(w), 6) AS mean, max(v) AS peak, max_by(v, t) AS last "
    "FROM n GROUP BY 1")
def time_weighted_occupancy(spark, d):
    a = _arrivals(spark, d).withColumn("k", F.col("user_id"))
    a = a.withColumn("r", F.row_number().over(Window.partitionBy("k", "t").orderBy("event_id"))).filter("r = 1")
    s = Q.running_total(a.withColumn("one", F.lit(1)), ["k"], ["t", "event_id"], "one", "seen").withColumn("v", F.col("seen") % 5)
    return Q.time_weighted_mean(s, ["k"], "t", "v", 7200000.0).select("k", F.round("mean", 6).alias("mean"), "peak", "last")


def scenarios(spark):
    rows = [(i, b, c, r) for i, (b, c, r) in enumerate(product(BANDWIDTHS, CLINICIANS, REJECTS))]
    return spark.createDataFrame(rows, "scenario int, bandwidth double, clinicians int, reject double")


def sweep(spark, d):
    """All entities of all scenarios with their times at every station; one job. Entities still under way at the horizon have null in the later stations' columns."""
    n = read(spark, d, "events").count()
    e = F.broadcast(scenarios(spark)).crossJoin(spark.range(n + 1).select(F.col("id").alias("i")))  # 18 rows
    e = e.withColumn("t0", F.col("i") * F.lit(HORIZON / n))
    by = ["scenario"]
    e = Q.long_station(e, by, "t0", "i", F.lit(ACQUIRE), prefix="a_")
    taken = e.filter(F.col("a_finish") <= HORIZON).withColumn("rejected", S.uniform("quality", F.col("scenario"), F.col("i")) < F.col("reject"))
    again = Q.long_station(taken.filter("rejected"), by, "a_finish", "i", F.lit(RECAPTURE), prefix="r_")
    up = Q.long_station(taken.filter("NOT rejected"), by, "a_finish", "i", F.lit(MEGABITS) / F.col("bandwidth"), prefix="u_")
    ai = Q.long_station(up.filter(F.col("u_finish") <= HORIZON), by, "u_finish", "i", F.lit(INFER), prefix="n_")
    routed = ai.filter(F.col("n_finish") <= HORIZON).withColumn("route", S.uniform("route", F.col("scenario"), F.col("i")))
    auto = routed.filter(F.col("route") < F.lit(1 - REFER - UNCERTAIN))
    review = Q.long_station(routed.filter(F.col("route") >= F.lit(1 - REFER - UNCERTAIN)), by, "n_finish", "i", F.lit(REVIEW), F.col("clinicians"), prefix="v_")
    return e, again, up, ai, auto, review


_AUTO = 1 - REFER - UNCERTAIN
_SWEEP = f"""WITH n AS (SELECT count(*) AS n FROM events), sc AS (SELECT CAST(row_number() OVER (ORDER BY b.o, c.o, r.o) - 1 AS INT) AS scenario, b.v AS bandwidth, c.v AS clinicians, r.v AS reject FROM
(SELECT unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in BANDWIDTHS)}]) AS v, unnest([1, 2, 3]) AS o) b, (SELECT unnest([1, 2]) AS v, unnest([1, 2]) AS o) c, (SELECT unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in REJECTS)}]) AS v, unnest([1, 2, 3]) AS o) r),
e0 AS (SELECT sc.*, g.range AS i, g.range * (CAST({HORIZON} AS DOUBLE) / n.n) AS t0 FROM sc, n, range(0, (SELECT count(*) + 1 FROM events)) g),
""" + _sql_station("e0", "scenario", "t0", "i", str(ACQUIRE), "1", "a") + f""",
tk AS (SELECT *, CAST({sql_draw('quality', "concat_ws('|', scenario, i)")} AS DOUBLE) / 10000 < reject AS rejected FROM (SELECT scenario, bandwidth, clinicians, reject, i, t0, a_start, a_finish FROM a WHERE a_finish <= {HORIZON})),
rj AS (SELECT * FROM tk WHERE rejected), ac AS (SELECT *, CAST({MEGABITS} AS DOUBLE) / bandwidth AS us FROM tk WHERE NOT rejected),
""" + ", ".join([
    _sql_station("rj", "scenario", "a_finish", "i", str(RECAPTURE), "1", "r"),
    _sql_station("ac", "scenario", "a_finish", "i", "us", "1", "u"),
    f"us AS (SELECT * FROM u WHERE u_finish <= {HORIZON})",
    _sql_station("us", "scenario", "u_finish", "i", str(INFER), "1", "n2"),
    f"rt AS (SELECT *, CAST({sql_draw('route', chr(99) + 'oncat_ws(' + chr(39) + '|' + chr(39) + ', scenario, i)')} AS DOUBLE) / 10000 AS route FROM n2 WHERE n2_finish <= {HORIZON})",
    f"rv AS (SELECT * FROM rt WHERE route >= CAST({_AUTO!r} AS DOUBLE))",
    _sql_station("rv", "scenario", "n2_finish", "i", str(REVIEW), "clinicians", "v"),
])
_SWEEP_OUT = f""", s1 AS (SELECT scenario, any_value(bandwidth) AS bandwidth, any_value(clinicians) AS clinicians, any_value(reject) AS reject, count(*) AS generated, sum(greatest(least(a_finish, {HORIZON}) - a_start, 0)) / {HORIZON} AS acquisition_utilisation FROM a GROUP BY 1),
s2 AS (SELECT scenario, count(*) FILTER (WHERE r_finish <= {HORIZON}) AS recaptures FROM r GROUP BY 1), s3 AS (SELECT scenario, sum(greatest(least(u_finish, {HORIZON}) - u_start, 0)) / {HORIZON} AS upload_utilisation FROM u GROUP BY 1),
s4 AS (SELECT scenario, count(*) FILTER (WHERE route < CAST({_AUTO!r} AS DOUBLE)) AS auto_cleared FROM rt GROUP BY 1),
s5 AS (SELECT scenario, count(*) AS routed, count(*) FILTER (WHERE v_finish <= {HORIZON}) AS reviewed, avg(v_start - n2_finish) FILTER (WHERE v_start <= {HORIZON}) AS wait, quantile_cont(v_start - n2_finish, 0.95) FILTER (WHERE v_start <= {HORIZON}) AS p95,
count(*) FILTER (WHERE (v_start <= {HORIZON} AND v_start - n2_finish > {ESCALATE}) OR (v_start > {HORIZON} AND {HORIZON} - n2_finish > {ESCALATE})) AS escalations, sum(greatest(least(v_finish, {HORIZON}) - v_start, 0)) / ({HORIZON} * any_value(clinicians)) AS clinician_utilisation FROM v GROUP BY 1),
j AS (SELECT s1.*, recaptures, upload_utilisation, coalesce(auto_cleared, 0) AS auto_cleared, coalesce(routed, 0) AS routed, coalesce(reviewed, 0) AS reviewed, wait, p95, coalesce(escalations, 0) AS escalations, clinician_utilisation FROM s1 LEFT JOIN s2 USING (scenario) LEFT JOIN s3 USING (scenario) LEFT JOIN s4 USING (scenario) LEFT JOIN s5 USING (scenario))"""


def sweep_summary(spark, d):
    e, again, up, _, auto, review = sweep(spark, d)
    h = F.lit(HORIZON)
    one = F.lit(1.0)
    s1 = e.groupBy("scenario").agg(F.first("bandwidth").alias("bandwidth"), F.first("clinicians").alias("clinicians"),
        F.first("reject").alias("reject"), F.count("*").alias("generated"), Q.utilisation(F.col("a_start"), F.col("a_finish"), h, one).alias("acquisition_utilisation"))
    s2 = again.groupBy("scenario").agg(F.count_if(F.col("r_finish") <= h).alias("recaptures"))
    s3 = up.groupBy("scenario").agg(Q.utilisation(F.col("u_start"), F.col("u_finish"), h, one).alias("upload_utilisation"))
    s4 = auto.groupBy("scenario").agg(F.count("*").alias("auto_cleared"))
    wait, began = F.col("v_start") - F.col("n_finish"), F.col("v_start") <= h
    s5 = review.groupBy("scenario").agg(F.count("*").alias("routed"), F.count_if(F.col("v_finish") <= h).alias("reviewed"),
        F.avg(F.when(began, wait)).alias("wait"), F.percentile(F.when(began, wait), F.lit(0.95)).alias("p95"),
        F.count_if((began & (wait > ESCALATE)) | (~began & (h - F.col("n_finish") > ESCALATE))).alias("escalations"),
        Q.utilisation(F.col("v_start"), F.col("v_finish"), h, F.col("clinicians").cast("double")).alias("clinician_utilisation"))
    out = s1
    for s in (s2, s3, s4, s5):
        out = out.join(s, "scenario", "left")
    return out.fillna(0, ["auto_cleared", "routed", "reviewed", "escalations"])


@query(_SWEEP + _SWEEP_OUT + f" SELECT scenario, bandwidth, clinicians, reject, generated, recaptures, auto_cleared, routed, reviewed, auto_cleared + reviewed AS completed, escalations, round(wait, 3) AS mean_wait, round(p95, 3) AS p95_wait, round(acquisition_utilisation, 6) AS acquisition_utilisation, round(upload_utilisation, 6) AS upload_utilisation, round(clinician_utilisation, 6) AS clinician_utilisation, greatest(1, CAST(ceil(generated * (1 - reject) * CAST({REFER + UNCERTAIN!r} AS DOUBLE) * {REVIEW} / ({HORIZON} * CAST(0.8 AS DOUBLE))) AS BIGINT)) AS required_clinicians "
    f"FROM j")
def scenario_sweep(spark, d):
    s = sweep_summary(spark, d)
    need = S.required_servers(F.col("generated") * (1 - F.col("reject")) * F.lit(REFER + UNCERTAIN) / HORIZON, F.lit(REVIEW))
    return s.select("scenario", "bandwidth", "clinicians", "reject", "generated", "recaptures", "auto_cleared", "routed", "reviewed",
        (F.col("auto_cleared") + F.col("reviewed")).alias("completed"), "escalations", F.round("wait", 3).alias("mean_wait"),
        F.round("p95", 3).alias("p95_wait"), *[F.round(c, 6).alias(c) for c in ("acquisition_utilisation", "upload_utilisation",
        "clinician_utilisation")], need.alias("required_clinicians"))


@query(_SWEEP + _SWEEP_OUT + f", i1 AS (SELECT scenario, count(*) FILTER (WHERE a_finish > {HORIZON}) AS acquiring "
    f"FROM a GROUP BY 1), i2 AS (SELECT scenario, count(*) AS rejected FROM rj GROUP BY 1), i3 AS (SELECT scenario, count(*) FILTER (WHERE u_finish > {HORIZON}) AS uploading "
    f"FROM u GROUP BY 1), i4 AS (SELECT scenario, count(*) FILTER (WHERE n2_finish > {HORIZON}) AS inferring "
    f"FROM n2 GROUP BY 1), i5 AS (SELECT scenario, count(*) FILTER (WHERE v_finish > {HORIZON}) AS reviewing "
    f"FROM v GROUP BY 1), k AS (SELECT j.scenario, generated, auto_cleared, reviewed, coalesce(acquiring, 0) AS acquiring, coalesce(rejected, 0) AS rejected, coalesce(uploading, 0) AS uploading, coalesce(inferring, 0) AS inferring, coalesce(reviewing, 0) AS reviewing "
    f"FROM j LEFT JOIN i1 USING (scenario) LEFT JOIN i2 USING (scenario) LEFT JOIN i3 USING (scenario) LEFT JOIN i4 USING (scenario) LEFT JOIN i5 USING (scenario)) "
    f"SELECT scenario, generated, acquiring, rejected, uploading, inferring, reviewing, acquiring + rejected + uploading + inferring + reviewing AS in_system, generated = auto_cleared + reviewed + acquiring + rejected + uploading + inferring + reviewing AS holds "
    f"FROM k")
def conservation(spark, d):
    """Who is still in the system is counted where they are: at each station beyond the horizon, or sent back for a recapture."""
    e, again, up, ai, auto, review = sweep(spark, d)
    late = lambda df, c, name: df.groupBy("scenario").agg(F.count_if(F.col(c) > HORIZON).alias(name))
    out = e.groupBy("scenario").agg(F.count("*").alias("generated"), F.count_if(F.col("a_finish") > HORIZON).alias("acquiring"))
    out = out.join(again.groupBy("scenario").agg(F.count("*").alias("rejected")), "scenario", "left").join(late(up, "u_finish", "uploading"),
        "scenario", "left").join(late(ai, "n_finish", "inferring"), "scenario", "left")
    out = out.join(review.groupBy("scenario").agg(F.count_if(F.col("v_finish") > HORIZON).alias("reviewing"), F.count_if(F.col("v_finish") <= HORIZON).alias("reviewed")), "scenario", "left")
    out = out.join(auto.groupBy("scenario").agg(F.count("*").alias("auto_cleared")), "scenario", "left").fillna(0)
    inside = F.col("acquiring") + F.col("rejected") + F.col("uploading") + F.col("inferring") + F.col("reviewing")
    return out.select("scenario", "generated", "acquiring", "rejected", "uploading", "inferring", "reviewing", inside.alias("in_system"),
        (F.col("generated") == F.col("auto_cleared") + F.col("reviewed") + inside).alias("holds"))


@query(_SWEEP + _SWEEP_OUT + """, xa AS (SELECT scenario, CAST(auto_cleared + reviewed AS DOUBLE) / generated AS rate FROM j), xb AS (SELECT scenario, rate + CASE WHEN scenario % 7 = 3 THEN CAST(0.02 AS DOUBLE) ELSE CAST(0.001 AS DOUBLE) END AS rate FROM xa) SELECT count(*) AS scenarios, count(*) FILTER (WHERE abs(a.rate - b.rate) > CAST(0.015 AS DOUBLE)) AS apart, bool_and(abs(a.rate - b.rate) <= CAST(0.015 AS DOUBLE)) AS agree, round(max(abs(a.rate - b.rate)), 6) AS largest FROM xa a JOIN xb b USING (scenario)""")
def sweep_comparison(spark, d):
    """Completion rates of two implementations held together by scenario; the second is played by shifted rates."""
    s = sweep_summary(spark, d).select("scenario", ((F.col("auto_cleared") + F.col("reviewed")) / F.col("generated")).alias("rate"))
    shift = F.when(F.col("scenario") % 7 == 3, 0.02).otherwise(0.001)
    other = s.select("scenario", (F.col("rate") + shift).alias("other"))
    gap = F.abs(F.col("rate") - F.col("other"))
    return s.join(other, "scenario").agg(F.count("*").alias("scenarios"), F.count_if(gap > 0.015).alias("apart"),
        F.bool_and(gap <= 0.015).alias("agree"), F.round(F.max(gap), 6).alias("largest"))


@query("WITH p AS (SELECT unnest([CAST(1.0 AS DOUBLE), CAST(3.5 AS DOUBLE), CAST(7.0 AS DOUBLE)]) AS megabytes), "
    "n AS (SELECT count(*) AS n FROM events) SELECT megabytes, 2 * megabytes * 8 / CAST(0.25 AS DOUBLE) AS upload_seconds, round(n * (2 * megabytes * 8 / CAST(0.25 AS DOUBLE)) / CAST(7200000 AS DOUBLE), 6) AS load "
    "FROM p, n")
def payload_what_if(spark, d):
    """Upload time and offered load as the image size changes."""
    p = spark.createDataFrame([(1.0,), (3.5,), (7.0,)], "megabytes double")
    up = 2 * F.col("megabytes") * 8 / F.lit(0.25)
    return p.crossJoin(read(spark, d, "events").agg(F.count("*").alias("n"))).select("megabytes", up.alias("upload_seconds"),
        F.round(F.col("n") * up / HORIZON, 6).alias("load"))  # three rows by one


@query("WITH g AS (SELECT c_custkey AS k, CAST(c_custkey % 10 AS DOUBLE) / 10 AS a, CAST(c_custkey % 5 AS DOUBLE) / 10 AS b "
    "FROM customer) SELECT a, b, count(*) AS n, round((1 - a) + a * CAST(0.9 AS DOUBLE) * ((1 - b) + b * CAST(0.9 AS DOUBLE) * (1 - b)), 6) AS accepted "
    "FROM g GROUP BY 1, 2")
def acceptance_probability(spark, d):
    g = read(spark, d, "customer").select(((F.col("c_custkey") % 10) / 10.0).alias("a"), ((F.col("c_custkey") % 5) / 10.0).alias("b"))
    return g.groupBy("a", "b").agg(F.count("*").alias("n")).select("a", "b", "n", F.round(S.acceptance_probability(F.col("a"), F.col("b"), 2, F.lit(0.1)), 6).alias("accepted"))


#: Name, settings and expected counts: generated, completed, abandoned, exhausted, in system, attempts started, quality checks, returns.
FIXTURES = [
    ("no_reject", {}, (1, 1, 0, 0, 0, 1, 1, 0)),
    ("zero_retries", {"reject": 1.0, "retries": 0}, (1, 0, 0, 1, 0, 1, 1, 0)),
    ("first_reject_then_success", {"reject": 1.0}, (1, 1, 0, 0, 0, 2, 2, 1)),
    ("repeated_rejection_exhaustion", {"reject": 1.0, "reject_again": 1.0}, (1, 0, 0, 1, 0, 3, 3, 2)),
    ("dropout", {"reject": 1.0, "abandon": 1.0}, (1, 0, 1, 0, 0, 1, 1, 0)),
    ("cutoff_mid_recapture", {"reject": 1.0, "horizon": 4.0}, (1, 0, 0, 0, 1, 1, 1, 0)),
    ("clinician_congestion", {"patients": 20, "interarrival": 3.0, "acquisition": 1.0, "upload": 1.0, "review": 10.0, "refer": 1.0}, (11, 2, 0, 0, 9, 11, 10, 0)),
]


@query()
def retry_workflow(spark, d):
    """Patients return to the acquisition queue they left: a feedback loop, which no window expresses. One scenario for each pair of rates."""
    rows = [(i, r, a) for i, (r, a) in enumerate(product((0.05, 0.1, 0.2, 0.4), (0.0, 0.1, 0.3)))]
    s = spark.createDataFrame(rows, "scenario long, reject double, abandon double")
    n = read(spark, d, "events").count()
    return Q.retry_sweep(s.select("scenario", "reject", F.col("reject").alias("reject_again"), "abandon", F.lit(n).alias("patients"),
        F.lit(72.0).alias("interarrival"), F.lit(72.0 * n).alias("horizon"), F.lit(45.0).alias("acquisition"), F.lit(120.0).alias("recapture"),
        F.lit(56.0).alias("upload"), F.lit(3.5).alias("inference"), F.lit(30.0).alias("review"), F.lit(0.08).alias("refer"), F.lit(0.0123).alias("uncertain")))
