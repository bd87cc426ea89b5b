"""First-come-first-served stations with deterministic service, as windows; and workflows with retries, as an event calendar."""

from __future__ import annotations

import hashlib
import heapq
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import leading32
from ..session import cut, ship


def station(df: DataFrame, by: Sequence[str], arrival: str, tie: str, service: Column, servers: Column | int = 1, prefix: str = "") -> DataFrame:
    """df with start and finish of each entity. With equal service times, entity i of c servers is the next of server i mod c, whose k-th start is max over j <= k of (arrival_j - j s), plus k s; that is one running maximum."""
    c = F.lit(servers) if isinstance(servers, int) else servers
    line = Window.partitionBy(*by).orderBy(arrival, tie)
    i = F.row_number().over(line) - 1
    d = df.withColumns({"_i": i, "_s": service.cast("double")})
    d = d.withColumns({"_lane": F.col("_i") % c, "_k": F.floor(F.col("_i") / c)})
    lane = Window.partitionBy(*by, "_lane").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    start = F.max(F.col(arrival) - F.col("_k") * F.col("_s")).over(lane) + F.col("_k") * F.col("_s")
    d = d.withColumn(f"{prefix}start", start).withColumn(f"{prefix}finish", F.col(f"{prefix}start") + F.col("_s"))
    return d.drop("_i", "_s", "_lane", "_k")


def long_station(df: DataFrame, by: Sequence[str], arrival: str, tie: str, service: Column, servers: Column | int = 1, prefix: str = "") -> DataFrame:
    """station() for queues that are too long for one task each.

    Rows are range-partitioned by (by, arrival, tie), so that a queue spreads over tasks. Places are counted inside a
    partition plus what the ones before hold of the queue; running maxima likewise, from each partition's maxima by lane.
    """
    c = F.lit(servers) if isinstance(servers, int) else servers
    order = [*by, arrival, tie]
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *by).orderBy(arrival, tie)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.groupBy("_part", *by).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")  # a row a queue and partition
    d = rows.withColumn("_at", F.row_number().over(inside) - 1).join(held, ["_part", *by])
    d = d.withColumns({"_i": F.col("_at") + F.col("_before"), "_s": service.cast("double")}).withColumns({"_lane": F.col("_i") % c, "_k": F.floor(F.col("_i") / c)})
    d = d.withColumn("_v", F.col(arrival) - F.col("_k") * F.col("_s"))
    lane = Window.partitionBy("_part", *by, "_lane").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    so_far = Window.partitionBy(*by, "_lane").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = d.groupBy("_part", *by, "_lane").agg(F.max("_v").alias("_m")).withColumn("_top", F.max("_m").over(so_far)).drop("_m")
    d = d.withColumn("_own", F.max("_v").over(lane)).join(tops, ["_part", *by, "_lane"])
    start = F.greatest("_own", "_top") + F.col("_k") * F.col("_s")
    d = d.withColumn(f"{prefix}start", start).withColumn(f"{prefix}finish", F.col(f"{prefix}start") + F.col("_s"))
    return d.drop("_part", "_at", "_before", "_i", "_s", "_lane", "_k", "_v", "_own", "_top")


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """df with the sum of value over each row and those before it in its group. Rows are range-partitioned by (by, order), and what lies in the partitions before comes from one sum a group and partition."""
    line = [*by, *order]
    rows = cut(df.repartitionByRange(*line).sortWithinPartitions(*line).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.groupBy("_part", *by).agg(F.sum(value).alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(earlier), F.lit(0))).drop("_s")  # a row a group and partition
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(held, ["_part", *by]).withColumn(out, F.sum(value).over(inside) + F.col("_before")).drop("_part", "_before")


def max_waiting(df: DataFrame, by: Sequence[str], arrival: str, start: str) -> DataFrame:
    """(by, max_waiting): most entities waiting at an arrival; starts at the same time go first. Spread over tasks, however long a queue."""
    up = df.select(*by, F.col(arrival).alias("t"), F.lit(1).alias("o"), F.lit(1).alias("d"))
    down = df.select(*by, F.col(start).alias("t"), F.lit(0).alias("o"), F.lit(-1).alias("d"))
    at = up.unionByName(down).groupBy(*by, "t", "o").agg(F.sum("d").alias("d"))  # what happens at one time and place in the order; the last of several arrivals sees most
    e = running_total(at, by, ["t", "o"], "d", "n")
    return e.filter("o = 1").groupBy(*by).agg(F.max(F.greatest(F.col("n"), F.lit(0))).alias("max_waiting"))


def utilisation(start: Column, finish: Column, horizon: Column, servers: Column) -> Column:
    """An aggregate: the share of server time in use up to the horizon."""
    return F.sum(F.greatest(F.least(finish, horizon) - start, F.lit(0.0))) / (F.first(horizon) * F.first(servers))


def time_weighted_mean(df: DataFrame, by: Sequence[str], t: str, value: str, horizon: float) -> DataFrame:
    """(by, mean, peak, last) of a step function up to the horizon.

    The weighted sum needs no row beside its neighbour: a value holds from its own time to the next, so each partition of the
    range-partitioned rows sums its own steps, and the step across a cut is added from the partitions' first and last rows.
    """
    rows = cut(df.select(*by, F.col(t).alias("_t"), F.col(value).alias("_v")).repartitionByRange(*by, "_t").sortWithinPartitions(*by, "_t").withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part", *by).orderBy("_t")
    step = F.lead("_t").over(w) - F.col("_t")
    held = rows.withColumn("_w", step).groupBy("_part", *by).agg(F.sum(F.col("_v") * F.col("_w")).alias("_a"), F.sum("_w").alias("_n"),
        F.min("_t").alias("_first"), F.max("_t").alias("_end"), F.max_by("_v", "_t").alias("_last"), F.max("_v").alias("_peak"))
    parts = Window.partitionBy(*by).orderBy("_part")  # a row a group and partition
    held = held.withColumn("_to", F.coalesce(F.lead("_first").over(parts), F.lit(horizon)) - F.col("_end"))
    total = F.sum(F.coalesce("_a", F.lit(0.0)) + F.col("_last") * F.col("_to"))
    return held.groupBy(*by).agg((total / F.sum(F.coalesce("_n", F.lit(0.0)) + F.col("_to"))).alias("mean"), F.max("_peak").alias("peak"), F.max_by("_last", "_part").alias("last"))


@dataclass(frozen=True)
class Workflow:
    """Times in seconds; a rejected patient comes back to the acquisition queue after a recapture, at most `retries` times."""

    patients: int = 1
    horizon: float = 30.0
    interarrival: float = 1000.0
    acquisition: float = 2.0
    recapture: float = 4.0
    upload: float = 3.0
    inference: float = 1.0
    review: float = 20.0
    clinicians: int = 1
    reject: float = 0.0
    reject_again: float = 0.0
    retries: int = 2
    abandon: float = 0.0
    refer: float = 0.0
    uncertain: float = 0.0
    seed: str = "w"


def _uniform(*key) -> float:
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:8], 16) % 10000 / 10000


#: Patients whose draws are made at once.
_DRAWN = 1 << 16


class _Station:
    def __init__(self, service: float, servers: int):
        self.service, self.servers, self.free, self.queue, self.peak, self.waits, self.busy = service, servers, servers, deque(), 0, [], 0.0


def simulate(w: Workflow) -> dict:
    """Counts, waits and peaks of a workflow; events at the horizon still happen. Draws depend on seed, patient and attempt only.

    One shared queue with feedback is sequential: each event depends on all before. What runs in parallel are scenarios and,
    for a larger population, independent sites or replicates, each a scenario with its own patients and seed.
    """
    plain = w.patients >= 1 and w.clinicians == 1 and min(w.acquisition, w.interarrival) > 0 and min(w.recapture, w.upload, w.inference) >= 0 and w.review > w.inference
    return flow(w) if plain else calendar_of(w)


def flow(w: Workflow) -> dict:
    """simulate() without a calendar: every station serves one after the other, so a patient goes through all of them at once, and who returns comes back in the order of leaving. Arrivals come before returns of the same time.

    That a review ends before another patient comes to it at the same time needs reviews that last longer than inference.
    """
    acquisition, recapture, upload, inference, review, horizon, retries = w.acquisition, w.recapture, w.upload, w.inference, w.review, w.horizon, w.retries
    never = float("inf")
    generated = completed = reviewed = abandoned = exhausted = started = checks = came_back = pending = peak = n_waits = 0
    free_a = free_u = free_i = free_r = -never
    waited = busy = 0.0
    back: deque = deque()
    waiting: deque = deque()
    arrivals = min(w.patients, int(horizon // w.interarrival) + 1)
    at, until, cleared = 0, 0, 1 - w.refer - w.uncertain
    bad: list[bool] = []
    clear: list[bool] = []
    arrival = 0.0
    while True:
        back_at = back[0][0] if back else never
        if at < arrivals and (arrival := at * w.interarrival) <= back_at:
            entry = arrival
            if entry > horizon:
                break
            if at == until:
                base, until = at, min(at + _DRAWN, arrivals)
                bad = (leading32(f"{w.seed}|quality|".encode(), base, until, b"|1") % 10000 / 10000 < w.reject).tolist()
                clear = (leading32(f"{w.seed}|route|".encode(), base, until) % 10000 / 10000 < cleared).tolist()
            patient, attempt, failed, direct = at, 1, bad[at - base], clear[at - base]
            at += 1
            generated += 1
        elif back_at <= horizon:
            entry, patient, attempt, direct = back.popleft()
            came_back += 1
            failed = _uniform(w.seed, "quality", patient, attempt) < w.reject_again
        else:
            break
        start = entry if entry > free_a else free_a
        if start > horizon:  # it waits, as do all behind it
            free_a = never
            continue
        started += 1
        free_a = done = start + acquisition
        if done > horizon:
            continue
        checks += 1
        if failed:
            if attempt > retries:
                exhausted += 1
            elif _uniform(w.seed, "abandon", patient, attempt) < w.abandon:
                abandoned += 1
            elif done + recapture <= horizon:
                back.append((done + recapture, patient, attempt + 1, direct))
            else:
                pending += 1
            continue
        free_u = (done if done > free_u else free_u) + upload
        if free_u > horizon:
            continue
        free_i = came = (free_u if free_u > free_i else free_i) + inference
        if came > horizon:
            continue
        if direct:
            completed += 1
            continue
        start = came if came > free_r else free_r
        free_r = start + review
        while waiting and waiting[0] <= came:
            waiting.popleft()
        if start > came:
            waiting.append(start)
            peak = max(peak, len(waiting))
        if start <= horizon:
            n_waits += 1
            waited += start - came
            busy += max(0.0, min(free_r, horizon) - start)
        if free_r <= horizon:
            completed += 1
            reviewed += 1
    return {"generated": generated, "completed": completed, "reviewed": reviewed, "abandoned": abandoned, "exhausted": exhausted, "attempts_started": started,
        "quality_checks": checks, "recapture_returns": came_back, "in_system": generated - completed - abandoned - exhausted, "recapture_pending": pending,
        "max_review_queue": peak, "review_wait": waited / n_waits if n_waits else None, "clinician_utilisation": busy / (horizon * w.clinicians)}


def calendar_of(w: Workflow) -> dict:
    """simulate() by an event calendar, for any settings."""
    st = {"acquire": _Station(w.acquisition, 1), "recapture": _Station(w.recapture, w.patients), "upload": _Station(w.upload, 1),
        "infer": _Station(w.inference, 1), "review": _Station(w.review, w.clinicians)}
    out = dict.fromkeys(("generated", "completed", "reviewed", "abandoned", "exhausted", "attempts_started", "quality_checks", "recapture_returns"), 0)
    calendar: list[tuple] = []
    order = 0

    def at(t, what, *args):
        nonlocal order
        order += 1
        heapq.heappush(calendar, (t, order, what, args))

    def enter(name, t, who):
        s = st[name]
        s.queue.append((t, who))
        s.peak = max(s.peak, len(s.queue) - (s.free > 0))
        serve(name, t)

    def serve(name, t):
        s = st[name]
        while s.free and s.queue:
            came, who = s.queue.popleft()
            s.free -= 1
            s.waits.append(t - came)
            s.busy += max(0.0, min(t + s.service, w.horizon) - t)
            if name == "acquire":
                out["attempts_started"] += 1
            at(t + s.service, "done", name, who)

    for i in range(min(w.patients, int(w.horizon // w.interarrival) + 1)):
        at(i * w.interarrival, "arrive", i)
    while calendar and calendar[0][0] <= w.horizon:
        t, _, what, args = heapq.heappop(calendar)
        if what == "arrive":
            out["generated"] += 1
            enter("acquire", t, (args[0], 1))
            continue
        name, who = args
        st[name].free += 1
        serve(name, t)
        patient, attempt = who
        if name == "acquire":
            out["quality_checks"] += 1
            if not _uniform(w.seed, "quality", patient, attempt) < (w.reject if attempt == 1 else w.reject_again):
                enter("upload", t, who)
            elif attempt > w.retries:
                out["exhausted"] += 1
            elif _uniform(w.seed, "abandon", patient, attempt) < w.abandon:
                out["abandoned"] += 1
            else:
                enter("recapture", t, who)
        elif name == "recapture":
            out["recapture_returns"] += 1
            enter("acquire", t, (patient, attempt + 1))
        elif name == "upload":
            enter("infer", t, who)
        elif name == "infer":
            if _uniform(w.seed, "route", patient) < 1 - w.refer - w.uncertain:
                out["completed"] += 1
            else:
                enter("review", t, who)
        else:
            out["completed"] += 1
            out["reviewed"] += 1
    out["in_system"] = sum(len(s.queue) + s.servers - s.free for s in st.values())  # who waits, and who is served
    rev = st["review"]
    out |= {"recapture_pending": len(st["recapture"].queue) + (max(1, w.patients) - st["recapture"].free), "max_review_queue": rev.peak,
        "review_wait": sum(rev.waits) / len(rev.waits) if rev.waits else None, "clinician_utilisation": rev.busy / (w.horizon * w.clinicians)}
    return out


RESULT = "scenario long, generated long, completed long, reviewed long, abandoned long, exhausted long, attempts_started long, quality_checks long, recapture_returns long, in_system long, recapture_pending long, max_review_queue long, review_wait double, clinician_utilisation double"


def retry_sweep(scenarios: DataFrame) -> DataFrame:
    """One simulation for each row of scenarios (scenario, and any fields of Workflow); scenarios run in parallel, each in one task."""
    ship(scenarios.sparkSession)
    fields = [c for c in scenarios.columns if c != "scenario"]

    def run(batches):
        for rows in batches:
            for r in rows.to_dict("records"):
                yield pd.DataFrame([{"scenario": r["scenario"]} | simulate(Workflow(**{f: r[f] for f in fields}))])[[x.split()[0] for x in RESULT.split(", ")]]

    # As many tasks as scenarios: groups of so few rows would be put into one task.
    return scenarios.repartitionByRange(max(1, scenarios.count()), "scenario").mapInPandas(run, RESULT)
