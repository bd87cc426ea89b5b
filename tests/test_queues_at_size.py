"""Workflows without a calendar against the calendar, and stations kept between batches."""

import os
import random
from datetime import datetime, timedelta, timezone

from cohortlens.functions.digests import leading32
from cohortlens.operators import queueing as Q
from cohortlens.streaming import replay


def test_flow_is_the_calendar():
    """Small whole numbers, so that events often happen at the same time."""
    pick = random.Random(5).choice
    for i in range(1500):
        w = Q.Workflow(patients=pick(range(1, 50)), horizon=pick([5.0, 30.0, 100.0, 400.0]), interarrival=pick([0.5, 1.0, 2.0, 7.0]), acquisition=pick([0.5, 1.0, 3.0]),
            recapture=pick([0.0, 1.0, 6.5]), upload=pick([0.0, 1.0, 3.0]), inference=pick([0.0, 1.0, 2.0]), review=pick([2.5, 3.0, 10.0]), reject=pick([0, 0.3, 1.0]),
            reject_again=pick([0, 0.3, 1.0]), retries=pick(range(4)), abandon=pick([0, 0.3]), refer=pick([0, 0.3, 1.0]), uncertain=pick([0, 0.2]), seed=str(i))
        assert Q.flow(w) == Q.calendar_of(w) == Q.simulate(w)


def test_digest_with_an_end():
    want = [Q._uniform("w", "quality", i, 1) for i in (9, 10, 11)]
    assert (leading32(b"w|quality|", 9, 12, b"|1") % 10000 / 10000).tolist() == want


def test_a_task_for_each_scenario(spark):
    """Twelve rows were put into one task by Spark, and ran one after the other."""
    s = spark.createDataFrame([(i, 5) for i in range(12)], "scenario long, patients long")
    assert Q.retry_sweep(s).rdd.glom().map(len).collect() == [1] * 12


def test_stream_queue_in_any_order(spark, tmp_path):
    """More events of a key than Arrow hands over at once, out of order; and a second batch, which begins where the first one ends."""
    order = list(range(25_000))
    random.Random(3).shuffle(order)
    frame = lambda ids: spark.createDataFrame([(i, "a" if i % 5 else None, datetime(2024, 1, 1) + timedelta(seconds=7 * i)) for i in ids], "event_id long, kind string, ts timestamp")
    (tmp_path / "in").mkdir()
    for n, ids in enumerate((order, [40, 20, 25_001])):
        frame(ids).coalesce(1).write.parquet(str(tmp_path / f"made{n}"))
        next((tmp_path / f"made{n}").glob("*.parquet")).rename(tmp_path / "in" / f"{n}.parquet")
        os.utime(tmp_path / "in" / f"{n}.parquet", (1000 + n, 1000 + n))
    stream = spark.readStream.schema(frame([]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r["event_id"], k): r["wait"] for k, r in enumerate(replay.served(stream, "kind", 9.0).orderBy("event_id", "wait").collect())}
    want, free, start = [], {}, datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp()
    for i in [*range(25_000), 20, 40, 25_001]:
        t, kind = start + 7 * i, bool(i % 5)
        at = max(t, free.get(kind, t))
        free[kind] = at + 9.0
        want.append((i, at - t))
    assert [(i, round(w, 6)) for (i, _), w in got.items()] == sorted((i, round(w, 6)) for i, w in want)
