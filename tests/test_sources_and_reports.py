"""Workbooks, images, reports, and the places and running sums that replace windows over large groups."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import indexing, policy, queueing, ranking, report, sampling, similarity
from cohortlens.sources import arrays, images, workbooks


def test_workbooks(spark):
    book = workbooks.workbook({"first": [["a", "b"], [1, "x & y"], [None, " "], [2.5, None, "far"]], "Ä": [["z"]]})
    files = spark.createDataFrame([("ok.xlsx", bytearray(book)), ("bad.xlsx", bytearray(b"no zip")), ("none.xlsx", None)], "path string, content binary")
    rows = workbooks.workbook_rows(files)
    got = [(r["sheet"], r["row"], r["cells"]) for r in rows.filter("path = 'ok.xlsx'").orderBy("row").collect()]
    assert got == [("first", 1, ["a", "b"]), ("first", 2, ["1", "x & y"]), ("first", 3, [None, " "]), ("first", 4, ["2.5", None, "far"])]
    assert rows.filter("error IS NOT NULL").count() == 2
    good = workbooks.workbook_rows(files.filter("path = 'ok.xlsx'"))
    table = workbooks.table_of(good, ["a", "b"])
    assert [(r["row"], r["a"], r["b"]) for r in table.orderBy("row").collect()] == [(2, "1", "x & y"), (4, "2.5", None)]
    assert [r["cells"] for r in workbooks.workbook_rows(files.limit(1), "Ä").collect()] == [["z"]]
    assert "no sheet" in workbooks.workbook_rows(files.limit(1), "gone").collect()[0]["error"]
    with pytest.raises(ValueError, match="header"):
        workbooks.table_of(good, ["a", "c"])
    with pytest.raises(ValueError, match="Zip"):
        workbooks.table_of(rows.filter("path = 'bad.xlsx'"), ["a"])
    assert [workbooks.column_number(c) for c in ("A1", "Z9", "AA1", "BC7")] == [0, 25, 26, 54]


def test_shared_strings_and_gaps(spark):
    import io
    import zipfile

    out = io.BytesIO(workbooks.workbook({"s": [["x"]]}))
    with zipfile.ZipFile(out, "a") as z:
        main = workbooks._MAIN[1:-1]
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r></si></sst>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="3"><c r="C3" t="s"><v>1</v></c></row><row><c t="s"><v>0</v></c><c><f>A1</f><v>7</v></c></row></sheetData></worksheet>')
    assert list(workbooks.sheet_rows(out.getvalue())) == [("s", 3, [None, None, "two"]), ("s", 4, ["one", "7"])]


def test_images(spark):
    rng = np.random.default_rng(3)
    pixels = rng.integers(0, 256, (9, 13))
    good = images.encode_png(pixels)
    assert np.array_equal(images.decode_png(good)[:, :, 0], pixels)
    files = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(good[:40])), ("c", bytearray(b"text")), ("d", None)], "path string, content binary")
    got = {r["path"]: r for r in images.measure(files).collect()}
    assert (got["a"]["status"], got["a"]["width"], got["a"]["height"]) == ("success", 13, 9) and math.isclose(got["a"]["mean"], pixels.mean())
    assert all(got[k]["status"] == "error" and got[k]["message"] for k in "bcd") and images.measure(files.limit(0)).count() == 0


def test_filtered_images():
    """Each of PNG's filters, undone."""
    import struct
    import zlib

    rng = np.random.default_rng(4)
    x = rng.integers(0, 256, (6, 5, 3))
    full = np.zeros((7, 6, 3), int)
    full[1:, 1:] = x
    lines = []
    for y, kind in enumerate((0, 1, 2, 3, 4, 4)):
        left, up, corner = full[y + 1, :-1], full[y, 1:], full[y, :-1]
        p = left + up - corner
        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
        guess = [np.zeros_like(left), left, up, (left + up) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))][kind]
        lines.append(bytes([kind]) + ((x[y] - guess) % 256).astype(np.uint8).tobytes())
    data = images._MAGIC + images._chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + images._chunk(b"IDAT", zlib.compress(b"".join(lines))) + images._chunk(b"IEND", b"")
    assert np.array_equal(images.decode_png(data), x)


def test_hash_places(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).alias("g"), "id", (F.col("id") % 7).alias("size"))
    order = F.md5(F.col("id").cast("string"))
    got = indexing.in_hash_order(df.withColumn("h", order), ["g"], order, "id", F.col("size"), 1).collect()
    for g in (True, False):
        own, at = sorted((r for r in got if r["g"] == g), key=lambda r: r["h"]), 0
        for place, r in enumerate(own):
            assert (r["_place"], r["_before"]) == (place, at)
            at += r["size"]
    assert sampling.standardised(df, "g", "size", "z").count() == 5000


def test_running_sums_over_raw_scores(spark):
    rng = random.Random(6)
    rows = [(rng.choice([rng.uniform(-9, 9), 0.25, 1 / 3]), rng.randint(0, 3), rng.randint(0, 3), rng.choice("ab")) for _ in range(800)]
    t = spark.createDataFrame(rows, "score double, pos int, neg int, g string").groupBy("g", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    for r in ranking.running(t, ["g"], "score", ["pos", "neg"], descending=True).collect():
        assert r["cum_pos"] == sum(p for s, p, _, g in rows if g == r["g"] and s >= r["score"]) and r["all_neg"] == sum(n for _, _, n, g in rows if g == r["g"])
    got = {r["g"]: r["auc"] for r in ranking.auc(t, ["g"]).collect()}
    for g in "ab":
        own = [(s, p, n) for s, p, n, x in rows if x == g]
        wins = sum(p * n * ((s > u) + (s == u) / 2) for s, p, _ in own for u, _, n in own)
        assert math.isclose(got[g], wins / (sum(p for _, p, _ in own) * sum(n for _, _, n in own)))


def test_boundary_by_group(spark):
    rng = random.Random(2)
    rows = [(g, round(rng.uniform(0, 4), 2), rng.random() < 0.5) for g in "ab" for _ in range(300)] + [("few", 1.0, True)]
    df = spark.createDataFrame(rows, "g string, s double, y boolean")
    for r in policy.boundary(df, F.col("y"), "s", 0.9, ["g"], fallback=1.5).collect():
        pos = sorted(s for g, s, y in rows if g == r["g"] and y)
        want = pos[math.floor((1 - 0.9) * len(pos))] - 1e-9 if len(pos) >= 5 else 1.5
        assert r["n_pos"] == len(pos) and math.isclose(r["cut"], want)


def test_long_queues_are_spread(spark):
    """Stations, waiting lines and step functions over several ranges of one queue, against a loop."""
    rng = random.Random(9)
    rows = [(i, "one" if i % 3 else "two", float(rng.randint(0, 4000))) for i in range(1500)]
    df = spark.createDataFrame(rows, "i long, k string, t double").repartition(7)
    q = queueing.long_station(df, ["k"], "t", "i", F.lit(5.0), 2)
    start = {r["i"]: r["start"] for r in q.collect()}
    waiting = {r["k"]: r["max_waiting"] for r in queueing.max_waiting(q, ["k"], "t", "start").collect()}
    steps = {r["k"]: r for r in queueing.time_weighted_mean(df.groupBy("k", "t").agg(F.max("i").alias("v")), ["k"], "t", "v", 5000.0).collect()}
    for k in ("one", "two"):
        own = sorted((t, i) for i, x, t in rows if x == k)
        free = [0.0, 0.0]
        for t, i in own:
            free.sort()
            assert start[i] == max(t, free[0])
            free[0] = start[i] + 5.0
        assert waiting[k] == max(sum(u <= t for u, _ in own) - sum(start[j] <= t for _, j in own) for t, _ in own)
        line = {t: max(i for u, i in own if u == t) for t, _ in own}
        at = [*sorted(line), 5000.0]
        mean = sum(line[a] * (b - a) for a, b in zip(at, at[1:], strict=False)) / (5000.0 - at[0])
        assert math.isclose(steps[k]["mean"], mean) and steps[k]["peak"] == max(line.values()) and steps[k]["last"] == line[at[-2]]


def test_blocks_of_vectors(spark):
    """Several blocks of queries and references give what one gives, mirrored vectors too."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 6))
    x[50] = x[3].reshape(2, 3)[:, ::-1].ravel()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    flip = x.reshape(-1, 2, 3)[:, :, ::-1].reshape(len(x), -1)
    both = np.round(np.maximum(x @ x.T, x @ flip.T), 6)
    for block in (7, 4096):
        pairs = {(r["a"], r["b"]) for r in similarity.similar_pairs(df, 2.0, 3, block).collect()}
        assert pairs == {(a, b) for a in range(60) for b in range(a + 1, 60) if both[a, b] >= 2.0} and (3, 50) in pairs
        top = similarity.top_k(df.filter("id < 9"), df, 3, 3, block).collect()
        assert len(top) == 27
        for q in range(9):
            order = sorted((j for j in range(60) if j != q), key=lambda j: (-both[q, j], j))[:3]  # noqa: B023
            assert [r["ref"] for r in sorted((r for r in top if r["query"] == q), key=lambda r: r["rank"])] == order
    assert df.select(similarity.mirrored(F.col("v"), 3).alias("m")).first()["m"] == flip[0].tolist()
    assert similarity.top_k(df.limit(0), df, 3).count() == similarity.similar_pairs(df.limit(0), 1.0).count() == 0


def test_arrays(spark):
    import io

    out = io.BytesIO()
    np.save(out, np.arange(6.0).reshape(3, 2))
    objects = io.BytesIO()
    np.save(objects, np.array([{}], object), allow_pickle=True)
    files = spark.createDataFrame([("a", bytearray(out.getvalue())), ("o", bytearray(objects.getvalue())), ("n", None)], "path string, content binary")
    rows = arrays.array_rows(files)
    assert [(r["row"], r["values"]) for r in rows.filter("path = 'a'").orderBy("row").collect()] == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])]
    assert rows.filter("error IS NOT NULL").count() == 2
    table = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "place long, key string")
    keys = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "row long, key string")
    good = rows.filter("path = 'a'")
    assert {r["key"]: r["values"] for r in arrays.aligned(table, good, "place", "key", keys).collect()} == {"x": [0.0, 1.0], "y": [2.0, 3.0], "z": [4.0, 5.0]}
    for other in (keys.filter("row < 2"), keys.withColumn("key", F.lit("x"))):
        with pytest.raises(ValueError, match="rows"):
            arrays.aligned(table, good, "place", "key", other)


def test_passport():
    parts = {"a": {"n": 3, "m": {"x": 1}}, "b": {"n": 3}}
    assert report.passport(parts, {"same n": ("a.n", "b.n")})["rules"] == ["same n"]
    with pytest.raises(ValueError, match="other"):
        report.passport(parts, {"other": ("a.m.x", "b.n")})


def test_no_exchange_ends_in_one_task(spark):
    """Plans of the operators for large groups hold no single-partition exchange."""
    df = spark.range(100).select("id", (F.col("id") % 2).alias("g"), F.rand(1).alias("s"))
    plans = [indexing.in_hash_order(df, ["g"], F.md5(F.col("id").cast("string")), "id"), sampling.stratified_folds(df, "g", "id", 5, "s"),
        sampling.greedy_prefix(df, "id", "g", 10, "s"), ranking.roc_table(ranking.score_table(df, F.col("g") == 1, "s", ["g"]), ["g"])]
    for p in plans:
        assert "SinglePartition" not in p._jdf.queryExecution().executedPlan().toString()
