"""Windows of a fixed number of units (bytes or words) that share a minimiser, and what repeats among them.

A window's minimiser is its leftmost gram with the smallest hash: a function of the window's content alone. Consecutive
windows with the minimiser at one place form a segment, so equal windows lie in segments of one class (the gram's hash) and
at the same distance from the minimiser. A segment travels as (class, digest of its content); equal segments are counted
before they are shuffled. Contents travel too, one for each distinct segment, where they are to be compared: in classes with
different segments, and if asked in all classes with repeats. Hot passages and groups of copies so shrink to one row a task
and segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_PLACE = np.uint64((1 << 24) - 1)
#: Windows handled at a time in a long document.
PIECE = 1 << 20
#: A class with more distinct segments than this is resolved window by window, over all tasks, instead of in one.
MOST_IN_CLASS = 50_000
#: Segments that a task counts at a time, that it compares at a time, and that it hands on at a time: what bounds a worker's memory.
COUNTED, COMPARED, SENT = 250_000, 6000, 20_000
_SEGMENT = "mh long, sh long, key long, th long, start long, windows int, rel int, n long"
RUNS = "array<struct<a:int,b:int>>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_ODD, _INVERSE)):
            _powers[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base)]))
    return _powers


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[: len(a) - (w - size)], a[w - size :]) if w > size else a


class Units:
    """How a text falls into units. bounds(data): begins and ends of the units in data, the bytes that stand for the text."""

    def __init__(self, window: int, gram: int, words: bool):
        self.window, self.gram, self.words = window, gram, words

    def data(self, text: str | None) -> bytes:
        raw = (text or "").encode()
        return b" ".join(raw.split()) if self.words else raw  # bytes.split takes the ASCII white space as separators

    def bounds(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        if not self.words:
            at = np.arange(len(data) + 1)
            return at[:-1], at[1:]
        if not data:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        return np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])

    def segments(self, data: bytes) -> Iterator[tuple[np.ndarray, ...]]:
        """(mh, sh, start, windows, rel) of all segments: class, digest, first window, number of windows, first window's distance to the minimiser."""
        begins, ends = self.bounds(data)
        for p in range(0, len(begins) - self.window + 1, PIECE):
            b, e = begins[p : p + PIECE + self.window - 1], ends[p : p + PIECE + self.window - 1]
            low = int(b[0])
            own = np.frombuffer(data, np.uint8, int(e[-1]) - low, low)
            b, e = b - low, e - low
            up, down = _power_tables(len(own) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[own] * up[: len(own)])])
            g = self.gram - 1
            first = b[: len(b) - g] if g else b
            last = e[g:]
            h = _mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
            place = sliding_min((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), self.window - g) & _PLACE
            start = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
            windows = np.diff(np.append(start, len(place)))
            at = place[start].astype(np.int64)
            stop = start + windows + self.window - 2
            view = memoryview(data)
            mh = [xxhash.xxh3_64_intdigest(view[x:y]) for x, y in zip((b[at] + low).tolist(), (e[at + g] + low).tolist(), strict=True)]
            sh = [xxhash.xxh64_intdigest(view[x:y], 7) for x, y in zip((b[start] + low).tolist(), (e[stop] + low).tolist(), strict=True)]
            yield np.array(mh, np.uint64).view(np.int64), np.array(sh, np.uint64).view(np.int64), start + p, windows, at - start


def _rows(units: Units, counted: bool):
    """Segments of documents; counted: equal ones of a task as one row with their number and the first place."""
    names = [x.split()[0] for x in _SEGMENT.split(", ")]

    def pack(held: list) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        mh, sh, key, th, start, windows, rel = cols
        n = np.ones(len(mh), np.int64)
        if counted:
            order = np.lexsort((start, th, key, sh, mh))
            mh, sh = mh[order], sh[order]
            new = np.flatnonzero(np.concatenate([[True], (mh[1:] != mh[:-1]) | (sh[1:] != sh[:-1])]))
            n = np.diff(np.append(new, len(mh)))
            mh, sh = mh[new], sh[new]
            key, th, start, windows, rel = (c[order][new] for c in (key, th, start, windows, rel))
        return pa.RecordBatch.from_arrays([pa.array(mh), pa.array(sh), pa.array(key), pa.array(th), pa.array(start),
            pa.array(windows.astype(np.int32)), pa.array(rel.astype(np.int32)), pa.array(n)], names)

    def sent(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        return (b.slice(k, SENT) for k in range(0, b.num_rows, SENT))

    def run(batches):
        held, size = [], 0
        for b in batches:
            for key, th, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for mh, sh, start, windows, rel in units.segments(units.data(text)):
                    held.append((mh, sh, np.full(len(mh), key, np.int64), np.full(len(mh), th, np.int64), start, windows, rel))
                    size += len(mh)
                if size >= (COUNTED if counted else SENT):
                    yield from sent(pack(held))
                    held, size = [], 0
        if held:
            yield from sent(pack(held))

    return run


def _content(units: Units):
    """The bytes of the segments that a document stands for."""

    def run(batches):
        for b in batches:
            rows = []
            for key, th, text, wanted in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                data = units.data(text)
                begins, ends = units.bounds(data)
                for w in wanted:
                    rows.append((w["mh"], w["sh"], key, th, w["start"], w["windows"], w["rel"], w["n"], data[begins[w["start"]] : ends[w["start"] + w["windows"] + units.window - 2]]))
            cols = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in _SEGMENT.split(", ")] + ["content"])

    return run


def runs_of(hit: np.ndarray) -> list[dict]:
    """Maximal runs of true values, as first and last place."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _classes(compare: Callable[[list[tuple]], list[np.ndarray]], most: int):
    """Hands whole classes, some at a time, to compare, which tells for each segment which of its windows are hit."""

    def run(batches):
        held: list[tuple] = []

        def out(rows):
            hits = compare(rows)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([runs_of(h) for h in hits], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], ["mh", "sh", "runs"])

        for b in batches:
            held += zip(*(c.to_pylist() for c in b.columns), strict=True)
            if len(held) > most:
                end = len(held)
                while end and held[end - 1][0] == held[-1][0]:
                    end -= 1
                if end:
                    yield out(held[:end])
                    held = held[end:]
        if held:
            yield out(held)

    return run


def _each_window(units: Units):
    """Each window of the segments of a class that is too large for one task: class, content's digest, place."""

    def run(batches):
        for b in batches:
            for mh, sh, key, th, start, windows, _, n, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                begins, ends = units.bounds(content)
                k = np.arange(windows)
                digest = [xxhash.xxh3_128_digest(content[x:y]) for x, y in zip(begins[k].tolist(), ends[k + units.window - 1].tolist(), strict=True)]
                same = lambda v, t=pa.int64(), c=windows: pa.array([v] * c, t)
                yield pa.RecordBatch.from_arrays([same(mh), same(sh), pa.array(digest, pa.binary()), same(key), same(th), pa.array(k + start),
                    pa.array(k.astype(np.int32)), same(n)], ["mh", "sh", "digest", "key", "th", "place", "k", "n"])

    return run


def repeated(docs: DataFrame, units: Units, compare: Callable, earlier: bool, most: int = MOST_IN_CLASS, alike: bool = False) -> DataFrame:
    """(key, th, spans) for documents (key, th, text) with hit windows; spans: ranges (a, b) of covered units, b exclusive.

    earlier: a window is hit if its content also starts earlier in the order of (key, th, start); else if it starts anywhere
    else. Rows with equal (key, th), which is to say repeated rows, are one document in that order and two otherwise.
    alike: compare decides on segments that only repeat themselves, too, and takes them as several strings.
    """
    src = docs.select("key", "th", "text")
    segments = src.mapInArrow(_rows(units, True), _SEGMENT).repartition("mh")
    each = segments.groupBy("mh", "sh").agg(F.sum("n").alias("n"), F.min(F.struct("key", "th", "start")).alias("first"), F.first("windows").alias("windows"), F.first("rel").alias("rel"))
    # What repeats, which is far less than all segments; without a cut, each of its uses below would segment all texts again.
    classes = cut(each.withColumn("kinds", F.count("*").over(Window.partitionBy("mh"))).filter("n > 1 or kinds > 1"))
    del segments, each
    none = F.lit(None).cast(RUNS)
    mixed = classes if alike else classes.filter("kinds > 1")
    wanted = mixed.groupBy("first.key", "first.th").agg(F.collect_list(F.struct("mh", "sh", F.col("first.start").alias("start"), "windows", "rel",
        "n", (F.col("kinds") > most).alias("hot"))).alias("wanted"))
    # The same rows as in with_spans(), so that Spark shuffles the texts once.
    texts = docs.select("id", "key", "th", "text").join(wanted.withColumnRenamed("key", "k").withColumnRenamed("th", "t"), (F.col("key") == F.col("k")) & (F.col("th") == F.col("t")))

    def contents(hot: bool) -> DataFrame:
        own = F.filter("wanted", lambda w: w["hot"] == F.lit(hot))
        return texts.select("id", "key", "th", "text", own.alias("wanted")).filter(F.size("wanted") > 0).mapInArrow(_content(units), _SEGMENT + ", content binary")

    order = ["mh", "sh", "key", "th", "start"]
    compared = contents(False).repartition("mh").sortWithinPartitions(*order).mapInArrow(_classes(compare, COMPARED), f"mh long, sh long, runs {RUNS}")
    if not mixed.filter(F.col("kinds") > most).isEmpty():
        single = contents(True).mapInArrow(_each_window(units), "mh long, sh long, digest binary, key long, th long, place long, k int, n long")
        owner = single.groupBy("mh", "digest").agg(F.min(F.struct("key", "th", "place", "sh")).alias("o"), F.sum("n").alias("c"))
        spread = single.join(owner, ["mh", "digest"]).filter(F.col("o.sh") != F.col("sh") if earlier else F.col("c") > 1)
        spread = spread.groupBy("mh", "sh").agg(F.array_sort(F.collect_set(F.struct(F.col("k").alias("a"), F.col("k").alias("b")))).alias("runs"))
        compared = compared.unionByName(spread)
    runs = compared.groupBy("mh", "sh").agg(F.first("runs").alias("runs"))
    found = mixed.select("mh", "sh", "n", "first").join(runs, ["mh", "sh"], "left")
    if not alike:
        found = classes.filter("kinds = 1").select("mh", "sh", "n", "first", none.alias("runs")).unionByName(found)
    found = cut(found)  # one row a distinct segment; read from a table, Spark may split the places of hot ones over tasks
    places = src.mapInArrow(_rows(units, False), _SEGMENT).drop("n", "rel")
    hit = places.join(found, ["mh", "sh"])
    whole = F.lit(False) if alike else (F.struct("key", "th", "start") != F.col("first")) if earlier else (F.col("n") > 1)
    own = F.when(whole, F.array(F.struct(F.lit(0).alias("a"), (F.col("windows") - 1).alias("b")))).otherwise(F.coalesce("runs", F.array().cast(RUNS)))
    spans = F.transform(own, lambda r: F.struct((F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"] + units.window).alias("b")))
    return hit.select("key", "th", spans.alias("spans")).filter(F.size("spans") > 0).groupBy("key", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def covered(n: int, spans: list[dict] | None) -> np.ndarray:
    """Which of n units lie in a span."""
    depth = np.zeros(n + 1, np.int32)
    if spans:
        np.add.at(depth, [s["a"] for s in spans], 1)
        np.add.at(depth, [s["b"] for s in spans], -1)
    return np.cumsum(depth[:-1]) > 0


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, text, spans) of all documents (id, key, th, text); each row keeps its own text, and spans are null without hits."""
    own = spans.select(F.col("key").alias("k"), F.col("th").alias("t"), "spans")
    return docs.select("id", "key", "th", "text").join(own, (F.col("key") == F.col("k")) & (F.col("th") == F.col("t")), "left").select("id", "text", "spans")


