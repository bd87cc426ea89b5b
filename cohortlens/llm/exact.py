"""Operator 2: exact duplicates by a content sort.

Rows are range-partitioned by sampled splitters over the normalised bytes: their first SPLITTER bytes, and behind those, for
texts that agree so far, digest, length and identifier, so that a hot text or a hot beginning spreads over ranges. An external
sort by the whole normalised bytes puts equals next to each other inside a range, and neighbours are compared in full. A range
cuts at most one group at either end, the one with its smallest or largest splitter key. What is known of these two runs, a few
numbers and digests each, is brought together over all ranges; texts of runs that are found to be one are compared in full again.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import setting
from .common import ASCII_SPACE, NULL_ID, cut, small_batches, table, unused

#: Bytes of the normalised text in a splitter, and rows sampled a partition. Spark samples at most a million rows, whatever the table, and some 150 bytes of each reach the driver.
SPLITTER, SAMPLED = 96, 20
_RUN_SCHEMA = "part int, run long, kind int, id long, th long, pos long, keep long, size long, sha binary, text binary"


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, ASCII_SPACE.encode())


def _normalise(batches):
    for b in batches:
        texts = b.column(1).to_pylist()
        norm = [normalised(t) for t in texts]
        cols = [b.column(0), b.column(2), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([x[:SPLITTER] for x in norm], pa.binary()),
            pa.array([hashlib.sha256(x).digest() for x in norm], pa.binary()), pa.array(norm, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["id", "th", "n", "start", "sha", "norm"])


def _runs(batches):
    """Rows of kind 0: a document, its run of equal texts, and what stays of the run and how many it has in this partition. Kind 1: the runs with the smallest and the largest splitter key, which may go on in other partitions, with their text."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    rows: list[tuple] = []
    ends: list[tuple] = []  # (splitter key, run, kept identifier, size, digest, text): smallest, largest
    run, last, key, ids = -1, None, (b"", b""), []  # ids: (identifier, th) of the present run, its kept one first

    def close():
        head, size = ids[0][0], len(ids)
        rows.extend((part, run, 0, i, th, p, head, size, key[1], None) for p, (i, th) in enumerate(ids))
        own = (key, run, head, size, key[1], last)
        ends[:] = [own, own] if not ends else [min(ends[0], own, key=lambda e: e[0]), max(ends[1], own, key=lambda e: e[0])]

    def batch():
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True),
            (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()),
            strict=True)], [x.split()[0] for x in _RUN_SCHEMA.split(", ")])
        rows.clear()
        return out

    for b in batches:
        for i, th, start, sha, norm in zip(*(b.column(c).to_pylist() for c in (0, 1, 3, 4, 5)), strict=True):
            if norm != last:  # the full comparison; last is None at the start
                if run >= 0:
                    close()
                run, last, key, ids = run + 1, norm, (start, sha), []
            ids.append((i, th))
        if len(rows) > 2000:
            yield batch()
    if run >= 0:
        close()
        rows.extend((part, e[1], 1, e[2], None, None, None, e[3], e[4], e[5]) for e in (ends if ends[0][1] != ends[1][1] else ends[:1]))
        yield batch()


def _row_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, th (a hash of the text as it is), keep_id, group_size, kept, sha (of the normalised text, binary).

    Texts are equal if they are identical without ASCII white space; null counts as empty, and empty texts form a group.
    Of a group stays the row with the most code points, then the smallest identifier, null before all others; of rows that
    are repeated wholly, one stays. An empty table gives no rows. Only id_col and text_col are read.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("th", _row_hash("text"))
    norm = src.mapInArrow(_normalise, "id long, th long, n long, start binary, sha binary, norm binary")
    stays = [F.col("n").desc(), F.col("id").asc_nulls_first()]
    # start is how norm begins, so this is the order of norm; most comparisons end there and copy no whole texts.
    with setting(docs.sparkSession, "spark.sql.execution.rangeExchange.sampleSizePerPartition", str(SAMPLED)):
        runs = cut(norm.repartitionByRange("start", "sha", *stays).sortWithinPartitions("start", "norm", *stays).mapInArrow(_runs, _RUN_SCHEMA))
    ends = runs.filter("kind = 1")
    # At most two runs a partition, without their texts: one task can order them all, and they are broadcast.
    line = Window.orderBy("sha", "part")
    held = ends.select("part", "run", "id", "size", "sha", (F.col("sha") != F.lag("sha").over(line)).alias("new"),
        F.lag("part").over(line).alias("part_0"), F.lag("run").over(line).alias("run_0"))
    held = held.withColumn("grp", F.sum(F.coalesce(F.col("new").cast("int"), F.lit(1))).over(line))
    _same_texts(ends, held.filter("not new"))
    whole = Window.partitionBy("grp")
    every = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # parts follow the order in which rows stay
    edges = held.select("part", "run", F.sum("size").over(whole).alias("e_size"),
        F.first(F.struct(F.col("id").alias("v"))).over(every).alias("e_keep"), (F.min("part").over(whole) == F.col("part")).alias("e_first"))
    out = runs.filter("kind = 0").join(F.broadcast(edges), ["part", "run"], "left")
    edge = F.col("e_size").isNotNull()
    return out.select(
        "id",
        "th",
        F.when(edge, F.col("e_keep.v")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("e_size", "size").alias("group_size"),
        ((F.col("pos") == 0) & F.coalesce("e_first", F.lit(True))).alias("kept"),
        "sha",
    )


def _same_texts(ends: DataFrame, joined: DataFrame) -> None:
    """Compares in full the texts of runs in different partitions that are taken for one by their digest."""
    text = lambda k: ends.select(F.col("part").alias(f"part{k}"), F.col("run").alias(f"run{k}"), F.col("text").alias(f"text{k}"))
    both = joined.select(F.col("part").alias("part_1"), F.col("run").alias("run_1"), "part_0", "run_0").join(text("_0"), ["part_0", "run_0"]).join(text("_1"), ["part_1", "run_1"])
    if not both.filter("text_0 <> text_1").isEmpty():
        raise ValueError("different texts with one SHA-256 digest")


def query(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, the one groups() marks.

    Rows are told apart by identifier and text, and of those repeated wholly (in these two) one stays. Null texts count as
    empty, a null identifier comes before all others, an empty table stays empty, and other columns may have any names.
    """
    own, own_th, stay_id, stay_th = unused(docs, "key", "th", "stay", "stay_th")
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias(own), _row_hash(text_col).alias(own_th)]
    rows = groups(docs, id_col, text_col).groupBy(F.coalesce("id", F.lit(NULL_ID)).alias(stay_id), F.col("th").alias(stay_th))
    stay = cut(rows.agg(F.max("kept").alias("kept"), F.count("*").alias("n")).filter("kept").drop("kept"))
    kept = lambda some: docs.select("*", *key).join(some, (F.col(own) == F.col(stay_id)) & (F.col(own_th) == F.col(stay_th)), "left_semi")
    if (again := stay.filter("n > 1")).isEmpty():
        return kept(stay).drop(own, own_th)
    return kept(stay.filter("n = 1")).unionByName(kept(again).dropDuplicates([own, own_th])).drop(own, own_th)


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
