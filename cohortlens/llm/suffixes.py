"""Operator 4: repeated byte strings, by column-wise suffix sorting of many strings at once.

The strings are segments around a common minimiser (see minimisers.py), aligned there. Each round inserts one symbol of
each string, going left; the symbols in the present suffix order are that column of the collection's Burrows-Wheeler
transform, a stable sort by them gives the next order, and the common prefixes of neighbours follow from range minima of
the last ones. Suffixes that start in different columns or classes can't share the wanted length, so every round keeps just
its own column's suffixes. Where a neighbour's common prefix reaches the wanted length, the string repeats. Equal segments are
counted before they meet, and enter as two strings: whatever is removed stands next to an equal in the suffix order.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, keyed, small_batches, table
from .minimisers import MOST_IN_CLASS, Units, covered, repeated, runs_of, with_spans

LENGTH, GRAM = 400, 100


def columns(group: np.ndarray, symbols: np.ndarray):
    """Sorts the suffixes of aligned strings column by column, from the last to the first.

    group: each string's class, not decreasing; symbols: strings by columns, 0 outside a string. Yields (column, order,
    common): the strings in the order of their suffixes from that column, and each one's common prefix with the one before,
    0 at a class's first; suffixes that would start outside their string count as empty.
    """
    m = len(group)
    order, common = np.arange(m), np.zeros(m + 1, np.int32)
    wide = group.astype(np.int64) << 9
    for c in range(symbols.shape[1] - 1, -1, -1):
        bwt = symbols[order, c]
        key = wide[order] + bwt
        to = np.argsort(key, kind="stable")
        sorted_key = key[to]
        same = np.flatnonzero((sorted_key[1:] == sorted_key[:-1]) & (bwt[to[1:]] > 0)) + 1
        p, q = to[same - 1], to[same]
        new = np.zeros(m + 1, np.int32)
        low = common[q]
        far = np.flatnonzero(q - p > 1)
        if len(far):
            low[far] = np.minimum.reduceat(common, np.stack([p[far] + 1, q[far] + 1], 1).ravel())[::2]
        new[same] = low + 1
        order, common = order[to], new
        yield c, order, common[:m]


def repeated_by_columns(length: int):
    """For segments (mh, sh, key, th, start, windows, rel, n, content): which of their windows stand elsewhere too. A segment with n of 2 or more is two strings."""

    def compare(rows: list[tuple]) -> list[np.ndarray]:
        own = np.repeat(np.arange(len(rows)), [1 + (r[7] > 1) for r in rows])  # a string's row
        left = max(r[6] for r in rows)
        width = max(left - r[6] + len(r[8]) for r in rows)
        symbols = np.zeros((len(own), width), np.uint16, order="F")
        for i, r in zip(range(len(own)), (rows[k] for k in own), strict=True):
            symbols[i, left - r[6] : left - r[6] + len(r[8])] = np.frombuffer(r[8], np.uint8).astype(np.uint16) + 1
        group = np.cumsum([i > 0 and rows[i][0] != rows[i - 1][0] for i in range(len(rows))])[own]
        hit = np.zeros((left + 1, len(rows)), bool)
        for c, order, common in columns(group, symbols):
            if c <= left and len(at := np.flatnonzero(common >= length)):
                hit[c, own[order[at]]] = True
                hit[c, own[order[at - 1]]] = True
        return [hit[left - r[6] : left - r[6] + r[5], i] for i, r in enumerate(rows)]

    return compare


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", most_in_class: int = MOST_IN_CLASS) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    A byte is removed if it lies in a string of length bytes that also starts anywhere else, in the same text or another;
    overlaps count, and strings are judged on the input. Null counts as empty. Rows that are repeated wholly repeat each
    other, and lose what is long enough.
    """
    small_batches(docs.sparkSession)
    src = keyed(docs, id_col, text_col)
    units = Units(length, gram, words=False)

    def run(batches):
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = (text or "").encode()
                hit = covered(len(data), spans) if spans else np.zeros(len(data), bool)
                kept = np.frombuffer(data, np.uint8)[~hit].tobytes() if spans else data
                rows.append((len(data), len(data) - len(kept), len(runs_of(hit)) if spans else 0, kept))
            cols = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()),
                strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    spans = repeated(src, units, repeated_by_columns(length), earlier=False, most=most_in_class, alike=True)
    return with_spans(src, spans).mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary")


def cleaned(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with the removed bytes gone from text_col and, if there is such a column, chars_col counted anew.

    Where a cut splits a character, its rest goes too. Untouched rows are as they were, null texts too, no row goes, and an
    empty table stays empty. Rows that are repeated wholly repeat each other. Other columns may have any names.
    """
    small_batches(docs.sparkSession)
    src = keyed(docs, id_col, text_col)
    spans = repeated(src, Units(length, gram, words=False), repeated_by_columns(length), earlier=False, alike=True).select(F.col("key").alias("k"), F.col("th").alias("t"), "spans")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("key"), F.xxhash64(text).alias("th"))
    rows = rows.join(spans, (F.col("key") == F.col("k")) & (F.col("th") == F.col("t")), "left").select("row", "spans")
    at, n = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else -1

    def run(batches):
        for b in batches:
            cols = b.column(0).flatten()
            names = [f.name for f in b.schema.field(0).type]
            if b.column(1).null_count < b.num_rows:
                texts, counts = cols[at].to_pylist(), cols[n].to_pylist()
                for i, spans in enumerate(b.column(1).to_pylist()):
                    if spans:
                        data = np.frombuffer(texts[i].encode(), np.uint8)
                        texts[i] = data[~covered(len(data), spans)].tobytes().decode(errors="ignore")
                        counts[i] = len(texts[i])
                cols = [pa.array(texts, pa.string()) if k == at else pa.array(counts, c.type) if k == n else c for k, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = remove(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
