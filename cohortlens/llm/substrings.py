"""Operator 10: repeated windows of words, by super-k-mers.

Consecutive windows of 20 words that share a minimiser (their leftmost 5-word gram with the smallest hash) form a
super-k-mer, one packed string. It goes to its minimiser's bucket, where the windows are sorted; of equal ones the earliest
stays. Equal super-k-mers are counted on the way, and where a bucket holds nothing else, their windows need no sorting.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, small_batches, table
from .minimisers import MOST_IN_CLASS, Units, covered, repeated, with_spans

WINDOW, GRAM = 20, 5


def earliest_by_sort(window: int):
    """For segments (mh, sh, key, th, start, windows, rel, n, content): which of their windows also start earlier in another segment."""

    def compare(rows: list[tuple]) -> list[np.ndarray]:
        hits = [np.zeros(r[5], bool) for r in rows]
        entries = []
        for i, (mh, _, key, th, start, windows, _, _, content) in enumerate(rows):
            words = content.split(b" ")
            entries += [(mh, b" ".join(words[k : k + window]), key, th, start + k, i, k) for k in range(windows)]
        entries.sort()
        last = None
        for mh, words, _, _, _, i, k in entries:
            if (mh, words) == last:
                hits[i][k] = True
            last = (mh, words)
        return hits

    return compare


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", most_in_class: int = MOST_IN_CLASS) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept (the remaining words joined by blanks).

    Words are runs of characters other than ASCII white space. A word is removed if a window covers it whose word sequence
    also starts earlier: in a document with a smaller identifier (null counts as the smallest), or further ahead in the same.
    Null texts have no words. Rows that repeat both identifier and text are one document; rows with one identifier and
    different texts are ordered by a hash of the text.
    """
    small_batches(docs.sparkSession)
    src = keyed(docs, id_col, text_col)
    units = Units(window, gram, words=True)

    def run(batches):
        for b in batches:
            n, gone, kept = [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                hit = covered(len(words), spans)
                n.append(len(words))
                gone.append(int(hit.sum()))
                kept.append(b" ".join(w for w, x in zip(words, hit.tolist(), strict=True) if not x) if gone[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])

    spans = repeated(src, units, earliest_by_sort(window), earlier=True, most=most_in_class)
    return with_spans(src, spans).mapInArrow(run, "id long, n_words long, n_removed long, kept string")


def query(spark, sf_dir: str) -> DataFrame:
    out = remove(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
