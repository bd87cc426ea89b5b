"""The plain form of operator 4's method, over a whole collection: each round inserts one symbol of every document into the
Burrows-Wheeler transform, and the common prefixes and owners beside it, all in files that are read and written in sequence.
It takes as many rounds as the longest document has bytes, each through everything inserted so far, so it serves to check the
operator, which sorts aligned segments by columns, and to measure what the plain form would cost."""

import json
import os
import sys
import time

import numpy as np
import pytest

FILES = (("bwt", np.uint16), ("common", np.int32), ("owner", np.int64))


def insert_columns(texts, folder, rounds=None):
    """Leaves the three files in folder; owner is document << 32 | start. rounds: stops after so many."""
    m = len(texts)
    size = np.array([len(t) for t in texts])
    data = [np.frombuffer(t, np.uint8) for t in texts]

    def symbols(docs, left):
        """What stands before the suffix that begins at left; 0 where nothing does."""
        return np.array([int(data[i][k - 1]) + 1 if k else 0 for i, k in zip(docs.tolist(), left.tolist(), strict=True)], np.uint16)

    def write(*arrays):
        for (name, kind), a in zip(FILES, arrays, strict=True):
            a.astype(kind).tofile(f"{folder}/{name}.new")
            os.replace(f"{folder}/{name}.new", f"{folder}/{name}")

    start, place, every = size.copy(), np.arange(m), np.arange(m)
    write(symbols(every, size), np.zeros(m), (every << 32) | size)
    live = size > 0
    while live.any() and (rounds is None or rounds > 0):
        rounds = None if rounds is None else rounds - 1
        bwt, common, owner = (np.fromfile(f"{folder}/{n}", k) for n, k in FILES)
        counts = np.bincount(bwt, minlength=258)
        counts[0] = 0
        first = m + np.cumsum(counts) - counts
        docs = every[live]
        own = bwt[place[docs]]
        to, low, behind = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64), []
        for c in np.unique(own):
            at, mine = np.flatnonzero(bwt == c), np.flatnonzero(own == c)
            k = np.searchsorted(at, place[docs[mine]])
            to[mine] = first[c] + k
            for x, j in zip(mine.tolist(), k.tolist(), strict=True):
                if j:
                    low[x] = 1 + common[at[j - 1] + 1 : at[j] + 1].min()
                if j + 1 < len(at):
                    behind.append((first[c] + j + 1, 1 + common[at[j] + 1 : at[j + 1] + 1].min()))
        start[docs] -= 1
        order = np.argsort(to)
        gap = to[order] - np.arange(len(order))
        bwt = np.insert(bwt, gap, symbols(docs[order], start[docs[order]]))
        common = np.insert(common, gap, low[order])
        owner = np.insert(owner, gap, (docs[order] << 32) | start[docs[order]])
        if behind:
            p, v = np.array(behind).T
            common[p] = v
        write(bwt, common, owner)
        place[docs] = to
        live = start > 0


def removed(texts, folder, length):
    """Bytes that lie in a string of this length that also starts elsewhere, read off the common prefixes."""
    common, owner = np.fromfile(f"{folder}/common", np.int32), np.fromfile(f"{folder}/owner", np.int64)
    at = np.flatnonzero(common >= length)
    hit = np.unique(np.concatenate([owner[at], owner[at - 1]])) if len(at) else np.zeros(0, np.int64)
    out = [np.zeros(len(t), bool) for t in texts]
    for h in hit.tolist():
        out[h >> 32][h & 0xFFFFFFFF :][:length] = True
    return [int(x.sum()) for x in out]


def test_transform_and_prefixes(tmp_path):
    texts = [b"banana", b"ananas", b"", b"banana", b"a", b"nab"]
    insert_columns(texts, tmp_path)
    suffixes = sorted((t[k:] + b"\x00" + bytes([i]), i, k) for i, t in enumerate(texts) for k in range(len(t) + 1))
    owner = np.fromfile(tmp_path / "owner", np.int64)
    assert [(o >> 32, o & 0xFFFFFFFF) for o in owner.tolist()] == [(i, k) for _, i, k in suffixes]
    assert np.fromfile(tmp_path / "bwt", np.uint16).tolist() == [texts[i][k - 1] + 1 if k else 0 for _, i, k in suffixes]
    for (a, *_), (b, *_), c in zip(suffixes, suffixes[1:], np.fromfile(tmp_path / "common", np.int32)[1:].tolist(), strict=False):
        a, b = a[:-2], b[:-2]
        assert c == next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("length", [40, 90])
def test_operator_removes_what_the_plain_form_removes(spark, tmp_path, length):
    from cohortlens.llm import suffixes
    from test_corpus import TEXTS

    texts = {i: t for i, t in TEXTS.items() if len(t or "") < 1600}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["id"]: r["n_removed"] for r in suffixes.remove(docs, length, 10).collect()}
    data = [(t or "").encode() for t in texts.values()]
    insert_columns(data, tmp_path)
    assert [got[i] for i in texts] == removed(data, tmp_path, length) and sum(got.values()) > 1000


if __name__ == "__main__":  # seconds a round of the plain form: python tests/llm/test_collection.py DOCUMENTS FOLDER ROUNDS
    import duckdb

    data = [(t or "").encode() for (t,) in duckdb.sql(f"SELECT text FROM '{sys.argv[1]}'").fetchall()]
    began = time.perf_counter()
    insert_columns(data, sys.argv[2], int(sys.argv[3]))
    spent = time.perf_counter() - began
    held = os.path.getsize(f"{sys.argv[2]}/bwt") // 2
    print(json.dumps({"documents": len(data), "bytes": sum(map(len, data)), "longest": max(map(len, data)), "rounds": int(sys.argv[3]), "seconds": round(spent, 2), "inserted": held}))
