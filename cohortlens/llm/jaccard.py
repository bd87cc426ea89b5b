"""Operator 6: n-gram Jaccard join in size-banded tiles with bitmap signatures.

Two sets of similarity t share a member among the first (1 - t) of each set's members in any common order. Those members
are the tiles' keys; the order puts members that many documents have last, by a sketch of counts over all documents, so that
a passage in many documents doesn't draw them into one tile. Of a pair, the smaller set needs even fewer first members,
which are marked. A tile holds documents of one size band, and is paired with itself and the band below. First each document
of a tile is paired with the tile's first; links found so shrink groups of near copies to components, and then only pairs
across components remain. Members that very many documents have are dealt in parts: the parts' firsts are paired with one
another, and what remains across components is paired part by part. The number of links is then counted inside the components, where all links lie: their distinct
sets are compared by pairs of blocks, each set weighted by its rows, and only counts leave a task. Parity bitmaps bound a pair's overlap from above by their differing bits: short ones inside the
tiles, longer ones by the pair. What passes is decided by the exact intersection of the sorted sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..operators.indexing import dense_index
from .common import LOWER, NULL_ID, UPPER, cut, small_batches, table, unused
from .minimisers import _VALUE, _mix, _power_tables

WORDS = 5
#: Two sets link when 100 * |both| >= PERCENT * |either|.
PERCENT = 75
#: Cells of the count sketch; a member counts as frequent above so many times the mean cell.
CELLS_LOG2, FREQUENT = 23, 3
#: Slightly above 4/3: sets of linked documents lie in one band or two neighbouring ones.
BAND = 1.34
#: Bits of the bitmaps inside tiles. Sets of more than 7/4 of it aren't told apart there, only by their own longer bitmap.
TILE_BITS = 1024
#: Documents named in candidate pairs, up to which their identifiers are broadcast; beyond, texts are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Rows of a member in one task, about; beyond, it is dealt in parts. The sketch says which members those are.
PART_ROWS = 50_000
#: Of a component, so many sets or shingles make a block; each pair of blocks is compared by itself to count links.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1_000_000
_LOW = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles, lower-cased A-Z; a text with fewer words has one of all its words, an empty one none."""
    data = b" ".join((text or "").encode().translate(_LOW).split())
    if not data:
        return np.zeros(0, np.uint64)
    own = np.frombuffer(data, np.uint8)
    gaps = np.flatnonzero(own == 32)
    b, e = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    b, e = (b[: len(b) - words + 1], e[words - 1 :]) if len(b) >= words else (b[:1], e[-1:])
    up, down = _power_tables(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[own] * up[: len(own)])])
    return np.unique(_mix((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64)))


def links(overlap, size_a, size_b):
    """100 * overlap >= PERCENT * union, in whole numbers."""
    return (100 + PERCENT) * overlap >= PERCENT * (size_a + size_b)


def signature(s: np.ndarray) -> bytes:
    """A parity bitmap of about two bits a member: each member turns one bit."""
    bits = 1 << max(6, int(2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def tile_signature(s: np.ndarray) -> bytes:
    odd = np.bincount((s & np.uint64(TILE_BITS - 1)).astype(np.int64), minlength=TILE_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(size_a: int, sig_a: bytes, size_b: int, sig_b: bytes) -> bool:
    """False only if the bitmaps' differing bits leave too small an overlap. The longer bitmap is folded to the shorter."""
    x, y = np.frombuffer(sig_a, np.uint8), np.frombuffer(sig_b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    apart = int(np.bitwise_count(x ^ y).sum())
    return bool(links((size_a + size_b - apart) // 2, size_a, size_b))


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - CELLS_LOG2)).astype(np.int64)


def _count(batches):
    counts = np.zeros(1 << CELLS_LOG2, np.uint32)
    for b in batches:
        for text in b.column(1).to_pylist():
            counts[_cells(shingles(text))] += 1
    step = 1 << 16
    for k in range(0, len(counts), step):
        if (own := counts[k : k + step]).any():
            yield pa.RecordBatch.from_arrays([pa.array([k // step], pa.int32()), pa.array([_packed(own)], pa.binary())], ["slice", "counts"])


def _packed(counts: np.ndarray) -> bytes:
    """Compressed; all lowest bytes first, as nearly all others are 0."""
    return zstandard.compress(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _add(key, rows):
    total = np.zeros(0, np.uint32)
    for x in rows.column("counts"):
        own = _unpacked(x.as_py())
        total = own if not len(total) else total + own
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([_packed(total)], pa.binary())})


def frequency_levels(src: DataFrame) -> tuple[np.ndarray, float]:
    """For each cell of the sketch, how far above the mean its count is, in powers of two; 0 for nearly all. And the count up to which a cell has level 0."""
    counts = np.zeros(1 << CELLS_LOG2, np.uint32)
    for r in src.mapInArrow(_count, "slice int, counts binary").groupBy("slice").applyInArrow(_add, "slice int, counts binary").collect():  # 2**23 counts, whatever the input
        own = _unpacked(r["counts"])
        counts[r["slice"] * len(own) : (r["slice"] + 1) * len(own)] = own
    usual = float(FREQUENT * (counts.mean() + 2))
    return np.floor(np.log2(1 + counts / usual)).astype(np.uint8), usual


def parts_of(level: np.ndarray, usual: float, rows: float) -> np.ndarray:
    """In how many parts of so many rows members of these levels are dealt, the same for a member wherever it occurs; 1 where the sketch shows nothing unusual."""
    return np.where(level > 0, np.maximum(1, np.ceil(usual * (2.0 ** (level.astype(float) + 1) - 1) / rows)), 1).astype(np.int64)


def _describe(batches):
    for b in batches:
        sets = [shingles(t) for t in b.column(1).to_pylist()]
        digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()),
            pa.array([signature(s) for s in sets], pa.binary()), pa.array([tile_signature(s) for s in sets], pa.binary())],
            ["key", "th", "size", "digest", "sig", "tile_sig"])


def _prefixes(levels):
    """(member, part, band, key, size, marked) for the first members of each set; of equal sets that a task sees, only for one.

    A set that is at least as large as another and links with it shares one of its own first 1 - t members with it; the
    smaller set has it among its first 1 - 2t / (1 + t), which are marked.
    """

    def run(batches):
        (level, usual, rows), seen = levels.value, set()
        for b in batches:
            cols = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(text)
                if not len(s) or (d := xxhash.xxh3_128_digest(s.tobytes())) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(d)
                first = len(s) - -(-PERCENT * len(s) // 100) + 1
                own = level[_cells(s)]
                order = np.lexsort((s, own))[:first] if own.any() else np.arange(first)
                s, own_parts = s[order], parts_of(own[order], usual, rows)
                part = (int.from_bytes(d[:6], "little") % own_parts).astype(np.int32)
                marked = np.arange(first) < len(own) - -(-2 * PERCENT * len(own) // (100 + PERCENT)) + 1
                cols.append((s.view(np.int64), np.where(own_parts > 1, part, -1).astype(np.int32),
                    np.full(first, int(np.log(len(own)) / np.log(BAND)), np.int32), np.full(first, key, np.int64),
                    np.full(first, len(own), np.int64), marked.astype(np.int8)))
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*cols, strict=True)], ["member", "part", "band", "key", "size", "marked"])

    return run


def _grouped(batches, keys: int, most: int = 200_000):
    """Arrays of whole groups (rows with equal first columns, so many), some at a time."""
    held, n = [], 0
    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        n += b.num_rows
        if n > most:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            other = np.flatnonzero(np.any([c != c[-1] for c in cols[:keys]], axis=0))
            end = int(other[-1]) + 1 if len(other) else 0
            if end:
                yield [c[:end] for c in cols]
            held, n = [[c[end:] for c in cols]], len(cols[0]) - end
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _fit(x, y, key, size, marked):
    """Whether rows x and y of a tile are a pair to look at: sizes that can link, and the smaller one's member marked."""
    small = np.where((size[x] < size[y]) | ((size[x] == size[y]) & (key[x] < key[y])), marked[x], marked[y])
    return (small > 0) & (key[x] != key[y]) & links(np.minimum(size[x], size[y]), size[x], size[y])


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, the smaller first."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    return a[new], b[new]


_STARS = "kind tinyint, a long, b long, member long, part int, band int, size long, marked tinyint"


def _stars(batches):
    """Kind 0: each document paired with the first of its tile and of the tile of the band below. Kind 1: the rows of members with three documents or more, and of all that are dealt in parts. Kind 2: the firsts of the tiles of a part."""
    names = [c.split()[0] for c in _STARS.split(", ")]

    def batch(kind, a, b, *rest):
        n = len(a)
        none = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int8())]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), pa.array(a), pa.nulls(n, pa.int64()) if b is None else pa.array(b),
            *([pa.array(c) for c in rest] or none)], names)

    for member, part, band, key, size, marked in _grouped(batches, 2):
        new = np.concatenate([[True], (member[1:] != member[:-1]) | (part[1:] != part[:-1])])
        group = np.cumsum(new) - 1
        m = np.bincount(group)[group]
        keep = (m > 1) | (part >= 0)
        member, part, band, key, size, marked, m = (x[keep] for x in (member, part, band, key, size, marked, m))
        if not len(member):
            continue
        same = (member[1:] == member[:-1]) & (part[1:] == part[:-1])
        new = np.concatenate([[True], ~same | (band[1:] != band[:-1])])
        tile, first = np.cumsum(new) - 1, np.flatnonzero(new)
        follows = (member[first[1:]] == member[first[:-1]]) & (part[first[1:]] == part[first[:-1]]) & (band[first[1:]] == band[first[:-1]] + 1)
        below = np.concatenate([[-1], np.where(follows, first[:-1], -1)])[tile]
        at = np.arange(len(member))
        x, y = np.concatenate([at, at[below >= 0]]), np.concatenate([first[tile], below[below >= 0]])
        # the first of a tile, too, against all of the band below
        up = np.full(len(first), -1)
        up[:-1] = np.where(follows, first[1:], -1)
        up = up[tile]
        x, y = np.concatenate([x, at[up >= 0]]), np.concatenate([y, up[up >= 0]])
        fit = _fit(x, y, key, size, marked)
        a, b = _pairs(key[x[fit]], key[y[fit]])
        if len(a):
            yield batch(0, a, b)
        if (rest := (m > 2) | (part >= 0)).any():
            yield batch(1, key[rest], None, member[rest], part[rest], band[rest], size[rest], marked[rest])
        if len(heads := first[part[first] >= 0]):
            yield batch(2, key[heads], None, member[heads], part[heads], band[heads], size[heads], marked[heads])


def _across(batches):
    """The pairs of a member's documents in one band or neighbouring ones that lie in different components and whose bitmaps may link; of two parts, the pairs between them."""
    out_a, out_b, n = [], [], 0

    def batch():
        a, b = _pairs(np.concatenate(out_a), np.concatenate(out_b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for member, lo, hi, band, key, size, marked, comp, own, sig in _grouped(batches, 3, 50_000):
        sig = np.frombuffer(b"".join(sig.tolist()), np.uint64).reshape(len(key), -1)
        cuts = [*np.flatnonzero(np.concatenate([[True], (member[1:] != member[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])).tolist(), len(member)]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            two = lo[start] != hi[start]
            for i in range(start, stop):
                to = np.arange(i + 1, int(np.searchsorted(band[start:stop], band[i] + 1, "right")) + start)
                to = to[(comp[to] != comp[i]) & ((own[to] != own[i]) if two else True)]
                to = to[_fit(np.full(len(to), i), to, key, size, marked)]
                apart = np.bitwise_count(sig[to] ^ sig[i]).sum(1, dtype=np.int64)
                to = to[links((size[to] + size[i] - apart) // 2, size[to], size[i])]
                if len(to):
                    out_b.append(key[to])
                    out_a.append(np.full(len(to), key[i]))
                    n += len(to)
            if n > 500_000:
                yield batch()
                out_a, out_b, n = [], [], 0
    if n:
        yield batch()


def _bounded(batches):
    for b in batches:
        keep = [i for i, (x, sx, y, sy) in enumerate(zip(*(b.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True)) if may_link(x, sx, y, sy)]
        yield b.take(pa.array(keep, pa.int64())).select([0, 1])


def _exact(batches):
    last, own = None, np.zeros(0, np.uint64)
    for b in batches:
        keep = []
        for i, (a, x, y) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
            if last is None or a != last[0] or x != last[1]:
                last, own = (a, x), shingles(x)
            other = shingles(y)
            if len(own) and len(other) and links(len(np.intersect1d(own, other, assume_unique=True)), len(own), len(other)):
                keep.append(i)
        yield b.take(pa.array(keep, pa.int64())).select([0, 1])


def _verified(pairs: DataFrame, info: DataFrame, src: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, cut."""
    side = lambda c: info.select(F.col("key").alias(c), F.col("size").alias(f"size_{c}"), F.col("sig").alias(f"sig_{c}"), F.col("digest").alias(f"digest_{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter("digest_a <> digest_b")
    near = cut(near.select("a", "b", "size_a", "sig_a", "size_b", "sig_b").mapInArrow(_bounded, "a long, b long"))
    named = near.select(F.col("a").alias("k")).unionByName(near.select(F.col("b").alias("k"))).distinct()
    if named.count() <= BROADCAST_IDS:
        named = F.broadcast(named)
    texts = src.join(named, F.col("key") == F.col("k"), "left_semi")
    both = near.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_b")
    both = both.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    return cut(both.select("a", "b", "text_a", "text_b").mapInArrow(_exact, "a long, b long").distinct())


def _block_links(sets: list[np.ndarray], n: np.ndarray, block: np.ndarray, inside: bool) -> np.ndarray:
    """For each set, the rows of the others it links with; if not inside, of those in another block."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size, weight, block = size[order], n[order], block[order]
    words, member = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size)])
    own, total = np.zeros(len(words), np.int32), np.zeros(len(sets), np.int64)
    for i in range(len(sets) - 1):
        end = int(np.searchsorted(PERCENT * size, 100 * size[i], "right"))
        if end > i + 1:
            mine = member[starts[i] : starts[i + 1]]
            own[mine] = 1
            both = np.add.reduceat(own[member[starts[i + 1] : starts[end]]], starts[i + 1 : end] - starts[i + 1])
            own[mine] = 0
            to = i + 1 + np.flatnonzero(links(both, size[i], size[i + 1 : end]) & (inside | (block[i + 1 : end] != block[i])))
            total[i] += weight[to].sum()
            total[to] += weight[i]
    out = np.zeros(len(sets), np.int64)
    out[order] = total
    return out


def _inside(batches):
    """(digest, links) from rows (component, lo, hi, block, digest, n, text), sorted by component, lo, hi: the links between blocks lo and hi."""
    last, held = None, {}

    def batch():
        rows = list(held.items())
        out = _block_links([r[1][2] for r in rows], np.array([r[1][1] for r in rows]), np.array([r[1][0] for r in rows]), last[1] == last[2])
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array(out, pa.int64())], ["digest", "links"])

    for b in batches:
        for *pair, block, digest, n, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if pair != last and held:
                yield batch()
            last = pair
            if digest not in held:  # a row repeated wholly comes with all its copies
                held[digest] = (block, n, shingles(text))
    if held:
        yield batch()


def _degrees(src: DataFrame, filled: DataFrame, parts: DataFrame) -> DataFrame:
    """(digest, n_links) of each set: its rows less one, and the rows of all the sets it links with."""
    sets = cut(filled.groupBy("digest").agg(F.min(F.struct("key", "th")).alias("row"), F.first("size").alias("size"), F.count("*").alias("n")))
    groups = sets.select("digest", "row.*", "size", "n").join(parts, F.col("key") == F.col("node")).drop("node")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    many = groups.groupBy(F.col("component").alias("whole")).agg(F.count("*").alias("m"), blocks.alias("blocks")).filter("m > 1").drop("m")
    named = cut(groups.join(many, F.col("component") == F.col("whole")).select(F.col("key").alias("k"), F.col("th").alias("t"), "component", "digest", "n", "blocks"))
    rows = src.join(F.broadcast(named) if named.count() <= BROADCAST_IDS else named, (F.col("key") == F.col("k")) & (F.col("th") == F.col("t")))
    own = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = ["component", "lo", "hi"]
    rows = rows.select("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "digest", "n", "text")
    found = rows.repartition(*pair).sortWithinPartitions(*pair).mapInArrow(_inside, "digest binary, links long").groupBy("digest").agg(F.sum("links").alias("links"))
    return cut(sets.join(found, "digest", "left").select("digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest identifier reachable by links), n_links.

    n_links counts all the other rows whose sets link with the row's; equal sets link. Null and empty texts have no shingles
    and link with nothing. In the components, rows that share an identifier are one document with the links of all its
    texts, and so are all rows without an identifier.
    """
    src, info, filled, parts = _linked(docs, id_col, text_col)
    links_of = _degrees(src, filled, parts).withColumnRenamed("digest", "of")
    return _with_components(info.join(links_of, F.col("digest") == F.col("of"), "left"), parts, F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _with_components(info: DataFrame, parts: DataFrame, *more) -> DataFrame:
    null = lambda c: F.when(c != NULL_ID, c)
    out = info.join(parts, F.col("key") == F.col("node"), "left")
    return out.select(null(F.col("key")).alias("id"), F.col("size").alias("n_shingles"), null(F.coalesce("component", "key")).alias("component_id"), *more)


def _linked(docs: DataFrame, id_col: str, text_col: str):
    """The rows (key, text, th), what is known of each, of those with shingles, and the components."""
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("key"),
        F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    levels = spark.sparkContext.broadcast((*frequency_levels(src), PART_ROWS))  # 8 MB
    info = cut(src.mapInArrow(_describe, "key long, th long, size long, digest binary, sig binary, tile_sig binary"))
    tile = ["member", "part"]
    order = [*tile, "band", "key"]
    rows = src.mapInArrow(_prefixes(levels), "member long, part int, band int, key long, size long, marked tinyint")
    tiles = cut(rows.repartition(*tile).sortWithinPartitions(*order).mapInArrow(_stars, _STARS))
    heads = tiles.filter("kind = 2").select("member", F.lit(-1).alias("part"), "band", F.col("a").alias("key"), "size", "marked")  # a few rows a part
    between = heads.repartition("member").sortWithinPartitions(*order).mapInArrow(_stars, _STARS)
    filled = info.filter("size > 0")
    same = filled.groupBy("digest").agg(F.min("key").alias("head"))
    copies = filled.join(same, "digest").filter("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b"))
    tested = tiles.unionByName(between).filter("kind = 0").select("a", "b").distinct()
    found = _verified(tested, filled, src)
    parts = components(found.unionByName(copies))
    rest = tiles.filter("kind = 1").select("member", "part", "band", F.col("a").alias("key"), "size", "marked").join(parts.withColumnRenamed("node", "key"), "key", "left")
    rest = cut(rest.withColumn("comp", F.coalesce("component", "key")).drop("component"))
    open_ = rest.groupBy(F.col("member").alias("of")).agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).filter("low < high")
    rest = rest.join(open_.select("of", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts")), F.col("member") == F.col("of"))
    rest = rest.join(filled.select(F.col("key").alias("k"), "tile_sig"), F.col("key") == F.col("k"))
    rest = rest.withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair = ["member", "lo", "hi"]
    rest = rest.select("member", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "band", "key", "size", "marked",
        "comp", "own", "tile_sig").repartition(*pair).sortWithinPartitions(*pair, "band", "key")
    more = _verified(rest.mapInArrow(_across, "a long, b long").distinct().join(tested, ["a", "b"], "left_anti"), filled, src)
    if not more.isEmpty():
        found = found.unionByName(more)
        parts = components(found.unionByName(copies))
    return src, info, filled, parts


def _gone(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The identifiers, unique ones, that their components hold under a smaller one."""
    _, info, _, parts = _linked(docs, id_col, text_col)
    return _with_components(info, parts).filter("component_id <> id").select("id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component of near copies: the one with the smallest identifier, null before all others.

    If identifiers repeat or are null, rows are told apart by identifier and text, numbered in that order, and each is a
    document of its own in the links; of rows repeated wholly (in these two) one stays. Rows without shingles, null texts
    among them, link with nothing. An empty table stays empty, and other columns may have any names.
    """
    gone_id, own, row_id, place_of = unused(docs, "gone", "own", "row", "place")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    if docs.groupBy(key.alias("k")).count().filter((F.col("count") > 1) | (F.col("k") == NULL_ID)).isEmpty():
        gone = _gone(docs, id_col, text_col).withColumnRenamed("id", gone_id)
        return docs.join(gone, F.col(id_col) == F.col(gone_id), "left_anti")
    row = F.struct(key.alias("key"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("th"))
    place = dense_index(docs.select(row.alias(own)).distinct(), own, row_id).withColumnRenamed(own, place_of)
    rows = cut(docs.withColumn(own, row).join(place, F.col(own) == F.col(place_of)).drop(own, place_of).dropDuplicates([row_id]))
    gone = _gone(rows, row_id, text_col).withColumnRenamed("id", gone_id)
    return rows.join(gone, F.col(row_id) == F.col(gone_id), "left_anti").drop(row_id)


def query(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
