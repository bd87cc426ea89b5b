"""Operator 1: sentencepiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary holds a whitespace marker behind another character, so a text falls apart at the markers into
chunks (a run of markers and the characters after it) that are segmented independently. A task reads a block of documents
and keeps, instead of texts, the positions' codes into the block's list of distinct chunks. The lists of all blocks are
brought together by chunk, each distinct chunk is segmented once, and its ids return to the blocks, where they are joined
back by position. Only codes and distinct chunks are shuffled, never words by the occurrence.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: A block closes at so many characters; it bounds what one group of the last join holds.
BLOCK_CHARS = 16_000_000
#: Positions in one row of codes, unless one document has more.
ROW_CODES = 200_000


def crossing_pieces(model: str) -> list[str]:
    """Pieces with a marker behind another character; the method needs that there are none."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if MARK in p.lstrip(MARK)]


def chunks_of(text: str) -> list[str]:
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def _planes(a: np.ndarray) -> bytes:
    """Compressed; the numbers' lowest bytes stand together, then the next."""
    return zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes(), 3)


def _unplanes(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(dtype).reshape(-1)


def _texts(items: list[str]) -> bytes:
    return zstandard.compress("\x01".join(x.replace("\x02", "\x02b").replace("\x01", "\x02a") for x in items).encode(), 3)


def _untexts(data: bytes) -> list[str]:
    items = zstandard.decompress(data).decode().split("\x01")
    return [x.replace("\x02a", "\x01").replace("\x02b", "\x02") if "\x02" in x else x for x in items]


class _Block:
    """Documents that are read together: each distinct chunk's code, and a digest of the texts, as two scans must cut blocks alike."""

    def __init__(self):
        self.code: dict[str, int] = {}
        self.size, self.digest = 0, xxhash.xxh64()

    def add(self, text: str, positions: bool) -> np.ndarray | None:
        chunks, code = chunks_of(text), self.code
        self.size += len(text)
        self.digest.update(text.encode() + b"\xff")
        if positions:
            return np.fromiter((code.setdefault(c, len(code)) for c in chunks), np.int32, len(chunks))
        for c in chunks:
            if c not in code:
                code[c] = len(code)
        return None

    def name(self, part: int, n: int) -> int:
        return xxhash.xxh64_intdigest(f"{part}.{n}.{self.digest.hexdigest()}") >> 1


def _emit_chunks(buckets: int):
    """A block's distinct chunks, dealt to buckets by a hash: one row for a block and bucket."""

    def emit(batches):
        from pyspark import TaskContext

        part, n, block = TaskContext.get().partitionId(), 0, _Block()

        def rows():
            chunks = list(block.code)
            at = np.fromiter((zlib.crc32(c.encode()) for c in chunks), np.uint32, len(chunks)) % buckets
            order = np.argsort(at, kind="stable").astype(np.int32)
            name, ends = block.name(part, n), np.cumsum(np.bincount(at, minlength=buckets))
            for k in range(buckets):
                if len(own := order[ends[k - 1] if k else 0 : ends[k]]):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([name], pa.int64()),
                        pa.array([_planes(np.diff(own, prepend=0).astype(np.int32))], pa.binary()),
                        pa.array([_texts([chunks[j] for j in own])], pa.binary())], ["bucket", "block", "codes", "chunks"])

        for batch in batches:
            for text in batch.column(1).to_pylist():
                block.add(text or "", False)
                if block.size >= BLOCK_CHARS:
                    yield from rows()
                    n, block = n + 1, _Block()
        yield from rows()

    return emit


def _emit_codes(batches):
    """A block's documents as codes, several in a row; the block's name is known when it ends."""
    from pyspark import TaskContext

    part, n, block, done, ids, rows = TaskContext.get().partitionId(), 0, _Block(), [], [], []

    def pack():
        done.append((list(ids), [len(r) for r in rows], _planes(np.concatenate(rows)) if sum(map(len, rows)) else b""))
        ids.clear()
        rows.clear()

    def out():
        pack()
        name = block.name(part, n)
        for i, lengths, data in done:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([i], pa.list_(pa.int64())),
                pa.array([lengths], pa.list_(pa.int32())), pa.array([data], pa.binary())], ["block", "ids", "lengths", "codes"])
        done.clear()

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            rows.append(block.add(text or "", True))
            if sum(map(len, rows[-1:])) + len(rows) * 500 > ROW_CODES or len(rows) % 64 == 0 and sum(map(len, rows)) > ROW_CODES:
                pack()
            if block.size >= BLOCK_CHARS:
                yield from out()
                n, block = n + 1, _Block()
    if ids or done:
        yield from out()


def _segmenter(model: str):
    """Segments a bucket's distinct chunks, each once, and answers every block's list of them."""

    def segment(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        mark, bucket, known = sp.piece_to_id(MARK), None, {}
        for batch in batches:
            answers = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if k != bucket:
                    bucket, known = k, {MARK: np.array([mark], np.uint16).tobytes()}
                chunks = _untexts(data)
                new = [c for c in chunks if c not in known]
                for c, own in zip(new, sp.encode([c[1:].replace(MARK, " ") for c in new], num_threads=1), strict=True):
                    known[c] = array("H", own).tobytes()
                own = [known[c] for c in chunks]
                answers.append(zstandard.compress(np.array([len(x) for x in own], np.uint32).tobytes() + b"".join(own), 3))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(answers, pa.binary())], ["block", "codes", "answers"])

    return segment


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids (little-endian uint16 as binary), decoded (the ids' text).

    Null texts count as empty; an empty text has no ids and decodes to the empty text. Repeated rows and null or repeated
    identifiers are carried through; other columns are not. docs must give the same rows in the same order when it is read
    twice, as a scan does; if it doesn't, the job fails instead of joining wrong ids.
    """
    if bad := crossing_pieces(model):
        raise ValueError(f"pieces cross whitespace markers: {bad[:3]}")
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = src.mapInArrow(_emit_chunks(buckets), "bucket int, block long, codes binary, chunks binary")
    segmented = chunks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_segmenter(model), "block long, codes binary, answers binary")
    coded = src.mapInArrow(_emit_codes, "block long, ids array<long>, lengths array<int>, codes binary")

    def assemble(rows: pa.Table, own: pa.Table) -> pa.Table:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        known: dict[int, bytes] = {}
        for codes, data in zip(own.column("codes").to_pylist(), own.column("answers").to_pylist(), strict=True):
            at, raw = np.cumsum(_unplanes(codes, np.int32)), zstandard.decompress(data)
            ends = np.cumsum(np.frombuffer(raw, np.uint32, len(at))) + 4 * len(at)
            known.update((c, raw[a:b]) for c, a, b in zip(at.tolist(), [4 * len(at), *ends[:-1].tolist()], ends.tolist(), strict=True))
        out_ids, out, text = [], [], []
        for ids, lengths, data in zip(rows.column("ids").to_pylist(), rows.column("lengths").to_pylist(), rows.column("codes").to_pylist(), strict=True):
            codes, a = _unplanes(data, np.int32).tolist() if data else [], 0
            for i, n in zip(ids, lengths, strict=True):
                out_ids.append(i)
                out.append(b"".join([known[c] for c in codes[a : a + n]]))  # a KeyError: the two scans cut different blocks
                text.append(sp.decode(np.frombuffer(out[-1], np.uint16).tolist()) if n else "")
                a += n
        return pa.table({"id": pa.array(out_ids, pa.int64()), "ids": pa.array(out, pa.binary()), "decoded": pa.array(text, pa.string())})

    return coded.groupBy("block").cogroup(segmented.groupBy("block")).applyInArrow(assemble, "id long, ids binary, decoded string")


def _digests(batches):
    for batch in batches:
        n, h, d = [], [], []
        for ids, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own = np.frombuffer(ids, np.uint16)
            n.append(len(own))
            h.append(hashlib.sha256(",".join(map(str, own.tolist())).encode()).hexdigest())
            d.append(hashlib.sha256(text.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(h), pa.array(d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.mapInArrow(_digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
