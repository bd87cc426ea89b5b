"""Operator 9: order-preserving packing by dynamic programming.

Documents keep their order inside a partition and form one stream of tokens. Cuts may fall behind a document, behind a
sentence, or, where neither comes for a while, at fixed steps between. A window between two cuts is one sequence; the cuts
minimise padding plus a penalty for each truncated document or sentence. The minimum over the windows that end at a cut is a
sliding-window minimum, kept in a monotone queue, so the work is linear in the number of possible cuts. Partitions are
packed on their own, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

LENGTH = 1024
#: What a cut costs in tokens of padding: behind a document, behind a sentence, elsewhere.
PENALTY = (0, 2, 12)
#: Longest way without a possible cut.
STEP = 16
#: The stream is packed in blocks of so many tokens; a block's last windows are packed again with the next.
BLOCK = 1 << 20
#: How byte-level BPE of this vocabulary cuts a text before merging; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space from so many characters on goes to tokenizers.
LONG_SPACE = 5000
LONG_RUN = re.compile(rf"\s{{{LONG_SPACE}}}")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_tokens(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """A byte-level vocabulary by bytes: printable Latin-1 bytes stand for themselves, the others for the characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    back = {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}
    return {bytes(back[c] for c in token): i for token, i in vocabulary.items() if all(c in back for c in token)}


class Encoder:
    """Ids of texts as the tokenizers library gives them, with no tokens added.

    tiktoken merges with the same vocabulary, several times faster; a test holds the two together. A text with a special
    token's name or with a long run of white space, which tiktoken's pattern can't take, goes to tokenizers itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        ranks = byte_tokens({t: i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if t not in self.special})
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.closes = np.zeros(self.tok.get_vocab_size(), bool)
        self.closes[[i for t, i in ranks.items() if t.endswith((b".", b"!", b"?", b"\n"))]] = True

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special) or (len(text) >= LONG_SPACE and LONG_RUN.search(text)):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint16)
        return np.array(self.fast.encode_ordinary(text), np.uint16)


def cuts(at: np.ndarray, cost: np.ndarray) -> list[int]:
    """Best cuts of a stream. at: increasing possible cuts, the first 0, the last the end, at most LENGTH apart; cost: each one's penalty."""
    pos, pen = at.tolist(), cost.tolist()
    best, back, queue = [0] * len(pos), [0] * len(pos), deque([(0, 0, 0)])  # queue: (best + position, position, index), best values increasing
    for j in range(1, len(pos)):
        p = pos[j]
        while p - queue[0][1] > LENGTH:
            queue.popleft()
        value, _, i = queue[0]
        best[j] = b = value + LENGTH - p + pen[j]
        back[j] = i
        key = b + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    out, j = [], len(pos) - 1
    while j > 0:
        out.append(pos[j])
        j = back[j]
    return out[::-1]


class _Stream:
    """Tokens that are not yet packed: ids, and each document's identifier, tokens and place relative to the stream's begin."""

    def __init__(self, encoder: Encoder, part: int):
        self.encoder, self.part, self.n = encoder, part, 0
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int]] = []
        self.size = 0

    def add(self, doc_id, text: str | None) -> None:
        own = np.append(self.encoder.encode(text or ""), np.uint16(0))
        self.docs.append((doc_id, len(own), self.size))
        self.parts.append(own)
        self.size += len(own)

    def pack(self, last: bool) -> pa.RecordBatch | None:
        ids = np.concatenate(self.parts)
        ends = np.array([a + n for _, n, a in self.docs], np.int64)
        marks = np.full(len(ids) + 1, PENALTY[2], np.int64)
        marks[1:][self.encoder.closes[ids]] = PENALTY[1]
        marks[ends] = PENALTY[0]
        free = marks < PENALTY[2]
        free[[0, len(ids)]] = True
        place = np.arange(len(ids) + 1)
        at = np.flatnonzero((place - np.maximum.accumulate(np.where(free, place, 0))) % STEP == 0)
        chosen = cuts(at, marks[at])
        if not last:
            chosen = chosen[:-2]
        if not chosen:
            return None
        stop = chosen[-1]
        begins = np.array([max(a, 0) for _, _, a in self.docs], np.int64)
        seq = np.array([0, *chosen], np.int64)
        first = np.union1d(seq[:-1], begins[begins < stop])  # where pieces begin
        length = np.diff(np.append(first, stop))
        doc = np.searchsorted(begins, first, "right") - 1
        which = np.searchsorted(seq, first, "right") - 1
        wide = ids.astype("<u4")
        crc = [zlib.crc32(wide[a : a + n]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
        out = pa.RecordBatch.from_arrays(
            [pa.array([self.docs[d][0] for d in doc], pa.int64()), pa.array(first - np.array([self.docs[d][2] for d in doc])), pa.array(length),
                pa.array(crc, pa.int64()), pa.array([self.docs[d][1] for d in doc], pa.int64()), pa.array((self.part << 33) + self.n + which),
                pa.array(first - seq[which])],
            [c.split()[0] for c in SCHEMA.split(", ")],
        )
        self.n += len(chosen)
        self.docs = [(i, n, a - stop) for i, n, a in self.docs if a + n > stop]
        self.parts, self.size = [ids[stop:]], len(ids) - stop
        return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, see SCHEMA: where it lies in its document and in its sequence.

    Each document's ids, and a 0 behind them, lie in exactly one piece each; offsets in a sequence have no gaps. A null or
    empty text is the 0 alone. Repeated rows and identifiers are documents of their own. An empty table gives no pieces.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        stream = _Stream(Encoder(tokenizer), TaskContext.get().partitionId())
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                stream.add(i, text)
            if stream.size >= BLOCK and (out := stream.pack(False)):
                yield out
        if stream.size:
            yield stream.pack(True)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
