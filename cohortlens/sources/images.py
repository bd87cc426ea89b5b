"""Image files as rows: decoded where they lie, with a status row for each file that can't be."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship

MEASURED = "path string, status string, width int, height int, mean double, message string"
_MAGIC = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(pixels: np.ndarray) -> bytes:
    """A grey 8-bit PNG of a matrix."""
    h, w = pixels.shape
    raw = np.hstack([np.zeros((h, 1), np.uint8), pixels.astype(np.uint8)]).tobytes()
    return _MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, channels) of an 8-bit PNG without interlacing or palette; anything else, and broken data, is an error."""
    if not data.startswith(_MAGIC):
        raise ValueError("not a PNG")
    at, head, body = len(_MAGIC), None, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if len(part) < n or zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"chunk {kind.decode('latin-1')} is broken")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ValueError("unsupported PNG")
    w, h, channels = head[0], head[1], _CHANNELS[head[3]]
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h + 1, w + 1, channels), np.int64)  # a zero row above and a zero pixel to the left
    for y in range(h):
        kind, line = int(rows[y, 0]), rows[y, 1:].reshape(w, channels).astype(np.int64)
        up = out[y, 1:]
        if kind in (0, 2):
            out[y + 1, 1:] = (line + (up if kind else 0)) & 255
            continue
        if kind not in (1, 3, 4):
            raise ValueError(f"filter {kind}")
        for x in range(w):
            left, above, corner = out[y + 1, x], out[y, x + 1], out[y, x]
            if kind == 1:
                guess = left
            elif kind == 3:
                guess = (left + above) // 2
            else:
                p = left + above - corner
                a, b, c = abs(p - left), abs(p - above), abs(p - corner)
                guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
            out[y + 1, x + 1] = (line[x] + guess) & 255
    return out[1:, 1:]


def measure(files: DataFrame) -> DataFrame:
    """MEASURED of files (path, content): size and mean of each image; a file that can't be decoded is a row with status error."""
    ship(files.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    x = decode_png(content or b"")
                    rows.append((path, "success", x.shape[1], x.shape[0], float(x.mean()), None))
                except Exception as e:
                    rows.append((path, "error", None, None, None, str(e)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in MEASURED.split(", ")])

    return files.select("path", "content").mapInArrow(run, MEASURED)
