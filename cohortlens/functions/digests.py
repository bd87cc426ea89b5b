"""MD5 of many short texts at once, in vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np

_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_START = tuple(np.array([x], np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
#: Texts of a vector, so few that it stays in a core's cache.
VECTOR = 1 << 14


def _compressed(state: Sequence[np.ndarray], words: Sequence[np.ndarray]) -> tuple[np.ndarray, ...]:
    """The state after a block of 16 words; each is a vector, or one number for all."""
    a, b, c, d = state
    for i in range(64):
        if i < 16:
            f, g = ((c ^ d) & b) ^ d, i
        elif i < 32:
            f, g = ((b ^ c) & d) ^ c, (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = (b | ~d) ^ c, 7 * i % 16
        f = f + a + (words[g] + np.uint32(_SINES[i]))
        s = _SHIFTS[i]
        a, b, c, d = d, b + ((f << np.uint32(s)) | (f >> np.uint32(32 - s))), b, c
    return tuple(x + y for x, y in zip(state, (a, b, c, d), strict=True))


def _ranges(start: int, stop: int) -> Iterator[tuple[int, int, int]]:
    """(from, to, digits): the range in vectors of numbers with as many digits."""
    while start < stop:
        digits = len(str(start))
        to = min(stop, 10**digits, start + VECTOR)
        yield start, to, digits
        start = to


def leading32(before: bytes, start: int, stop: int, after: bytes = b"") -> np.ndarray:
    """The first 32 bits of md5(before + j + after), as whole numbers, for each j from start to stop, in decimal digits."""
    out = np.empty(stop - start, np.int64)
    whole = len(before) // 64 * 64
    state: tuple[np.ndarray, ...] = _START
    for i in range(0, whole, 64):
        state = _compressed(state, [np.array([w], np.uint32) for w in np.frombuffer(before[i : i + 64], "<u4")])
    rest = before[whole:]
    for lo, hi, digits in _ranges(start, stop):
        n = len(rest) + digits + len(after)
        size = (n + 9 + 63) // 64 * 64
        fixed = bytearray(rest + bytes(digits) + after + b"\x80" + bytes(size - n - 1))
        fixed[-8:] = (8 * (whole + n)).to_bytes(8, "little")
        words = [np.array([w], np.uint32) for w in np.frombuffer(bytes(fixed), "<u4")]
        j = np.arange(lo, hi, dtype=np.int64)
        for at in range(len(rest) + digits - 1, len(rest) - 1, -1):
            j, digit = np.divmod(j, 10)
            words[at // 4] = words[at // 4] + ((digit.astype(np.uint32) + np.uint32(48)) << np.uint32(at % 4 * 8))
        own = state
        for i in range(0, size // 4, 16):
            own = _compressed(own, words[i : i + 16])
        out[lo - start : hi - start] = own[0].byteswap()
    return out
