"""The numbers of :func:`scalars.hash_number` for many repeats of many rows: MD5 as operations on arrays."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows that are hashed at once, so that they stay in the processor's cache.
ROWS = 1 << 14
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [t for turn in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in turn * 4]
_WORDS = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _first_words(words: list, n: int) -> np.ndarray:
    """The first 32 bits, as a number, of the MD5 of n messages of one block; each of its 16 words is an array or the same for all."""
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i, (added, turn, w) in enumerate(zip(_ADDED, _TURNS, _WORDS, strict=True)):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        f += a
        if isinstance(words[w], np.ndarray):
            f += words[w]
        else:
            added = (added + words[w]) & 0xFFFFFFFF
        f += np.uint32(added)
        np.left_shift(f, np.uint32(turn), out=t)
        f >>= np.uint32(32 - turn)
        f |= t
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    a += np.uint32(_START[0])
    return a.byteswap()


def suffix(key: Column) -> Column:
    """What :func:`scalars.hash_number` puts after seed and repeat: a bar and the key, nothing for a null."""
    return F.coalesce(F.concat(F.lit("|"), key.cast("string")), F.lit(""))


def hash_numbers(prefixes: list[str], suffixes: pa.Array) -> Iterator[np.ndarray]:
    """For each prefix in turn the hash numbers of all rows; rows are best :data:`ROWS` at most.  Messages of over 55 bytes are hashed one by one."""
    suffixes = suffixes.cast(pa.large_string()).combine_chunks() if isinstance(suffixes, pa.ChunkedArray) else suffixes.cast(pa.large_string())
    n = len(suffixes)
    offsets = np.frombuffer(suffixes.buffers()[1], np.int64)[suffixes.offset : suffixes.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(suffixes.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    row, place = np.repeat(np.arange(n), sizes), np.arange(len(raw)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    laid: dict[int, tuple] = {}
    for text in prefixes:
        prefix = text.encode()
        if (at := len(prefix)) not in laid:
            far = np.flatnonzero(sizes > 55 - at)
            near = np.where(sizes <= 55 - at, sizes, 0)
            block, short = np.zeros((n, 64), np.uint8), near[row] > 0
            block[row[short], at + place[short]] = raw[short]
            block[np.arange(n), at + near] = 0x80
            block[:, 56:] = ((at + near) * 8).astype("<u8")[:, None].view(np.uint8)
            words = block.view("<u4").T
            laid[at] = [np.ascontiguousarray(w) if n and (w != w[0]).any() else int(w[0]) if n else 0 for w in words], [(int(i), suffixes[int(i)].as_py().encode()) for i in far]
        words, long = laid[at]
        head = np.frombuffer(prefix.ljust(64, b"\0"), "<u4")
        out = _first_words([w + h if isinstance(w, np.ndarray) else w + int(h) for w, h in zip(words, head, strict=True)], n)
        for i, rest in long:
            out[i] = int.from_bytes(hashlib.md5(prefix + rest).digest()[:4], "big")
        yield out
