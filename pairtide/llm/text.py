"""Arrow and numpy helpers that turn batches of texts into flat word arrays.

All helpers treat a null text as empty.  Words are maximal runs of characters
other than ASCII white space, ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one numpy step works on; bounds a worker's memory whatever the batch size.
CHUNK_BYTES = 4 << 20


def string_array(column) -> pa.Array:
    """One contiguous ``large_string`` array without nulls whose bytes start at 0.

    Some string kernels misread slices (``ascii_lower`` does in the pinned version), so slices are rebased."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) and (column.offset or np.frombuffer(column.buffers()[1], np.int64)[0]):
        column = from_bytes(*raw_bytes(column))
    return column


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, back to back, and each text's first byte (one entry more than texts)."""
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def from_bytes(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The reverse of :func:`raw_bytes`."""
    return pa.Array.from_buffers(
        pa.large_string(),
        len(bounds) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    )


def chunks(batch: pa.RecordBatch | pa.Table, column: str = "text", most: int = CHUNK_BYTES):
    """Slices of a batch with about ``most`` bytes of text each; a longer single row is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(np.asarray(sizes, np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and each text's first word (one entry more than texts)."""
    lists = pc.ascii_split_whitespace(texts)
    bounds = np.asarray(lists.offsets, np.int64)
    words = lists.flatten()
    full = np.asarray(pc.binary_length(words)) > 0
    before = np.concatenate([[0], np.cumsum(full)])
    return words.filter(pa.array(full)), before[bounds - bounds[0]]


def encode_words(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's code, and the distinct words by code."""
    if not len(words):
        return np.zeros(0, np.int64), words
    coded = pc.dictionary_encode(words)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return np.asarray(coded.indices, np.int64), coded.dictionary


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (a common finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Longer words are hashed one by one; the sums below are only as good as a hash while words are short.
LONG_WORD = 256
_POWERS = np.cumprod(np.full(LONG_WORD, mix(np.array([3], np.uint64))[0] | np.uint64(1)), dtype=np.uint64)


def hash_words(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: its bytes as a polynomial, mixed with its length."""
    data, bounds = raw_bytes(distinct.cast(pa.large_string()))
    sizes = np.diff(bounds)
    start = np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    out = mix(sizes.astype(np.uint64) + start)
    short = np.flatnonzero((sizes > 0) & (sizes <= LONG_WORD))
    if len(short) < len(sizes):
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            out[i] = xxhash.xxh64_intdigest(data[bounds[i] : bounds[i + 1]].tobytes(), seed)
        if not len(short):
            return out
        at = np.repeat(bounds[short] - np.concatenate([[0], np.cumsum(sizes[short])[:-1]]), sizes[short]) + np.arange(sizes[short].sum())
        data, sizes = data[at], sizes[short]
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    terms = (data.astype(np.uint64) + np.uint64(1)) * _POWERS[np.arange(len(data)) - np.repeat(firsts, sizes)]
    out[short] = mix(np.add.reduceat(terms, firsts) + out[short])
    return out


def planes(values: np.ndarray) -> bytes:
    """Numbers as byte planes, which compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def from_planes(raw, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def rising_planes(values: np.ndarray) -> bytes:
    """Ascending numbers as the byte planes of their differences."""
    return planes(np.diff(values, prepend=values.dtype.type(0)))


def from_rising_planes(raw, kind) -> np.ndarray:
    return np.cumsum(from_planes(raw, kind), dtype=kind)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each ``size`` consecutive entries: a polynomial in an odd base, built by doubling."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    power, out, done, block, length = _ODD, None, 0, hashes, 1
    n = len(hashes) - size + 1
    with np.errstate(over="ignore"):
        left = size
        while left:
            if left & 1:
                part = block[done : done + n]
                out = part.copy() if out is None else out * power + part
                done += length
            left >>= 1
            if left:
                block = block[: len(block) - length] * power + block[length:]
                power, length = power * power, length * 2
    return mix(out)


def starts_of(bounds: np.ndarray, size: int) -> np.ndarray:
    """A flag for each entry at which a window of ``size`` entries of one text starts."""
    n = int(bounds[-1])
    ok = np.ones(n, bool)
    for k in range(1, size):
        ends = bounds[1:] - k
        ok[ends[ends >= bounds[:-1]]] = False
    return ok


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The text's number for each entry."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sums_by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def without(df: DataFrame, names) -> DataFrame:
    """``df`` without the columns that an operator is about to add, whatever their case."""
    names = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])


def widened(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with more fields at its end."""
    return StructType(df.schema.fields + StructType.fromDDL(ddl).fields)


def appended(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    """``batch`` with more columns at its end."""
    arrays = [*batch.columns, *(v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values())]
    return pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *columns])
