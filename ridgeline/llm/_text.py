"""Vectorised kernels over whole texts: bytes of an Arrow column, words, hashes.

Every function works on all bytes of a text. A null text counts as an empty one unless its caller says otherwise.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C55)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
#: Words are maximal runs of anything but space and U+0009 to U+000D.
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Texts of a batch are worked on in slices of about so many bytes, which bounds a worker's memory.
SLICE_BYTES = 1 << 20
#: append() hands on a batch in parts of about so many bytes of text.
PART_BYTES = 4 << 20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the offsets of its rows (int64, one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes; a longer text makes a range of its own."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64, at least n of each; one pair of arrays for the process."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        up, down = np.full(size, BASE, U64), np.full(size, BASE_INVERSE, U64)
        up[0] = down[0] = 1
        _POWERS[:] = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
    return _POWERS[0], _POWERS[1]


@lru_cache(maxsize=1)
def _allocator():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


def release() -> None:
    """Give memory that a batch has freed back to the system, so that idle workers do not hold it."""
    pa.default_memory_pool().release_unused()
    _allocator()(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


#: Spans of up to so many bytes are hashed eight bytes at a time, longer ones by a digest.
LONG_BYTES = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range raw[start:end]; equal bytes give equal hashes wherever they lie.

    Up to eight bytes the hash is a bijection for each length. Every further eight bytes are mixed in by a function that is not linear, so that no pattern of bytes
    makes different ranges meet (as sums of powers modulo 2**64 do on Thue-Morse words); long ranges are hashed by BLAKE2. seed gives an independent hash.
    """
    n = len(starts)
    if n == 0:
        return np.zeros(0, U64)
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    size = ends - starts
    out = mix((eight[starts] & _MASKS[np.minimum(size, 8)]) ^ (size.astype(U64) * BASE_INVERSE + U64(seed) * BASE))
    live, done = np.flatnonzero((size > 8) & (size <= LONG_BYTES)), 8
    while len(live):
        left = size[live] - done
        out[live] = mix((out[live] * BASE) ^ (eight[starts[live] + done] & _MASKS[np.minimum(left, 8)]))
        live, done = live[left > 8], done + 8
    salt = seed.to_bytes(8, "little")
    for k in np.flatnonzero(size > LONG_BYTES):
        out[k] = int.from_bytes(hashlib.blake2b(padded[starts[k] : ends[k]], digest_size=8, salt=salt).digest(), "little")
    return out


def word_spans(raw: np.ndarray, at: np.ndarray, spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the offset of its first word (one more than rows)."""
    word = np.zeros(len(raw) + 2, dtype=bool)
    word[1:-1] = ~spaces[raw]
    bound = np.zeros(len(raw) + 1, dtype=bool)
    bound[at] = True
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | bound[:-1]))
    ends = np.flatnonzero(word[1:-1] & (~word[2:] | bound[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def words(raw: np.ndarray, at: np.ndarray, lower: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and for each row the offset of its first word."""
    starts, ends, first = word_spans(raw, at)
    return span_hashes(lower_ascii(raw) if lower else raw, starts, ends, seed), first


def _doubled(values: np.ndarray, width: int) -> np.ndarray:
    """From hashes of width consecutive values those of twice as many."""
    return mix(values[:-width] * BASE + values[width:]) if len(values) > width else np.zeros(0, U64)


def sequences(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each sequence values[first:last], none empty: of its first and its last 2**j values, which cover it, and its length."""
    size = (last - first).astype(np.int64)
    out, level = np.zeros(len(size), U64), np.frexp(size.astype(float))[1] - 1
    table, j = values, 0
    while j <= (level.max() if len(level) else -1):
        own = np.flatnonzero(level == j)
        out[own] = mix((table[first[own]] * BASE_INVERSE) ^ (table[last[own] - (1 << j)] + size[own].astype(U64)))
        table, j = _doubled(table, 1 << j), j + 1
    return out


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values, as sequences() gives it; rows must be told apart by the caller."""
    n, table, width = len(values) - k + 1, values, 1
    if n <= 0:
        return np.zeros(0, U64)
    while 2 * width <= k:
        table, width = _doubled(table, width), 2 * width
    return mix((table[:n] * BASE_INVERSE) ^ (table[k - width : k - width + n] + U64(k)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def append(docs, text: str, added: str, function):
    """docs with columns that function(text array) -> list of arrays gives; added: their DDL. Other columns pass through as one struct, whatever their names; columns of docs by the added names are replaced.

    The function gets a part of a batch at a time, so a worker never holds what it makes of a whole batch.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(added)
    docs = docs.drop(*new.names)
    row = "_row" if "_row" not in docs.columns else "_row_of_all"
    packed = docs.select(F.struct("*").alias(row))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(utf8(batch.column(0).field(place))[1], PART_BYTES):
                part = batch.column(0).slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part, *function(part.field(place))], names=[row, *new.names])
            release()

    schema = StructType([packed.schema[row], *new.fields])
    return packed.mapInArrow(run, schema).select(f"{row}.*", *new.names)
