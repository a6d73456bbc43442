"""Arrow helpers shared by the operators of this subpackage."""
import contextlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries a worker's cache may hold; it is emptied beyond that, so memory stays bounded.
CACHE = 400_000
U = np.uint64


class Packed(dict):
    """unit -> packed bytes, made on a miss by pack(unit)."""

    def __init__(self, pack, limit=CACHE):
        super().__init__()
        self.pack, self.limit = pack, limit

    def __missing__(self, unit):
        if len(self) >= self.limit:
            self.clear()
        self[unit] = v = self.pack(unit)
        return v


@contextlib.contextmanager
def settings(spark, wanted):
    """Session settings for what is run inside, put back after."""
    had = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def lists(arrays, dtype):
    """Arrow list array of numpy arrays."""
    ends = np.cumsum([0] + [len(x) for x in arrays]).astype(np.int32)
    flat = np.concatenate(arrays).astype(dtype) if arrays else np.empty(0, dtype)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def rows(schema, columns):
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip(columns, schema)], schema=schema)


def in_parts(batches, size=500):
    """Small slices: one slice's Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def utf8(column):
    """(bytes as uint8, row offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, width)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8), (at - at[0]).astype(np.int64)


def by_bytes(batches, column, most=1 << 21):
    """Slices of at least one row whose texts hold about `most` bytes together."""
    for batch in batches:
        at = utf8(batch.column(column))[1]
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def mix(h):
    """splitmix64 finaliser."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
VALUE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_powers = np.ones(1, U)


def powers(n):
    """At least n powers of an odd multiplier, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        step = np.full(1 << max(10, int(n - 1).bit_length()), U(0x9E3779B97F4A7C15 | 1))
        step[0] = 1
        _powers = np.cumprod(step, dtype=U)
    return _powers


def word_hashes(data, piece=1 << 22):
    """(64-bit hash, first byte, last three lower-cased bytes as a number) of each word of a byte array: A-Z lower-cased, words end at space and U+0009 to U+000D. At most about `piece` bytes, and one word, at a time."""
    found, firsts, lasts, lo = [], [], [], 0
    while lo < len(data):
        hi = min(len(data), lo + piece)
        while hi < len(data) and not SPACE[data[hi]]:
            more = np.flatnonzero(SPACE[data[hi : hi + piece]])
            hi = hi + int(more[0]) if len(more) else min(len(data), hi + piece)
        x = data[lo:hi]
        inside = ~SPACE[x]
        edge = np.diff(inside.view(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(start):
            n = end - start
            first = np.cumsum(n) - n
            values = VALUE[LOWER[x[inside]]]
            values *= powers(int(n.max()))[np.arange(len(values)) - np.repeat(first, n)]
            found.append(mix(np.add.reduceat(values, first) + n.astype(U)))
            firsts.append(start + lo)
            last = np.concatenate([np.zeros(2, np.int64), LOWER[x]])
            lasts.append(last[end + 1] + (last[end] << 8) + (last[end - 1] << 16))
        lo = hi
    return tuple(map(np.concatenate, (found, firsts, lasts))) if found else (np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64))


def words_of_rows(column, endings=False):
    """(hashes of the words of all rows, place of each row's first word among them, and the end); with endings, also each word's last three bytes (or what stands before a shorter one) as a number."""
    data, at = utf8(column)
    space = at[1:-1]
    if len(space) and len(data):  # a word ends with its row
        inner = space[(space > 0) & (space < len(data))]
        cut = np.unique(inner)
        data = np.insert(data, cut, 32)
        at = at + np.searchsorted(cut, at, side="left")
    h, first, last = word_hashes(data)
    at = np.searchsorted(first, at, side="left")
    return (h, at, last) if endings else (h, at)
