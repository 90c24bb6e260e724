"""Numpy over Arrow text: whole batches as one run of bytes, their words, and hashes of ranges of symbols.

All of it works inside a task, on one bounded group of documents at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
GROUP_BYTES = 2 << 20
LANES = 2


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row begins and ends; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(batches: Iterator[pa.RecordBatch], column: str, size: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `size` bytes of `column`, or one longer row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, at = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))]), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each row (one more entry than rows)."""
    inside = ~SPACE[data]
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, inside
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    after = np.empty(len(data) + 1, bool)
    after[-1], after[:-1] = False, inside
    ends = np.flatnonzero(inside & (~after[1:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all 64 (constants of splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2^64, kept as far as they have been needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, factor in (("up", self.base), ("down", self.inverse)):
                made = np.full(size, factor, U64)
                made[0] = 1
                setattr(self, name, np.multiply.accumulate(made))
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(0x9E3779B97F4A7C13), _Powers(0xC2B2AE3D27D4EB4B)]
BYTE_SYMBOLS = [np.random.default_rng(91 + lane).integers(0, 1 << 64, 256, U64) for lane in range(LANES)]


class Ranges:
    """Hashes of any ranges of a sequence of 64-bit symbols; equal ranges have equal hashes wherever they lie."""

    def __init__(self, symbols: np.ndarray, lane: int = 0):
        up, self.down = _POWERS[lane].get(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, U64)
        np.cumsum(symbols * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U64))

    def all_of(self, length: int) -> np.ndarray:
        """Of every range of this length, by its start."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, U64)
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n] + U64(length))


def word_symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash for each word."""
    made, at = np.empty(len(starts), U64), 0
    while at < len(starts):  # a very long text goes through in parts
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + 2 * GROUP_BYTES, "right")))
        first = starts[at]
        part = Ranges(BYTE_SYMBOLS[lane][data[first : ends[to - 1]]], lane)
        made[at:to] = part.of(starts[at:to] - first, ends[at:to] - first)
        at = to
    return made


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbouring values, by the first one's place."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


# Places within a group of documents take these low bits beside a hash's high bits.
_PLACE_BITS = 28
MOST_SYMBOLS = 1 << _PLACE_BITS


def anchors(symbols: Ranges, window: int, gram: int, row_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of `window` symbols that lie within a row, each with the place and the hash of its anchor.

    The anchor is the window's least `gram`-symbol hash, the leftmost of equals: it depends on the window's
    content alone, so equal windows have equal anchors at equal distances. `row_ends` gives, for each symbol,
    where its row ends. Returns window starts, anchor places and anchor hashes.
    """
    grams = symbols.all_of(gram)
    if len(grams) < window - gram + 1:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U64)
    low = U64(MOST_SYMBOLS - 1)
    least = sliding_minimum((grams & ~low) | np.arange(len(grams), dtype=U64), window - gram + 1)
    places = (least & low).astype(np.int64)
    starts = np.flatnonzero(row_ends[: len(places)] - np.arange(len(places)) >= window)
    places = places[starts]
    return starts, places, grams[places]


def runs(values: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def spans_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges, as maximal ranges in order; touching ranges join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])]


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Parts of an array as little-endian binary values; `bounds` has one more entry than parts."""
    return pa.Array.from_buffers(
        pa.binary() if values.nbytes < 1 << 31 else pa.large_binary(), len(bounds) - 1,
        [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32 if values.nbytes < 1 << 31 else np.int64)),
         pa.py_buffer(np.ascontiguousarray(values))],
    )
