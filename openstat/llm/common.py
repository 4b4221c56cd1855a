"""Helpers shared by the operators: word hashes, batches and scratch tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches to about `limit` bytes of text, so that memory does not follow row sizes."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.nan_to_num(np.asarray(pa.compute.binary_length(column).to_numpy(zero_copy_only=False), float))
        ends = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(ends[1:] != ends[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit value."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Hashes of all runs of k values, from one pass of prefix sums modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, self.BASE, np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, self.INVERSE, np.uint64)])

    def sums(self, values: np.ndarray) -> np.ndarray:
        self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (sums[ends] - sums[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(np.uint64))

    def grams(self, sums: np.ndarray, k: int) -> np.ndarray:
        """Hash of the run that starts at each value; empty if there are fewer than k."""
        if len(sums) <= k:
            return np.empty(0, np.uint64)
        raw = (sums[k:] - sums[:-k]) * self.down[: len(sums) - k]
        return mix(raw + np.uint64(k))


#: Classes of bytes: 0 separates words, and a word is a run of one other class.
NOT_SPACE = np.array([0 if b == 0x20 or 0x09 <= b <= 0x0D else 1 for b in range(256)], np.uint8)
#: Random numbers for the bytes, and the same with A-Z as a-z.
BYTES = mix(np.arange(1, 257, dtype=np.uint64))
LOWER_BYTES = BYTES[[b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)]]


class WordScan:
    """64-bit hashes of the words of a text column, straight from its bytes.

    A text longer than `most` bytes is scanned in parts that end between words.
    """

    def __init__(self, classes: np.ndarray = NOT_SPACE, values: np.ndarray = BYTES, most: int = 4 << 20) -> None:
        self.classes, self.values, self.most, self.rolling = classes, values, most, Rolling()

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The words of all rows in order, and how many each row has."""
        column = (column.fill_null("") if column.null_count else column).cast(pa.binary())
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        if len(data) <= self.most:
            return self._scan(data, offsets)
        found, counts = [np.empty(0, np.uint64)], np.zeros(len(column), np.int64)
        for row, (a, end) in enumerate(zip(offsets, offsets[1:])):
            while a < end:
                b = min(a + self.most, end)
                while b < end and not (gaps := np.flatnonzero(self.classes[data[a:b]] == 0)).size:
                    b = min(b + self.most, end)
                if b < end:
                    b = a + int(gaps[-1]) + 1
                words, n = self._scan(data[a:b], np.array([0, b - a]))
                found.append(words)
                counts[row] += n[0]
                a = b
        return np.concatenate(found), counts

    def _scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
        kind = self.classes[data]
        before, after = np.zeros_like(kind), np.zeros_like(kind)
        before[1:], after[:-1] = kind[:-1], kind[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        before[inner] = 0
        after[inner - 1] = 0
        word = kind != 0
        starts = np.flatnonzero(word & (kind != before))
        ends = np.flatnonzero(word & (kind != after)) + 1
        hashes = self.rolling.between(self.rolling.sums(self.values[data]), starts, ends)
        return hashes, np.diff(np.searchsorted(starts, offsets))


def split_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words without gaps, the end of each word in them, words per row."""
    column = (column.fill_null("") if column.null_count else column).cast(pa.binary())
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.empty(0, np.uint8)
    bounds = bounds - bounds[0]
    inside = NOT_SPACE[data].view(bool)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    starts[inner] |= inside[inner]
    at = np.flatnonzero(starts).astype(np.int32)
    del starts
    ends = np.empty(len(at), np.int32)
    if len(at):
        ends[:-1] = np.cumsum(inside, dtype=np.int32)[at[1:] - 1]
        ends[-1] = np.count_nonzero(inside)
    return data[inside], ends, np.diff(np.searchsorted(at, bounds))


def join_words(packed: np.ndarray, ends: np.ndarray, kept: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """Kept words of each row joined by one space."""
    size = np.diff(ends, prepend=np.int32(0))
    per_row = np.bincount(row[kept], minlength=n)
    stretch = size[kept] + 1
    after = np.cumsum(stretch)
    out = np.full(int(after[-1]) if len(after) else 0, 0x20, np.uint8)
    hole = np.ones(len(out), bool)
    hole[after - 1] = False
    out[hole] = packed[np.repeat(kept, size)]
    # the space after the last word of a row goes
    last = np.cumsum(per_row)[per_row > 0] - 1
    drop = np.zeros(len(out), bool)
    drop[after[last] - 1] = True
    width = np.bincount(row[kept], weights=stretch, minlength=n).astype(np.int64) - (per_row > 0)
    offsets = np.r_[0, np.cumsum(width)].astype(np.int32)
    text = np.ascontiguousarray(out[~drop])
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(text)])


#: Keys share ranges of their upper bits; a range this many times the mean is frequent.
RANGE_BITS, FREQUENT = 16, 8


def range_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - RANGE_BITS)).astype(np.int64)


class RangeCounts:
    """Counts of keys by range, in one task."""

    def __init__(self) -> None:
        self.n = np.zeros(1 << RANGE_BITS, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.n += np.bincount(range_of(keys), minlength=len(self.n))

    def batch(self) -> pa.RecordBatch:
        used = np.flatnonzero(self.n)
        return pa.RecordBatch.from_arrays([pa.array(used), pa.array(self.n[used])], ["range", "n"])


def frequent_ranges(counts: DataFrame) -> np.ndarray:
    """For each range whether it is frequent; from rows (range, n), at most 65 536 after summing."""
    seen = {r["range"]: r["n"] for r in counts.groupBy("range").agg(F.sum("n").alias("n")).collect()}
    most = FREQUENT * max(sum(seen.values()) / (1 << RANGE_BITS), 64)
    table = np.zeros(1 << RANGE_BITS, bool)
    table[[r for r, n in seen.items() if n > most]] = True
    return table
