"""Periodic run detection with a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q that no neighbouring
word extends. Level w of the dictionary names every factor of w words (w a power of
two): the name at a word is the pair of the names of the two halves, and only factors
that occur again in the same document are kept. At each level the occurrences of a name
are put in order; a successor q words further on with w/2 < q <= w proposes the period q.
The occurrences of a name that follow at the same distance are an arithmetic progression
of difference q; progressions of neighbouring words are joined, which extends a proposal
to the whole run: within a run of period q <= w the successor of every factor is exactly
q away, at the word before the run and beyond its last whole factor it is not. Each q has
one level, so no run comes twice, and as factors are shorter than 2q, every run of at
least three periods is found.

Words are compared by a dictionary of their bytes, not by hashes. A document is the unit
of work, documents share no state, and nothing is shuffled: texts are scanned whole in
the task that reads them, about a megabyte of them at a time. One text needs memory in
proportion to itself.

Null and blank texts have no words and no runs; rows with a null or repeated id are rows
like others; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from openstat.llm.common import join_words, pieces, split_words

FOUND = "n_words long, runs array<struct<start:long,length:long,period:long>>, n_kept long, collapsed_text string"


def codes_of(packed: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One number for each distinct word."""
    offsets = np.r_[np.int32(0), ends]
    words = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False)


def find_runs(codes: np.ndarray, sizes: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run of at least max(least, times * period) words.

    `codes` holds the words of several documents one after another, `sizes` of each.
    """
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    stop = np.cumsum(sizes)
    at = np.arange(len(codes), dtype=np.int32)
    key = row.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes if len(sizes) > 1 else codes
    name = np.empty(len(codes), np.int32)
    found: list[tuple[np.ndarray, ...]] = []
    w = 1
    while len(at) > 1:
        order = np.argsort(key, kind="stable")
        place, key = at[order], key[order]
        del order
        same = key[1:] == key[:-1]
        del key
        gap = place[1:] - place[:-1]
        near = np.flatnonzero(same & (gap <= w) & (2 * gap > w))
        if len(near):
            near = near[np.argsort(place[near])]
            first, q = place[near], gap[near]
            new = np.flatnonzero(np.r_[True, (np.diff(first) != 1) | (q[1:] != q[:-1])])
            last = first[np.r_[new[1:], len(first)] - 1]
            found.append(tuple(x.astype(np.int64) for x in (first[new], last - first[new] + w + q[new], q[new])))
        if times * (w + 1) > sizes.max():
            break
        again = np.r_[False, same] | np.r_[same, False]
        name.fill(-1)
        name[place[1:]] = np.cumsum(~same, dtype=np.int32)
        name[place[0]] = 0
        name[place[~again]] = -1
        at = np.sort(place[again])
        del place, gap, same, again
        at = at[at + 2 * w <= stop[row[at]]]
        after = name[at + w]
        at, after = at[after >= 0], after[after >= 0]
        key = name[at].astype(np.int64) * len(codes) + after
        w *= 2
    if not found:
        return (np.empty(0, np.int64),) * 3
    start, length, period = map(np.concatenate, zip(*found))
    order = np.lexsort((period, start))
    order = order[(length >= np.maximum(least, times * period))[order]]
    return start[order], length[order], period[order]


def _search(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            packed, ends, sizes = split_words(batch.column(1))
            n = len(sizes)
            row = np.repeat(np.arange(n, dtype=np.int32), sizes)
            start, length, period = find_runs(codes_of(packed, ends), sizes, least, times)
            cover = np.zeros(len(row) + 1, np.int32)
            np.add.at(cover, start + period, 1)
            np.add.at(cover, start + length, -1)
            kept = np.cumsum(cover[:-1]) == 0
            own = row[start] if len(start) else start
            begins = np.cumsum(sizes) - sizes
            runs = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(own, np.arange(n + 1)).astype(np.int32)),
                pa.StructArray.from_arrays(
                    [pa.array(start - begins[own]), pa.array(length), pa.array(period)], ["start", "length", "period"]
                ),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes.astype(np.int64)), runs,
                    pa.array(np.bincount(row[kept], minlength=n).astype(np.int64)), join_words(packed, ends, kept, row, n),
                ],
                [batch.schema.names[0], "n_words", "runs", "n_kept", "collapsed_text"],
            )

    return run


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4
) -> DataFrame:
    """The id, n_words, runs (start, length, period; by start, then period), n_kept and collapsed_text of every row.

    Runs have at least max(least, times * period) words. The collapsed text has the words
    that lie in no run after its first period, joined by one space.
    """
    if times < 3 or least < 1:
        raise ValueError("runs need at least three periods")
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), *_parse_datatype_string(FOUND).fields])
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(_search(least, times), schema)
