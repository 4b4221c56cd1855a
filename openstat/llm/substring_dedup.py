"""Substring dedup by relative Lempel-Ziv factors against indexed reference blocks.

The reference is the corpus itself, cut into blocks: a block holds, of all documents, the
segments that share a range of anchors. The anchor of a phrase of `least` words is the
smallest hash of its 6-word runs, a segment is a stretch of neighbouring phrases of one
anchor, and equal phrases have equal anchors; so a document can match only in the blocks of
its own anchors, and is factored against every one of them. In a block, segments are
indexed by their prefixes: names are given to all prefixes of one, two, three ... phrases,
with the first holder of each. The parse of a segment is greedy: at each word the longest
prefix that stands in an earlier document is a factor, with that document (of several the
smallest id) and the place in it; the next factor starts behind the last phrase of the
one before, so that the phrases across the boundary of two factors are looked up too. Factors
have at least `least` words by construction. Factors of neighbouring segments that go
on in the same document at the same distance are joined; the words of all factors are the
duplicate spans.

What moves is small. Most anchors have one holder. So anchors go first, with the
document and the place alone; only segments whose anchor has several holders follow with
8 bytes per phrase, found again in the text. Two phrases are equal if their 64-bit anchor and a
separate 64-bit hash of all their words are; different phrases of one anchor are told
apart by the 64 bits. Frequent anchors, found by counts over 65 536 ranges, are first
dealt out by document too and then met by phrase, so that a passage in a third of all
documents is no task's burden. A long text is hashed in chunks of CHUNK words.

Null text has no words; null ids neither find nor mark anything; an id that repeats
is one holder. Ids are whole numbers, or texts of such. Empty input gives no rows; other
columns of `docs` are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from openstat.llm.common import (
    RangeCounts, Rolling, WordScan, frequent_ranges, join_words, mix, pieces, range_of, split_words,
)
from openstat.session import store

#: Words of a run from which the anchor of a phrase is chosen.
RUN = 6
#: Shares of the documents among which the rows of a frequent anchor are dealt.
SHARES = 64
ROW_SCHEMA = "anchor long, doc_id long, text_id long, start int, phrases binary"
ROWS = pa.schema([
    ("anchor", pa.int64()), ("doc_id", pa.int64()), ("text_id", pa.int64()),
    ("start", pa.int32()), ("phrases", pa.binary()),
])
FACTOR_SCHEMA = "doc_id long, text_id long, start int, stop int, source_id long, source_start int"
FACTORS = pa.schema([
    ("doc_id", pa.int64()), ("text_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()),
    ("source_id", pa.int64()), ("source_start", pa.int32()),
])
PLACE_SCHEMA = "anchor long, doc_id long, start int"
#: Words of a long text that are hashed at a time, and most phrases of a segment; the first is a multiple of the second.
CHUNK, SEGMENT = 1 << 20, 64


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def _stretches(sizes: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int, int]]:
    """First and last row, first and last word, and the word of the row at which each stretch starts.

    Short rows go together; a row above CHUNK words goes alone, in chunks that overlap by a phrase.
    """
    ends = np.cumsum(sizes)
    begins = ends - sizes
    a = 0
    for long in [*np.flatnonzero(sizes > CHUNK + least - 1).tolist(), len(sizes)]:
        if long > a:
            yield a, long, int(begins[a]), int(ends[long - 1]), 0
        if long < len(sizes):
            for at in range(0, int(sizes[long]), CHUNK):
                yield long, long + 1, int(begins[long]) + at, int(min(begins[long] + at + CHUNK + least - 1, ends[long])), at
        a = long + 1


def _anchored(batches: Iterator[pa.RecordBatch], least: int):
    """For each piece of input: ids, text ids, row of each segment, start, anchor, ends, phrase hashes."""
    scan, rolling = WordScan(), Rolling()
    for batch in pieces(batches, "text"):
        ids, text_ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        words, sizes = scan(batch.column(2))
        for first, stop, a, b, skipped in _stretches(sizes, least):
            if b - a < least:
                continue
            part = np.full(1, b - a) if skipped or b - a < sizes[first] else sizes[first:stop]
            ends = np.cumsum(part)
            sums = rolling.sums(words[a:b])
            phrase = rolling.grams(sums, least)
            anchor = sliding_min(rolling.grams(sums, RUN), least - RUN + 1)
            row = np.repeat(np.arange(len(part)), part)[: len(phrase)]
            at = np.arange(len(phrase)) - (ends - part)[row]
            whole = at + least <= part[row]
            phrase, anchor, row, at = phrase[whole], anchor[whole], row[whole] + first, at[whole] + skipped
            if not len(row):
                continue
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (at[1:] % SEGMENT == 0)]
            new = np.flatnonzero(new)
            yield ids, text_ids, row[new], at[new], anchor[new], np.r_[new, len(row)], phrase


def _count_ranges(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = RangeCounts()
        for _, _, _, _, anchor, _, _ in _anchored(batches, least):
            counts.add(anchor)
        yield counts.batch()

    return run


def _places(least: int, frequent: np.ndarray):
    """Anchor, document and place of every segment whose anchor is not frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, row, at, anchor, _, _ in _anchored(batches, least):
            keep = ~frequent[range_of(anchor)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[keep].view(np.int64)), pa.array(ids[row[keep]]), pa.array(at[keep].astype(np.int32))],
                ["anchor", "doc_id", "start"],
            )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor and id: documents and places whose anchor has several holders."""
    last, shared = None, False
    wait_doc, wait_start = np.empty(0, np.int64), np.empty(0, np.int32)
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, doc, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if anchor[0] != last:
            wait_doc, wait_start, shared = wait_doc[:0], wait_start[:0], False
        anchor = np.r_[np.full(len(wait_doc), anchor[0]), anchor]
        doc, start = np.r_[wait_doc, doc], np.r_[wait_start, start]
        firsts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        lasts = np.r_[firsts[1:], len(anchor)] - 1
        several = doc[firsts] != doc[lasts]
        several[0] |= shared
        use = np.repeat(several, lasts - firsts + 1)
        yield pa.RecordBatch.from_arrays([pa.array(doc[use]), pa.array(start[use])], ["doc_id", "start"])
        last, shared = anchor[-1], bool(several[-1])
        wait_doc, wait_start = (x[firsts[-1] :] if not shared else x[:0] for x in (doc, start))


def _rows(ids, text_ids, row, at, anchor, cuts, phrase, keep: np.ndarray) -> pa.RecordBatch:
    packed = pa.BinaryArray.from_buffers(
        pa.binary(), len(row),
        [None, pa.py_buffer((cuts * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(phrase))],
    )
    made = pa.RecordBatch.from_arrays([
        pa.array(anchor.view(np.int64)), pa.array(ids[row]), pa.array(text_ids[row]),
        pa.array(at.astype(np.int32)), packed,
    ], schema=ROWS)
    return made.take(pa.array(np.flatnonzero(keep)))


def _emit_frequent(least: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _anchored(batches, least):
            if (keep := frequent[range_of(found[4])]).any():
                yield _rows(*found, keep)

    return run


def _emit_shared(least: int):
    """Segments at the places named beside each text; segments of a text are the same in every scan of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            batch = batch.filter(pa.compute.is_valid(batch.column(3)))
            if not batch.num_rows:
                continue
            places = batch.column(3)
            counts = np.asarray(pa.compute.list_value_length(places))
            named = np.repeat(np.arange(len(counts)), counts) * (1 << 31) + places.flatten().to_numpy(zero_copy_only=False)
            for found in _anchored(iter([batch.select([0, 1, 2])]), least):
                keep = np.isin(found[2] * (1 << 31) + found[3], named)
                if keep.any():
                    yield _rows(*found, keep)

    return run


def _runs(row: np.ndarray, offset: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last position of each run of chosen neighbours within a row."""
    at = np.flatnonzero(chosen)
    if not len(at):
        return at, at
    new = np.r_[True, (np.diff(at) != 1) | (row[at][1:] != row[at][:-1])]
    first = np.flatnonzero(new)
    return at[first], at[np.r_[first[1:], len(at)] - 1] + 1


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct key, and the first place of each number."""
    order = np.argsort(key, kind="stable")
    change = np.r_[True, key[order[1:]] != key[order[:-1]]][: len(order)]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(change) - 1
    return rank, order[change]


def longest(part: np.ndarray, code: np.ndarray, left: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At each phrase the longest prefix of its segment that an earlier document holds, and its first holder's place.

    Phrases of a segment follow one another, `left` of them from each to the segment's end;
    those of one part are in the order of ids, and parts share nothing.
    """
    order = np.lexsort((code, part))
    change = np.r_[True, (code[order[1:]] != code[order[:-1]]) | (part[order[1:]] != part[order[:-1]])][: len(order)]
    one = np.empty(len(order), np.int64)
    one[order] = np.cumsum(change) - 1
    first = order[change][one]
    length, source = np.zeros(len(code), np.int64), np.full(len(code), -1)
    name, active, size = one.copy(), np.arange(len(code)), 1
    while len(active):
        hit = docs[active] > docs[first]
        length[active[hit]], source[active[hit]] = size, first[hit]
        held = np.zeros(len(code), bool)
        held[first[hit]] = True
        go = (held[first] | hit) & (left[active] > size)
        active, name = active[go], name[go]
        rank, firsts = _ranked(name * (len(code) + 1) + one[active + size]) if len(active) else (name, name)
        first, name = active[firsts[rank]] if len(active) else active, rank
        size += 1
    return length, source


def _factor(least: int, open_too: bool = False):
    """Over rows sorted by anchor and id: the factors of each segment.

    Of an anchor that goes on in the next batch only the segments with a phrase of their own are held.
    With `open_too`, phrases without an earlier holder are given out as rows again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, doc, text_id, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            packed = batch.column(4)
            ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1] // 8
            data = np.frombuffer(packed.buffers()[2], np.uint8)[: int(ends[-1]) * 8].view(np.uint64)
            group = np.cumsum(np.r_[0, anchor[1:] != anchor[:-1]])
            firsts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            lasts = np.r_[firsts[1:], len(group)] - 1
            several = doc[firsts] != doc[lasts]
            several[0] |= anchor[0] == last
            several[-1] = True  # may go on
            rows = np.flatnonzero(several[group] | open_too)
            n = ends[rows + 1] - ends[rows]
            row = np.repeat(rows, n)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            if anchor[0] != last:
                held = tuple(x[:0] for x in held)
            own = len(held[0])
            code = np.r_[held[0], data[ends[row] + offset]]
            docs, place = np.r_[held[1], doc[row]], np.r_[held[2], start[row] + offset]
            left = np.r_[held[3], np.repeat(n, n) - offset]
            part = np.r_[np.zeros(own, np.int64), group[row]]
            length, source = longest(part, code, left, docs)
            hit = length > 0
            # the greedy parse: from each segment's start, the next factor begins behind the last one's phrases
            following = np.where(hit, np.arange(len(hit)), len(hit))
            following = np.r_[np.minimum.accumulate(following[::-1])[::-1], len(hit)]
            at = np.flatnonzero(offset == 0) + own
            stop = at + left[at]
            factors = []
            while len(at):
                at = following[at]
                at, stop = at[at < stop], stop[at < stop]
                factors.append(at)
                at = at + length[at]
            f = np.concatenate(factors) if factors else at
            r = row[f - own]
            columns = [
                doc[r], text_id[r], place[f].astype(np.int32), (place[f] + length[f] - 1 + least).astype(np.int32),
                docs[source[f]], place[source[f]].astype(np.int32),
            ]
            if open_too:
                c, d = _runs(row, offset, ~hit[own:])
                o = row[c]
                none = np.zeros(len(o), np.int64)
                rest = [doc[o], text_id[o], (start[o] + offset[c]).astype(np.int32), none.astype(np.int32), none, none.astype(np.int32)]
                columns = [np.r_[x, y] for x, y in zip(columns, rest)]
                columns += [np.r_[np.zeros(len(r), np.int64), anchor[o]]]
                phrase = code[own:]
                parts = [None] * len(r) + [phrase[x:y].tobytes() for x, y in zip(c, d)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(parts, pa.binary())], OPEN_NAMES)
            elif len(r):
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], schema=FACTORS)
            last = anchor[-1]
            end = part == group[-1]
            segment = np.cumsum(np.r_[True, left[1:] != left[:-1] - 1][: len(left)]) - 1
            new = np.bincount(segment[end], weights=~hit[end], minlength=int(segment.max(initial=0)) + 1) > 0
            keep = np.flatnonzero(end & new[segment]) if len(segment) else segment
            held = (code[keep], docs[keep], place[keep], left[keep])

    return run


OPEN_NAMES = [*FACTORS.names, "anchor", "phrases"]
OPEN_SCHEMA = f"{FACTOR_SCHEMA}, anchor long, phrases binary"


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per phrase, named by anchor and phrase together."""
    for batch in batches:
        anchor, doc, text_id, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        packed = batch.column(4).to_pylist()
        n = np.array([len(p) // 8 for p in packed], np.int64)
        row = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        phrase = np.frombuffer(b"".join(packed), np.uint64)
        ends = np.arange(len(row) + 1, dtype=np.int32) * 8
        name = mix(anchor[row].view(np.uint64)) ^ phrase
        yield pa.RecordBatch.from_arrays([
            pa.array(name.view(np.int64)), pa.array(doc[row]), pa.array(text_id[row]),
            pa.array((start[row] + offset).astype(np.int32)),
            pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(phrase))]),
        ], schema=ROWS)


def factors(texts: DataFrame, least: int = 13) -> DataFrame:
    """doc_id, text_id, start, stop, source_id, source_start: factors that stand in an earlier document.

    `texts` has doc_id, text_id and text. Factors may touch or overlap. Rows of frequent
    anchors are first compared within shares of the documents; what finds no earlier
    holder there, about one row per share and phrase, is compared by phrase.
    """
    usable = texts.filter("doc_id is not null and text is not null")
    frequent = frequent_ranges(usable.mapInArrow(_count_ranges(least), "range long, n long"))
    shared = (
        usable.mapInArrow(_places(least, frequent), PLACE_SCHEMA)
        .repartition("anchor").sortWithinPartitions("anchor", "doc_id").mapInArrow(_shared, "doc_id long, start int")
        .groupBy("doc_id").agg(F.collect_list("start").alias("starts"))
    )
    # a left join of the same columns as the one that cuts the texts, so that Spark deals the texts out once
    found = (
        texts.join(shared, "doc_id", "left").select("doc_id", "text_id", "text", "starts")
        .mapInArrow(_emit_shared(least), ROW_SCHEMA)
        .repartition("anchor").sortWithinPartitions("anchor", "doc_id").mapInArrow(_factor(least), FACTOR_SCHEMA)
    )
    if not frequent.any():
        return found
    shares = store(
        usable.mapInArrow(_emit_frequent(least, frequent), ROW_SCHEMA)
        .repartition("anchor", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)))
        .sortWithinPartitions("anchor", "doc_id").mapInArrow(_factor(least, open_too=True), OPEN_SCHEMA)
    )
    left = (
        shares.filter("phrases is not null").select("anchor", "doc_id", "text_id", "start", "phrases")
        .mapInArrow(_single, ROW_SCHEMA).repartition("anchor").sortWithinPartitions("anchor", "doc_id")
        .mapInArrow(_factor(least), FACTOR_SCHEMA)
    )
    return found.unionByName(shares.filter("phrases is null").select(*FACTORS.names)).unionByName(left)


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order, those that overlap or touch as one."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.r_[True, start[1:] > reach[:-1]][: len(start)]
    first = np.flatnonzero(new)
    return start[first], reach[np.r_[first[1:], len(start)] - 1] if len(first) else first


def joined(doc: np.ndarray, start, stop, source, place) -> list[np.ndarray]:
    """Factors in order; those of one row that go on in the same source at the same distance are one."""
    order = np.lexsort((start, start - place, source, doc))
    doc, start, stop, source, place = (x[order] for x in (doc, start, stop, source, place))
    shift = start - place
    new = np.r_[True, (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | (shift[1:] != shift[:-1]) | (start[1:] > stop[:-1])][: len(doc)]
    first = np.flatnonzero(new)
    ends = np.maximum.reduceat(stop, first) if len(first) else first
    out = [x[first] for x in (doc, start)] + [ends] + [x[first] for x in (source, place)]
    order = np.lexsort((out[1], out[0]))
    return [x[order] for x in out]


SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
FACTOR = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("source_id", pa.int64()), ("source_start", pa.int32())])
RESULT = ["doc_id", "n_words", "n_removed", "spans", "factors", "kept_text", "kept_sha256"]
RESULT_SCHEMA = (
    "doc_id long, n_words long, n_removed long, spans array<struct<start:int,stop:int>>, "
    "factors array<struct<start:int,stop:int,source_id:long,source_start:int>>, kept_text string, kept_sha256 string"
)


def _lists(owner: np.ndarray, n: int, kind: pa.DataType, columns: list[np.ndarray]) -> pa.Array:
    """A list of structs per row, from columns in the order of their rows."""
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind))
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        packed, ends, sizes = split_words(batch.column(2))
        n = len(sizes)
        found = batch.column(3)
        counts = np.asarray(pa.compute.list_value_length(found).fill_null(0))
        flat = found.flatten()
        own = np.repeat(np.arange(n), counts)
        text_id, start, stop, source, place = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
        mine = text_id == batch.column(1).to_numpy(zero_copy_only=False)[own]
        own, start, stop, source, place = joined(own[mine], start[mine], stop[mine], source[mine], place[mine])
        begin = np.cumsum(sizes) - sizes
        # rows one word apart, so that spans of different rows never touch
        a, b = merged(begin[own] + own + start, begin[own] + own + stop)
        row = np.searchsorted(begin + np.arange(n), a, side="right") - 1
        row_of_word = np.repeat(np.arange(n, dtype=np.int32), sizes)
        gone = np.zeros(len(row_of_word) + 1, np.int32)
        gone[a - row] += 1
        gone[b - row] -= 1
        kept = np.cumsum(gone[:-1]) == 0
        text = join_words(packed, ends, kept, row_of_word, n)
        removed = np.bincount(row_of_word[~kept], minlength=n)
        shift = begin[row] + row
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(sizes.astype(np.int64)), pa.array(removed.astype(np.int64)),
            _lists(row, n, SPAN, [a - shift, b - shift]), _lists(own, n, FACTOR, [start, stop, source, place]), text,
            pa.array([hashlib.sha256(t).hexdigest() for t in as_buffers(text)]),
        ], RESULT)


def as_buffers(column: pa.Array) -> Iterator[memoryview]:
    """The bytes of each string, not copied."""
    ends = np.frombuffer(column.buffers()[1], np.int32)
    data = memoryview(column.buffers()[2]) if column.buffers()[2] is not None else memoryview(b"")
    return (data[a:b] for a, b in zip(ends, ends[1 : len(column) + 1]))


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 13
) -> DataFrame:
    """doc_id, n_words, n_removed, spans, factors, kept_text, kept_sha256 of every row.

    `factors` name the earlier document and the word of it at which each starts; `spans`
    are the words that factors cover.
    """
    if least < RUN:
        raise ValueError(f"spans need at least {RUN} words")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.withColumn("text_id", F.xxhash64("text")).select("doc_id", "text_id", "text")
    found = factors(texts, least).groupBy("doc_id").agg(
        F.collect_list(F.struct("text_id", "start", "stop", "source_id", "source_start")).alias("factors")
    )
    return (
        texts.join(found, "doc_id", "left").select("doc_id", "text_id", "text", "factors").mapInArrow(_cut, RESULT_SCHEMA)
    )
