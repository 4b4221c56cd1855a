"""Exact Jaccard join on word shingles by partitioning the universe of shingles.

Two sets of sizes a and b with similarity at least t differ in at most
H = a + b - 2 ceil(t (a + b) / (1 + t)) shingles. A hash deals all shingles to H + 1
segments, so two such sets agree on a whole segment. Sizes fall into bands in which
only neighbours can be similar; each pair of neighbouring bands has its own H, and
a set enters the index of both pairs that its band belongs to.

Which segments are indexed, and how, goes by cost. An empty segment would match
everything and is skipped; by the pigeonhole principle a skipped segment is made up
for by one that also admits a difference of one. So the first few segments, as many
as are expected empty and some more, are indexed with their one-deletion
neighbourhoods; a set with more empty ones indexes the neighbourhoods of all.
Segments that turn out too costly (many sets that do not link share them) are
skipped and made up for in the same way; where a set has too few other segments, its
costly ones stay, and all other holders of these meet it there. A neighbourhood meets
whole segments only, never another one.

Equal sets are one node. In each index entry all nodes are first compared with one;
beyond that only nodes of different components count, so a thousand near copies cost
a few thousand comparisons: those outside an entry's largest component meet single
nodes inside it, and what remains meets in blocks of bounded size, by parity sketches
first. A shingle in one of two sets flips one bit, so more differing bits than H
prove the sets unlike. What the sketches leave is verified on the texts, the
likeliest first, until no pair between two components is open.

Words are runs without ASCII whitespace, A-Z lower-cased. Fewer words than a
shingle make one shingle; a text without words (or null) has no shingle and no
link. Rows with a null id link with nothing and have a null component. Rows that
share an id count as one document for components. Empty input gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from openstat.llm.common import (
    LOWER_BYTES, NOT_SPACE, RangeCounts, WordScan, frequent_ranges, mix, pieces, range_of,
)
from openstat.llm.components import components
from openstat.session import shared_dir, store

#: Nodes on either side of a block of comparisons.
BLOCK = 2048
#: Comparisons of sketches that an index entry may cost before its segments are allocated anew: a block.
ENTRY_COST = BLOCK * BLOCK
#: Spark's own limit of the buckets of a table.
MOST_BUCKETS = 100_000
#: Bits of a sketch for each shingle in which similar sets may differ.
SKETCH_BITS = 16
#: Times that the nodes outside an entry's largest component meet one node inside it, another each time.
STARS = 2
#: Likeliest partners of a node that are verified in each round; the last takes all.
ROUNDS = (8, None)
#: Bits of the filter of text ids, as words of 64 bits; it is broadcast and never larger.
FILTER_WORDS = 1 << 18


class Threshold:
    """Similarity of at least `top` / `bottom`, in whole numbers."""

    def __init__(self, top: int, bottom: int) -> None:
        self.top, self.bottom = top, bottom
        self.starts = [1, 2]

    def differ(self, total):
        """Most shingles in which two similar sets of `total` shingles together differ."""
        return total - 2 * -(-self.top * total // (self.top + self.bottom))

    def band(self, size: int) -> int:
        while self.starts[-1] <= size:
            last = self.starts[-1]
            self.starts.append(max(last + 1, (last - 1) * self.bottom // self.top + 1))
        return int(np.searchsorted(self.starts, size, "right")) - 1

    @lru_cache(None)  # noqa: B019
    def segments(self, scheme: int) -> tuple[int, int]:
        """Segments for the pair of bands scheme and scheme + 1, and how many of them have
        neighbourhoods; one segment if only equal sets are similar."""
        if scheme < 0:
            return 1, 0
        while len(self.starts) < scheme + 3:
            self.band(self.starts[-1])
        high = 2 * (self.starts[scheme + 2] - 1)
        least = self.starts[scheme]
        m = 1 + max(self.differ(s) for s in range(max(2 * least, high - 2 * (self.top + self.bottom)), high + 1))
        empty = m * exp(-least / m)
        return m, min(m, ceil(empty + 3 * sqrt(empty)) + 1)

    @lru_cache(None)  # noqa: B019
    def sketch_bytes(self, size: int) -> int:
        n = 8
        while 8 * n < SKETCH_BITS * self.differ(2 * size):
            n *= 2
        return n

    def __reduce__(self):
        return Threshold, (self.top, self.bottom)


@dataclass
class Sets:
    """Distinct shingles of the non-empty sets of a batch, one set after the other."""

    rows: np.ndarray
    sizes: np.ndarray
    shingles: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def sums(self, seed: int) -> np.ndarray:
        parts = np.add.reduceat(mix(self.shingles + np.uint64(seed)), self.starts)
        return mix(parts + self.sizes.astype(np.uint64)).view(np.int64)

    def sketches(self, limit: Threshold) -> list[bytes]:
        """Parities of how many shingles fall on each of a power of two of bits."""
        n = np.array([limit.sketch_bytes(int(s)) for s in self.sizes], np.int64)
        first = np.cumsum(n) - n
        at = (mix(self.shingles + np.uint64(77)) & np.repeat(8 * n - 1, self.sizes).astype(np.uint64)).astype(np.int64)
        odd = np.bincount(at + np.repeat(8 * first, self.sizes), minlength=8 * n.sum()) % 2 == 1
        raw = np.packbits(odd, bitorder="little").tobytes()
        return [raw[a : a + b] for a, b in zip(first.tolist(), n.tolist())]


class Shingles:
    """Shingle sets of a text column."""

    def __init__(self, k: int) -> None:
        self.k, self.scan = k, WordScan(NOT_SPACE, LOWER_BYTES)

    def __call__(self, column: pa.Array) -> Sets:
        words, counts = self.scan(column)
        padded = np.r_[words, np.zeros(self.k, np.uint64)]
        left = np.repeat(np.cumsum(counts), counts) - np.arange(len(words))
        out = np.zeros(len(words), np.uint64)
        for i in range(self.k):
            out = mix(out + np.where(left > i, padded[i : i + len(words)], np.uint64(0)) + np.uint64(i + 1))
        rows, found = np.flatnonzero(counts), []
        ends = np.cumsum(counts)
        for row in rows:
            a, b = ends[row] - counts[row], ends[row]
            one = np.sort(out[a : max(a + 1, b - self.k + 1)])
            found.append(one[np.r_[True, one[1:] != one[:-1]]])
        return Sets(rows, np.array([len(f) for f in found], np.int64), np.concatenate([np.empty(0, np.uint64), *found]))


class Index:
    """Index keys of all sets of a batch, under the lower or the upper of their two schemes.

    Only segments that hold something have an entry here; `sets` says whose it is.
    """

    def __init__(self, data: Sets, limit: Threshold, upper: bool) -> None:
        scheme = np.array([limit.band(int(s)) for s in data.sizes], np.int64) - (not upper)
        m, near = np.array([limit.segments(int(s)) for s in scheme], np.int64).reshape(-1, 2).T
        self.m = np.where(m > 1, m, 0)
        first = np.cumsum(self.m) - self.m
        salt = mix(scheme.astype(np.uint64))
        owner = np.repeat(np.arange(len(m)), data.sizes)
        used = self.m[owner] > 0
        owner = owner[used]
        value = mix(data.shingles[used] ^ salt[owner])
        at = first[owner] + ((value >> np.uint64(32)) * self.m[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        total = int(self.m.sum())
        value = mix(value)
        low = np.bincount(at, (value & np.uint64(0xFFFFFFFF)).astype(float), total).astype(np.uint64)
        high = np.bincount(at, (value >> np.uint64(32)).astype(float), total).astype(np.uint64)
        self.value, self.at, self.sum = value, at, (high << np.uint64(32)) + low
        self.sizes = np.bincount(at, minlength=total)
        self.sets = np.repeat(np.arange(len(m)), self.m)
        segment = np.arange(total) - first[self.sets]
        self.name = mix(salt[self.sets] + segment.astype(np.uint64) + np.uint64(1))
        self.exact = mix(self.sum ^ self.name)
        self.near = segment < near[self.sets]
        self.filled = self.sizes > 0

    def held(self, chosen: np.ndarray) -> np.ndarray:
        """How many of the chosen segments each set has."""
        return np.bincount(self.sets[chosen], minlength=len(self.m))

    def deletions(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets and keys of the chosen segments without one of their shingles."""
        take = (chosen & (self.sizes > 1))[self.at]
        at = self.at[take]
        return self.sets[at], mix((self.sum[at] - self.value[take]) ^ self.name[at])


SETS = pa.schema([
    ("doc_id", pa.int64()), ("text_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()),
    ("check", pa.int64()), ("sketch", pa.binary()), ("range", pa.int64()), ("n", pa.int64()),
])
SETS_SQL = "doc_id long, text_id long, n_shingles long, node long, check long, sketch binary, range long, n long"
KEYS = pa.schema([("key", pa.int64()), ("kind", pa.int8()), ("node", pa.int64())])
KEYS_SQL = "key long, kind byte, node long"
#: Kinds of key: a whole segment, or one without one of its shingles.
WHOLE, LESS = 0, 1


def index_keys(data: Sets, limit: Threshold) -> list[tuple[np.ndarray, int, np.ndarray]]:
    """Sets, kind and keys that a batch of sets enters into the index."""
    out = []
    for upper in (False, True):
        index = Index(data, limit, upper)
        out.append((index.sets[index.filled], WHOLE, index.exact[index.filled]))
        empty = index.held(~index.filled)
        more = empty > index.held(index.filled & index.near)
        out.append((*(x := index.deletions(index.near | more[index.sets]))[:1], LESS, x[1]))
        nothing = ~index.filled & (2 * empty > index.m)[index.sets]  # too few left to make up for the empty ones
        out.append((index.sets[nothing], WHOLE, mix(index.exact[nothing])))
    return out


def _sets(k: int, limit: Threshold, seed: int):
    """A row per document, and at the end the counts of index keys by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = Shingles(k), RangeCounts()
        for batch in pieces(batches, "text"):
            data = shingles(batch.column(1))
            n = batch.num_rows
            sizes, node, check = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            sketches: list[bytes | None] = [None] * n
            if len(data.rows):
                sizes[data.rows] = data.sizes
                node[data.rows], check[data.rows] = data.sums(2 * seed + 1), data.sums(2 * seed + 2)
                for row, raw in zip(data.rows.tolist(), data.sketches(limit)):
                    sketches[row] = raw
                for _, _, keys in index_keys(data, limit):
                    counts.add(keys)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(sizes), pa.array(node, mask=sizes == 0),
                pa.array(check, mask=sizes == 0), pa.array(sketches, pa.binary()), none, none,
            ], schema=SETS)
        told = counts.batch()
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(told.num_rows, f.type) for f in list(SETS)[:6]] + told.columns, schema=SETS
        )

    return run


def _batch(parts: list[tuple[np.ndarray, int, np.ndarray]], node: np.ndarray, keep=None) -> pa.RecordBatch:
    keys = np.concatenate([p[2] for p in parts])
    kinds = np.repeat(np.array([p[1] for p in parts], np.int8), [len(p[2]) for p in parts])
    nodes = node[np.concatenate([p[0] for p in parts])]
    if keep is not None:
        chosen = keep(keys)
        keys, kinds, nodes = keys[chosen], kinds[chosen], nodes[chosen]
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(kinds), pa.array(nodes)], schema=KEYS)


def _keys(k: int, limit: Threshold, seed: int, frequent: np.ndarray, take: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)
        for batch in pieces(batches, "text"):
            data = shingles(batch.column(1))
            if len(data.rows):
                yield _batch(index_keys(data, limit), data.sums(2 * seed + 1), lambda x: frequent[range_of(x)] == take)

    return run


def _reallocated(k: int, limit: Threshold):
    """For nodes with costly keys: their other segments and all neighbourhoods of these.

    Two nodes with costly segments that leave each at least half of its segments meet
    in these. A node with fewer meets in its costly entries whatever is in them: there
    it counts as whole, and the nodes that have enough as neighbourhoods.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)
        for batch in pieces(batches, "text"):
            node = batch.column(0).to_numpy()
            data = shingles(batch.column(1))
            costly = [np.array(c, np.int64).view(np.uint64) for c in batch.column(2).to_pylist()]
            whole: list[list[np.ndarray]] = [[] for _ in costly]
            lacking = np.zeros(len(costly), bool)
            parts = []
            for upper in (False, True):
                index = Index(data, limit, upper)
                hot = np.zeros(len(index.exact), bool)
                bounds = np.r_[0, np.cumsum(index.m)]
                for i, c in enumerate(costly):
                    own = index.exact[bounds[i] : bounds[i + 1]]
                    hot[bounds[i] : bounds[i + 1]] = np.isin(own, c)
                    whole[i].append(own)
                cold = index.filled & ~hot
                parts.append((index.sets[cold], WHOLE, index.exact[cold]))
                parts.append((*(x := index.deletions(cold))[:1], LESS, x[1]))
                few = 2 * index.held(cold) < index.m
                lacking |= few
                for kind, chosen in ((WHOLE, hot & few[index.sets]), (LESS, hot & ~few[index.sets])):
                    parts.append((index.sets[chosen], kind, mix(index.exact[chosen])))
            for i, c in enumerate(costly):  # met in a neighbourhood, or by what stands for empty segments
                other = np.setdiff1d(c, np.concatenate(whole[i]))
                parts.append((np.full(len(other), i), WHOLE if lacking[i] else LESS, mix(other)))
            yield _batch(parts, node)

    return run


MEMBERS = pa.schema([("key", pa.int64()), ("kind", pa.int8()), ("node", pa.int64()), ("first", pa.int64())])
MEMBERS_SQL = "key long, kind byte, node long, first long"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key, kind and node: entries of several nodes with a whole segment.

    The first node of an entry is written when a second one comes; nothing else of an
    entry is held.
    """
    row, first, written = (None, None, None), None, False
    for batch in batches:
        key, kind, node = (batch.column(i).to_numpy() for i in range(3))
        if not len(key):
            continue
        new = np.r_[
            (key[0], kind[0], node[0]) != row,
            (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]) | (node[1:] != node[:-1]),
        ]
        key, kind, node = key[new], kind[new], node[new]
        if not len(key):
            continue
        starts = np.r_[key[0] != row[0], key[1:] != key[:-1]]
        group = np.cumsum(starts)  # 0 is the entry that goes on from the last batch
        at = np.flatnonzero(starts)
        leader = np.r_[np.int64(0 if first is None else first), node[at]]
        valid = np.r_[first is not None, kind[at] == WHOLE]
        sizes = np.bincount(group, minlength=len(at) + 1)
        rest = ~starts & valid[group]
        led = at[valid[1:] & (sizes[1:] > 1)]
        out = [
            np.r_[key[rest], key[led]], np.r_[kind[rest], kind[led]], np.r_[node[rest], node[led]],
            np.r_[leader[group[rest]], node[led]],
        ]
        if not starts[0] and first is not None and not written:
            out = [np.r_[x, np.array([y], x.dtype)] for x, y in zip(out, (row[0], WHOLE, first, first))]
            written = True
        if len(at):
            first, written = (node[at[-1]], sizes[-1] > 1) if valid[-1] else (None, False)
        row = (key[-1], kind[-1], node[-1])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], schema=MEMBERS)


def folded(sketch: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) with fewer bits."""
    while sketch.shape[1] > width:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def _possible(limit: Threshold):
    """Pairs that sizes and sketches allow, over (a, b, n_a, sketch_a, n_b, sketch_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(i).to_numpy() for i in (2, 4))
            near = np.minimum(n_a, n_b) * limit.bottom >= np.maximum(n_a, n_b) * limit.top
            most, keep = limit.differ(n_a + n_b), []
            for i in np.flatnonzero(near).tolist():
                a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64)[None] for c in (3, 5))
                width = min(a.shape[1], b.shape[1])
                if np.bitwise_count(folded(a, width) ^ folded(b, width)).sum() <= most[i]:
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


@dataclass
class Side:
    """Nodes on one side of a block."""

    node: np.ndarray
    component: np.ndarray
    kind: np.ndarray
    n: np.ndarray
    sketch: list[bytes]

    def take(self, at: np.ndarray) -> Side:
        return Side(self.node[at], self.component[at], self.kind[at], self.n[at], [self.sketch[i] for i in at])


def compare(u: Side, v: Side, limit: Threshold, most: int | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Possible pairs between components of a block, for each u the `most` with the fewest
    differing bits; and whether some u had more."""
    widths = np.array([len(s) for s in v.sketch])
    pairs, more = [], False
    for i in range(len(u.node)):
        fits = (
            (u.component[i] != v.component) & (u.kind[i] + v.kind < 2 * LESS)
            & (np.minimum(u.n[i], v.n) * limit.bottom >= np.maximum(u.n[i], v.n) * limit.top)
        )
        at = np.flatnonzero(fits)
        if not len(at):
            continue
        bits = np.zeros(len(at), np.int64)
        own = np.frombuffer(u.sketch[i], np.uint64)[None]
        for width in np.unique(widths[at]):
            same = np.flatnonzero(widths[at] == width)
            other = np.frombuffer(b"".join(v.sketch[j] for j in at[same]), np.uint64).reshape(len(same), -1)
            w = min(other.shape[1], own.shape[1])
            bits[same] = np.bitwise_count(folded(other, w) ^ folded(own, w)).sum(1)
        ok = np.flatnonzero(bits <= limit.differ(u.n[i] + v.n[at]))
        if most is not None and len(ok) > most:
            more = True
            ok = ok[np.lexsort((v.node[at[ok]], bits[ok]))[:most]]
        pairs += [(u.node[i], x) for x in v.node[at[ok]]]
    a = np.array(pairs, np.int64).reshape(-1, 2)
    return a.min(1) if len(a) else a[:, 0], a.max(1) if len(a) else a[:, 0], more


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("open", pa.int64())])


def _blocks(limit: Threshold, most: int | None):
    """Over rows sorted by key, block, side: possible pairs, and the keys that have more."""

    def pairs(key: int, rows: pa.Table) -> pa.RecordBatch | None:
        columns = [rows.column(c).to_numpy() for c in ("node", "component", "kind", "n_shingles", "side")]
        sketch = rows.column("sketch").to_pylist()
        both = Side(*columns[:4], sketch)
        a, b, more = compare(both.take(np.flatnonzero(columns[4] == 0)), both.take(np.flatnonzero(columns[4] == 1)), limit, most)
        if not len(a) and not more:
            return None
        last = np.array([key] if more else [], np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(np.r_[a, last * 0], mask=np.r_[a < a, last == last]), pa.array(np.r_[b, last * 0], mask=np.r_[a < a, last == last]),
            pa.array(np.r_[a * 0, last], mask=np.r_[a == a, last != last]),
        ], schema=PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        unit = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                now = tuple(names[:, x].tolist())
                if now != unit and held:
                    if (out := pairs(unit[0], pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                unit = now
                held.append(batch.slice(x, y - x))
        if held and (out := pairs(unit[0], pa.Table.from_batches(held))) is not None:
            yield out

    return run


def _similar(k: int, limit: Threshold):
    def shingles(text: bytes) -> set:
        words = text.lower().split()
        return set(zip(*(words[i:] for i in range(k)))) if len(words) >= k else {tuple(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, set] = (None, set())
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                a = batch.column(0)[i].as_py()
                if a != last[0]:
                    last = (a, shingles(batch.column(2)[i].as_py().encode()))
                other = shingles(batch.column(3)[i].as_py().encode())
                both = len(last[1] & other)
                if limit.bottom * both >= limit.top * (len(last[1]) + len(other) - both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Write a table once in buckets of a key, so that joins on the key need not move it.

    The files are in the shared folder and stay there; the name that Spark needs for
    buckets leaves the catalog at once.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
    df.repartition(n, key).write.bucketBy(n, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(
        name, format="parquet"
    )
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


class Join:
    """The steps over one table (doc_id, text, text_id)."""

    def __init__(self, docs: DataFrame, k: int, limit: Threshold) -> None:
        self.k, self.limit = k, limit
        seed = 0
        while True:
            told = store(docs.mapInArrow(_sets(k, limit, seed), SETS_SQL))
            self.sets = told.filter("range is null").drop("range", "n")
            clash = self.sets.filter("node is not null").groupBy("node").agg(
                F.min("check").alias("low"), F.max("check").alias("high"),
                F.min("n_shingles").alias("few"), F.max("n_shingles").alias("many"),
            ).filter("low <> high or few <> many")
            if clash.isEmpty():
                break
            seed += 1
        named = docs.filter("doc_id is not null and text is not null")
        frequent = frequent_ranges(told.filter("range is not null").select("range", "n"))
        members = (
            named.mapInArrow(_keys(k, limit, seed, frequent, False), KEYS_SQL)
            .repartition("key").sortWithinPartitions("key", "kind", "node").mapInArrow(_entries, MEMBERS_SQL)
        )
        if frequent.any():
            members = members.unionByName(
                self.entries(named.mapInArrow(_keys(k, limit, seed, frequent, True), KEYS_SQL))
            )
        self.members = store(members)
        nodes = self.sets.filter("doc_id is not null and node is not null").groupBy("node").agg(
            F.min(F.struct("doc_id", "text_id")).alias("row"), F.max("n_shingles").alias("n_shingles"),
            F.max("sketch").alias("sketch"),
        ).select("node", "row.*", "n_shingles", "sketch")
        self.nodes = store(nodes.join(self.members.select("node").distinct(), "node", "left_semi"))
        texts = self.drawn(docs).join(
            self.nodes.select("doc_id", "text_id", "node"), ["doc_id", "text_id"]
        ).select("node", "text")
        self.texts = bucketed(texts, "node")
        if self.texts.count() > self.nodes.count():  # rows that repeat both id and text
            self.texts = bucketed(self.texts.groupBy("node").agg(F.min("text").alias("text")), "node")

    def drawn(self, docs: DataFrame) -> DataFrame:
        """The rows whose text may be a node's: all that are, and few others.

        Each text id of a node sets a bit of a table of fixed size. Rows that meet no bit go
        where they are read, so the join with the nodes moves no text that no entry holds.
        """
        word, bit = F.pmod(F.shiftright("text_id", 6), F.lit(FILTER_WORDS)), F.pmod("text_id", F.lit(64)).cast("int")
        bits = self.nodes.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
        rows = docs.withColumn("word", word).join(F.broadcast(bits), "word")
        return rows.filter(F.getbit("bits", bit) == 1).select(docs.columns)

    @staticmethod
    def entries(keys: DataFrame) -> DataFrame:
        """The same as _entries, from sums per key: no entry is brought together."""
        several = keys.groupBy("key").agg(
            F.min(F.when(F.col("kind") == WHOLE, F.col("node"))).alias("first"),
            F.min("node").alias("low"), F.max("node").alias("high"),
        ).filter("first is not null and low < high")
        return keys.join(several.select("key", "first"), "key").select("key", "kind", "node", "first").distinct()

    def sized(self, pairs: DataFrame) -> DataFrame:
        """The pairs that sizes and sketches allow."""
        size = self.nodes.select("node", "n_shingles", "sketch")
        a, b = size.toDF("a", "n_a", "sketch_a"), size.toDF("b", "n_b", "sketch_b")
        return (
            pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b")
            .mapInArrow(_possible(self.limit), "a long, b long")
        )

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are similar, by their texts.

        The texts stay in their buckets; those that the pairs name are written out, so only
        these move, and Spark can split the rows of a node that many pairs name.
        """
        named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = store(self.texts.join(named, "node", "left_semi"))
        both = (
            pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
            .select("a", "b", "text_a", "text_b")
        )
        return store(both.mapInArrow(_similar(self.k, self.limit), "a long, b long"))

    @staticmethod
    def placed(members: DataFrame, labels: DataFrame) -> DataFrame:
        """Members of entries with several components, with the size and cost of the entry."""
        rows = members.select("key", "kind", "node").join(labels, "node", "left").select(
            "key", "kind", "node", F.coalesce("component", "node").alias("component")
        )
        entries = rows.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(
            F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("parts")
        ).filter("parts > 1").select(
            "key", "all", F.col("most.component").alias("main"),
            (F.col("all") * (F.col("all") - F.col("most.n"))).alias("cost"),
        )
        return store(rows.join(entries, "key"), members.count())

    @staticmethod
    def star(placed: DataFrame, turn: int) -> DataFrame:
        """Nodes outside an entry's largest component, each with one node inside it.

        The order of the nodes is the same for all entries, so few nodes are chosen.
        """
        order = F.xxhash64(F.lit(turn), F.col("node"))
        inside = placed.filter("component = main").filter(F.col("kind") == WHOLE).groupBy("key").agg(
            F.min(F.struct(order.alias("order"), "node")).getField("node").alias("centre")
        )
        return placed.filter("component <> main").join(inside, "key").select(
            F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")
        ).distinct()

    def across(self, placed: DataFrame, most: int | None) -> DataFrame:
        """a, b: possible pairs between components of an entry; open: entries that have more.

        Nodes outside an entry's largest component meet all of it, in blocks: each side is
        dealt into blocks of about 2 048 nodes, and every two blocks are one unit.
        """
        blocks = F.ceil(F.col("all") / BLOCK)
        every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        own = F.col("own")
        as_u = F.transform(every, lambda v: F.struct(own.alias("u"), v.alias("v"), F.lit(0).alias("side")))
        as_v = F.transform(every, lambda u: F.struct(u.alias("u"), own.alias("v"), F.lit(1).alias("side")))
        units = F.explode(F.when(F.col("component") == F.col("main"), as_v).otherwise(F.concat(as_u, as_v)))
        return store(
            placed.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
            .withColumn("unit", units)
            .join(self.nodes.select("node", "n_shingles", "sketch"), "node")
            .select("key", "unit.u", "unit.v", "unit.side", "node", "component", "kind", "n_shingles", "sketch")
            .repartition("key", "u", "v").sortWithinPartitions("key", "u", "v")
            .mapInArrow(_blocks(self.limit, most), "a long, b long, open long")
        )

    def components(self, cost: int) -> DataFrame:
        first = self.members.filter("node <> first").select(
            F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b")
        ).distinct()
        tried = store(self.sized(first))
        labels, members = components(self.linked(tried)), self.members
        for turn in range(STARS):
            placed = self.placed(members, labels)
            members = placed.select("key", "kind", "node")
            fresh = store(self.star(placed, turn).join(tried, ["a", "b"], "left_anti"), placed.count())
            pairs = store(self.sized(fresh))
            if pairs.isEmpty():
                break
            tried = tried.unionByName(pairs)
            labels = components(self.linked(pairs), labels)
        placed = self.placed(members, labels)
        costly = placed.filter(F.col("cost") > cost).select("key", "node")
        if not costly.isEmpty():
            skip = costly.groupBy("node").agg(F.collect_set("key").alias("costly"))
            keys = self.texts.join(skip, "node").select("node", "text", "costly").mapInArrow(
                _reallocated(self.k, self.limit), KEYS_SQL
            )
            members = placed.filter(F.col("cost") <= cost).select("key", "kind", "node")
            members = store(members.unionByName(self.entries(keys).select("key", "kind", "node")))
            placed = self.placed(members, labels)
        for most in ROUNDS:
            found = self.across(placed, most)
            pairs = store(
                found.filter("a is not null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"),
                found.count(),
            )
            tried = tried.unionByName(pairs)
            labels = components(self.linked(pairs), labels)
            more = found.filter("open is not null").select(F.col("open").alias("key")).distinct()
            if more.isEmpty():
                break
            placed = self.placed(store(placed.join(more, "key", "left_semi"), placed.count()), labels)
        return labels


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3,
    top: int = 90, bottom: int = 100, cost: int = ENTRY_COST,
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row (similarity >= top / bottom)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    join = Join(texts.withColumn("text_id", F.xxhash64("text")), k, Threshold(top, bottom))
    labels = join.components(cost)
    rows = join.sets.select("doc_id", "n_shingles", "node").join(
        labels.withColumnRenamed("component", "label"), "node", "left"
    ).withColumn("label", F.coalesce("label", "node"))
    least = rows.filter("label is not null and doc_id is not null").groupBy("label").agg(
        F.min("doc_id").alias("component_id")
    )
    return rows.join(least, "label", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
