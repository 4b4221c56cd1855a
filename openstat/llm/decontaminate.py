"""Benchmark decontamination with suffix arrays over shards of training text.

Each shard of training text (a few MB of words) gets a suffix array. Every suffix
of every benchmark item is found in it by binary search, for all suffixes at once;
its range of equal beginnings holds all places where the window of `n` words
stands, and the neighbours in the array give the longest verbatim match. Words that
no item has cannot be part of a match, so a shard keeps only its stretches of item
words that are long enough for a window.

Items travel in blocks of at most `block_bytes` of text, each sent to every shard;
one block is the usual case, and the results of several are put together per
document. An item of fewer than `n` words is one window; an item without words or
text has none and is never found. Null text has no words. A null id is kept as it
is; rows that repeat an id are each judged by their own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from openstat.llm.common import as_bytes, pieces

#: Lower-cases A-Z and turns every byte that is no word character into a space.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A
    else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80
    else 0x20
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` words (at least), by prefix doubling."""
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    order, have = np.argsort(rank, kind="stable"), 1
    while have < depth and len(words):
        after = np.zeros(len(rank), np.int64)
        after[:-have] = rank[have:] + 1 if have < len(rank) else 0
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(len(rank), np.int64)
        rank[order] = np.cumsum(np.r_[0, sorted_key[1:] != sorted_key[:-1]])
        have *= 2
        if rank.max() == len(rank) - 1:
            break
    return order


class Items:
    """Item words as numbers, and their suffixes."""

    def __init__(self, rows: list[tuple[str, bytes]], n: int) -> None:
        self.names = [name for name, _ in rows]
        split = [words_of(text) for _, text in rows]
        self.number = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for ws in split for w in ws))}
        self.words = np.array([self.number[w] for ws in split for w in [*ws]], np.int64)
        sizes = np.array([len(ws) for ws in split], np.int64)
        self.item = np.repeat(np.arange(len(split)), sizes)
        stops = np.repeat(np.cumsum(sizes), sizes)
        self.left = stops - np.arange(len(self.words))
        window = np.repeat(np.minimum(sizes, n), sizes)
        self.window = np.where(self.left >= window, window, 0)  # 0: too near the item's end
        self.start = np.arange(len(self.words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.least = int(min(sizes[sizes > 0].min(initial=n), n))
        self.most = int(self.window.max(initial=0))


def _before(words, order, items, places, width, or_equal) -> np.ndarray:
    """How many suffixes of the shard come before each item suffix of `width` words."""
    low, high = np.zeros(len(places), np.int64), np.full(len(places), len(order))
    reach = np.arange(width)
    pattern = items.words[places[:, None] + reach]
    padded = np.r_[words, np.full(width, -1)]
    while (open_ := low < high).any():
        mid = (low + high) // 2
        text = padded[order[np.minimum(mid, len(order) - 1)][:, None] + reach]
        differ = text != pattern
        at = differ.argmax(1)
        rows = np.arange(len(places))
        sign = np.where(differ.any(1), np.sign(text[rows, at] - pattern[rows, at]), 0)
        less = (sign < 0) | (or_equal & (sign == 0))
        low = np.where(open_ & less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)
    return low


def occurrences(words: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item suffix, place in the shard, and longest match, wherever a window occurs."""
    order = suffix_array(words, items.most)
    found, place = [], []
    for width in np.unique(items.window[items.window > 0]):
        tests = np.flatnonzero(items.window == width)
        low = _before(words, order, items, tests, int(width), False)
        high = _before(words, order, items, tests, int(width), True)
        n = high - low
        found.append(np.repeat(tests, n))
        place.append(order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0, int)
    suffix, at = np.concatenate(found), np.concatenate(place)
    length = items.window[suffix].copy()
    grow = np.arange(len(suffix))
    while len(grow):
        s, p = suffix[grow] + length[grow], at[grow] + length[grow]
        fits = (length[grow] < items.left[suffix[grow]]) & (p < len(words))
        fits[fits] = items.words[s[fits]] == words[p[fits]]
        grow = grow[fits]
        length[grow] += 1
    return suffix, at, length


MATCH = pa.struct([
    ("item_id", pa.string()), ("item_start", pa.int32()), ("start", pa.int32()), ("words", pa.int32())
])
FOUND = pa.schema([("n_words", pa.int64()), ("matches", pa.list_(MATCH)), ("hits", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])
FOUND_SQL = (
    "n_words long, matches array<struct<item_id:string,item_start:int,start:int,words:int>>, "
    "hits array<struct<start:int,stop:int>>"
)


def _shard(texts: list[bytes | None], items: Items) -> list[dict]:
    numbers, starts, owner, at, out = [], [], [], 0, []
    for i, text in enumerate(texts):
        words = words_of(text or b"")
        out.append({"n_words": len(words), "matches": [], "hits": []})
        coded = np.fromiter((items.number.get(w, 0) for w in words), np.int64, len(words))
        known = np.r_[0, coded > 0, 0]
        a, b = np.flatnonzero(np.diff(known) == 1), np.flatnonzero(np.diff(known) == -1)
        for x, y in zip(a, b):
            if y - x >= items.least:
                numbers += [coded[x:y], np.zeros(1, np.int64)]
                starts.append(at)
                owner.append((i, int(x)))
                at += int(y - x) + 1
    if not numbers:
        return out
    words = np.concatenate(numbers)
    suffix, place, length = occurrences(words, items)
    stretch = np.searchsorted(np.array(starts), place, "right") - 1
    reached: dict[tuple[int, int], int] = {}
    by_place = np.lexsort((suffix, place))
    for j in by_place:
        i, x = owner[stretch[j]]
        start, item = int(place[j]) - starts[stretch[j]] + x, int(items.item[suffix[j]])
        out[i]["hits"].append((start, start + int(items.window[suffix[j]])))
        diagonal = (stretch[j], item, int(items.start[suffix[j]]) - start)
        if reached.get(diagonal, -1) >= start + int(length[j]):
            continue  # part of the match before it
        reached[diagonal] = start + int(length[j])
        out[i]["matches"].append({
            "item_id": items.names[item], "item_start": int(items.start[suffix[j]]),
            "start": start, "words": int(length[j]),
        })
    for row in out:
        merged: list[list[int]] = []
        for start, stop in sorted(row["hits"]):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], stop)
            else:
                merged.append([start, stop])
        row["hits"] = [{"start": a, "stop": b} for a, b in merged]
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    rows = benchmark.select(
        F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")
    ).filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield [(r["item_id"] or "", r["text"].encode()) for r in part.collect()]


def contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", n: int = 10, block_bytes: int = 32 << 20,
) -> DataFrame:
    """`docs` with n_words, matches and hits (word spans), in place, without a shuffle.

    With several blocks of items the passes follow one another over the same rows.
    Columns of these names in `docs` are replaced.
    """
    made = ("n_words", "matches", "hits")
    out = docs.drop(*(set(made) - {text_col}))
    columns = list(out.columns)
    spark = docs.sparkSession
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        items = spark.sparkContext.broadcast(Items(block, n))

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, text_col):
                names = batch.schema.names
                rows = _shard(as_bytes(batch.column(names.index(text_col))), items.value)
                if "hits" in names:
                    for row, seen, old in zip(rows, batch.column(names.index("matches")).to_pylist(), batch.column(names.index("hits")).to_pylist()):
                        row["matches"] = seen + row["matches"]
                        spans: list[list[int]] = []
                        for x in sorted(old + row["hits"], key=lambda x: (x["start"], x["stop"])):
                            if spans and x["start"] <= spans[-1][1]:
                                spans[-1][1] = max(spans[-1][1], x["stop"])
                            else:
                                spans.append([x["start"], x["stop"]])
                        row["hits"] = [{"start": a, "stop": b} for a, b in spans]
                found = pa.RecordBatch.from_pylist(rows, FOUND)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(names.index(c)) for c in columns), *found.columns], [*columns, *made]
                )

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name not in made)
        out = out.mapInArrow(run, f"{fields}, {FOUND_SQL}")
    return out


def digest(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated of contamination()'s rows."""
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m.item_id)))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x.stop - x.start)
    return found.withColumns({
        "n_hit": n_hit, "n_items": F.size(items).cast("long"),
        "items_sha256": F.sha2(F.array_join(items, ","), 256), "contaminated": n_hit > 0,
    })


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", n: int = 10) -> DataFrame:
    """The rows of `docs` in which no window of any item occurs, with their own columns."""
    plain = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    found = contamination(plain, benchmark, "text", n=n)
    return found.filter(F.size("hits") == 0).select("row.*")
