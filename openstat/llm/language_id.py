"""Language identification with bit-sliced Bloom filters over character n-grams.

One filter answers for all languages at once: a position holds one bit per language,
and the AND of an n-gram's positions is the set of languages that have it. Per
language the bits are counted over a document's n-grams, the count expected from
false positives is taken off, and the largest rest decides.

Letters are lower-cased; everything else is a boundary. An n-gram belongs to a
language if it makes up at least `rate` of that language's n-grams and at least
`lift` of its largest rate in any language. That bounds a language to 1 / `rate`
n-grams, and so the filter, whatever the size of the corpus; counts cover all
learning rows.

Text that is null or has no letter is `und` with score 0. Ties go to the smaller
name; text of which no n-gram is known goes to the language with the most learned
n-grams, score 0. Without learned languages all is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from openstat.llm.common import mix, pieces

N, HASHES, BITS_EACH = 4, 3, 12
RATE, LIFT = 2e-5, 0.1


@lru_cache(None)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-gram hashes of all texts, how many each has, and whether it has a letter."""
    joined, sizes, lettered = [], [], []
    for text in texts:
        codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
        codes = np.where(_letters()[codes], codes, 0)
        seq = np.r_[np.uint32(0), codes, np.uint32(0)]
        seq = seq[np.r_[True, (seq[1:] != 0) | (seq[:-1] != 0)]]  # runs of boundaries as one
        has = len(seq) > 1
        seq = np.r_[seq, np.zeros(max(0, N - len(seq)), np.uint32)] if has else seq[:0]
        joined.append(seq)
        sizes.append(max(0, len(seq) - N + 1))
        lettered.append(has)
    codes, counts = np.concatenate(joined).astype(np.uint64), np.array(sizes, np.int64)
    lengths = np.array([len(j) for j in joined], np.int64)
    if len(codes) < N:
        return np.empty(0, np.uint64), counts, np.array(lettered)
    out = np.zeros(len(codes) - N + 1, np.uint64)
    for i in range(N):
        out = out * np.uint64(0x1FFFFF) + codes[i : i + len(out)]
    at = np.arange(len(out)) - np.repeat(np.cumsum(lengths) - lengths, lengths)[: len(out)]
    return mix(out[at <= np.repeat(lengths, lengths)[: len(out)] - N]), counts, np.array(lettered)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 16 << 20):
        lang = np.array(batch.column(0).to_pylist(), object)
        texts = batch.column(1).to_pylist()
        for name in sorted(set(lang)):
            found, n = np.unique(grams([texts[i] for i in np.flatnonzero(lang == name)])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)],
                ["lang", "gram", "n"],
            )


def language_grams(learning: DataFrame, rate: float = RATE, lift: float = LIFT) -> DataFrame:
    """lang, gram, n: the n-grams that belong to each language, from all rows of (lang, text)."""
    counts = learning.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy(
        "lang", "gram"
    ).agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    most = F.max("rate").over(Window.partitionBy("gram"))
    return rated.withColumn("most", most).filter((F.col("rate") >= rate) & (F.col("rate") >= lift * F.col("most"))).select("lang", "gram", "n")


@dataclass
class Filters:
    """One table of language bits, sliced into columns of 64 languages."""

    names: list[str]
    table: np.ndarray
    false: np.ndarray
    usual: int

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]]) -> Filters:
        names = sorted({r[0] for r in rows})
        number = {n: i for i, n in enumerate(names)}
        lang = np.array([number[r[0]] for r in rows], np.int64)
        gram = np.array([r[1] for r in rows], np.int64).view(np.uint64)
        held = np.bincount(lang, minlength=len(names))
        size = 1024
        while size < BITS_EACH * max(held, default=0):
            size *= 2
        table = np.zeros((size, -(-len(names) // 64) or 1), np.uint64)
        for at in cls.places(gram, size):
            np.bitwise_or.at(table, (at, lang // 64), np.uint64(1) << (lang % 64).astype(np.uint64))
        fill = np.array([((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(names))])
        weight = np.bincount(lang, [r[2] for r in rows], len(names)) if rows else np.zeros(0)
        return cls(names, table, fill**HASHES, int(weight.argmax()) if len(names) else 0)

    @staticmethod
    def places(gram: np.ndarray, size: int) -> list[np.ndarray]:
        other = mix(gram ^ np.uint64(0xABCDEF)) | np.uint64(1)
        return [((gram + np.uint64(k) * other) & np.uint64(size - 1)).astype(np.int64) for k in range(HASHES)]

    def counts(self, gram: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Per document and language, the n-grams that the language has, false positives taken off."""
        out = np.zeros((len(sizes), len(self.names)))
        has = np.flatnonzero(sizes)
        if not len(has):
            return out
        starts = (np.cumsum(sizes) - sizes)[has]
        masks = np.bitwise_and.reduce([self.table[at] for at in self.places(gram, len(self.table))])
        for i in range(len(self.names)):
            bits = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            out[has, i] = np.add.reduceat(bits, starts)
        return np.maximum(0, (out - sizes[:, None] * self.false) / (1 - np.minimum(self.false, 0.99)))

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        gram, sizes, lettered = grams(texts)
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        counts = self.counts(gram, sizes)
        best, total = counts.argmax(1), counts.sum(1)
        best = np.where(total > 0, best, self.usual)
        score = np.where(total > 0, counts.max(1) / np.maximum(total, 1e-9), 0.0)
        return [self.names[b] if h else "und" for b, h in zip(best, lettered)], np.where(lettered, score, 0.0)


def identify_language(
    docs: DataFrame, learn: Column, lang_col: str = "lang", text_col: str = "text",
    rate: float = RATE, lift: float = LIFT,
) -> DataFrame:
    """`docs` with lang_pred and score, in place, without a shuffle of texts.

    `learn` chooses the learning rows of `docs`; of them those with a language and a
    text count. The filter goes to all tasks; it has at most 1 / `rate` n-grams per
    language. Columns named lang_pred or score are replaced.
    """
    learning = docs.filter(learn).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = language_grams(learning.filter("lang is not null and text is not null"), rate, lift).collect()
    filters = docs.sparkSession.sparkContext.broadcast(Filters.of([tuple(r) for r in rows]))
    rest = docs.drop(*({"lang_pred", "score"} - {text_col}))
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            lang, score = filters.value.decide(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(run, f"{fields}, lang_pred string, score double")
