"""Quality classifier on random-indexing word vectors.

Every word falls into one of a fixed number of rows and has a sparse random index
vector, both from its hash. One pass over all documents adds the index vectors of
the two words on either side to a word's row; Spark sums the rows. A document is
pooled into the mean of its words' (normalized) context vectors, of their index
vectors, and of the products of neighbours' index vectors, which repeated words raise. A network of two layers, trained in NumPy, turns that into a
score, and a temperature fitted on rows kept apart makes the scores probabilities.

The corpus statistics cover all documents; the table has a fixed size. Only the
network is fitted on a bounded sample: at most `sample` labelled rows, those of the
smallest hashed ids. Words keep their case; runs of other characters are words too.
Null or empty text pools to zeros and is
scored as that. An id with labels of both kinds teaches nothing; one that repeats with
the same label is one label. Without labels of both
kinds the score is the share of label 1, or 0.5 without any label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from openstat.llm.common import NOT_SPACE, WordScan, pieces

#: Words are runs of letters and digits, or of other characters; ASCII white space separates.
TOKENS = np.where(
    NOT_SPACE == 0, 0, [1 if b >= 0x80 or chr(b).isalnum() else 2 for b in range(256)]
).astype(np.uint8)
ROWS, DIM, SPARSE, NEAR = 1 << 14, 32, 4, 2
#: Words that are added up at a time, so that a very long text needs little more than its hashes.
CHUNK = 1 << 17
#: Most labelled rows that the network is fitted on.
SAMPLE = 20_000


def _places(hashes: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Row of each word, and place and sign of each entry of its index vector."""
    row = (hashes & np.uint64(ROWS - 1)).astype(np.int64)
    entries = []
    for k in range(SPARSE):
        part = hashes >> np.uint64(14 + 8 * k)
        entries.append(((part & np.uint64(DIM - 1)).astype(np.int64), 1.0 - 2.0 * ((part >> np.uint64(6)) & np.uint64(1))))
    return row, entries


def _coded(batches: Iterator[pa.RecordBatch], name: str):
    scan = WordScan(TOKENS)
    for batch in pieces(batches, name):
        hashes, sizes = scan(batch.column(batch.schema.get_field_index(name)))
        yield batch, sizes, hashes


def _chunks(sizes: np.ndarray, hashes: np.ndarray, beyond: int):
    """Words in chunks, each with up to `beyond` of the words after it: number, documents and hashes."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    for a in range(0, len(hashes), CHUNK):
        n = min(CHUNK, len(hashes) - a)
        yield n, doc[a : a + n + beyond], hashes[a : a + n + beyond]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(ROWS * DIM)
    for _, sizes, hashes in _coded(batches, "text"):
        for n, doc, part in _chunks(sizes, hashes, NEAR):
            row, entries = _places(part)
            for step in range(1, NEAR + 1):
                left = np.flatnonzero(doc[step:][:n] == doc[:-step][:n])
                for to, of in ((left, left + step), (left + step, left)):
                    base = row[to] * DIM
                    for place, sign in entries:
                        table += np.bincount(base + place[of], sign[of], ROWS * DIM)
    table = table.astype(np.int64).reshape(ROWS, DIM)
    used = np.flatnonzero(table.any(1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used), *(pa.array(table[used, d]) for d in range(DIM))], ["row", *(f"d{d}" for d in range(DIM))]
    )


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Context vectors summed over all documents, each of length 1: a table of fixed size."""
    names = [f"d{d}" for d in range(DIM)]
    summed = (
        texts.select("text").mapInArrow(_contexts, "row long, " + ", ".join(f"{n} long" for n in names))
        .groupBy("row").agg(*(F.sum(n).alias(n) for n in names))
    ).collect()
    table = np.zeros((ROWS, DIM))
    for r in summed:
        table[r[0]] = r[1:]
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.maximum(length, 1e-9)).astype(np.float32)


def pooled(sizes: np.ndarray, hashes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean context vector and mean index vector of each document, the mean product of the
    index vectors of neighbours, and the logarithm of the length; zeros without words."""
    out = np.zeros((len(sizes), 3 * DIM + 1))
    for n, doc, part in _chunks(sizes, hashes, 1):
        row, entries = _places(part)
        starts = np.flatnonzero(np.r_[True, doc[1:n] != doc[: n - 1]])
        own = np.zeros((len(row), DIM), np.float32)
        for place, sign in entries:
            own[np.arange(len(row)), place] += sign
        both = np.zeros((n, DIM), np.float32)
        pair = np.flatnonzero(doc[1:] == doc[:-1])
        both[pair] = own[pair] * own[pair + 1]
        for at, values in enumerate((vectors[row[:n]], own[:n], both)):
            out[doc[starts], at * DIM : (at + 1) * DIM] += np.add.reduceat(values, starts, axis=0, dtype=np.float64)
    out /= np.maximum(sizes, 1)[:, None]
    out[:, -1] = np.log1p(sizes)
    return out


@dataclass
class Network:
    """Standardized input, one hidden layer, one output, and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x) / self.temperature
        return 0.5 * (1 + np.tanh(z / 2))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 11) -> Network:
    """Adam on log loss with small weight decay; inputs are standardized."""
    rng = np.random.default_rng(seed)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    net = Network(
        x.mean(0), x.std(0) + 1e-6, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)),
        np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), float(np.log(prior / (1 - prior))),
    )
    x = (x - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 128):
            part = order[a : a + 128]
            h = np.tanh(x[part] @ params[0] + params[1])
            p = 0.5 * (1 + np.tanh((h @ params[2] + params[3]) / 2))
            back = (p - y[part]) / len(part)
            inner = np.outer(back, params[2]) * (1 - h * h)
            grads = [x[part].T @ inner + 1e-4 * params[0], inner.sum(0), h.T @ back + 1e-4 * params[2], back.sum(keepdims=True)]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] -= 3e-3 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    return net


def calibrate(net: Network, x: np.ndarray, y: np.ndarray) -> Network:
    """Temperature of least log loss, searched by golden section on its logarithm.

    Targets keep the distance from 0 and 1 that so many rows can vouch for.
    """
    z = net.logits(x)
    y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))

    def loss(log_t: float) -> float:
        s = z / np.exp(log_t)
        return float(np.mean(np.logaddexp(0, s) - y * s))

    low, high, ratio = -2.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    net.temperature = float(np.exp((low + high) / 2))
    return net


def _pool_rows(vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sizes, hashes in _coded(batches, "text"):
            x = pooled(sizes, hashes, vectors.value).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array([r.tobytes() for r in x], pa.binary())],
                ["quality", "order", "apart", "x"],
            )

    return run


def fit(docs: DataFrame, labels: DataFrame, vectors, id_col: str, text_col: str, learn: Column, sample: int) -> Network | float:
    """The network, or a constant score where labels do not tell two kinds apart.

    `labels` has doc_id and quality. One in five rows, by hash, is kept apart for the
    temperature.
    """
    order = F.xxhash64(F.col("doc_id").cast("string"))
    quality = F.col("quality").cast("int")
    chosen = (
        labels.filter("doc_id is not null and quality is not null").filter(learn)
        .groupBy("doc_id").agg(F.min(quality).alias("quality"), F.max(quality).alias("most"))
        .filter("quality = most").select("doc_id", "quality", order.alias("order")).orderBy("order", "doc_id").limit(sample)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = (
        texts.join(F.broadcast(chosen), "doc_id")
        .select("quality", "order", (F.pmod("order", F.lit(5)) == 0).alias("apart"), "text")
        .mapInArrow(_pool_rows(vectors), "quality int, order long, apart boolean, x binary")
        .collect()
    )
    rows.sort(key=lambda r: (r["order"], r["x"]))
    y = np.array([r["quality"] for r in rows], float)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], float)
    apart = np.array([r["apart"] for r in rows])
    if len(set(y[~apart])) < 2 or len(set(y[apart])) < 2:
        return train(x, y)
    return calibrate(train(x[~apart], y[~apart]), x[apart], y[apart])


def score_quality(
    docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id",
    text_col: str = "text", sample: int = SAMPLE, name: str = "quality_score",
) -> DataFrame:
    """`docs` with a column `name`: the probability of label 1, in place, without a shuffle.

    `learn` says, in terms of labels.doc_id, which labels may be learned from. The
    broadcast sample has at most `sample` ids and labels.
    """
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col(text_col).alias("text"))
    vectors = context.broadcast(word_vectors(texts))
    model = context.broadcast(
        fit(docs, labels, vectors, id_col, text_col, F.lit(True) if learn is None else learn, sample)
    )
    rest = docs.drop(name)
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sizes, hashes in _coded(batches, text_col):
            x = pooled(sizes, hashes, vectors.value).astype(np.float32).astype(float)
            net = model.value
            scores = np.full(len(sizes), net) if isinstance(net, float) else net.scores(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(run, f"{fields}, `{name}` double")
