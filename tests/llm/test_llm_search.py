"""Vector searches and periodic runs against brute force on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from openstat.llm import hard_negatives as hn
from openstat.llm.hard_negatives import hard_negatives
from openstat.llm.onebit_search import nearest, rotated
from openstat.llm.periodic_runs import periodic_runs
from openstat.llm.queries import QUERIES
from openstat.llm.vectors import TopK

EXTRA = "vec_id long, embedding array<float>, label int, score double, rank int, code string, cell int, key string"


def vector_rows(seed=2, n=260, dim=12):
    """Clusters, a third of all rows one vector, ties, other lengths, and rows that take no part."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(4, dim))
    rows = []
    for i in range(n):
        x = middle[i % 4] + rng.normal(size=dim) * 0.3
        if i % 3 == 0:
            x = middle[0]
        rows.append((i, np.round(x, 2).astype(np.float32).tolist(), i % 5))
    rows += [(n + i, [1.0, float(i)], i % 2) for i in range(30)]
    rows += [(400, None, 1), (420, [0.0] * dim, 1), (440, [float("nan")] * dim, 1), (460, [None] * dim, 1)]
    rows += [(480, [float("inf")] + [0.0] * (dim - 1), 1), (None, rows[1][1], 1), (500, [], 1), (520, rows[1][1], None)]
    return rows + [rows[3], rows[3], rows[40]]


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, l, 0.5, 1, "c", 2, "k") for i, v, l in rows], EXTRA).repartition(3)


def brute_nearest(rows, k, every):
    sound = [(i, v) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for i, q in sound:
        if i % every == 0:
            scored = [(-float(np.cumsum(np.multiply(q, v))[-1]), j) for j, v in sound if j != i and len(v) == len(q)]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("k", [1, 20, 400])
def test_nearest_equals_brute_force(spark, k):
    rows = vector_rows()
    df = vector_table(spark, rows)
    found = nearest(df, df.filter("vec_id % 20 = 0"), k=k).collect()
    assert found[0].__fields__ == ["query_id", "rank", "vec_id", "score"] if found else True
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found}
    want = brute_nearest(rows, k, 20)
    assert len(found) == len(got) and got == want


def test_nearest_recall_on_hard_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    found = nearest(df, df.filter("vec_id % 100 = 0"), k=10, bits=1, confidence=3.0).collect()
    want = {(i, j) for i in range(0, 3000, 100) for j in [j for j in np.argsort(-(x @ x[i])) if j != i][:10]}
    assert len(want & {(r["query_id"], r["vec_id"]) for r in found}) >= 0.95 * len(want)


def test_nearest_of_nothing(spark):
    df = vector_table(spark, vector_rows())
    assert nearest(df.limit(0), df.limit(0)).count() == 0
    assert nearest(df, df.limit(0)).count() == 0
    assert nearest(df.limit(0), df.filter("vec_id = 20")).count() == 0
    lone = df.filter("vec_id = 20")
    assert nearest(lone, lone).count() == 0


def test_rotation_keeps_inner_products():
    x = np.random.default_rng(1).normal(size=(6, 20))
    assert np.allclose(rotated(x, 64) @ rotated(x, 64).T, x @ x.T)


def test_topk_breaks_ties_by_id_over_several_batches():
    top = TopK(2, 3, np.int64)
    top.add(np.array([0, 0, 1]), np.array([5, 5, 1]), np.array([9, 3, 4]))
    top.add(np.array([0, 0, 0]), np.array([5, 7, 5]), np.array([1, 2, 3]))
    assert top.ids[0].tolist() == [2, 1, 3] and top.n.tolist() == [3, 1] and top.lists().to_pylist()[1] == [{"worse": -1, "near": 4}]


def whole(rows):
    return [(i, None if v is None else [None if x is None or not np.isfinite(x) else int(np.floor(8 * x)) for x in v], l) for i, v, l in rows]


def brute_negatives(rows, every, n_positives=5, n_negatives=3):
    sound = [(i, v, l) for i, v, l in rows if i is not None and l is not None and v and None not in v]
    out = set()
    for i, q, label in {(i, tuple(v), l) for i, v, l in sound if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, l) for j, v, l in sound if j != i and len(v) == len(q))
        for s, j, _ in [x for x in scored if x[2] == label][:n_positives]:
            fits = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:n_negatives]
            out |= {(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fits)}
    return out


INTEGERS = EXTRA.replace("array<float>", "array<long>")


def integer_table(spark, rows):
    return spark.createDataFrame([(i, v, l, 0.5, 1, "c", 2, "k") for i, v, l in rows], INTEGERS).repartition(3)


def test_hard_negatives_equal_brute_force(spark):
    rows = whole(vector_rows())
    df = integer_table(spark, rows)
    found = hard_negatives(df, df.filter("vec_id % 10 = 0")).collect()
    assert {tuple(r) for r in found} == brute_negatives(rows, 10) and len(found) > 30


def test_hard_negatives_with_many_parts(spark, monkeypatch):
    monkeypatch.setattr(hn, "TILE_BYTES", 8 * 12 * 16)
    monkeypatch.setattr(hn, "LEAF", 16)
    rows = whole(vector_rows(seed=9, n=400))
    df = integer_table(spark, rows)
    found = hard_negatives(df, df.filter("vec_id % 25 = 0")).collect()
    assert {tuple(r) for r in found} == brute_negatives(rows, 25)


def test_hard_negatives_of_nothing(spark):
    df = integer_table(spark, whole(vector_rows()))
    assert hard_negatives(df.limit(0), df.limit(0)).count() == 0
    assert hard_negatives(df, df.limit(0)).count() == 0
    assert hard_negatives(df.filter("vec_id = 10"), df.filter("vec_id = 10")).count() == 0
    huge = spark.createDataFrame([(1, [1 << 40, 1], 1), (2, [1, 1], 1)], "vec_id long, embedding array<long>, label int")
    assert hard_negatives(huge, huge).count() == 0


def test_tree_search_reads_few_leaves_and_finds_all(monkeypatch):
    monkeypatch.setattr(hn, "LEAF", 8)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (700, 2)).astype(float) + np.repeat([[0, 0], [300, 0], [0, 300], [300, 300], [-300, 0], [0, -300], [900, 900]], 100, axis=0)
    labels = rng.integers(0, 3, 700)
    tree = hn.Tree(np.arange(700), labels, x)
    assert sorted(np.concatenate(tree.ids).tolist()) == list(range(700)) and len(tree.children) > 1
    at = np.arange(0, 700, 70)
    anchors = hn.Anchors(
        at + 1000, labels[at], at, x[at], np.full((10, 1), 1000), np.full((10, 1), 200_000), 4, False
    )
    seen, score = [], hn.Anchors.score

    def counted(self, who, leaf, tree):
        seen.append(len(who))
        score(self, who, leaf, tree)

    monkeypatch.setattr(hn.Anchors, "score", counted)
    anchors.search(tree)
    for n, i in enumerate(at):
        s = x @ x[i]
        best = sorted((-v, j) for j, v in enumerate(s.tolist()) if labels[j] != labels[i] and 1000 <= v <= 200_000)[:4]
        assert anchors.top.ids[n, : anchors.top.n[n]].tolist() == [j for _, j in best]
    assert sum(seen) < 0.5 * 10 * len(tree.ids)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(ws, least=6, times=4):
    n, runs = len(ws), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, times * q):
                if not any(all(ws[i + t] == ws[i + t + p] for t in range(length - p)) for p in range(1, q)):
                    runs.append((i, length, q))
            i = j + 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def run_texts(seed=6):
    rng = random.Random(seed)
    texts = [None, "", " \t\n\x0b ", "a", "a a a a a", "a a a a a a", "x " * 5000, "é ü " * 9 + "z", "a b c d " * 4]
    for _ in range(250):
        ws = [rng.choice("abcde") * rng.choice([1, 1, 2]) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            ws[rng.randint(0, len(ws)) : 0] = (ws[: rng.randint(1, 12)] or ["z"]) * rng.randint(2, 9)
        texts.append(rng.choice([" ", "\t \n"]).join(ws))
    return texts + [" ".join(f"w{rng.randrange(300)}" for _ in range(4000)) + " p q r" * 700]


def test_runs_equal_brute_force(spark):
    texts = run_texts()
    rows = [(i if i % 50 else None, t, 1, "r", "k") for i, t in enumerate(texts)] + [(3, "b b b b b b b", 1, "r", "k")] * 2
    df = spark.createDataFrame(rows, "doc_id int, text string, n_words int, runs string, collapsed_text string").repartition(5)
    found = periodic_runs(df).collect()
    got = sorted((repr(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["n_kept"], r["collapsed_text"]) for r in found)
    want = []
    for i, t, *_ in rows:
        ws = words(t)
        runs = brute_runs(ws)
        gone = {p for s, length, q in runs for p in range(s + q, s + length)}
        kept = [w for p, w in enumerate(ws) if p not in gone]
        want.append((repr(i), len(ws), runs, len(kept), " ".join(kept)))
    assert got == sorted(want) and sum(len(r["runs"]) for r in found) > 100
    assert periodic_runs(df.limit(0)).count() == 0


def test_runs_with_other_limits(spark):
    df = spark.createDataFrame([(1, "a b a b a b c"), (2, "a a a")], "id long, body string")
    found = {r["id"]: [tuple(x) for x in r["runs"]] for r in periodic_runs(df, "id", "body", least=3, times=3).collect()}
    assert found == {1: [(0, 6, 2)], 2: [(0, 3, 1)]}
    with pytest.raises(ValueError):
        periodic_runs(df, "id", "body", times=2)


def test_query_of_periodic_runs(spark, tmp_path):
    texts = run_texts(8)
    spark.createDataFrame([(i * 37, t, "en", 2) for i, t in enumerate(texts)], "doc_id long, text string, lang string, start int").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    got = {r["doc_id"]: r for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    planted = 0
    for i, t in enumerate(texts):
        doc, ws = i * 37, words(t)
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0 and ws:
            g = h // 10
            a = g % len(ws)
            p = 1 + (len(ws) - a) // (3 + g % 8)
            ws = [w if j < a else ws[a + (j - a) % p] for j, w in enumerate(ws)]
            planted += 1
        runs = brute_runs(ws)
        gone = {x for s, length, q in runs for x in range(s + q, s + length)}
        best = min(((-length, s, q) for s, length, q in runs), default=None)
        row = got[doc]
        assert row["n_runs"] == len(runs)
        assert (row["start"], row["length"], row["period"]) == ((best[1], -best[0], best[2]) if best else (None,) * 3)
        assert row["exponent_milli"] == (1000 * -best[0] // best[2] if best else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(" ".join(w for x, w in enumerate(ws) if x not in gone).encode()).hexdigest()
    assert planted > 10
