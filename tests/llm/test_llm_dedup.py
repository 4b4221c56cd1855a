"""Dedup, join and decontamination operators against brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from openstat.llm import jaccard_join as jj
from openstat.llm import substring_dedup as sd
from openstat.llm.common import NOT_SPACE, WordScan
from openstat.llm.components import components
from openstat.llm.decontaminate import contamination, decontaminate, digest
from openstat.llm.exact_dedup import exact_dedup
from openstat.llm.jaccard_join import Threshold, jaccard_join
from openstat.llm.substring_dedup import substring_dedup

EVERYWHERE = np.ones(1 << 16, bool)
SCHEMA = "doc_id long, text string, size int, spans string, hits string, n_words string, node string, key int"


def corpus(seed=5, n=60):
    """Rows with copies, near copies, shared passages, repeats, nulls, blanks and a very long text."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Ünder", "STRASSE", "naïve."]
    text = lambda k: " ".join(rng.choices(vocab, k=k))
    passage = text(40)
    rows = [(i, text(rng.randint(1, 120))) for i in range(n)]
    for i in range(n, 2 * n):
        base = rows[rng.randrange(n)][1].split()
        kind = rng.randrange(4)
        if kind == 1 and base:
            for _ in range(1 + len(base) // 60):
                base[rng.randrange(len(base))] = rng.choice(vocab)
        elif kind == 2:
            base = passage.split() + base
        elif kind == 3:
            base = [w.upper() for w in base]
        rows.append((i, "\n".join(base) if kind == 0 else " ".join(base)))
    rows += [(500, None), (501, ""), (502, " \t\n "), (503, "x"), (504, "x"), (None, rows[3][1]), (None, None)]
    rows += [(505, "a " * 40), (506, "a\x0ba\x0ca " * 20), (507, "b a " * 30), (508, text(9000)), (509, rows[0][1])]
    return rows + [rows[7], rows[7], (7, "another text of the same id " + passage)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", "h", "n", "o", 2) for i, t in rows], SCHEMA).repartition(5)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_spans(rows, least=13):
    first = {}
    for i, t in rows:
        ws = words(t)
        for p in range(len(ws) - least + 1):
            g = tuple(ws[p : p + least])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        ws, gone = words(t), set()
        for p in range(len(ws) - least + 1):
            if i is not None and first[tuple(ws[p : p + least])] < i:
                gone |= set(range(p, p + least))
        kept = " ".join(w for p, w in enumerate(ws) if p not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("frequent", [False, True])
def test_substring_dedup(spark, monkeypatch, frequent):
    if frequent:
        monkeypatch.setattr(sd, "frequent_ranges", lambda counts: EVERYWHERE)
    rows = corpus()
    got = substring_dedup(table(spark, rows))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr) == brute_spans(rows)
    one = got.filter("n_removed > 0").first()
    assert sum(s["stop"] - s["start"] for s in one["spans"]) == one["n_removed"]
    assert len(words(one["kept_text"])) == one["n_words"] - one["n_removed"]


def test_factor_goes_on_across_batches(spark):
    """An anchor's rows may fall into many Arrow batches."""
    text = " ".join(f"v{i}" for i in range(30))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = substring_dedup(docs).groupBy("n_removed").count().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == [(0, 1), (30, 2999)]


@pytest.mark.parametrize("open_too", [False, True])
def test_phrases_of_an_anchor_differ_in_all_64_bits(open_too):
    """Hashes that agree in either half are still different phrases; also across batches."""
    import pyarrow as pa

    phrases = [1 << 40, 1 << 40 | 1, 1 << 41 | 1, 1 << 40]
    rows = [(5, i, 0, 0, np.uint64(p).tobytes()) for i, p in enumerate(phrases)]
    for cuts in ([0, 4], [0, 1, 2, 3, 4], [0, 2, 4]):
        batches = [
            pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a:b]), sd.ROWS)], schema=sd.ROWS)
            for a, b in zip(cuts, cuts[1:])
        ]
        out = [tuple(r.values())[:4] for b in sd._factor(13, open_too)(iter(batches)) for r in b.to_pylist()]
        assert [r for r in out if r[3]] == [(3, 0, 0, 13)]


@pytest.mark.parametrize("frequent", [False, True])
def test_factors_name_their_source(spark, monkeypatch, frequent):
    """Each factor stands word for word in the earlier document that it names; copies are one factor."""
    if frequent:
        monkeypatch.setattr(sd, "frequent_ranges", lambda counts: EVERYWHERE)
    rows = [(i, t) for i, t in corpus() if i is not None and i != 7]
    texts = {i: words(t) for i, t in rows}
    got = substring_dedup(table(spark, rows)).collect()
    most = 0
    for r in got:
        covered = set()
        for start, stop, source, place in r["factors"]:
            assert source < r["doc_id"] and stop - start >= 13
            assert texts[r["doc_id"]][start:stop] == texts[source][place : place + stop - start]
            covered |= set(range(start, stop))
            most = max(most, stop - start)
        assert len(covered) == r["n_removed"]
    assert most > 60
    whole = next(r for r in got if r["doc_id"] == 509)
    if not frequent:
        assert [tuple(f) for f in whole["factors"]] == [(0, whole["n_words"], 0, 0)]


def test_longest_prefixes_equal_brute_force():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 9, 200)
    part = np.repeat(np.sort(rng.integers(0, 12, 200)), sizes)
    docs = np.repeat(rng.integers(0, 1000, 200), sizes)
    for p in np.unique(part):  # ids in order within a part
        own = np.flatnonzero(part == p)
        docs[own] = np.sort(docs[own])
    left = np.concatenate([np.arange(n, 0, -1) for n in sizes])
    code = rng.integers(0, 3, len(part)).astype(np.uint64)
    length, source = sd.longest(part, code, left, docs)
    for i in range(len(part)):
        best, first = 0, -1
        for j in range(i):
            if part[j] == part[i] and docs[j] < docs[i]:
                n = 0
                while n < min(left[i], left[j]) and code[i + n] == code[j + n]:
                    n += 1
                if n > best:
                    best, first = n, j
        assert length[i] == best and (best == 0 or source[i] == first)


def test_segments_of_a_long_text_do_not_depend_on_chunks_or_neighbours(monkeypatch):
    import pyarrow as pa

    rng = random.Random(3)
    long = " ".join(rng.choices([f"v{i}" for i in range(50)], k=5000))

    def segments(texts):
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text_id": [1] * len(texts), "text": texts})
        out = {}
        for ids, _, row, at, anchor, cuts, phrase in sd._anchored(iter([batch]), 13):
            for r, a, h, x, y in zip(row, at, anchor, cuts, cuts[1:]):
                assert (ids[r], a) not in out
                out[(texts[ids[r]], a)] = (h, phrase[x:y].tolist())
        return out

    short = " ".join(f"x{i}" for i in range(40))
    whole = segments([short, long])
    monkeypatch.setattr(sd, "CHUNK", 128)
    chunks = segments([long, short])
    assert sorted(p for _, ps in whole.values() for p in ps) == sorted(p for _, ps in chunks.values() for p in ps)
    assert len(whole) > 700 and segments([short, long, None, ""]) == chunks


def test_phrase_hashes_keep_all_their_bits():
    import pyarrow as pa

    text = " ".join(f"v{i}" for i in range(200))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text_id": [1], "text": [text]})
    (*_, cuts, phrase), = sd._anchored(iter([batch]), 13)
    assert phrase.dtype == np.uint64 and cuts[-1] == len(phrase) == 188
    assert (phrase >> np.uint64(32)).all() and (phrase & np.uint64(0xFFFFFFFF)).all()


def shingle_set(text, k):
    lower = text.translate({c: c + 32 for c in range(65, 91)}) if text else ""
    ws = words(lower)
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1)))


def brute_components(rows, k, top, bottom):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, r in sets[:a]:
            if i is not None and j is not None and s and r:
                both = len(s & r)
                if bottom * both >= top * (len(s) + len(r) - both):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


@pytest.mark.parametrize(
    "k, top, cost, frequent, rounds",
    [(3, 90, jj.ENTRY_COST, False, jj.ROUNDS), (3, 90, 0, True, (1, None)), (5, 80, 0, False, jj.ROUNDS), (2, 60, 3, False, (1, None))],
)
def test_jaccard_join(spark, monkeypatch, k, top, cost, frequent, rounds):
    monkeypatch.setattr(jj, "ROUNDS", rounds)
    if frequent:
        monkeypatch.setattr(jj, "frequent_ranges", lambda counts: EVERYWHERE)
    rows = corpus(seed=k)
    rng = random.Random(1)
    base = [f"n{i}" for i in range(60)]
    for i in range(600, 640):  # a group whose members are near the threshold
        own = list(base)
        for _ in range(2):
            own[rng.randrange(60)] = f"m{rng.randrange(9)}"
        rows.append((i, " ".join(own)))
    got = jaccard_join(table(spark, rows), k=k, top=top, cost=cost)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(rows, k, top, 100)


@pytest.mark.parametrize("filter_words", [1, jj.FILTER_WORDS])
def test_texts_of_no_entry_stay_where_they_are_read(spark, monkeypatch, filter_words):
    monkeypatch.setattr(jj, "FILTER_WORDS", filter_words)
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(40))) for i in range(300)]
    rows += [(i, rows[i - 300][1] + " end") for i in range(300, 303)] + [(303, None), (304, ""), (None, rows[5][1])]
    docs = table(spark, rows).select("doc_id", "text", F.xxhash64("text").alias("text_id"))
    drawn = [r["doc_id"] for r in jj.Join(docs, 3, Threshold(90, 100)).drawn(docs).collect()]
    assert {0, 1, 2, 300, 301, 302} <= set(drawn)
    assert len(drawn) < (20 if filter_words > 1 else 100)
    got = jaccard_join(table(spark, rows), k=3, top=90)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(rows, 3, 90, 100)


def test_blocks_of_comparisons_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 3)
    rng = random.Random(3)
    rows = [(i, " ".join(f"n{j}" if rng.random() > 0.04 else f"m{rng.randrange(5)}" for j in range(50))) for i in range(40)]
    got = jaccard_join(table(spark, rows), k=1, top=85)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(rows, 1, 85, 100)


@pytest.mark.parametrize("cost", [0, 50, 500])
def test_bare_template_meets_templates_with_extras(spark, cost):
    """The bare text has only costly segments, those with extras have enough others."""
    base = " ".join(f"n{j}" for j in range(100))
    rows = [(i, f"{base} " + " ".join(f"x{i}_{j}" for j in range(11))) for i in range(60)] + [(60, base)]
    got = jaccard_join(table(spark, rows), k=1, top=90, cost=cost)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(rows, 1, 90, 100)


@pytest.mark.parametrize("top", [60, 80, 90])
def test_similar_sizes_share_a_scheme_with_enough_segments(top):
    limit = Threshold(top, 100)
    for a in range(1, 400):
        for b in range(a, a * 100 // top + 1):
            x, y = limit.band(a), limit.band(b)
            assert y - x in (0, 1)
            assert limit.segments(x)[0] > limit.differ(a + b) or a == b and limit.differ(a + b) == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(links.union(spark.createDataFrame([(100, 200)], "a long, b long"))).collect()
    assert {(r["node"], r["component"]) for r in got} == {(i, 0) for i in range(61)} | {(100, 100), (200, 100)}


def test_components_go_on_from_earlier_labels(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(230)]
    pairs += [(999, i) for i in range(400, 430)] + [(5, 5), (700, 700), (None, 3), pairs[0], pairs[0][::-1]]
    labels, parent = None, {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for part in (pairs[:150], [], pairs[150:], [(999, 0), (800, 801)]):
        labels = components(spark.createDataFrame(part, "a long, b long"), labels)
        for a, b in part:
            if a is not None and a != b:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
        assert sorted((r["node"], r["component"]) for r in labels.collect()) == sorted((x, find(x)) for x in list(parent))


def test_few_links_are_not_written_as_a_file_per_partition(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("openstat.session.shared_dir", lambda _: str(tmp_path))
    held = {"spark.sql.shuffle.partitions": "150", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    links = spark.range(400).select(F.col("id").alias("a"), (F.col("id") - F.col("id") % 4).alias("b")).cache()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        labels = components(links)
        assert labels.filter("component <> node - node % 4").isEmpty() and labels.count() == 400
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(list(tmp_path.rglob("*.parquet"))) < 100


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    rows = corpus(n=25)
    rows += [(700, "long. " * 900 + "end"), (701, "long. " * 900 + "end"), (702, "long. " * 900 + "End")]
    identify = (lambda c: F.pmod(F.xxhash64(c), F.lit(3))) if weak else (lambda c: F.xxhash64(c))
    got = exact_dedup(table(spark, rows), identify=identify).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = []
    for t, ids in groups.items():
        keep = max(ids, key=lambda i: -1 if i is None else i)
        sha = hashlib.sha256(t.encode()).hexdigest()
        kept = False
        for i in sorted(ids, key=repr):
            want.append((i, keep, len(ids), i == keep and not kept, sha))
            kept |= i == keep
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)


def brute_contamination(rows, items, n=10):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    windows = {}
    for item, t in items:
        ws = split(t)
        k = min(n, len(ws))
        for p in range(len(ws) - k + 1 if ws else 0):
            windows.setdefault(tuple(ws[p : p + k]), set()).add(str(item))
    sizes = sorted({len(w) for w in windows})
    out = []
    for i, t in rows:
        ws, hit, found = split(t), set(), set()
        for k in sizes:
            for p in range(len(ws) - k + 1):
                if tuple(ws[p : p + k]) in windows:
                    hit |= set(range(p, p + k))
                    found |= windows[tuple(ws[p : p + k])]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(ws), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_contamination(spark, block_bytes):
    rows = corpus(n=30)
    items = [(i, " ".join(words(t)[2:16])) for i, t in rows[:6]] + [(50, "w1 w2"), (51, None), (52, " -- "), (53, rows[1][1]), (53, "w7")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = digest(contamination(table(spark, rows), benchmark, block_bytes=block_bytes))
    got = got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got), key=repr) == brute_contamination(rows, items)


def test_longest_matches_and_removal(spark):
    docs = table(spark, [(1, "p q a b c d e f g h i j k l x"), (2, "a b c d"), (3, None)])
    items = spark.createDataFrame([(9, "z a b c d e f g h i j k l y")], "item_id long, text string")
    found = {r["doc_id"]: r["matches"] for r in contamination(docs, items).collect()}
    assert [tuple(m) for m in found[1]] == [("9", 1, 2, 12)] and found[2] == [] and found[3] == []
    left = decontaminate(docs, items)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {2, 3}


@pytest.mark.parametrize("run", [
    substring_dedup, jaccard_join, exact_dedup,
    lambda d: contamination(d, d.select(F.col("doc_id").alias("item_id"), "text")),
])
def test_empty_tables(spark, run):
    assert run(table(spark, [(1, "a")]).filter("doc_id < 0")).collect() == []


def test_word_scan_cuts_long_texts_between_words():
    import pyarrow as pa

    texts = [None, "", "aa  bb\tcc", " dd", "x" * 50 + " y " + "z" * 30, "aa"]
    whole, counts = WordScan()(pa.array(texts))
    parts, same = WordScan(most=8)(pa.array(texts))
    assert counts.tolist() == same.tolist() == [0, 0, 3, 1, 3, 1]
    assert (whole == parts).all() and whole[0] == whole[-1] and len(set(whole.tolist())) == 7
    assert NOT_SPACE.sum() == 250
