"""Scoring, extraction, archives, mixing, sharding and the pipeline on small tables."""

import hashlib
import os
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from openstat.llm import queries
from openstat.llm.html_text import extract_text, render
from openstat.llm.language_id import Filters, identify_language
from openstat.llm.mixing import OTHER, leaf_budgets, mix_sources, shares
from openstat.llm.quality import calibrate, score_quality, train
from openstat.llm.sharding import SlotMaps, assign_shards, growth_map, map_version, rebalance, slot_bytes, slot_weights
from openstat.llm.warc import parse_record, ranges, read_records, record, write_archives
from tests.llm.test_llm_dedup import brute_components, brute_contamination, corpus

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_quality_learns_and_scores_every_row(spark):
    rng = np.random.default_rng(1)
    rows = [
        (i, " ".join(rng.choice(["the", "cat", "sat", "on", "mats"], 30)) + (" !!! $$$" * 5 if i % 3 == 0 else ""), "x")
        for i in range(300)
    ] + [(900, None, "x"), (901, "", "x"), (None, "the cat", "x"), (5, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(250)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = score_quality(docs, labels, learn=F.col("doc_id") % 5 != 0, name="score").collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 300 and r["doc_id"] != 5 and r["doc_id"] % 5 == 0]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 != 0) for r in held]) > 0.95
    assert {r["score"] for r in score_quality(docs, labels.filter("quality = 1"), name="s").select(F.col("s").alias("score")).collect()} == {1.0}
    assert {r["s"] for r in score_quality(docs, labels.filter("false"), name="s").collect()} == {0.5}
    assert score_quality(docs.filter("false"), labels, name="s").collect() == []


def test_temperature_calms_scores_that_are_too_sure():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = (rng.random(2000) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    net = train(x[:200], y[:200], epochs=200)
    loss = lambda p: -np.mean(y[200:] * np.log(p + 1e-12) + (1 - y[200:]) * np.log(1 - p + 1e-12))
    before = loss(net.scores(x[200:]))
    assert calibrate(net, x[200:], y[200:]).temperature > 1 and loss(net.scores(x[200:])) < before


def test_held_out_accuracy(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    labels = queries.table(spark, folder, "labels")
    rows = queries.QUERIES["op4_quality"](spark, folder).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    langs = queries.table(spark, folder, "documents").select("doc_id", "lang")
    rows = queries.QUERIES["op10_language"](spark, folder).join(langs, "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97


def test_folds_follow_the_contract(spark):
    got = spark.range(50).select("id", queries.fold(F.col("id"), 3).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 3 for r in got)


def test_language_of_odd_texts(spark):
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate([("the cat and the dog and the bird", "en"), ("der hund und die katze und der vogel", "de")] * 20)]
    rows += [(100, None, None, "s", 0), (101, "", "en", "s", 0), (102, "123 !", "de", "s", 0), (103, "the bird", None, "s", 0), (104, "ЖЖЖ", None, "s", 0), (105, "d", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, lang_pred int")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify_language(docs, F.col("doc_id") < 40).collect()}
    assert len(got) == len(rows) and got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[0][0] == got[103][0] == "en" and got[1][0] == "de" and got[104][0] in ("en", "de") and got[104][1] == 0
    assert {r["lang_pred"] for r in identify_language(docs, F.lit(False)).collect()} == {"und"}
    assert identify_language(docs.filter("false"), F.lit(True)).collect() == []


def test_filters_return_every_language_of_a_gram():
    rng = np.random.default_rng(2)
    rows = [(f"l{lang:02d}", int(g), 1) for lang in range(70) for g in rng.integers(0, 1 << 62, 200)]
    filters = Filters.of(rows)
    gram = np.array([g for _, g, _ in rows], np.int64).view(np.uint64)
    masks = np.bitwise_and.reduce([filters.table[at] for at in filters.places(gram, len(filters.table))])
    assert all(masks[i, int(n[1:]) // 64] >> np.uint64(int(n[1:]) % 64) & np.uint64(1) for i, (n, _, _) in enumerate(rows))
    assert filters.false.max() < 0.02


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<head><title>t</title></head><p>a<p>b<div>c</div>d", "a\n\nb\n\nc\nd"),
    ("<h1>T</h1>x<br>y<script>no</script><style>no</style><!-- no -->", "T\n\nx\ny"),
    ("<ul><li>one<li>two<ol><li>in<li>side</ol></ul>", "- one\n- two\n  1. in\n  2. side"),
    ("<ol start=3><li>a</li><li>b</li></ol>", "3. a\n4. b"),
    ("<table><tr><th>name<th>n<tr><td>long name<td>1<tr><td>x<td>22</table>", "name       n\nlong name  1\nx          22"),
    ("<table>loose<tbody>more<tr><td colspan=2>a<td>b<tr><td>1<td>2<td>3</table>", "loose\nmore\na     b\n1  2  3"),
    ("<div hidden>no</div><p style='color:red; display : none'>no</p><span style='visibility:hidden'>no</span>yes", "yes"),
    ("<pre>\n a\n   b\n</pre>c", " a\n   b\n\nc"), ("a  <b> b</b>\n\n <i>c </i> d", "a b c d"),
    ("<body>x</body></html></div></p>y", "x\n\ny".replace("\n\n", "\n")), ("<p>unclosed <b>bold<p>next", "unclosed bold\n\nnext"),
    ("<select><option>no</select><textarea>no</textarea><img alt='pic'><input type=submit value=Go><input value=no>", "picGo"),
    ("<dl><dt>term<dd>means<dt>two<dd>both</dl>", "term\n  means\ntwo\n  both"),
    ("<blockquote>said</blockquote>then", "  said\n\nthen"),
])
def test_render(html, text):
    assert render(html) == text


@pytest.mark.parametrize("html, text", [
    ("<div>a <svg class='icon'/>b</div>c", "a b\nc"), ("<p>a <math/>b", "a b"),
    ("<svg><path d='m0'/><g><text x=1>one <tspan>two</tspan></text></g>no<text>three</text><title>no</title></svg>d", "one two\nthree\nd"),
    ("<svg><defs><text>no</text></defs><desc>no</desc><foreignObject><p>in<p>side</foreignObject></svg>", "in\n\nside"),
    ("<svg><path d='m0'>no<p>out<svg><text/>", "out"),
    ("so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math>.", "so x=2."),
    ("<math><mfrac><mn>1</mn><mn>2</mn></mfrac><mo>+</mo><mi>y</mi></math>", "1 2 +y"),
    ("<math><mtable><mtr><mtd>a</mtd><mtd>b</mtd></mtr><mtr><mtd>c</mtd></mtr></mtable></math>", "a b\nc"),
    ("<pre>a\n<svg><text>t</text></svg></pre>", "a\nt"),
])
def test_render_drawings_and_formulas(html, text):
    assert render(html) == text


@pytest.mark.parametrize("tail, text", [
    ("<script>no</script>a<style>no</style>b", "ab"), ("a<div hidden>no<div>no</div>no</div>b", "ab"),
    ("<p hidden>no<p>a", "a"), ("a<span style='display:none'>no</b></span>b", "ab"), ("a<template>no</div>b", "a\nb"),
    ("<select><option>no<option>no</select>a<svg/>b", "ab"), ("a<svg hidden/>b", "ab"),
])
def test_hidden_elements_below_the_greatest_depth(tail, text):
    assert [x for x in render("<div>" * 300 + tail).split("\n") if x] == text.split("\n")


def test_deep_and_broken_pages_lose_no_text(spark):
    deep = "<div>" * 3000 + "core" + "</div>" * 3000 + "<b" + "<li>" * 2000 + "tail"
    assert "core" in render(deep)
    pages = spark.createDataFrame([(1, deep, "old"), (2, None, "old")], "page_id long, html string, visible_text string")
    got = {r["page_id"]: r["visible_text"] for r in extract_text(pages).collect()}
    assert "core" in got[1] and got[2] == "" and extract_text(pages.filter("false")).collect() == []


def test_archives_round_trip(spark):
    long = "<p>" + "é" * 200000
    rows = [(3, "u3", "a" * 100), (1, "u1", "a" * 100), (2, None, "a" * 99), (4, "u\r\n4 x", "a" * 99), (5, "u5", None), (6, "u6", ""), (7, "u7", long), (8, "u8", long), (8, "u8", long), (None, "u", "a" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(1)).repartition(3)
    index = write_archives(pages)
    got = read_records(index).collect()
    assert len(got) == len(rows)
    kinds = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got), key=repr)
    assert kinds == sorted([
        ("3", "revisit", "1"), ("1", "response", None), ("2", "response", None), ("4", "response", None), ("5", "response", None),
        ("6", "response", None), ("7", "response", None), ("8", "revisit", "7"), ("8", "revisit", "7"), (None, "revisit", "1"),
    ], key=repr)
    payload = {r["page_id"]: bytes(r["payload"]) for r in got if r["record_type"] == "response"}
    assert payload == {"1": b"a" * 100, "2": b"a" * 99, "4": b"a" * 99, "5": b"", "6": b"", "7": long.encode()}
    assert all(r["payload_digest"] == hashlib.sha256(payload[r["page_id"]]).hexdigest() for r in got if r["record_type"] == "response")
    assert {r["page_id"] for r in read_records(index, "url = 'u7'").collect()} == {"7"}
    assert read_records(write_archives(pages.filter("false"))).collect() == []


def test_ranges_join_near_neighbours_only():
    offsets, lengths = np.array([0, 10, 500, 520]), np.array([10, 10, 20, 10])
    assert ranges(offsets, lengths, gap=50, span=1000) == [(0, 2), (2, 4)]
    assert ranges(offsets, lengths, gap=1000, span=100) == [(0, 2), (2, 4)]
    head, body = parse_record(record("response", {"page_id": "a b", "url": "u", "payload_digest": "d", "payload": b"\r\n\r\nx"}))
    assert body == b"\r\n\r\nx" and head["WARC-Record-ID"] == "<urn:page:a%20b>"


def test_shares_and_shortages():
    assert shares(100, [1, 1, 2], [10, 1000, 1000]) == [10, 30, 60]
    assert shares(10, [1, 1, 1], [9, 9, 9]) == [4, 3, 3] and shares(5, [0, 1], [9, 3]) == [0, 3]
    weights = {("a",): 1, ("b",): 1, ("a", "x"): 1, ("a", "y"): 1, ("b", "x"): 1}
    tokens = {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 100, ("c", "x"): 100}
    assert leaf_budgets(weights, tokens, 100, 1) == {("a", "x"): 10, ("a", "y"): 40, ("b", "x"): 50}
    assert leaf_budgets(weights, tokens, 200, 1) == {("a", "x"): 10, ("a", "y"): 90, ("b", "x"): 100}
    assert leaf_budgets(weights, tokens, 10**6, 2) == {("a", "x"): 20, ("a", "y"): 200, ("b", "x"): 200}


def brute_mix(rows, weights, budget, epochs, order):
    leaves = {}
    for row in rows:
        leaf = (str(row["source"]) if row["source"] is not None else "null",)
        if weights.get(leaf, 0) > 0:
            leaves.setdefault(leaf, []).append(row)
    tokens = {p: sum(r["n"] for r in v) for p, v in leaves.items()}
    out = []
    for leaf, amount in leaf_budgets(weights, tokens, budget, epochs).items():
        total = tokens[leaf]
        whole, rest = (amount // total, amount % total) if total else (0, 0)
        run = 0
        for row in sorted(leaves[leaf], key=lambda r: (order(whole, r), r["doc_id"])):
            run += row["n"]
            copies = whole + (run <= rest)
            out += [(row["doc_id"], copies)] if copies else []
    return sorted(out)


@pytest.mark.parametrize("budget, epochs", [(300, 1), (2500, 3), (10**6, 2)])
def test_mixing(spark, budget, epochs):
    rng = np.random.default_rng(3)
    rows = [(i, ["s0", "s1", None, "other"][0 if i % 3 == 0 else i % 4], "w " * int(rng.integers(0, 20)), "c", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, copies string, vslot int").repartition(4)
    weights = {("s0",): 2.0, ("s1",): 1.0, ("null",): 1.0}
    got = mix_sources(docs, {"source": F.col("source")}, weights, queries.n_words(F.col("text")), budget=budget, epochs=epochs)
    keys = {
        (r["w"], r["doc_id"]): r["h"] for w in range(epochs + 1)
        for r in docs.select("doc_id", F.lit(w).alias("w"), F.xxhash64(F.lit(7), F.lit(w).cast("long"), F.col("doc_id").cast("string"), "text").alias("h")).collect()
    }
    unsigned = lambda x: x % (1 << 64)
    order = lambda w, r: (unsigned(keys[w, r["doc_id"]]) >> 52, keys[w, r["doc_id"]])
    plain = [{"doc_id": i, "source": s, "n": t.count("w")} for i, s, t, _, _ in rows]
    assert sorted((r["doc_id"], r["copies"]) for r in got.collect()) == brute_mix(plain, weights, budget, epochs, order)


def test_documents_of_values_without_a_name_are_mixed(spark):
    """Null and unnamed languages and sources have leaves with a weight, and count for the budget."""
    kinds = [("src0", "en"), ("src0", None), ("src0", "it"), ("src99", "en"), (None, "fr"), ("web", "de"), (None, None), ("src007", "es")]
    rows = [(i, *kinds[i % 8], "w " * (5 + i % 3)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").repartition(4)
    mix = lambda **x: mix_sources(docs, queries.source_path(), queries.source_weights(), queries.n_words(F.col("text")), **x)
    whole = mix(share=1.0, epochs=1)
    assert sorted(r["doc_id"] for r in whole.collect()) == list(range(400)) and whole.columns == [*docs.columns, "n_tokens", "copies"]
    leaves = [
        ("web", "en", "src0"), ("web", "*", "src0"), ("web", "*", "src0"), ("*", "en", "*"), ("*", "fr", "*"),
        ("*", "de", "*"), ("*", "*", "*"), ("reference", "es", "*"),
    ]
    held, size = {}, {}
    for i, _, _, text in rows:
        held[leaves[i % 8]] = held.get(leaves[i % 8], 0) + text.count("w")
        size[i] = text.count("w")
    got = {}
    for r in mix(budget=1000, epochs=1).collect():
        got[leaves[r["doc_id"] % 8]] = got.get(leaves[r["doc_id"] % 8], 0) + r["n_tokens"] * r["copies"]
    for leaf, amount in leaf_budgets(queries.source_weights(), held, 1000, 1).items():
        assert amount - max(size.values()) < got.get(leaf, 0) <= amount


def test_values_without_a_name_are_left_out_only_if_their_node_has_no_other(spark):
    docs = spark.createDataFrame([(1, "a", "w"), (2, "b", "w"), (3, None, "w")], "doc_id long, source string, text string")
    mix = lambda w: {r["doc_id"] for r in mix_sources(docs, {"source": F.col("source")}, w, queries.n_words(F.col("text"))).collect()}
    assert mix({("a",): 1.0}) == {1} and mix({("a",): 1.0, (OTHER,): 1.0}) == {1, 2, 3}
    assert mix({("a",): 1.0, ("null",): 0.0, (OTHER,): 1.0}) == {1, 2}


def test_mixing_odd_rows(spark):
    rows = [(None, "s0", None), (1, "s0", ""), (1, "s0", ""), (2, "s0", "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    tokens = queries.n_words(F.col("text"))
    got = mix_sources(docs, {"source": F.col("source")}, {("s0",): 1.0}, tokens, epochs=1)
    assert got.count() == 4 and mix_sources(docs.filter("false"), {"source": F.col("source")}, {("s0",): 1.0}, tokens).collect() == []


def test_growth_moves_slots_into_the_new_shard_only():
    before = growth_map(8)
    after = growth_map(9)
    assert all(a == b or b == 8 for a, b in zip(before, after)) and after.count(8) == 4096 // 9
    assert max(before.count(s) for s in range(8)) - min(before.count(s) for s in range(8)) <= 1


def test_rebalance_evens_out_bytes_and_moves_few_slots():
    owner = growth_map(4, 64)
    weights = {s: 100 if s < 16 else 10 for s in range(64)}
    new = rebalance(owner, weights, 4)
    load = [sum(weights[s] for s in range(64) if new[s] == k) for k in range(4)]
    assert max(load) - min(load) <= 10 and sum(a != b for a, b in zip(owner, new)) <= 16


def test_sharding(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 9) for i, t in rows], "doc_id long, text string, slot string, shard int").repartition(4)
    got = assign_shards(docs, map_version(spark, growth_map(3), 1)).collect()
    assert len(got) == len(rows)
    for shard in range(3):
        own = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert own == list(range(len(own))) and own
    for r in got:
        raw = (r["text"] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
    assert slot_bytes(assign_shards(docs, map_version(spark, growth_map(3), 1))).agg(F.sum("bytes")).first()[0] == sum(r["size"] for r in got)
    assert assign_shards(docs.filter("false"), map_version(spark, growth_map(3), 1)).collect() == []


def test_pipeline_stages_on_their_own_inputs(spark, data, tmp_path):
    docs = queries.table(spark, data, "documents")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        assert i == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        before, out = docs.collect(), spark.read.parquet(f"{tmp_path}/{i}")
        after = {r["doc_id"] for r in out.collect()}
        rows = [(r["doc_id"], r["text"]) for r in before]
        if i == 0:
            labels = {r["doc_id"]: r["quality"] for r in queries.table(spark, data, "labels").collect()}
            good = [d for d, _ in rows if labels.get(d) == 1]
            assert len(after & set(good)) >= 0.95 * len(good) and len(after) < len(rows)
        elif i == 1:
            assert after == {d for d, _, c in brute_components(rows, 5, 80, 100) if c == d}
        elif i == 2:
            items = [tuple(r) for r in queries.table(spark, data, "benchmark").collect()]
            assert after == {d for d, _, _, _, _, hit in brute_contamination(rows, items) if not hit}
        elif i == 3:
            size = {d: len((t or "").split()) for d, t in rows}
            assert 0.6 <= sum(size[d] for d in after) / sum(size.values()) <= corpus_pipeline.MIX_SHARE
        else:
            assert after == {d for d, _ in rows} and out.select("shard", "slot").distinct().count() == len(rows)
        docs = out


def test_pipeline_takes_an_empty_table(spark, data):
    docs = queries.table(spark, data, "documents").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).collect() == []


def test_library_works_without_the_subpackage(tmp_path):
    """The other queries are registered when llm and the pipeline are absent."""
    for name in ("openstat", "__spark_entry__.py"):
        os.symlink(f"{REPO}/{name}", tmp_path / name)
    code = (
        "import sys; sys.modules['openstat.llm'] = None; import __spark_entry__ as e; "
        "assert 'pipeline' not in e.queries() and len(e.queries()) > 150"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_conflicting_labels_teach_nothing(spark):
    """The same scores however the rows of labels lie."""
    docs = spark.createDataFrame([(i, ("good plain words here " if i % 2 else "## $$ !! xx ") * 5) for i in range(60)], "doc_id long, text string")
    rows = [(i, i % 2) for i in range(40)]
    conflicting = rows + [(i, 1 - i % 2) for i in range(0, 40, 4)] + rows[:9]
    clean = [(i, q) for i, q in rows if i % 4]
    want = None
    for table, parts in ((clean, 2), (conflicting, 1), (conflicting[::-1], 3), (conflicting, 7)):
        labels = spark.createDataFrame(table, "doc_id long, quality int").repartition(parts)
        got = {r["doc_id"]: r["quality_score"] for r in score_quality(docs, labels).collect()}
        want = want or got
        assert got == pytest.approx(want, abs=1e-9)
    assert want[1] > 0.5 > want[2]


def test_pooling_does_not_depend_on_chunks(monkeypatch):
    from openstat.llm import quality as q

    rng = np.random.default_rng(2)
    sizes = np.array([0, 5, 1, 400, 0, 33])
    hashes = rng.integers(0, 1 << 63, sizes.sum()).astype(np.uint64)
    hashes[50:90] = hashes[50]
    vectors = rng.normal(size=(q.ROWS, q.DIM)).astype(np.float32)
    whole = q.pooled(sizes, hashes, vectors)
    text = pa.RecordBatch.from_pydict({"text": [" ".join(f"w{i % 7}" for i in range(300)), None, "a b"]})
    counts = [b.to_pydict() for b in q._contexts(iter([text]))]
    monkeypatch.setattr(q, "CHUNK", 7)
    assert np.allclose(q.pooled(sizes, hashes, vectors), whole, atol=1e-9)
    assert [b.to_pydict() for b in q._contexts(iter([text]))] == counts
    assert (whole[[0, 4]] == 0).all()


def test_urls_come_back_unchanged(spark):
    urls = ["http://a/b  c\td", None, "", "http://ü/ß?q=%20+x", "a\r\nWARC-Type: x", "http://plain/x?a=b&c#d", " lead"]
    pages = spark.createDataFrame([(i, u, "x" * 150 if i % 2 else f"p{i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    index = write_archives(pages)
    assert index.select("store").first()[0].startswith("file:///")
    got = {int(r["page_id"]): r for r in read_records(index).collect()}
    assert {i: r["url"] for i, r in got.items()} == dict(enumerate(urls))
    assert {i: r["payload_bytes"] for i, r in got.items()} == {i: 150 if i % 2 else 2 for i in range(len(urls))}
    assert [r["record_type"] for _, r in sorted(got.items())] == ["response", "response", "response", "revisit", "response", "revisit", "response"]


def test_slot_maps_are_stored_by_version(spark):
    maps = SlotMaps.create(spark).publish(growth_map(2), 1)
    docs = spark.createDataFrame([(i, "x" * (5000 if i == 3 else 10)) for i in range(200)], "doc_id long, text string")
    weights = slot_weights(docs)
    assert sum(weights.values()) == 199 * 11 + 5001
    maps.publish(rebalance(maps.owner(), weights, 2), 2)
    again = SlotMaps(spark, maps.path)
    assert again.owner(1) == growth_map(2) and again.owner() == again.owner(2) != again.owner(1)
    load = {r["shard"]: r["s"] for r in assign_shards(docs, again.read()).groupBy("shard").agg(F.sum("size").alias("s")).collect()}
    assert abs(load[0] - load[1]) <= 5001
    with pytest.raises(Exception, match="(?i)exist"):
        maps.publish(growth_map(2), 2)


def test_query_of_sharding_equals_plain_python(spark, tmp_path):
    import xxhash

    rows = [(i * 13, None if i % 11 == 0 else "é" * (i % 50), "first") for i in range(3000)] + [(26, "again", "x"), (None, "n", "x"), (None, None, "y")]
    spark.createDataFrame(rows, "doc_id long, text string, _first string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op9_sharding"](spark, str(tmp_path)).collect()
    eight, nine = growth_map(8), growth_map(9)
    want = []
    for i, t, _ in rows:
        raw = (t or "").encode()
        hashed = 42 if i is None else xxhash.xxh64_intdigest(str(i).encode(), seed=42)
        slot = (hashed - (1 << 64) if hashed >> 63 else hashed) % 4096
        want.append((i, len(raw) + 1, zlib.crc32(raw), "key", eight[slot], nine[slot]))
    key = lambda r: tuple(repr(x) for x in r)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got), key=key) == sorted(want, key=key)
    assert all(w[5] in (w[4], 8) for w in want)
    for shard in range(8):
        own = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert own == list(range(len(own)))


@pytest.mark.parametrize("html, text", [
    ("a<textarea>\n x  y\nz</textarea>b", "a\n x  y\nz\nb"),
    ("<select><option>one<option selected>two<option>three</select> end", "two end"),
    ("<select><optgroup label=g><option>one</optgroup><option>two</select>", "one"),
    ("<select multiple><option>one<option>two</select>", "one two"),
    ("<input value=typed> <input type=password value=secret><input type=hidden value=h>", "typed"),
    ("<object data=x>instead</object>", "instead"),
    ("<div style='visibility:hidden'>no<p style='visibility: visible'>yes<b>too</b></p>no</div>", "yestoo"),
    ("<div style='visibility:hidden'><span style='visibility:visible;display:none'>no</span></div>x", "x"),
    ("<ul style='visibility:hidden'><li>no<li style='visibility:visible'>yes</ul>", "- yes"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tr><td>a<td rowspan=3 colspan=2>b<td>c<tr><td>d<td>e<tr><td>f</table>", "a  b    c\nd       e\nf"),
    ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
    ("<ol><li>a<li value=9>b<li>c</ol>", "1. a\n9. b\n10. c"),
    ("<details><summary>head</summary>body</details>x", "head\nx"),
    ("<details open><summary>head</summary>body</details>", "head\nbody"),
    ("<ruby>k<rp>(</rp><rt>r</rt><rp>)</rp></ruby>", "kr"),
])
def test_visible_text_of_fields_cells_and_details(html, text):
    assert render(html, fields=True) == text
