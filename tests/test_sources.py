import json

import pytest
from pyspark.sql import functions as F

from openstat.functions import text
from openstat.operators import curation, metrics
from openstat.sources import catalog_sync, paging, probe, scan


def _write(path, payload):
    path.write_text(json.dumps(payload), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("n", [2, 401, 2000])
def test_late_keys_are_kept(spark, tmp_path, n):
    rows = [{"id": i, "name": f"n{i}"} for i in range(n)]
    rows[-1]["boro"] = "X"
    df = scan.read_records(spark, _write(tmp_path / "r.json", rows))
    assert set(df.columns) == {"id", "name", "boro"} and df.where("boro is not null").count() == 1 and df.count() == n


def test_json_shapes(spark, tmp_path):
    envelope = scan.read_records(spark, _write(tmp_path / "e.json", [{"total": 2}, [{"a": 1}, {"a": 2, "b": "x"}]]))
    assert set(envelope.columns) == {"a", "b"} and envelope.count() == 2
    assert scan.read_records(spark, _write(tmp_path / "o.json", {"a": 1, "b": 2})).count() == 1
    assert scan.read_records(spark, _write(tmp_path / "z.json", [])).columns == ["placeholder"]
    with pytest.raises(ValueError):
        scan.read_records(spark, _write(tmp_path / "s.json", "text"))


def test_indicator_fallbacks(spark):
    rows = [
        {"indicator": {"id": "I", "value": "Pop"}, "country": {"id": "KE", "value": "Kenya"}, "countryiso3code": "KEN", "date": "2020", "value": 1.5},
        {"indicator": {"id": "I", "value": ""}, "country": {"id": "ZZ", "value": None}, "countryiso3code": "", "date": "2021", "value": {"value": 2}},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string")
    got = [tuple(r) for r in scan.flatten_indicator(df, "j").collect()]
    assert got == [("KEN", "Kenya", "I", "Pop", "2020", 1.5), ("ZZ", "ZZ", "I", "I", "2021", 2.0)]


def test_observations_drop_bad_values(spark):
    payload = json.dumps({"observations": [{"date": "a", "value": v} for v in ("1.5", ".", "", None, "x", "2")]})
    df = spark.createDataFrame([(payload, "fred:GDP", "")], "j string, rid string, url string")
    assert [(r.value, r.series_id) for r in scan.flatten_observations(df, "j", F.col("rid"), F.col("url")).collect()] == [(1.5, "GDP"), (2.0, "GDP")]


_CSV = "name,amount\n" + "\n".join(f"a{i},{i}" for i in range(25))
_ROWS = [{"name": f"a{i}", "amount": i} for i in range(25)]


@pytest.mark.parametrize(
    "payload, ingestible, fmt, reason",
    [
        ("", False, "EMPTY", "empty file"),
        ("  <!DOCTYPE html><html>", False, "HTML", "HTML page, not a data file"),
        ("PK\x03\x04zip", False, "ZIP", "ZIP archive — unpack not supported yet"),
        (_CSV, True, "CSV", "CSV tabular file"),
        ("name,amount\na,1\n", False, None, "CSV sample has 1 row(s) — need at least 20"),
        ("column1,column2,name\n" + "1,2,3\n" * 30, False, "CSV", None),
        (json.dumps(_ROWS), True, "JSON_RECORDS", "flat JSON records"),
        (json.dumps([{"total": 25}, _ROWS]), True, "JSON_WORLDBANK", "flat JSON records"),
        (json.dumps([{"a": {"b": 1}, "c": 2}] * 30), False, "JSON_NESTED", "nested JSON objects need a source adapter"),
        (json.dumps([{"indicator": {"id": 1}, "c": 2}] * 30), True, "JSON_WORLDBANK", "nested JSON — flattened on ingest"),
        (json.dumps({"type": "FeatureCollection", "features": []}), False, "GEOJSON", "GeoJSON not supported yet"),
        ("[1, 2, 3]", False, "JSON_NESTED", "JSON rows are not objects"),
        ("{broken", False, "JSON_INVALID", "invalid JSON"),
        ("plain words", False, "UNKNOWN", "unsupported or unrecognized format"),
    ],
)
def test_probe_verdicts(spark, payload, ingestible, fmt, reason):
    df = spark.createDataFrame([(payload, "https://example.org/x")], "p string, u string")
    r = probe.probe_payloads(df, "p", "u").first()
    assert (r.ingestible, r.detected_format) == (ingestible, fmt)
    assert reason is None or r.reason == reason


def test_chunks_stop_at_the_first_bad_one(spark):
    rows = spark.createDataFrame([(c, p) for c in (0, 1, 3) for p in range(3)], "chunk int, pos int")
    chunks = spark.createDataFrame([(c, True) for c in range(5)], "chunk int, ok boolean")
    assert paging.assemble_chunks(rows, chunks).count() == 6
    assert paging.assemble_chunks(rows, chunks, 4).count() == 4
    assert paging.assemble_chunks(rows, chunks.withColumn("ok", F.col("chunk") > 0)).count() == 0


def test_bytes_trim_keeps_the_longest_prefix(spark):
    rows = [{"i": i, "t": "é" * (i % 9)} for i in range(200)]
    df = spark.createDataFrame([(r["i"], r["t"]) for r in rows], "i long, t string")
    for cap in (2, 50, 1000, 10**6):
        n = 0
        while n < len(rows) and len(json.dumps(rows[: n + 1], separators=(",", ":"), ensure_ascii=False).encode()) <= cap:
            n += 1
        assert abs(paging.trim_to_bytes(df, "i", cap).count() - n) <= 0


@pytest.mark.parametrize("tail", ["", "a", "é", "漢", "𝄞"])
def test_byte_cut_never_splits_a_character(spark, tail):
    for lead in range(2490, 2501):
        s = "x" * lead + tail * 20
        want = s if len(s.encode()) <= 2500 else s.encode()[:2500].decode("utf-8", errors="ignore").rstrip()
        got = spark.createDataFrame([(s,)], "s string").select(text.cut_bytes(F.col("s"), 2500)).first()[0]
        assert got == want


def test_numbers_must_be_grounded(spark):
    df = spark.createDataFrame(
        [("r is 0.42, that is 42 percent of 1,234 rows", [0.42, 1234.0]), ("grew by 77 percent", [0.5]), ("no digits", [])],
        "s string, a array<double>",
    )
    assert [r[0] for r in df.select(text.numbers_grounded(F.col("s"), F.col("a"))).collect()] == [True, False, True]


@pytest.mark.parametrize("seed", range(4))
def test_spanning_families_follow_the_plain_walk(spark, seed):
    import random

    rnd = random.Random(seed)
    rows = [(i, str(rnd.randrange(25)), rnd.choice("abcdef"), i, rnd.random() < 0.05) for i in range(300)]
    families, topics, kept = {}, {}, set()
    for i, f, t, _, curated in sorted(rows, key=lambda r: (not r[4], r[3])):
        if curated or (families.get(f, 0) < 2 and topics.get(t, 0) < 6):
            kept.add(i)
            families[f] = families.get(f, 0) + 1
            topics[t] = topics.get(t, 0) + 1
    df = spark.createDataFrame(rows, "id long, family string, topic string, seq long, curated boolean")
    assert {r.id for r in curation.diversity_caps(df, 2, 6).collect()} == kept


def test_visit_metrics(spark):
    rows = [("u1", "/", "2026-06-01 03:30:00"), ("u1", "/a", "2026-06-01 12:00:00"), ("u2", "/", "2026-06-02 12:00:00")]
    v = spark.createDataFrame(rows, "visitor_id string, path string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    cutoff = F.lit("2026-06-01 00:00:00").cast("timestamp")
    r = metrics.visitor_totals(v, cutoff).first()
    assert (r.total_page_views, r.unique_visitors_all_time, r.page_views_in_window) == (3, 2, 3)
    days = {x.day: (x.visitors, x.page_views) for x in metrics.daily_visitors(v, cutoff).collect()}
    assert days == {"2026-05-31": (1, 1), "2026-06-01": (1, 1), "2026-06-02": (1, 1)}


def test_streams_read_a_folder_of_parts_as_they_read_a_file(spark, data, tmp_path):
    from openstat.streaming.visits import stream_table

    whole = spark.read.parquet(f"{data}/events.parquet")
    whole.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for folder in (data, str(tmp_path)):
        run = stream_table(spark, folder, "events").writeStream.format("memory").queryName("seen").trigger(availableNow=True)
        run.option("checkpointLocation", f"{tmp_path}/{'a' if folder == data else 'b'}").start().awaitTermination()
        assert spark.table("seen").count() == whole.count()


def test_places_that_repeat_are_one_card(spark):
    from openstat.operators.places import search_places

    rows = [(1 if i < 50 else i, f"n{0 if i < 50 else i}", "cafe", "b", "s", "A", "x") for i in range(60)]
    places = spark.createDataFrame(rows, "id int, name string, category string, borough string, street string, grade string, address string")
    assert search_places(places, category="cafe").count() == 8


def test_bar_chart_counts_all_groups(spark):
    from openstat.operators.charts import bar_rows

    rows = bar_rows(spark.range(1000).selectExpr("id AS g", "id * 1.0D AS v"), "v", "g").collect()
    assert len(rows) == 10 and {r["total"] for r in rows} == {1000}


def test_records_of_mixed_shapes(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    _write(folder / "a.json", [{"a": 1}, {"a": 2, "b": "x"}])
    _write(folder / "b.json", [{"total": 1}, [{"a": 3, "c": True}]])
    _write(folder / "c.json", {"a": 4})
    _write(folder / "d.json", [{"total": 0}, []])
    rows = scan.read_records(spark, str(folder)).collect()
    assert sorted((r.a, r.b, r.c) for r in rows) == [(1, None, None), (2, "x", None), (3, None, True), (4, None, None)]
    empty = scan.read_records(spark, _write(tmp_path / "m.json", [{"total": 0}, []]))
    assert empty.columns == ["placeholder"] and empty.count() == 0


def test_diversity_caps_with_one_hot_topic_and_null_keys(spark):
    rows = [
        (i, None if i % 11 == 0 else f"f{i % 37}", "hot" if i % 10 else (None if i % 20 else f"t{i % 7}"), i, i % 53 == 0)
        for i in range(600)
    ]
    families, topics, kept = {}, {}, set()
    for i, f, t, _, curated in sorted(rows, key=lambda r: (not r[4], r[3])):
        if curated or (families.get(f, 0) < 2 and topics.get(t, 0) < 9):
            kept.add(i)
            families[f], topics[t] = families.get(f, 0) + 1, topics.get(t, 0) + 1
    df = spark.createDataFrame(rows, "id int, family string, topic string, seq int, curated boolean")
    assert {r.id for r in curation.diversity_caps(df, 2, 9).collect()} == kept


def test_unfinished_pass_prunes_nothing(spark):
    catalog = spark.createDataFrame([("a", "p"), ("b", "p")], "id string, portal string")
    seen = spark.createDataFrame([("a",)], "id string")
    assert catalog_sync.prune_stale(catalog, seen, "p").count() == 1
    assert catalog_sync.prune_stale(catalog, seen, "p", hit_cap=True).count() == 2


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_byte_cap_cuts_where_a_running_sum_does(spark, kind):
    def near(i):  # many close values, some far off
        return -(2**40) + i if i < 300 else 3**(i - 290) - 7

    whole = [(near(i), "x" * (i * 37 % 90), None if i % 5 else "é") for i in range(320)]
    df = spark.createDataFrame(whole, "at bigint, s string, `a.b` string").withColumn("at", F.col("at").cast(kind))
    df = df.unionByName(df.limit(1).withColumn("at", F.lit(None).cast(kind))).repartition(3).cache()
    sizes = {r[0]: r[1] for r in df.select("at", paging.row_bytes(["at", "s", "`a.b`"])).collect()}
    ordered = sorted(v for v in sizes if v is not None)
    for cap in (0, 1, sizes[ordered[0]], sizes[ordered[0]] + 1, 5_000, 19_000, 10**6):
        expected, spent = [], 1
        for value in ordered:
            spent += sizes[value]
            if spent > cap:
                break
            expected.append(value)
        got = paging.trim_to_bytes(df, "at", cap, ranges=4, few=5)
        assert sorted(r["at"] for r in got.collect()) == expected
    assert paging.trim_to_bytes(df.where("at > 1e300"), "at", 100).count() == 0


def test_byte_cap_is_a_pushed_filter(spark, tmp_path):
    spark.range(5000).withColumn("s", F.repeat(F.lit("y"), 30)).write.parquet(f"{tmp_path}/t")
    cut = paging.trim_to_bytes(spark.read.parquet(f"{tmp_path}/t"), "id", 2_000)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "LessThan" in plan and "Window" not in plan and "Join" not in plan and "Exchange" not in plan
    assert 0 < cut.count() < 100


def test_probe_parses_a_payload_once_for_each_part(spark):
    rows = spark.range(40).select(F.concat(F.lit('{"a": '), F.col("id"), F.lit("}")).alias("p"), F.lit("https://example.org/x").alias("u"))
    plan = probe.probe_payloads(rows, "p", "u").groupBy("reason", "ingestible", "detected_format").count()._jdf.queryExecution().optimizedPlan().toString()
    counts = {name: plan.count(f"{name}(") for name in ("parseJson", "jsonObjectKeys", "from_json", "regexp_extract_all")}
    assert set(counts.values()) == {1} and plan.count("get_json_object(") == 4, plan
