from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from openstat.operators import coerce, filters, joins, profile, relevance, sampling
from openstat.plans import selection
from openstat.plans.analysis import analyze, profile_table, report_rows
from openstat.sources import sinks


def test_validation_floor(spark):
    small = spark.createDataFrame([(1, "a")], "x int, y string")
    r = profile.validate_table(small).first()
    assert not r.ok and "only 1 row" in r.reason
    three = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "x int, y string")
    assert profile.validate_table(three, 2).first().ok
    empty = spark.createDataFrame([(None, None)] * 25, "x int, y string")
    assert profile.validate_table(empty).first().reason == "All columns are empty"


def test_coercion_needs_half_the_rows(spark):
    rows = [(str(i), "n/a" if i % 3 else str(i), f"{1 + i % 12}/{1 + i % 28}/2020", str(1990 + i % 9), (str(i), 7.5)) for i in range(30)]
    df = spark.createDataFrame(rows, "num string, mostly_text string, day string, year string, cell struct<value:string,note:double>")
    types = {f.name: f.dataType.simpleString() for f in coerce.coerce(df).schema.fields}
    assert types == {"num": "double", "mostly_text": "string", "day": "timestamp", "year": "timestamp", "cell": "double"}


def test_kinds_of_a_country_panel(spark):
    rows = [(c, "IND.X", "Population", str(2000 + y), float(y * k)) for k, c in enumerate(["AAA", "BBB", "CCC"], 1) for y in range(12)]
    df = coerce.coerce(spark.createDataFrame(rows, "countryiso3code string, indicator_id string, indicator string, date string, value double"))
    p = profile_table(df, "Panel", "wb")
    assert {c["name"]: c["kind"] for c in p.columns} == {
        "countryiso3code": "categorical", "indicator_id": "other", "indicator": "other", "date": "datetime", "value": "numeric",
    }
    assert p.is_panel
    plans = selection.plan_tests(p).plans
    assert any(x.kind == "trend" and x.tier == "derived" for x in plans)
    labels = profile.measure_labels(df, ["value"], "Title").first()
    assert labels.label == "Population" and labels.source == "indicator_column"


def test_filter_guard():
    assert filters.filter_is_safe("borough = 'X' AND n >= 3")
    for bad in ("1=1; drop table x", "x -- y", "f(x) = 1", 'a = "b"', "a != 1"):
        assert not filters.filter_is_safe(bad)


def test_questions_cannot_reach_other_tables(spark):
    one = spark.range(40).withColumn("g", F.col("id") % 3)
    tables = {"analysis_0": one, "raw_0": one}
    assert filters.ask(tables, "SELECT id FROM analysis_0 LIMIT 500").count() == 25
    one.createOrReplaceTempView("raw_0")
    for sql in (
        "SELECT * FROM raw_0", "SELECT * FROM analysis_0, raw_0", "DELETE FROM analysis_0", "SELECT 1",
        "SELECT * FROM analysis_0; SELECT 1", "SELECT * FROM analysis_0 -- x", "SELECT * FROM analysis_0, parquet.`/tmp/x`",
    ):
        with pytest.raises(ValueError):
            filters.ask(tables, sql)
    spark.catalog.dropTempView("raw_0")


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(50_000).withColumn("same", F.lit(1))
    a = sampling.sample_rows(df, 1234).orderBy("id").collect()
    b = sampling.sample_rows(df.repartition(13), 1234).orderBy("id").collect()
    assert len(a) == 1234 and a == b
    copies = spark.range(30_000).select(F.lit("copy").alias("x"))
    assert sampling.sample_rows(copies, 777).count() == 777


@pytest.mark.parametrize(
    "left, right, ok, matched",
    [
        ([("a", 1), ("a", 2)], [("a", 3), ("a", 4)], False, 0),
        ([("a", i) for i in range(8)], [("a", 9)], True, 8),
        ([("a", 1)], [("b", 1)], False, 0),
    ],
)
def test_join_assessment(spark, left, right, ok, matched):
    l, r = (spark.createDataFrame(x, "k string, v int") for x in (left, right))
    row = joins.assess_join(l, r, [("k", "k")]).first()
    assert (row.ok, row.matched_rows) == (ok, matched)


def test_composite_key_wins_over_unsafe_single_keys(spark):
    rows = [(c, y, float(y)) for c in "ABCDE" for y in (2020, 2021)]
    l = spark.createDataFrame(rows, "country string, year int, v double")
    r = spark.createDataFrame([(c, y, v * 10) for c, y, v in rows], "country string, year int, v double")
    best = joins.select_join(joins.suggest_joins(l, r)).first()
    assert best.left_keys == ["country", "year"] and best.matched_rows == 10 and best.auto_recommended
    joined = joins.join_tables(l, r, [("country", "country"), ("year", "year")])
    assert joined.columns == ["country", "year", "v", "v_1"] and joined.count() == 10


@pytest.mark.parametrize("whole", [True, False])
def test_all_candidates_are_scored_from_one_scan_per_table(spark, tmp_path, whole):
    schema = "id int, code string, at timestamp, x double, ratio double"
    stamp = [datetime(2024, 1, 1 + i % 5, i % 24) for i in range(60)]
    l = [(i % 20, f"c{i % 7}" if i % 9 else None, stamp[i], -0.0 if i % 2 else 0.0, i / 4) for i in range(60)]
    r = [(i, f"c{i}", stamp[i], 0.0, float(i % 3)) for i in range(30)] + [(None, None, None, None, None)] * 3
    spark.createDataFrame(l, schema).write.parquet(f"{tmp_path}/l")
    spark.createDataFrame(r, schema.replace("id int", "id bigint")).write.parquet(f"{tmp_path}/r")
    left, right = spark.read.parquet(f"{tmp_path}/l"), spark.read.parquet(f"{tmp_path}/r")
    names = ["id", "code", "at", "x", "ratio"]
    if whole:
        candidates = [[("at", "at")], [("id", "id")], [("id", "id"), ("at", "at")]]
    else:
        candidates = [[(n, n)] for n in names] + [
            [("id", "ratio")], [("id", "id"), ("code", "code")], [("at", "at"), ("id", "id"), ("x", "x")],
        ]
    scored = joins.assess_joins(left, right, candidates)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2
    got = {row.position: row for row in scored.collect()}
    assert sorted(got) == list(range(len(candidates)))
    for i, pairs in enumerate(candidates):
        one = joins.assess_join(left, right, pairs).first().asDict()
        assert {k: v for k, v in got[i].asDict().items() if k != "position"} == one, pairs
        keys = [
            Counter(tuple(row[names.index(p[side])] for p in pairs) for row in rows)
            for side, rows in enumerate((l, r))
        ]
        whole = sum(n * keys[1][k] for k, n in keys[0].items() if None not in k)
        repeats = max(keys[0].values()) > 1 and max(keys[1].values()) > 1
        assert got[i].matched_rows == (0 if repeats else whole)


def test_candidates_of_an_empty_table_have_no_rows(spark):
    l = spark.createDataFrame([], "id int, code string")
    r = spark.createDataFrame([(1, "a")], "id int, code string")
    rows = joins.assess_joins(l, r, [[("id", "id")], [("code", "code")]]).collect()
    assert [(x.position, x.ok, x.matched_rows, x.overlap_left, x.overlap_right) for x in rows] == [
        (0, False, 0, 0.0, 0.0), (1, False, 0, 0.0, 0.0)
    ]
    assert joins.suggest_joins(l, r).where("ok").count() == 0


def test_null_keys_count_but_never_match(spark):
    l = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    r = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, v int")
    row = joins.key_overlap(l, r, [("k", "k")]).first()
    assert (row.overlap_left, row.overlap_right) == (0.5, pytest.approx(1 / 3))


def test_aggregates_are_not_entities(spark):
    df = spark.createDataFrame([("Kenya",), ("World",), ("Euro area",), (" ",), ("USA",)], "n string")
    got = [r[0] for r in df.select(joins.entity_id(F.col("n"), "name")).collect()]
    assert got == ["kenya", None, None, None, "usa"]


@pytest.mark.parametrize(
    "name, kind, category",
    [
        ("borough", "categorical", "geographic"), ("latitude", "numeric", "metadata"), (":id", "other", "metadata"),
        ("unique_key", "numeric", "administrative_identifier"), ("created_date", "datetime", "temporal"),
        ("complaint_type", "categorical", "core_analytical"), ("price", "numeric", "numeric_measure"),
    ],
)
def test_field_categories(spark, name, kind, category):
    df = spark.createDataFrame([(0, name, kind, 5)], "position int, name string, kind string, nunique long")
    flagged = relevance.with_name_flags(df)
    assert flagged.select(relevance.field_category(F.col("kind"), F.col("nunique"))).first()[0] == category


def test_ids_are_relaxed_when_nothing_else_is_left(spark):
    df = spark.createDataFrame([(0, "record_id", "numeric", 9), (1, ":id", "numeric", 9)], "position int, name string, kind string, nunique long")
    rows = {r.name: (r.include, r.score) for r in relevance.rank_fields(df).collect()}
    assert rows == {"record_id": (True, 50), ":id": (False, 5)}


def test_whole_analysis_of_one_table(spark, tmp_path):
    rows = [("CA" if i % 2 else "NY", float(i % 2) * 50 + i % 7, 2000 + i % 20) for i in range(80)]
    result = analyze([spark.createDataFrame(rows, "state string, value double, year int")], ["States"], ["s"], models=False)
    top = result.display.collect()
    assert top and top[0]["type"] == "group_comparison" and result.mode == "explore"
    sinks.write_results({"findings": result.findings, "report": report_rows(result)}, str(tmp_path))
    assert sinks.read_results(spark, str(tmp_path), "findings").count() == result.findings.count()


def test_whole_analysis_of_two_panels(spark):
    def panel(name, f):
        rows = [(c, str(2000 + y), name, f(k, y)) for k, c in enumerate(["AAA", "BBB", "CCC"], 1) for y in range(8)]
        return spark.createDataFrame(rows, "countryiso3code string, date string, indicator string, value double")

    result = analyze(
        [panel("Income", lambda k, y: k * 10.0 + y), panel("Mortality", lambda k, y: 200.0 - k * 10.0 - y)],
        ["Income", "Mortality"], ["a", "b"], models=False,
    )
    lead = result.display.orderBy("display_order").first()
    assert lead["type"] == "spearman_correlation" and lead["value"] < -0.9
    cross = result.join_report["cross_measure"]
    assert cross["success"] and cross["strategy"] == "iso3_year" and cross["matched_pairs"] == 24
    assert any(r["kind"] == "verdict" and "opposite" in r["text"] for r in result.summary.collect())


def test_too_small_a_table_is_refused(spark):
    with pytest.raises(ValueError, match="only 3 row"):
        analyze([spark.createDataFrame([(1, "a")] * 3, "x int, y string")])


def test_constants_per_group_and_over_all_rows(spark):
    rows = [("a", " x ", 1), ("a", "x", 2), ("b", "x", 3), ("b", "", 3), ("b", None, 3), (None, "y", 4), (None, "z", 4)]
    df = spark.createDataFrame(rows, "g string, s string, n int")
    got = {(r.g, r["name"]): r.constant for r in profile.constant_values(df, ["s", "n"], by=["g"]).collect()}
    assert got == {("a", "s"): "x", ("a", "n"): None, ("b", "s"): "x", ("b", "n"): "3", (None, "s"): None, (None, "n"): "4"}
    assert {r["name"]: r.constant for r in profile.constant_values(df).collect()} == {"g": None, "s": None, "n": None}
    assert profile.constant_values(df, ["none"], by=["g"]).count() == 0
