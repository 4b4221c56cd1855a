"""Which tests to run on which table: rules over column names and kinds only."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from openstat import rules
from openstat.operators.profile import TableProfile, pick_by_name, preferred_geo
from openstat.operators.relevance import redundant_geo


@dataclass
class TestPlan:
    __test__ = False
    kind: str
    columns: list[str]
    tier: str = "primary"
    primary: bool = False


@dataclass
class TablePlans:
    plans: list[TestPlan] = field(default_factory=list)


def analysis_mode(datasets: int) -> str:
    return "compare" if datasets == 2 else "explore"


def tables_to_test(mode: str, tables: list, joined=None) -> list:
    """Explore: the first table. Compare: the joined table, or both when the join failed."""
    if mode == "explore":
        return tables[:1]
    return list(tables) if joined is None else [joined]


@dataclass(frozen=True)
class PlanLimits:
    """How many columns of a kind enter the plans of a table, and how many plans it gets."""

    correlated: int = 12
    modeled: int = 8
    factors: int = 6
    grouped: int = 8
    times: int = 2
    trended: int = 4
    plans: int = rules.MAX_PLANS


def left_out(profile: TableProfile, limits: PlanLimits, joined: bool = False) -> list[str]:
    """What the limits keep from a table's tests and models, in words."""
    n = {kind: len(profile.of_kind(kind)) for kind in ("numeric", "categorical", "datetime")}
    uses = [
        ("numeric", limits.correlated, "correlated"), ("numeric", limits.modeled, "modeled"),
        ("numeric", limits.grouped, "compared by group"), ("numeric", limits.trended, "tested for a trend"),
        ("categorical", limits.factors, "used as groups"), ("datetime", limits.times, "used as times"),
    ]
    notes = [f"{profile.title}: {limit} of {n[kind]} {kind} columns are {use}" for kind, limit, use in uses if n[kind] > limit]
    everything = replace(limits, plans=1 << 30)
    planned = plan_rows(SparkSession.active(), profile, joined, everything).count()
    return notes + ([f"{profile.title}: {limits.plans} of {planned} planned tests are run"] if planned > limits.plans else [])


def plan_rows(spark: SparkSession, profile: TableProfile, joined: bool = False,
              limits: PlanLimits = PlanLimits()) -> DataFrame:
    """(position, kind, columns, tier, primary): the planned tests of one table, in run order.

    Each kind of test is one rule over the column metadata; a joined table with two
    measures leaves its own geography out, and a panel's own pair comes first.
    """
    measures = profile.of_kind("numeric")
    cross = joined and len(measures) >= 2
    fields = spark.createDataFrame(
        [(kind, i, name) for kind in ("numeric", "datetime", "categorical") for i, name in enumerate(profile.of_kind(kind))],
        "kind string, position int, name string",
    ).coalesce(1)  # a few names

    def each(measure_limit: int, others: DataFrame, stage: int, kind: str, tier: str) -> DataFrame:
        """One plan per (measure, other column); the few measures are an array on each other column."""
        return others.select("nth", F.posexplode(F.lit(measures[:measure_limit]).cast("array<string>")).alias("at", "measure"), "name").select(
            F.array(F.lit(stage), F.col("nth"), F.col("at")).alias("order"), F.lit(kind).alias("kind"),
            F.array("measure", "name").alias("columns"), F.lit(tier).alias("tier"), F.lit(False).alias("primary"),
        )

    def together(some: DataFrame, stage: int, kind: str, primary: bool) -> DataFrame:
        """One plan over all given columns, if there are two."""
        listed = F.array_sort(F.collect_list(F.struct("position", "name")))["name"]
        return some.agg(listed.alias("columns")).where(F.size("columns") >= 2).select(
            F.array(F.lit(stage), F.lit(0), F.lit(0)).alias("order"), F.lit(kind).alias("kind"),
            "columns", F.lit("primary").alias("tier"), F.lit(primary).alias("primary"),
        )

    nth = F.row_number().over(W.orderBy("position"))
    factors = redundant_geo(fields.where("kind = 'categorical'")).where("keep").withColumn("nth", nth)
    grouped = factors.where(F.col("nth") <= limits.factors)
    if cross:
        grouped = grouped.where(~F.lower("name").isin(*rules.GEO_COLUMNS))
    times = fields.where("kind = 'datetime'").withColumn("nth", nth).where(F.col("nth") <= limits.times)
    plans = (
        together(fields.where((F.col("kind") == "numeric") & (F.col("position") < limits.correlated)), 1, "correlation", cross)
        .unionByName(each(limits.grouped, grouped, 2, "group_comparison", "primary"))
        .unionByName(together(factors.where("nth <= 2"), 3, "chi_square", False))
        .unionByName(each(limits.trended, times, 4, "trend", "derived" if profile.is_panel else "primary"))
    )
    pair = [pick_by_name(measures, rules.PREFERRED_MEASURE), preferred_geo(profile.of_kind("categorical"))]
    if profile.is_panel and not cross and all(pair):
        lead = spark.createDataFrame(
            [([0, 0, 0], "group_comparison", pair, "primary", False)],
            "order array<int>, kind string, columns array<string>, tier string, primary boolean",
        )
        plans = plans.unionByName(lead)
    once = plans.groupBy("kind", "columns", "tier", "primary").agg(F.max("order").alias("order"))
    position = F.row_number().over(W.orderBy("order")) - 1
    return once.select(position.alias("position"), "kind", "columns", "tier", "primary").where(F.col("position") < limits.plans)


def plan_tests(profile: TableProfile, joined: bool = False, limits: PlanLimits = PlanLimits()) -> TablePlans:
    """The planned tests as a list: metadata of at most `limits.plans` rows."""
    rows = plan_rows(SparkSession.active(), profile, joined, limits).orderBy("position").collect()
    return TablePlans([TestPlan(r["kind"], list(r["columns"]), r["tier"], r["primary"]) for r in rows])


#: fixed values: method names in the order they are reported
METHOD_LABELS = {
    "correlation": "Spearman correlation",
    "group_comparison": "Group comparison",
    "chi_square": "Chi-square test",
    "trend": "Time trend",
}
MODEL_LABELS = (
    "K-means clustering", "DBSCAN clustering", "PCA structure", "Anomaly detection",
    "Local outlier detection",
)


def methods_run(plans: list[TestPlan], mode: str, models: bool) -> list[str]:
    """Unique labels of the planned methods in run order."""
    labels = ["Harmonized cross-dataset correlation"] if mode == "compare" else []
    labels += [METHOD_LABELS[p.kind] for p in plans if p.tier != "derived"]
    if any(p.tier == "derived" and p.kind == "trend" for p in plans):
        labels.append("Year/time averages")
    if models:
        labels += MODEL_LABELS
    return list(dict.fromkeys(labels))
