"""Plans and values where one key holds a third of all rows."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lateline import fixed_values as fv
from lateline.operators import team
from lateline.operators.labels import delay_label
from lateline.operators.reports import high_risk_digest
from lateline.operators.sentiment import sentiment_series
from lateline.operators.quality import quality_report
from lateline.sources.staging import settle, shared_dir

ROWS = 60_000

SHUFFLED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def small_limits(spark):
    for name, value in SHUFFLED.items():
        spark.conf.set(name, value)
    yield
    for name in SHUFFLED:
        spark.conf.unset(name)


@pytest.fixture(scope="module")
def hot(spark):
    """One project, and one assignee, hold a third of the tickets; another third is nobody's."""
    i = F.col("id")
    return settle(
        spark.range(ROWS, numPartitions=8).select(
            F.concat(F.lit("K-"), i.cast("string")).alias("issue_key"),
            F.when(i % 3 == 0, "HOT").otherwise(F.concat(F.lit("P"), (i % 997).cast("string"))).alias("project_key"),
            F.when(i % 3 == 0, "busy").when(i % 3 == 1, F.concat(F.lit("dev"), (i % 1009).cast("string"))).alias("assignee"),
            (i % 8).cast("double").alias("story_points"),
            F.when(i % 2 == 0, "In Progress").otherwise("Done").alias("status_category"),
            (i % 50).cast("double").alias("days_in_status"),
            F.lit(0).cast("long").alias("sprint_rollover_count"),
            F.lit(None).cast("timestamp").alias("resolution_date"),
            F.lit(None).cast("timestamp").alias("due_date"),
        )
    )


def test_hot_keys_are_dealt_to_many_tasks(spark, hot, small_limits):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    joined = team.merge_sentiment(hot, hot.limit(0).selectExpr("project_key", "'' AS window_start", "0.0D AS avg_sentiment"))
    sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == ROWS and max(sizes) < ROWS / 3
    joined = team.team_features(hot)
    row = joined.where("project_key = 'HOT'").agg(F.count("*").alias("n"), F.max("assignee_load").alias("load")).first()
    expected = hot.where("assignee = 'busy'").agg(F.sum("story_points").alias("s")).first()["s"]
    assert (row["n"], row["load"]) == (ROWS // 3, expected)
    assert joined.where("assignee IS NULL AND assignee_load <> 0").count() == 0
    assert joined.columns == [*hot.columns, "complexity_per_person", "team_wip", "assignee_load"]


def test_features_write_nothing_before_an_action(spark, hot):
    folder = shared_dir(spark)
    before = sorted(str(p) for p in Path(folder).rglob("part-*"))
    team.team_features(hot)
    quality_report(hot, {"story_points": {"type": "numeric", "min": 1}}, ["project_key"]).summary
    assert sorted(str(p) for p in Path(folder).rglob("part-*")) == before


def test_group_aggregates_combine_before_the_shuffle(hot):
    plan = team.workload(hot)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") > plan.index("Exchange")  # below it in the tree
    assert plan.count("Exchange") == 1


def test_label_of_a_hot_project(hot):
    assert delay_label(hot).agg(F.sum("is_delayed")).first()[0] == 0  # twice the median of 24 is never passed
    assert delay_label(hot.withColumn("days_in_status", F.pow("days_in_status", 2))).agg(F.sum("is_delayed")).first()[0] > 0


def test_series_of_a_hot_project(spark):
    i = F.col("id")
    df = spark.range(30_000).select(
        F.when(i % 3 == 0, "HOT").otherwise(F.concat(F.lit("P"), i.cast("string"))).alias("project_key"),
        (F.lit(1704067200) + i % 3600).cast("string").alias("message_ts"),
        F.lit(0.25).alias("sentiment_score"),
    )
    series = sentiment_series(df)
    assert "partial_sum" in series._jdf.queryExecution().executedPlan().toString()
    row = series.where("project_key = 'HOT'").first()
    assert (row["message_count"], row["avg_sentiment"], row["std_dev"]) == (10_000, 0.25, 0.0)


def test_digest_of_a_hot_project_keeps_a_few_rows_per_task(hot):
    scored = hot.select(
        "project_key", "issue_key", F.lit("s").alias("summary"), F.lit("Open").alias("status"), "story_points", "days_in_status",
        F.lit(0).cast("long").alias("dependency_count"), F.lit(0.9).alias("risk_score"), F.lit("High").alias("risk_level"),
    )
    digest = high_risk_digest(scored)
    assert "WindowGroupLimit" in digest._jdf.queryExecution().executedPlan().toString()
    assert len(digest.where("project_key = 'HOT'").first()["high_risk_digest"].split("\n")) == fv.DIGEST_TICKETS


def test_factors_meet_the_values_of_listed_features_only(spark, monkeypatch):
    from lateline.operators import drift
    from lateline.plans import queries, risk_model

    names = fv.MODEL_FEATURES[:8]
    rows = [("A-1", *range(8)), ("A-2", None, *range(7)), ("A-2", *range(8)), (None, *range(8))]
    features = spark.createDataFrame(rows, ", ".join(["issue_key string", *(f"{name} long" for name in names)]))
    importance = [(name, 0.3 - i / 100) for i, name in enumerate(names)]
    met, long_form = [], drift.long_form
    monkeypatch.setattr(queries, "_model", lambda *_: (features, None))
    monkeypatch.setattr(risk_model, "feature_importance", lambda _: importance)
    monkeypatch.setattr(drift, "long_form", lambda *a, **b: met.append(long_form(*a, **b)) or met[-1])
    found = {row["issue_key"]: (row["factors"], row["own_values"]) for row in queries.q_top_risk_factors(spark, None).collect()}
    assert found == {"A-1": (5, True), "A-2": (18, False), None: (5, False)}
    assert {row["feature"] for row in met[0].select("feature").distinct().collect()} == set(names[:5])
