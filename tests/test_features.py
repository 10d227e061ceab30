from conftest import AS_OF, link, sprint, ticket
from pyspark.sql import functions as F

from lateline import fixed_values as fv
from lateline.operators.features import model_input, ticket_features
from lateline.operators.labels import delay_label
from lateline.operators.team import latest_sentiment, merge_sentiment, team_features

SERIES = "project_key string, window_start string, avg_sentiment double"


def only(df):
    return df.first().asDict()


def test_values_of_one_ticket(make_tickets):
    row = only(
        ticket_features(
            make_tickets(
                ticket(
                    priority="High",
                    story_points=8.0,
                    issue_type="Bug",
                    status_category="In Progress",
                    updated="2024-03-30T12:00:00.000+0000",
                    sprint_history=[sprint(1), sprint(2), sprint(3)],
                    issue_links=[link("Blocks"), link("IS BLOCKED BY"), link("Relates"), link(None)],
                    comment_count=11,
                )
            ),
            AS_OF,
        )
    )
    expected = {
        "story_points": 8.0,
        "has_dependency": 1,
        "dependency_count": 4,
        "priority_numeric": 4,
        "priority_interaction": 32.0,
        "days_in_status": 1.5,
        "days_since_created": 104.8,
        "is_overdue": 1,
        "description_word_count": 11,
        "description_ambiguity": 0.0,
        "sprint_rollover_count": 2,
        "current_sprint_name": "Sprint 3",
        "ticket_churn": 4,
        "assignee_churn": 2,
        "blocker_dependency_ratio": 0.5,
        "issue_type_risk": 0.7,
        "status_category_encoded": 1,
    }
    assert {name: row[name] for name in expected} == expected


def test_missing_values_fall_back(make_tickets):
    row = only(
        ticket_features(
            make_tickets(
                ticket(
                    priority="Urgent",
                    story_points=None,
                    issue_type=None,
                    status_category=None,
                    updated="no date",
                    created=None,
                    due_date=None,
                    description=None,
                    sprint_history=None,
                    issue_links=None,
                    comment_count=None,
                )
            ),
            AS_OF,
        )
    )
    assert (row["priority_numeric"], row["story_points"], row["issue_type_risk"]) == (3, 0.0, 0.3)
    assert (row["days_in_status"], row["days_since_created"], row["is_overdue"]) == (0.0, 0.0, 0)
    assert (row["description_word_count"], row["description_ambiguity"]) == (0, 1.0)
    assert (row["dependency_count"], row["sprint_rollover_count"], row["ticket_churn"]) == (0, 0, 0)
    assert row["current_sprint_name"] is None and row["status_category_encoded"] == 0


def test_word_count_follows_unicode_white_space(make_tickets):
    texts = ["a\tb\nc  d", "   ", "x y　z", "word " * 501, ""]
    df = ticket_features(make_tickets(*[ticket(i, description=t) for i, t in enumerate(texts)]), AS_OF)
    rows = df.orderBy("issue_id").collect()
    assert [r["description_word_count"] for r in rows] == [len(t.split()) for t in texts]
    assert rows[3]["description_ambiguity"] == 0.5


def test_future_updates_are_no_negative_age(make_tickets):
    assert only(ticket_features(make_tickets(ticket(updated="2030-01-01T00:00:00Z")), AS_OF))["days_in_status"] == 0.0


def test_no_python_in_the_feature_plan(tickets):
    plan = ticket_features(tickets, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_team_features(make_tickets):
    rows = [
        ticket(1, assignee="a", story_points=3.0, status_category="In Progress"),
        ticket(2, assignee="b", story_points=4.0),
        ticket(3, assignee=None, story_points=3.0, status_category="In Progress"),
        ticket(4, assignee="a", story_points=5.0, project_key="OTHER", issue_key="OTHER-4"),
        ticket(5, assignee=None, story_points=2.0, project_key="LONE", issue_key="LONE-5"),
    ]
    got = {r["issue_key"]: r for r in team_features(ticket_features(make_tickets(*rows), AS_OF)).collect()}
    assert [got[k]["complexity_per_person"] for k in ("PROJ-1", "PROJ-3", "OTHER-4", "LONE-5")] == [5.0, 5.0, 5.0, 2.0]
    assert [got[k]["team_wip"] for k in ("PROJ-2", "OTHER-4")] == [2, 0]
    assert [got[k]["assignee_load"] for k in ("PROJ-1", "PROJ-2", "PROJ-3", "OTHER-4")] == [8.0, 4.0, 0.0, 8.0]


def test_team_features_on_a_shuffled_join(spark, tickets):
    """Beyond the broadcast limit the same values come from a shuffled join."""
    features = ticket_features(tickets, AS_OF)
    small = sorted(map(tuple, team_features(features).select("issue_key", "complexity_per_person", "assignee_load").collect()))
    limits = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for name, value in limits.items():
        spark.conf.set(name, value)
    try:
        df = team_features(features).select("issue_key", "complexity_per_person", "assignee_load")
        large = sorted(map(tuple, df.collect()))
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in limits:
            spark.conf.unset(name)
    assert small == large


def test_latest_sentiment_and_merge(spark, make_tickets):
    series = spark.createDataFrame(
        [("PROJ", "2024-01-01", 0.3), ("PROJ", "2024-01-03", -0.3), ("PROJ", "2024-01-02", 0.2), ("ONE", "2024-01-01", 0.4)],
        SERIES,
    )
    latest = {r["project_key"]: r for r in latest_sentiment(series).collect()}
    assert latest["PROJ"]["avg_sentiment"] == -0.3 and abs(latest["PROJ"]["sentiment_velocity"] + 0.5) < 1e-9
    assert latest["PROJ"]["sentiment_anomaly"] == 1
    assert (latest["ONE"]["sentiment_velocity"], latest["ONE"]["sentiment_anomaly"]) == (0.0, 0)
    df = make_tickets(ticket(1), ticket(2, project_key="QUIET"))
    merged = {r["project_key"]: r["avg_sentiment"] for r in merge_sentiment(df, series).collect()}
    assert merged == {"PROJ": -0.3, "QUIET": 0.0}
    assert only(merge_sentiment(df))["sentiment_velocity"] == 0.0


def test_delay_label(make_tickets):
    busy = dict(status_category="In Progress", resolution_date=None)
    rows = [
        ticket(1),
        ticket(2, resolution_date="2024-03-15T00:00:00Z"),
        ticket(3, sprint_history=[sprint(1), sprint(2)]),
        ticket(4, updated="2024-03-22T00:00:00Z", **busy),
        ticket(5, updated="2024-03-22T00:00:00Z", **busy),
        ticket(6, updated="2024-01-02T00:00:00Z", **busy),
        ticket(7, due_date=None),
    ]
    labelled = delay_label(ticket_features(make_tickets(*rows), AS_OF))
    got = {int(r["issue_id"]): r["is_delayed"] for r in labelled.collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 1, 7: 0}


def test_delay_label_without_tickets_in_progress(make_tickets):
    assert only(delay_label(ticket_features(make_tickets(ticket(1)), AS_OF)))["is_delayed"] == 0


def test_stall_median_per_project(make_tickets):
    busy = dict(status_category="In Progress", resolution_date=None)
    rows = [ticket(i, updated="2024-03-31T00:00:00Z", **busy) for i in range(1, 6)]
    rows += [ticket(i, project_key="SLOW", updated="2024-03-01T00:00:00Z", **busy) for i in range(6, 8)]
    features = ticket_features(make_tickets(*rows), AS_OF)
    count = F.sum("is_delayed").alias("n")
    assert delay_label(features).agg(count).first()["n"] == 2
    assert delay_label(features, by_project=True).agg(count).first()["n"] == 0


def test_model_input(make_tickets):
    df = ticket_features(make_tickets(ticket(1)), AS_OF).withColumn("story_points", F.lit("bad"))
    inputs = model_input(df)
    assert inputs.columns == list(fv.MODEL_FEATURES)
    assert {kind for _, kind in inputs.dtypes} == {"double"}
    row = only(inputs)
    assert row["story_points"] == 0.0 and row["team_wip"] == 0.0 and None not in row.values()
