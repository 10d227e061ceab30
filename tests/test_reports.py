import json

import pytest
from pyspark.sql import functions as F

from lateline import fixed_values as fv
from lateline.functions.text import fixed, percent
from lateline.operators import replies as P
from lateline.operators import reports as R

SCORED = (
    "project_key string, issue_key string, summary string, status string, status_category string, assignee string, "
    "risk_score double, risk_level string, story_points double, issue_type_risk double, avg_sentiment double, "
    "days_in_status double, dependency_count long"
)


def row(number, score, project="P", **changes):
    level = "High" if score >= 0.7 else "Medium" if score >= 0.4 else "Low"
    base = dict(
        project_key=project, issue_key=f"{project}-{number}", summary=f"Ticket {number}", status="Open", status_category="To Do",
        assignee="a", risk_score=score, risk_level=level, story_points=3.0, issue_type_risk=0.7, avg_sentiment=0.1,
        days_in_status=4.6, dependency_count=2,
    )
    return {**base, **changes}


@pytest.fixture
def scored(spark):
    def make(*rows):
        return spark.createDataFrame([[r[c.split()[0]] for c in SCORED.split(", ")] for r in rows], SCORED)

    return make


@pytest.mark.parametrize("value, places, text", [(0.5, 0, "1"), (2.345, 2, "2.35"), (-0.8, 3, "-0.800"), (-0.0001, 2, "0.00"), (12.0, 1, "12.0")])
def test_fixed(spark, value, places, text):
    assert spark.createDataFrame([(value,)], "v double").select(fixed(F.col("v"), places)).first()[0] == text


def test_percent(spark):
    df = spark.createDataFrame([(0.854,)], "v double")
    assert tuple(df.select(percent(F.col("v")), percent(F.col("v"), 2)).first()) == ("85%", "85.40%")


def test_summaries(scored):
    dock = [(1, 0.93, "In Progress"), (2, 0.41, "In Progress"), (3, 0.66, "Done"), (4, 0.72, "Done"), (5, 0.4, "Done"), (6, 0.08, "To Do")]
    df = scored(*[row(n, s, "DOCK", status_category=c) for n, s, c in dock], row(7, 0.39, project="PIER"))
    risk = {r["project_key"]: r for r in R.project_risk(df).collect()}
    assert [risk["DOCK"][n] for n in ("total_tickets", "high_risk", "medium_risk", "low_risk", "avg_risk_score")] == [6, 2, 3, 1, 0.5333]
    facts = {r["project_key"]: r for r in R.report_facts(df).collect()}
    assert [facts["DOCK"][n] for n in ("completed", "in_progress", "high_risk")] == [3, 2, 2]
    digest = {r["project_key"]: r["score_digest"] for r in R.score_digest(df).collect()}
    assert digest["DOCK"] == "Risk Distribution: 2 High, 3 Medium, 1 Low\nAverage Risk Score: 53.33%\nTotal Tickets Scored: 6"
    assert [r["issue_key"] for r in R.ticket_lookup(df, "PIER-7").collect()] == ["PIER-7"]


def test_high_risk_digest(scored):
    df = scored(*[row(i, 0.7 + i / 100, story_points=None if i == 29 else 8.0) for i in range(30)], row(1, 0.1, project="CALM"))
    digest = {r["project_key"]: r["high_risk_digest"] for r in R.high_risk_digest(df).collect()}
    assert digest["CALM"] == fv.NO_HIGH_RISK_TEXT
    lines = digest["P"].split("\n")
    assert len(lines) == 15
    assert lines[0] == "- [P-29] Ticket 29 | Status: Open | Risk: 99% | Points: 0.0 | Days in Status: 5 | Dependencies: 2"
    assert lines[14].startswith("- [P-15]")


def test_top_tickets_are_limited_before_the_shuffle(scored):
    df = scored(*[row(i, 0.9) for i in range(5)])
    plan = R.high_risk_digest(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_radar(scored):
    points = R.radar_points(
        scored(
            row(1, 0.8, summary="s" * 100),
            row(2, 0.1, story_points=None, issue_type_risk=None, avg_sentiment=None, days_in_status=None),
            row(3, 0.1, story_points=20.0, avg_sentiment=-1.5),
            row(4, 0.1, project="FLAT", story_points=0.0),
        )
    )
    got = {r["issue_key"]: r for r in points.collect()}
    assert (got["P-1"]["x"], got["P-1"]["y"], got["P-1"]["size"], got["P-1"]["radius"], got["P-1"]["color"]) == (2.1, 0.1, 3.0, 9.0, "High")
    assert len(got["P-1"]["summary"]) == 80
    assert (got["P-2"]["x"], got["P-2"]["y"], got["P-2"]["size"], got["P-2"]["radius"]) == (0.0, 0.0, 1.0, 4.0)
    assert got["P-3"]["radius"] == 30.0
    axes = {r["project_key"]: r for r in R.radar_axes(points).collect()}
    assert (axes["P"]["x_min"], axes["P"]["y_min"], axes["P"]["y_max"]) == (0.0, -1.5, 1.0)
    assert axes["P"]["x_max"] == pytest.approx(14 * 1.1) and axes["FLAT"]["x_max"] == 10.0


def test_risk_table(scored):
    rows = R.risk_table(scored(row(1, 0.2), row(2, 0.9, summary="x" * 90), row(3, 0.2, risk_score=None, risk_level=None, days_in_status=None))).collect()
    assert [r["issue_key"] for r in rows] == ["P-2", "P-1", "P-3"]
    assert (rows[0]["score"], len(rows[0]["summary"]), rows[0]["days"]) == ("90%", 60, "5d")
    assert (rows[2]["score"], rows[2]["risk_level"], rows[2]["days"]) == ("0%", "-", "0d")


def test_sentiment_digest_and_context(spark, scored):
    series = spark.createDataFrame([("P", "2024-01-01", 0.5, 9), ("P", "2024-01-02", 0.3, 9)], "project_key string, window_start string, avg_sentiment double, message_count long")
    found = series.limit(1).selectExpr("*", "-2.5D AS z_score")
    text = R.sentiment_digest(series, found).first()["sentiment_digest"]
    assert text == (
        "Overall team sentiment is positive (avg: 0.400).\n\n1 sentiment anomalies detected:\n- 2024-01-01: sentiment=0.500, z-score=-2.50"
    )
    assert R.sentiment_digest(series, found.limit(0)).first()["sentiment_digest"].endswith("(avg: 0.400).")
    prompts = {r["project_key"]: r["prompt"] for r in R.report_context(scored(row(1, 0.9), row(2, 0.9, project="Q")), series, found, "May").collect()}
    assert "High risk: 1" in prompts["P"] and "- [P-1]" in prompts["P"] and "for May" in prompts["P"]
    assert fv.NO_SENTIMENT_TEXT in prompts["Q"]
    assert "z-score -2.50" in R.anomaly_prompts(found).first()["prompt"]


def test_ticket_prompts(spark, scored):
    tickets = spark.createDataFrame([("P-1", "s", "d" * 900, "Bug", "Open", None)], "issue_key string, summary string, description string, issue_type string, status string, story_points double")
    prompt = R.classification_prompts(tickets).first()["prompt"]
    assert prompt.count("d" * 500) == 1 and "d" * 501 not in prompt and "Story Points: 0.0" in prompt
    explained = R.explanation_prompts(scored(row(1, 0.85)), [("story_points", 0.2), ("days_in_status", 0.8), ("lost", 0.01)], k=2)
    text = explained.first()["prompt"]
    assert "- days_in_status: value=4.6, importance=0.8\n- story_points: value=3.0, importance=0.2" in text
    assert "Risk Score: 85%" in text and "lost" not in text
    assert "Exchange" not in explained._jdf.queryExecution().executedPlan().toString()
    assert text.endswith(fv.NO_CONTEXT_TEXT)


@pytest.mark.parametrize(
    "raw, value",
    [
        ('```json\n{"key": "v"}\n```', '{"key":"v"}'),
        ('Here: {"key": "v"} and more.', '{"key":"v"}'),
        ('  {"a": {"b": [1]}}\n', '{"a":{"b":[1]}}'),
        ("```\nnot json\n```", None),
        ("The harbour master has nothing to add today", None),
        ("} wrong {", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_replies(spark, raw, value):
    row = P.parse_replies(spark.createDataFrame([(raw,)], "raw string")).select(F.to_json("parsed").alias("j"), "parse_error", "raw").first()
    assert (row["j"], row["parse_error"], row["raw"]) == (value, value is None, raw)


def test_cited_tickets(spark):
    report = {"critical_risks": [{"affected_tickets": ["A-1", "A-2"]}, {"affected_tickets": "A-3"}, {"title": "x"}, {"affected_tickets": 5}, {"affected_tickets": []}]}
    df = spark.createDataFrame([(1, json.dumps(report)), (2, "{}"), (3, '{"critical_risks": "none"}')], "id int, raw string")
    got = P.cited_tickets(P.parse_replies(df), "id").orderBy("risk_position", "position").collect()
    assert [(r["id"], r["ticket"]) for r in got] == [(1, "A-1"), (1, "A-2"), (1, "A-3")]


def test_anomaly_analysis(spark):
    found = spark.createDataFrame([("P", f"2024-01-0{i}", -0.8) for i in range(1, 8)], "project_key string, window_start string, avg_sentiment double")
    answers = spark.createDataFrame([("P", "2024-01-01", '{"severity": "high"}'), ("P", "2024-01-02", "no idea")], "project_key string, window_start string, raw string")
    got = [json.loads(r["analysis"]) for r in P.anomaly_analysis(found, answers).orderBy("window_start").collect()]
    assert len(got) == 5
    assert got[0] == {"severity": "high"}
    assert got[1] == {"raw_response": "no idea", "parse_error": True}
    assert got[2] == fv.MISSING_ANALYSIS
