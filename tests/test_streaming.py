import json
import os

import pytest
from conftest import AS_OF
from pyspark.sql import functions as F

from lateline.operators.flatten import explode_issues, flatten_issues
from lateline.operators.redaction import redact_records
from lateline.operators.sentiment import sentiment_series
from lateline.schemas import issue_page
from lateline.streaming import quality, sentiment, silver

MESSAGES = "project_key string, channel_id string, message_ts string, sentiment_score double"
POINTS, SPRINT = "customfield_1", "customfield_2"


def messages(spark, tmp_path, rows, name="in"):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").parquet(path)
    return path, spark.readStream.schema(MESSAGES).parquet(path)


def hourly(days, project="P"):
    start = 1704067200  # 2024-01-01
    return [(project, "C", str(start + h * 3600), ((h * 7) % 10) / 10 - 0.5) for h in range(days * 24)]


def test_windows_equal_the_batch(spark, tmp_path):
    path, stream = messages(spark, tmp_path, hourly(5) + [("P", "C", "bad", 0.0)])
    out = str(tmp_path / "out")
    windows = sentiment.windowed_sentiment(sentiment.with_event_time(stream))
    sentiment.write_closed_windows(windows, out, str(tmp_path / "cp")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    batch = sorted(map(tuple, sentiment_series(spark.read.schema(MESSAGES).parquet(path)).collect()))
    assert len(batch) == 5 and got == batch[:4]  # the last window is still open


def test_all_windows_are_stored(spark, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    everything = hourly(5) + hourly(3, "Q")
    for part in (everything[:70], everything[70:]):
        path, stream = messages(spark, tmp_path, part)
        windows = sentiment.windowed_sentiment(sentiment.with_event_time(stream, "30 days"))
        sentiment.write_windows(windows, out, checkpoint).awaitTermination()
    got = sentiment.read_windows(spark, out)
    batch = sentiment_series(spark.read.schema(MESSAGES).parquet(path)).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) and got.count() == 8


def test_a_second_run_goes_on_where_the_first_stopped(spark, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    everything = hourly(6)
    for part in (everything[:80], everything[80:]):
        _, stream = messages(spark, tmp_path, part)
        windows = sentiment.windowed_sentiment(sentiment.with_event_time(stream))
        sentiment.write_closed_windows(windows, out, checkpoint).awaitTermination()
    got = spark.read.parquet(out).orderBy("window_start").collect()
    assert [r["message_count"] for r in got] == [24] * 5


def test_redelivered_messages(spark, tmp_path):
    _, stream = messages(spark, tmp_path, hourly(1) + hourly(1) + hourly(1)[:3])
    out = str(tmp_path / "out")
    once = sentiment.drop_redelivered(sentiment.with_event_time(stream))
    sentiment.write_closed_windows(once, out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 24


def test_anomalies_on_closed_windows(spark, tmp_path):
    rows = [("P", "C", str(1704067200 + d * 86400), -0.9 if d == 8 else 0.5 + d / 100) for d in range(12)]
    _, stream = messages(spark, tmp_path, rows)
    series, found = str(tmp_path / "series"), str(tmp_path / "found")
    windows = sentiment.windowed_sentiment(sentiment.with_event_time(stream))
    sentiment.flag_closed_windows(windows, series, found, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(series).count() == 10  # the watermark trails the last message
    assert [r["window_start"] for r in spark.read.parquet(found).collect()] == ["2024-01-09T00:00:00Z"]


def test_state_of_closed_windows_does_not_grow(spark, tmp_path):
    rows = [("P", "C", str(1704067200 + d * 86400), -0.9 if d in (8, 14) else 0.5 + d / 100) for d in range(20)]
    series, found, cp = (str(tmp_path / name) for name in ("series", "found", "cp"))
    for start in range(0, 20, 4):  # stopped and started again after each part
        _, stream = messages(spark, tmp_path, rows[start : start + 4])
        windows = sentiment.windowed_sentiment(sentiment.with_event_time(stream))
        sentiment.flag_closed_windows(windows, series, found, cp).awaitTermination()
    assert len([name for name in os.listdir(series + "-state") if name.startswith("batch_id=")]) == 2
    assert spark.read.parquet(series).count() == 18
    flagged = sorted(r["window_start"][:10] for r in spark.read.parquet(found).collect())
    assert flagged == ["2024-01-09", "2024-01-15"]


def page(number, project="PROJ", status="Open"):
    fields = {
        "project": {"key": project}, "summary": f"S {number}", "description": "mail a@b.io", "status": {"name": status},
        "priority": {"name": "High"}, "created": "2024-01-01", POINTS: 3,
    }
    return json.dumps({"issues": [{"id": str(number), "key": f"{project}-{number}", "fields": fields}]})


@pytest.fixture
def landed(tmp_path):
    folder = tmp_path / "pages"
    os.makedirs(folder)
    for number in range(4):
        (folder / f"{number}.json").write_text(page(number, "PROJ" if number < 3 else "BAD", "Open" if number < 3 else "Lost"))
    return str(folder)


def test_silver_stream_takes_each_file_once(spark, tmp_path, landed):
    out = str(tmp_path / "silver")

    def run():
        pages = silver.page_stream(spark, landed, POINTS, SPRINT, files_per_trigger=2)
        silver.write_silver(silver.silver_tickets(pages, POINTS, SPRINT, AS_OF), out, str(tmp_path / "cp")).awaitTermination()
        return spark.read.parquet(out)

    first = run()
    assert first.count() == 4 and os.path.isdir(f"{out}/project=BAD/date=2024-04-01")
    assert {r["description"] for r in first.collect()} == {"mail [EMAIL]"}
    with open(f"{landed}/9.json", "w") as more:
        more.write(page(9))
    assert run().count() == 5
    pages = spark.read.schema(issue_page(POINTS, SPRINT)).json(landed)
    batch = redact_records(flatten_issues(explode_issues(pages), POINTS, SPRINT, AS_OF), ["summary", "description"])
    shown = ["issue_key", "story_points", "description", F.col("_pii_redaction.pii_detected")]
    assert sorted(map(tuple, run().select(shown).collect())) == sorted(map(tuple, batch.select(shown).collect()))


def test_quality_alerts_per_batch(spark, tmp_path, landed):
    out = str(tmp_path / "alerts")
    pages = silver.page_stream(spark, landed, POINTS, SPRINT)
    tickets = silver.silver_tickets(pages, POINTS, SPRINT, AS_OF)
    quality.check_batches(tickets, out, str(tmp_path / "cp"), as_of=AS_OF).awaitTermination()
    alerts = spark.read.parquet(out).collect()
    assert [(a["project_key"], a["batch_id"]) for a in alerts] == [("BAD", 0)]
    assert json.loads(alerts[0]["payload"])["violations"][0]["invalid_values"] == ["Lost"]
