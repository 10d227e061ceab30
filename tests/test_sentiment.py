import statistics

import pytest
from pyspark.sql import functions as F

from lateline.operators import sentiment as S

MESSAGES = "project_key string, message_ts string, sentiment_score double"
SERIES = "project_key string, window_start string, avg_sentiment double, message_count long"


def score(spark, text, lexicon=None):
    df = spark.createDataFrame([(text,)], "text string")
    return df.select(S.score_text(F.col("text"), lexicon)).first()[0]


@pytest.mark.parametrize(
    "text, sign",
    [
        ("milestone in sight, the ferry timetable got approved", 1),
        ("Another hotfix after the rollback; the lock gates regression is back", -1),
        ("Moved the tide tables to the second shelf", 0),
        ("The dredger is BROKEN since Tuesday", -1),
        ("unblocked", 1),
        ("That is tech debt", -1),
        ("", 0),
        (None, 0),
    ],
)
def test_sign_of_score(spark, text, sign):
    value = score(spark, text)
    assert (value > 0) - (value < 0) == sign and -1 <= value <= 1


def compound(total):
    return round(total / (total * total + 15) ** 0.5, 4)


@pytest.mark.parametrize(
    "text, total",
    [
        ("it shipped", 2.0),
        ("it really shipped", 2.293),
        ("it really just shipped", 2 + 0.293 * 0.95),
        ("slightly broken", -2.0 + 0.293),
        ("very very broken", -2 - 0.293 - 0.293 * 0.95),
        ("not shipped", -1.48),
        ("it wasn't really approved", (1.5 + 0.293) * -0.74),
        ("approved, not a b c shipped", 1.5 + 2.0),
        ("it SHIPPED", 2.733),
        ("SHIPPED IT", 2.0),
        ("BROKEN build", -2.733),
        ("shipped!", 2.292),
        ("broken!!!!!!", -2 - 4 * 0.292),
        ("broken??", -2.36),
        ("broken?????", -2.96),
        ("shipped but broken", 2 * 0.5 - 2 * 1.5),
        ("what? why!", 0.0),
        ("badé éhack", 0.0),
    ],
)
def test_scoring_rules(spark, text, total):
    assert score(spark, text) == (compound(total) if total else 0.0)


def test_compound_value_and_own_lexicon(spark):
    assert score(spark, "blocked blocked") == round(-5 / (25 + 15) ** 0.5, 4)
    assert score(spark, "on track, on track") == round(4 / (16 + 15) ** 0.5, 4)
    assert score(spark, "shipped fine", {"fine": 1.0}) == 0.25


def test_longest_terms_count(spark):
    lexicon = {"low": -1.0, "low tide": 0.5, "low tide mark": 2.0, "tide": -0.25, "tide mark": 3.0, "mark book": 1.0, "tide mark a b": 4.0}
    for text, total in {
        "low tide": 0.5,
        "low TIDE, not a mark": 0.5,
        "low tide mark": 2.0,  # the pair and the word within it do not count beside it
        "low tide mark book": 2.0 + 1.0,  # two terms that overlap, none within the other
        "a tide mark a b": 4.0,
        "tide mark a": 3.0,
        "low": -1.0,
        "mark": 0.0,
        "low low tide": -1.0 + 0.5,
    }.items():
        assert score(spark, text, lexicon) == round(total / (total * total + 15) ** 0.5, 4), text


def test_a_lexicon_of_thousands(spark):
    lexicon = {f"ab{i}": (i % 7) / 2 - 1.75 for i in range(10_000)} | {f"on{i} to{i} it": 1.0 for i in range(1_000)}
    rows = [(f"ab{i} xy on{i % 1000} to{i % 1000} it", (i % 7) / 2 - 1.75 + 1.0) for i in range(0, 10_000, 7)]
    scored = spark.createDataFrame(rows, "text string, total double").select("total", S.score_text(F.col("text"), lexicon).alias("score"))
    for row in scored.collect():
        assert abs(row["score"] - row["total"] / (row["total"] ** 2 + 15) ** 0.5) < 1e-4


def test_drafted_lexicon(spark, tmp_path):
    texts = spark.createDataFrame([("Fog fog bank",), ("fog bank, tide",), (None,), ("",)], "text string")
    terms = S.frequent_terms(texts, 2, 1)
    assert [row["term"] for row in terms.collect()] == ["fog", "bank", "fog bank"]
    S.write_lexicon(terms.withColumn("valence", F.length("term") * 0.5), str(tmp_path / "terms"))
    assert S.read_lexicon(spark, str(tmp_path / "terms")) == {"fog": 1.5, "bank": 2.0, "fog bank": 4.0}
    assert score(spark, "nothing here", {}) == 0.0


def test_lexicon_from_a_file(spark, tmp_path):
    path = tmp_path / "lexicon.txt"
    path.write_text("Breezy\t1.5\t0.8\textra\nfog bank\t-2\n'tis\t0.5\n")
    lexicon = S.read_lexicon(spark, str(path))
    assert lexicon == {"breezy": 1.5, "fog bank": -2.0, "'tis": 0.5}
    assert score(spark, "a breezy day", lexicon) == compound(1.5) and score(spark, "Fog bank!", lexicon) < 0
    for broken in ("calm\t1\nCALM\t2\n", "calm\n", "calm\tvery\n"):
        path.write_text(broken)
        with pytest.raises(ValueError):
            S.read_lexicon(spark, str(path))


def test_series_per_day_and_hour(spark):
    rows = [
        ("P", "1700000000.000000", 0.5),
        ("P", "1700001000.000000", -0.3),
        ("P", "1700086400.5", 0.2),
        ("P", "bad", 0.9),
        ("P", "", 0.9),
        ("P", None, 0.9),
        ("Q", "1700000000", 0.7),
    ]
    df = spark.createDataFrame(rows, MESSAGES)
    days = {(r[0], r[1]): (r[2], r[3], r[4]) for r in S.sentiment_series(df).collect()}
    assert days == {
        ("P", "2023-11-14T00:00:00Z"): (0.1, 2, round(statistics.stdev([0.5, -0.3]), 4)),
        ("P", "2023-11-15T00:00:00Z"): (0.2, 1, 0.0),
        ("Q", "2023-11-14T00:00:00Z"): (0.7, 1, 0.0),
    }
    hours = S.sentiment_series(df, window_hours=1).where("project_key = 'P'").orderBy("window_start").collect()
    assert [r["window_start"] for r in hours] == ["2023-11-14T22:00:00Z", "2023-11-15T22:00:00Z"]
    assert S.sentiment_series(df, window_hours=48).count() == 3
    assert S.sentiment_series(df.limit(0)).count() == 0


def series(spark, values, project="P"):
    return spark.createDataFrame([(project, f"2024-01-{i:02d}", v, 10) for i, v in enumerate(values, 1)], SERIES)


def test_anomalies(spark):
    values = [0.5, 0.4, 0.3, -0.8, 0.4]
    found = S.sentiment_anomalies(series(spark, values), 1.5).collect()
    z = (-0.8 - statistics.mean(values)) / statistics.stdev(values)
    assert [(r["window_start"], r["z_score"], r["anomaly_type"]) for r in found] == [
        ("2024-01-04", round(z, 4), "negative_sentiment_drop")
    ]
    assert S.sentiment_anomalies(series(spark, [0.3] * 7)).count() == 0
    assert S.sentiment_anomalies(series(spark, [0.3, -0.9]), 0.1).count() == 0


def test_anomalies_are_per_project(spark):
    both = series(spark, [0.5, 0.4, 0.3, -0.8, 0.4]).unionByName(series(spark, [-0.8] * 5, "GLOOM"))
    assert [r["project_key"] for r in S.sentiment_anomalies(both, 1.5).collect()] == ["P"]
    assert S.sentiment_anomalies(both, 1.5, keys=()).count() == 0


def test_first_anomalies_keeps_the_earliest(spark):
    kept = S.first_anomalies(series(spark, [-0.1] * 9), keep=5).orderBy("anomaly_rank").collect()
    assert [r["window_start"] for r in kept] == [f"2024-01-0{i}" for i in range(1, 6)]


def test_outlook_reads_the_last_seven(spark):
    up = S.sentiment_outlook(series(spark, [-1.0] * 5 + [0.2] * 7)).first()
    assert (up["outlook"], up["recent_windows"], round(up["recent_sentiment"], 6)) == ("positive", 7, 0.2)
    assert S.sentiment_outlook(series(spark, [-0.5, -0.3])).first()["outlook"] == "negative"
    assert S.sentiment_outlook(series(spark, [0.1])).first()["outlook"] == "neutral"


def test_scoring_needs_no_shuffle(spark):
    df = spark.createDataFrame([("a",)], "text string").select(S.score_text(F.col("text")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan
