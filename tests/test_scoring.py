import json
import random

import pytest
from conftest import AS_OF, many_tickets

from lateline import fixed_values as fv
from lateline.operators import scoring as S
from lateline.plans import monitoring
from lateline.plans import risk_model as M
from lateline.plans.training import labelled_features, project_delay_summary
from lateline.sources.lake import Lake
from lateline.sources.staging import settle

TREES = dict(rounds=3, depth=3)


def test_levels_at_the_thresholds(spark):
    scores = [0.0, 0.39994, 0.39995, 0.4, 0.69994, 0.69995, 0.7, 1.0]
    df = spark.createDataFrame([(s,) for s in scores], "p double")
    got = [(r["risk_score"], r["risk_level"]) for r in S.with_risk(df, df.p).orderBy("p").collect()]
    assert got == [
        (0.0, "Low"), (0.3999, "Low"), (0.4, "Medium"), (0.4, "Medium"),
        (0.6999, "Medium"), (0.7, "High"), (0.7, "High"), (1.0, "High"),
    ]


def folded(spark, count, slices=3):
    rows = [(f"K-{i:04d}", f"2024-01-{1 + i // 9:02d}" if i < 180 else None, int(i % 3 == 0), (i * 37 % 100) / 100) for i in range(count)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "issue_key string, created string, is_delayed int, risk_score double")
    return S.walk_forward(df, slices=slices)


def test_walk_forward_blocks(spark):
    rows = folded(spark, 200).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in rows] == list(range(200))
    assert [r["issue_key"] for r in rows] == [f"K-{i:04d}" for i in range(200)]  # no date sorts last
    block, first = 200 // 6, 200 - 5 * (200 // 6)
    assert [r["test_fold"] for r in rows] == [None] * first + [f for f in range(5) for _ in range(block)]
    with pytest.raises(ValueError):
        folded(spark, 5)


def test_training_rows_and_weights(spark):
    df = settle(folded(spark, 200))
    weights = {r["fold"]: r for r in S.positive_weights(df).collect()}
    for fold in range(5):
        train = S.training_rows(df, fold).collect()
        assert max(r["ordinal"] for r in train) < min(r["ordinal"] for r in df.where(df.test_fold == fold).collect())
        positives = sum(r["is_delayed"] for r in train)
        assert (weights[fold]["positives"], weights[fold]["negatives"]) == (positives, len(train) - positives)
        assert weights[fold]["positive_weight"] == pytest.approx((len(train) - positives) / positives)
    assert {r["positive_weight"] for r in S.positive_weights(df.replace({1: 0}, subset=["is_delayed"])).collect()} == {2.0}


def test_metrics_against_brute_force(spark):
    df = settle(folded(spark, 200))
    got = {r["test_fold"]: r for r in S.classification_metrics(df).collect()}
    for fold, row in got.items():
        rows = df.where(df.test_fold == fold).collect()
        real = [(r["risk_score"], r["is_delayed"]) for r in rows]
        tp = sum(s > 0.5 and y for s, y in real)
        fp = sum(s > 0.5 and not y for s, y in real)
        fn = sum(s <= 0.5 and y for s, y in real)
        assert row["recall"] == pytest.approx(tp / (tp + fn)) and row["precision"] == pytest.approx(tp / (tp + fp))
        assert row["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn))
        pairs = [(a > b) + (a == b) / 2 for a, y in real if y for b, z in real if not z]
        assert row["auc_roc"] == pytest.approx(sum(pairs) / len(pairs))
        assert (row["test_size"], row["positive_rate"]) == (33, pytest.approx(sum(y for _, y in real) / 33))


def test_metrics_of_one_class(spark):
    df = spark.createDataFrame([(0, 0.9, 0), (0, 0.1, 0), (None, 0.5, 1)], "test_fold int, risk_score double, is_delayed int")
    row = S.classification_metrics(df).first()
    assert (row["recall"], row["precision"], row["f1"], row["auc_roc"], row["test_size"]) == (0.0, 0.0, 0.0, 0.0, 2)


def test_top_factors(spark):
    df = spark.createDataFrame([("A-1", 3.0, None)], "issue_key string, a double, b int")
    got = S.top_factors(df, [("b", 0.2), ("a", 0.5), ("gone", 0.2), ("c", 0.01)], ["issue_key"], 3).orderBy("rank").collect()
    assert [(r["feature"], r["value"], r["importance"]) for r in got] == [("a", 3.0, 0.5), ("b", 0.0, 0.2), ("gone", 0.0, 0.2)]


@pytest.fixture(scope="module")
def trained(spark):
    from lateline.schemas import TICKET

    tickets = spark.createDataFrame(many_tickets(240), TICKET)
    features = settle(labelled_features(tickets, AS_OF))
    return features, M.fit_model(features, **TREES)


def test_scores_and_importance(spark, trained):
    features, model = trained
    rows = M.score(features, model).collect()
    assert len(rows) == 240 and all(0 <= r["risk_score"] <= 1 for r in rows)
    for r in rows:
        expected = "High" if r["risk_score"] >= 0.7 else "Medium" if r["risk_score"] >= 0.4 else "Low"
        assert r["risk_level"] == expected
    delayed = [r["risk_score"] for r in rows if r["is_delayed"]]
    others = [r["risk_score"] for r in rows if not r["is_delayed"]]
    assert sum(delayed) / len(delayed) > sum(others) / len(others)
    importance = M.feature_importance(model)
    assert importance and {n for n, _ in importance} <= set(fv.MODEL_FEATURES)
    assert [w for _, w in importance] == sorted((w for _, w in importance), reverse=True)
    assert M.importance_table(spark, model).count() == len(importance)


def test_save_and_load(spark, trained, tmp_path):
    features, model = trained
    path = str(tmp_path / "models")
    M.save_model(spark, model, {"a": 1}, path, "v1")
    M.save_model(spark, model, {"a": 2}, path, "v2")
    assert M.load_model(spark, path)[1] == {"a": 2}
    loaded, metadata = M.load_model(spark, path, "v1")
    assert metadata == {"a": 1}
    before = {r["issue_key"]: r["risk_score"] for r in M.score(features, model).collect()}
    after = {r["issue_key"]: r["risk_score"] for r in M.score(features, loaded).collect()}
    assert before == after


def test_default_weight_without_positives(spark, trained):
    features, _ = trained
    assert M.class_counts(features.limit(0), "is_delayed") == (0, 0)


def test_training_from_the_lake(spark, tickets, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    lake.write_silver(tickets, "jira", "2024-03-01")
    series = spark.createDataFrame([("PROJ", "2024-01-01", 0.3), ("PROJ", "2024-01-02", -0.2)], "project_key string, window_start string, avg_sentiment double")
    result = M.run_training(lake, ["PROJ", "ALPHA", "EMPTY"], series=series, as_of=AS_OF, version="v1", folds=2, **TREES)
    assert result["status"] == "success" and result["training_samples"] == 120
    assert set(result["metrics"]) == {"recall", "precision", "f1", "auc_roc"}
    assert lake.read_gold(projects="PROJ").select("avg_sentiment").distinct().collect()[0][0] == -0.2
    assert lake.read_gold().count() == 120
    model, metadata = M.load_model(spark, lake.path("models", "risk_model"))
    assert metadata["training_samples"] == 120 and len(metadata["fold_metrics"]) == 2
    assert M.score(lake.read_gold(), model).count() == 120

    scored = monitoring.run_scoring(lake, run_date=AS_OF)
    assert scored.count() == 120 and "risk_level" in scored.columns
    same = monitoring.drift_status(lake, as_of=AS_OF)
    assert {r["status"] for r in same.report.collect()} == {"stable"} and same.alerts.count() == 0
    assert same.report.count() == len(fv.MODEL_FEATURES)
    moved = monitoring.watch_drift(lake, "ALPHA", version="v1", as_of=AS_OF)
    assert moved.summary.first()["needs_retrain"]
    assert [r["alert_type"] for r in lake.read_alerts().collect()] == [fv.DRIFT_ALERT]
    messages = spark.createDataFrame([("PROJ", "1704067200", 0.4)], "project_key string, message_ts string, sentiment_score double")
    lake.write_silver(messages, "slack", AS_OF)
    prompts = {r["project_key"]: r["prompt"] for r in monitoring.report_rows(lake, "May").collect()}
    assert set(prompts) == {"PROJ", "ALPHA"} and "positive (avg: 0.400)" in prompts["PROJ"]
    with pytest.raises(ValueError, match="No training data"):
        M.run_training(lake, ["EMPTY"])

    # a delivered drift alert leads to one training, and is then served
    message = json.dumps({"alert_type": fv.DRIFT_ALERT, "overall_drift_pct": 60.0})
    envelope = json.dumps({"Records": [{"Sns": {"Message": message}}]})
    delivered = spark.createDataFrame([(1, envelope), (2, envelope)], "id int, envelope string")
    options = dict(as_of=AS_OF, folds=2, **TREES)
    assert monitoring.retrain(lake, delivered, ["PROJ", "ALPHA"], "id", version="v2", **options)["model_version"] == "v2"
    assert monitoring.retrain(lake, delivered, ["PROJ", "ALPHA"], "id", version="v3", **options) is None


def test_project_delay_summary(tickets):
    rows = {r["project_key"]: r for r in project_delay_summary(labelled_features(tickets, AS_OF)).collect()}
    assert rows["PROJ"]["tickets"] + rows["ALPHA"]["tickets"] == 120
    assert rows["PROJ"]["assignees"] == 5 and rows["PROJ"]["wip"] == 40 and rows["ALPHA"]["wip"] == 0
