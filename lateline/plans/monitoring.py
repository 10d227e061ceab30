"""Drift of stored features against the stored baseline, scoring, and report rows."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from lateline import fixed_values as fv
from lateline.operators.alerts import drift_alerts, retrain_requests
from lateline.operators.drift import drift_report, drift_summary, feature_profile
from lateline.operators.reports import report_context
from lateline.operators.sentiment import sentiment_anomalies, sentiment_series
from lateline.plans.risk_model import load_model, run_training, score
from lateline.sources.lake import new_run_id, path_exists
from lateline.sources.staging import settle

PREDICTIONS = "predictions"


@dataclass
class DriftStatus:
    report: DataFrame  # one row per feature
    summary: DataFrame  # one row
    alerts: DataFrame  # one row where retraining is called for


def drift_status(lake, projects=None, version="latest", threshold=fv.DRIFT_THRESHOLD_PCT, features=fv.MODEL_FEATURES, as_of=None):
    """Compare the gold features of some projects with a stored baseline."""
    current = feature_profile(lake.read_gold(projects=projects), features=features)
    report = settle(drift_report(lake.load_baseline(version), current, threshold), "drift")
    summary = drift_summary(report, threshold)
    return DriftStatus(report, summary, drift_alerts(summary, as_of=as_of))


def watch_drift(lake, projects=None, version="latest", threshold=fv.DRIFT_THRESHOLD_PCT, as_of=None):
    """The drift status, with its alert appended to the alerts table."""
    status = drift_status(lake, projects, version, threshold, as_of=as_of)
    lake.append_alerts(status.alerts)
    return status


def run_scoring(lake, projects=None, version="latest", run_date=None, run_id=None):
    """Score gold features with a stored model; of each project and date the newest run's result is read."""
    model, _ = load_model(lake.spark, lake.path("models", "risk_model"), version)
    predictions = score(lake.read_gold(projects=projects), model)
    lake.write_gold(predictions.drop("project", "date"), PREDICTIONS, run_date, run_id=run_id or new_run_id())
    return lake.read_gold(PREDICTIONS, projects)


def report_rows(lake, period, projects=None, date=None, source="slack"):
    """Prompt rows of the weekly report from stored predictions and silver messages."""
    predictions = lake.read_gold(PREDICTIONS, projects, date)
    series = settle(sentiment_series(lake.read_silver(source, projects)), "series")
    return report_context(predictions, series, sentiment_anomalies(series), period)


SERVED = "retrain_served"


def open_requests(lake, requests, key):
    """Retrain requests (key, project_key, ...) that no training has served yet."""
    path = lake.path("gold", SERVED)
    if not path_exists(lake.spark, path):
        return requests
    served = lake.spark.read.parquet(path).select(key, "project_key").distinct()
    return requests.join(served, [key, "project_key"], "left_anti")


def mark_served(lake, requests, key):
    """Remember that these requests have been served."""
    requests.select(key, "project_key").write.mode("append").parquet(lake.path("gold", SERVED))


def retrain(lake, envelopes, project_keys, key, **training):
    """Delivered alerts to a new model: one training for all requests that are open, then marked as served.

    Returns the training's result, or None if nothing is asked for.
    """
    asked = settle(open_requests(lake, retrain_requests(envelopes, project_keys, key), key), "requests")
    if asked.isEmpty():
        return None
    result = run_training(lake, list(project_keys), **training)
    mark_served(lake, asked, key)
    return result
