"""Alert rows, and the retraining requests found in delivered alerts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lateline import fixed_values as fv
from lateline.functions.numbers import iso_text, moment

ENVELOPE = "struct<Records:array<struct<Sns:struct<Message:string>>>>"


def quality_alerts(report, key="project_key", as_of=None):
    """One alert per failed group, carrying its first violations.

    `report` is a QualityReport made per `key`; its violations per group are
    bounded by the number of rules.
    """
    order = Window.partitionBy(key).orderBy("column", "rule")
    row = F.struct("column", "rule", "expected", "actual", "message", "invalid_values")
    shown = (
        report.violations.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= fv.ALERT_VIOLATIONS)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("_rank", row.alias("v")))).alias("_shown"))
    )
    created = iso_text(moment(as_of))
    payload = F.to_json(
        F.struct(
            F.lit(fv.QUALITY_ALERT).alias("alert_type"),
            F.col(key).alias("project_key"),
            "violations_count",
            F.transform("_shown", lambda s: s["v"]).alias("violations"),
            created.alias("timestamp"),
        )
    )
    failed = report.summary.where(~F.col("passed")).join(shown, key)
    return failed.select(
        F.lit(fv.QUALITY_ALERT).alias("alert_type"),
        F.col(key).alias("project_key"),
        payload.alias("payload"),
        created.alias("created_at"),
    )


def drift_alerts(summary, key=None, as_of=None):
    """One alert per drift summary that calls for retraining."""
    project = F.col(key) if key else F.lit(None).cast("string")
    created = iso_text(moment(as_of))
    payload = F.to_json(
        F.struct(
            F.lit(fv.DRIFT_ALERT).alias("alert_type"),
            "overall_drift_pct",
            "drifted_features",
            F.lit("Automated retraining recommended").alias("recommendation"),
            created.alias("timestamp"),
        )
    )
    return summary.where("needs_retrain").select(
        F.lit(fv.DRIFT_ALERT).alias("alert_type"),
        project.alias("project_key"),
        payload.alias("payload"),
        created.alias("created_at"),
    )


def retrain_requests(envelopes, project_keys, key, envelope="envelope"):
    """Projects to retrain per delivered alert envelope (a JSON text).

    Keeps drift alerts; other alerts and malformed messages are ignored. As an
    alert asks to retrain every configured project, each gives one row per key.
    """
    records = F.from_json(F.col(envelope), ENVELOPE)["Records"]
    messages = envelopes.select(key, F.explode(records).alias("_r")).select(
        key, F.try_parse_json(F.col("_r.Sns.Message")).alias("_m")
    )
    drift = messages.where(F.try_variant_get("_m", "$.alert_type", "string") == fv.DRIFT_ALERT)
    asked = drift.groupBy(key).agg(F.max(F.try_variant_get("_m", "$.overall_drift_pct", "double")).alias("overall_drift_pct"))
    return asked.withColumn("project_key", F.explode(F.array(*[F.lit(p) for p in project_keys])))
