"""Quality checks per micro-batch."""

from pyspark.sql import functions as F

from lateline.operators.alerts import quality_alerts
from lateline.operators.quality import quality_report


def check_batches(tickets, alert_path, checkpoint, rules=None, as_of=None):
    """Check each batch per project and store its alerts, once per batch."""

    def check(batch, batch_id):
        batch.persist()  # profile and invalid categories read it
        try:
            report = quality_report(batch, rules, ["project_key"])
            alerts = quality_alerts(report, as_of=as_of).withColumn("batch_id", F.lit(batch_id).cast("long"))
            writer = alerts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("batch_id").parquet(alert_path)
        finally:
            batch.unpersist()

    writer = tickets.writeStream.option("checkpointLocation", checkpoint)
    return writer.foreachBatch(check).trigger(availableNow=True).start()
