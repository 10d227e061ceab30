"""Incremental loads: high-water marks, look-back, latest versions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lateline import fixed_values as fv
from lateline.functions.numbers import moment
from lateline.operators.sentiment import sent_at


def with_marks(df, state, key="project_key"):
    """Attach each project's mark, null on its first run."""
    return df.join(state.select(key, "last_ingest_date"), key, "left")


def since_mark(df, state, key="project_key", updated="updated"):
    """Rows updated at or after their project's mark; all rows of a new project.

    A row whose update cannot be read may be new, so it is taken each time.
    """
    mark, moved = F.col("last_ingest_date").try_cast("timestamp"), F.col(updated).try_cast("timestamp")
    fresh = mark.isNull() | moved.isNull() | (moved >= mark)
    return with_marks(df, state, key).where(fresh).drop("last_ingest_date")


def undated(df, updated="updated"):
    """Rows whose update cannot be read: no mark can tell whether they were loaded before."""
    return df.where(F.col(updated).try_cast("timestamp").isNull())


def advance_marks(state, batch, key="project_key", updated="updated"):
    """New state: the newest update that was read, in full, for projects that brought rows.

    A mark never moves back, and what changes while a load runs is read by the next.
    """
    newest = batch.groupBy(key).agg(F.max(F.col(updated).try_cast("timestamp")).alias("_newest"))
    joined = state.select(key, "last_ingest_date").join(newest, key, "full")
    mark = F.col("last_ingest_date").try_cast("timestamp")
    moved = F.col("_newest").isNotNull() & (mark.isNull() | (F.col("_newest") > mark))
    shown = F.date_format("_newest", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return joined.select(key, F.when(moved, shown).otherwise(F.col("last_ingest_date")).alias("last_ingest_date"))


def recent_messages(messages, hours=fv.LOOKBACK_HOURS, as_of=None):
    """Messages of the last hours."""
    oldest = moment(as_of) - F.make_interval(hours=F.lit(hours))
    return messages.where(sent_at(F.col("message_ts")) >= oldest)


def latest(df, key="issue_key", order=("updated", "ingested_at")):
    """The newest version of each record.

    Spark applies the rank limit before the shuffle too, so of a record with
    very many copies each task passes on one.
    """
    newest = Window.partitionBy(key).orderBy(*[F.col(name).desc_nulls_last() for name in order])
    return df.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") == 1).drop("_rank")


def ingestion_summary(silver, quality, key="project_key", asked=None, errors=None):
    """Per project: records, records with personal data, quality flag, violations, outcome.

    `asked` (key) names the projects of the run and `errors` (key, error) those that
    could not be read. The outcome is error, no_new_data or success.
    """
    counted = silver.groupBy(key).agg(
        F.count("*").alias("tickets_ingested"),
        F.count_if(F.col("_pii_redaction.pii_detected")).alias("pii_detected"),
    )
    verdict = quality.select(
        key, F.col("passed").alias("quality_passed"), F.col("violations_count").alias("quality_violations")
    )
    joined = counted.join(verdict, key, "left")
    if asked is not None:
        joined = asked.select(key).distinct().join(joined, key, "full")
    error = F.lit(None).cast("string")
    if errors is not None:
        failed = errors.groupBy(key).agg(F.min("error").alias("_error"))
        joined, error = joined.join(failed, key, "full"), F.col("_error")
    status = F.when(error.isNotNull(), "error").when(F.col("tickets_ingested").isNull(), "no_new_data").otherwise("success")
    return joined.select(
        key,
        F.coalesce("tickets_ingested", F.lit(0)).alias("tickets_ingested"),
        F.coalesce("pii_detected", F.lit(0)).alias("pii_detected"),
        "quality_passed",
        "quality_violations",
        status.alias("status"),
    )
