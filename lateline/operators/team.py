"""Group features: aggregate first, then attach to each ticket.

The join back is salted, so the tickets of a hot project or assignee are dealt to
many tasks; where the aggregate turns out small, adaptive execution broadcasts it.
"""

from pyspark.sql import functions as F
from pyspark.sql import Window

from lateline import fixed_values as fv
from lateline.functions.numbers import rounded
from lateline.sources.staging import attach

ROW_KEY = "issue_key"  # deals the tickets of a hot project or assignee


def workload(features):
    """Points and tickets in progress per project and assignee.

    The one pass over the tickets: both group aggregates follow from this table,
    and a project with very many tickets is spread over its assignees.
    """
    busy = (F.col("status_category") == "In Progress") & F.col("issue_key").isNotNull()
    return features.groupBy("project_key", "assignee").agg(
        F.sum("story_points").alias("points"), F.count_if(busy).alias("busy")
    )


def project_stats(pairs):
    """Complexity per person and work in progress per project. Nobody is no person."""
    people = F.greatest(F.count("assignee"), F.lit(1))
    return pairs.groupBy("project_key").agg(
        rounded(F.sum("points") / people, 2).alias("complexity_per_person"), F.sum("busy").alias("team_wip")
    )


def assignee_stats(pairs):
    """Points per assignee across all projects; tickets of nobody are left out."""
    owned = pairs.where(F.col("assignee").isNotNull())
    return owned.groupBy("assignee").agg(F.sum("points").alias("assignee_load"))


def team_features(features):
    """Add complexity_per_person, team_wip and assignee_load.

    Both aggregates follow from one table of projects and assignees; the tickets
    themselves are neither written nor gathered.
    """
    pairs = workload(features)
    attached = attach(features, project_stats(pairs), "project_key", ROW_KEY)
    attached = attach(attached, assignee_stats(pairs), "assignee", ROW_KEY)
    return attached.withColumns(
        {
            "team_wip": F.coalesce("team_wip", F.lit(0)),
            "assignee_load": F.coalesce("assignee_load", F.lit(0.0)),
        }
    )


def latest_sentiment(series):
    """Each project's last average and its change from the window before.

    Only two windows per project pass the rank limit, and Spark applies that
    limit before the shuffle.
    """
    newest = Window.partitionBy("project_key").orderBy(F.col("window_start").desc())
    last_two = series.withColumn("_rank", F.row_number().over(newest)).where("_rank <= 2")
    value = F.col("avg_sentiment")
    both = last_two.groupBy("project_key").agg(
        F.max(F.when(F.col("_rank") == 1, value)).alias("avg_sentiment"),
        F.max(F.when(F.col("_rank") == 2, value)).alias("_previous"),
    )
    velocity = F.coalesce(F.col("avg_sentiment") - F.col("_previous"), F.lit(0.0))
    return both.select(
        "project_key",
        "avg_sentiment",
        velocity.alias("sentiment_velocity"),
        (velocity < fv.VELOCITY_ALARM).cast("int").alias("sentiment_anomaly"),
    )


def merge_sentiment(features, series=None):
    """Put each project's latest sentiment on its tickets; no series means 0."""
    names = ["avg_sentiment", "sentiment_velocity", "sentiment_anomaly"]
    zeros = {names[0]: F.lit(0.0), names[1]: F.lit(0.0), names[2]: F.lit(0)}
    if series is None:
        return features.withColumns(zeros)
    joined = attach(features, latest_sentiment(series), "project_key", ROW_KEY)
    return joined.withColumns({name: F.coalesce(name, zero) for name, zero in zeros.items()})
