"""Ticket features: one projection, no shuffle."""

from pyspark.sql import functions as F

from lateline import fixed_values as fv
from lateline.functions.numbers import (
    choose,
    days_between,
    moment,
    number,
    number_or_zero,
    rounded,
)
from lateline.functions.text import word_count

DATE_COLUMNS = ("created", "updated", "due_date", "resolution_date")
MEASURES = ("sprint_count", "current_sprint_name", "link_count", "blocker_count")


def measure_arrays(tickets):
    """Counts over a ticket's own sprint and link arrays.

    A source whose sprints and links live in child tables aggregates these four
    columns there instead and never builds the arrays.
    """
    sprints, links = F.col("sprint_history"), F.col("issue_links")
    blockers = F.filter(links, lambda link: F.lower(link["type"]).isin(*fv.BLOCKER_LINK_TYPES))
    return tickets.withColumns(
        {
            "sprint_count": F.coalesce(F.array_size(sprints), F.lit(0)).cast("long"),
            "current_sprint_name": F.try_element_at(sprints, F.lit(-1))["sprint_name"],
            "link_count": F.coalesce(F.array_size(links), F.lit(0)).cast("long"),
            "blocker_count": F.coalesce(F.array_size(blockers), F.lit(0)).cast("long"),
        }
    )


def parse_dates(tickets, columns=DATE_COLUMNS):
    """Coerce the date columns to timestamps; what does not parse is null."""
    present = [name for name in columns if name in tickets.columns]
    return tickets.withColumns({name: F.col(name).try_cast("timestamp") for name in present})


def ticket_features(tickets, as_of=None):
    """Add the ticket-level features as of a moment.

    Takes tickets with arrays or with the MEASURES columns, and with a
    `description` or an already counted `description_word_count`.
    """
    now = moment(as_of)
    if not set(MEASURES) <= set(tickets.columns):
        tickets = measure_arrays(tickets)
    if "description_word_count" not in tickets.columns:
        tickets = tickets.withColumn("description_word_count", word_count(F.col("description")))
    comments = F.coalesce(number(F.col("comment_count")), F.lit(0.0))
    base = parse_dates(tickets).withColumns(
        {
            "story_points": number_or_zero(F.col("story_points")),
            "comment_count": comments.cast("long"),
            "has_dependency": (F.col("link_count") > 0).cast("int"),
            "dependency_count": F.col("link_count"),
            "priority_numeric": choose(F.col("priority"), fv.PRIORITY_RANK, fv.PRIORITY_RANK_OTHER),
            "sprint_rollover_count": F.greatest(F.col("sprint_count") - 1, F.lit(0)).cast("long"),
        }
    )
    words, rollovers = F.col("description_word_count"), F.col("sprint_rollover_count")
    ambiguity = F.when(words < fv.SHORT_DESCRIPTION_WORDS, 1.0).when(words > fv.LONG_DESCRIPTION_WORDS, 0.5)
    churn = rollovers + (F.col("comment_count") / fv.COMMENTS_PER_CHURN).cast("long")
    busy = F.col("comment_count") > fv.BUSY_COMMENT_COUNT
    blocking = rounded(F.try_divide(F.col("blocker_count"), F.col("link_count")), 2)
    return base.withColumns(
        {
            "priority_interaction": F.col("priority_numeric") * F.col("story_points"),
            "days_in_status": days_between(F.col("updated"), now),
            "days_since_created": days_between(F.col("created"), now),
            "is_overdue": F.coalesce(now > F.col("due_date"), F.lit(False)).cast("int"),
            "description_ambiguity": ambiguity.otherwise(0.0),
            "ticket_churn": churn,
            "assignee_churn": (rollovers > 0).cast("int") + busy.cast("int"),
            "blocker_dependency_ratio": F.coalesce(blocking, F.lit(0.0)),
            "issue_type_risk": choose(F.col("issue_type"), fv.ISSUE_TYPE_RISK, fv.ISSUE_TYPE_RISK_OTHER),
            "status_category_encoded": choose(
                F.col("status_category"), fv.STATUS_CATEGORY_CODE, fv.STATUS_CATEGORY_CODE_OTHER
            ),
        }
    ).drop(*[name for name in MEASURES if name != "current_sprint_name"])


def model_input(df, keys=(), features=fv.MODEL_FEATURES):
    """The model's inputs in order, as doubles; an absent column and a null are 0."""
    inputs = [
        (number_or_zero(F.col(name)) if name in df.columns else F.lit(0.0)).alias(name)
        for name in features
    ]
    return df.select(*keys, *inputs)
