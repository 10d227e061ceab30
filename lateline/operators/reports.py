"""Read models over predictions: summaries, scatter data, digests, prompt rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lateline import fixed_values as fv
from lateline.functions.numbers import exact_mean, rounded
from lateline.functions.text import fixed, percent
from lateline.operators.scoring import factor_list
from lateline.operators.sentiment import first_anomalies, sentiment_outlook

KEY = "project_key"


def _level_counts():
    return [F.count_if(F.col("risk_level") == level).alias(f"{level.lower()}_risk") for level in ("High", "Medium", "Low")]


def project_risk(predictions):
    """Tickets per risk level and the mean score, per project."""
    return predictions.groupBy(KEY).agg(
        F.count("*").alias("total_tickets"),
        *_level_counts(),
        rounded(exact_mean(F.coalesce("risk_score", F.lit(0.0))), 4).alias("avg_risk_score"),
    )


def ticket_lookup(predictions, issue_key):
    """One ticket; the project in its key prunes the partitions of a stored table."""
    return predictions.where((F.col(KEY) == issue_key.split("-")[0]) & (F.col("issue_key") == issue_key))


def risk_table(predictions):
    """Tickets by falling score."""
    score = F.coalesce("risk_score", F.lit(0.0))
    return predictions.select(
        "issue_key",
        F.substring(F.coalesce("summary", F.lit("")), 1, fv.TABLE_SUMMARY_CHARS).alias("summary"),
        F.coalesce("status", F.lit("-")).alias("status"),
        percent(score).alias("score"),
        F.coalesce("risk_level", F.lit("-")).alias("risk_level"),
        F.concat(fixed(F.coalesce("days_in_status", F.lit(0.0)), 0), F.lit("d")).alias("days"),
        F.coalesce("dependency_count", F.lit(0)).alias("dependencies"),
        score.alias("risk_score"),
    ).orderBy(F.col("risk_score").desc(), "issue_key")


def radar_points(predictions):
    """One bubble per ticket: complexity, sentiment, size, radius and colour."""
    points = F.coalesce("story_points", F.lit(0.0))
    size = F.greatest(points, F.lit(1.0))
    risk = F.coalesce("issue_type_risk", F.lit(fv.ISSUE_TYPE_RISK_OTHER))
    return predictions.select(
        KEY,
        "issue_key",
        F.substring(F.coalesce("summary", F.lit("")), 1, fv.RADAR_SUMMARY_CHARS).alias("summary"),
        rounded(points * risk, 4).alias("x"),
        rounded(F.coalesce("avg_sentiment", F.lit(0.0)), 4).alias("y"),
        size.alias("size"),
        F.greatest(F.lit(4.0), F.least(size * 3, F.lit(30.0))).alias("radius"),
        F.coalesce("risk_level", F.lit("Low")).alias("color"),
        rounded(F.coalesce("risk_score", F.lit(0.0)), 4).alias("risk_score"),
        "status",
        "assignee",
        rounded(F.coalesce("days_in_status", F.lit(0.0)), 1).alias("days_in_status"),
    )


def radar_axes(points):
    """The axis ranges per project."""
    highest = F.max("x") * 1.1
    return points.groupBy(KEY).agg(
        F.least(F.lit(0.0), F.min("x")).alias("x_min"),
        F.when(highest == 0, 10.0).otherwise(highest).alias("x_max"),
        F.least(F.lit(-1.0), F.min("y")).alias("y_min"),
        F.greatest(F.lit(1.0), F.max("y")).alias("y_max"),
    )


def report_facts(predictions):
    """Total, completed, in progress and the risk levels, per project."""
    category = F.col("status_category")
    return predictions.groupBy(KEY).agg(
        F.count("*").alias("total_tickets"),
        F.count_if(category == "Done").alias("completed"),
        F.count_if(category == "In Progress").alias("in_progress"),
        *_level_counts(),
    )


def _risk_line():
    return F.concat(
        F.lit("- ["),
        F.coalesce("issue_key", F.lit("N/A")),
        F.lit("] "),
        F.coalesce("summary", F.lit("No summary")),
        F.lit(" | Status: "),
        F.coalesce("status", F.lit("Unknown")),
        F.lit(" | Risk: "),
        percent(F.coalesce("risk_score", F.lit(0.0))),
        F.lit(" | Points: "),
        F.coalesce("story_points", F.lit(0.0)).cast("string"),
        F.lit(" | Days in Status: "),
        fixed(F.coalesce("days_in_status", F.lit(0.0)), 0),
        F.lit(" | Dependencies: "),
        F.coalesce("dependency_count", F.lit(0)).cast("string"),
    )


def _joined_lines(df, rank, line):
    """The ranked lines of each project as one text; the ranks are already bounded."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank), F.col(line).alias("line"))))
    return df.groupBy(KEY).agg(F.array_join(F.transform(ordered, lambda item: item["line"]), "\n").alias("lines"))


def high_risk_digest(predictions, keep=fv.DIGEST_TICKETS):
    """The riskiest tickets of each project as lines of text."""
    high = F.coalesce(F.col("risk_level") == "High", F.lit(False))
    order = Window.partitionBy(KEY).orderBy(high.desc(), F.col("risk_score").desc(), "issue_key")
    # a project without risky tickets is there by its first ones, which give no line
    top = predictions.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= keep)
    lines = _joined_lines(top.select(KEY, "_rank", F.when(high, _risk_line()).alias("line")), "_rank", "line")
    text = F.when(F.col("lines") == "", fv.NO_HIGH_RISK_TEXT).otherwise(F.col("lines"))
    return lines.select(KEY, text.alias("high_risk_digest"))


def score_digest(predictions):
    """The distribution of scores of each project as text."""
    summed = predictions.groupBy(KEY).agg(
        F.count("*").alias("n"), *_level_counts(), exact_mean(F.coalesce("risk_score", F.lit(0.0))).alias("mean")
    )
    text = F.concat(
        F.lit("Risk Distribution: "),
        F.col("high_risk").cast("string"),
        F.lit(" High, "),
        F.col("medium_risk").cast("string"),
        F.lit(" Medium, "),
        F.col("low_risk").cast("string"),
        F.lit(" Low\nAverage Risk Score: "),
        percent(F.col("mean"), 2),
        F.lit("\nTotal Tickets Scored: "),
        F.col("n").cast("string"),
    )
    return summed.select(KEY, text.alias("score_digest"))


def sentiment_digest(series, anomalies):
    """Mood and the first anomalies of each project as text."""
    mood = sentiment_outlook(series)
    counts = anomalies.groupBy(KEY).agg(F.count("*").alias("anomalies"))
    line = F.concat(
        F.lit("- "),
        F.col("window_start"),
        F.lit(": sentiment="),
        fixed(F.col("avg_sentiment"), 3),
        F.lit(", z-score="),
        fixed(F.col("z_score"), 2),
    )
    first = first_anomalies(anomalies).select(KEY, "anomaly_rank", line.alias("line"))
    lines = _joined_lines(first, "anomaly_rank", "line")
    head = F.concat(
        F.lit("Overall team sentiment is "),
        F.col("outlook"),
        F.lit(" (avg: "),
        fixed(F.col("recent_sentiment"), 3),
        F.lit(")."),
    )
    tail = F.concat(
        F.lit("\n\n"), F.col("anomalies").cast("string"), F.lit(" sentiment anomalies detected:\n"), F.col("lines")
    )
    joined = mood.join(counts, KEY, "left").join(lines, KEY, "left")
    return joined.select(KEY, F.concat(head, F.coalesce(tail, F.lit(""))).alias("sentiment_digest"))


REPORT_KEYS = (
    "executive_summary",
    "key_accomplishments",
    "critical_risks",
    "blockers",
    "sentiment_outlook",
    "mitigation_plan",
    "next_week_focus",
)


def report_context(predictions, series, anomalies, period):
    """One prompt row per project: the facts and the three digests."""
    joined = (
        report_facts(predictions)
        .join(high_risk_digest(predictions), KEY, "left")
        .join(score_digest(predictions), KEY, "left")
        .join(sentiment_digest(series, anomalies), KEY, "left")
    )
    counts = [
        ("Tickets", "total_tickets"),
        ("Completed", "completed"),
        ("In progress", "in_progress"),
        ("High risk", "high_risk"),
        ("Medium risk", "medium_risk"),
        ("Low risk", "low_risk"),
    ]
    facts = [F.concat(F.lit(f"{label}: "), F.col(name).cast("string")) for label, name in counts]
    prompt = F.concat_ws(
        "\n",
        F.concat(F.lit("Write the weekly status report of project "), F.col(KEY), F.lit(f" for {period}.")),
        *facts,
        F.lit("<tickets>"),
        F.col("high_risk_digest"),
        F.lit("</tickets>\n<sentiment>"),
        F.coalesce("sentiment_digest", F.lit(fv.NO_SENTIMENT_TEXT)),
        F.lit("</sentiment>\n<scores>"),
        F.coalesce("score_digest", F.lit(fv.NO_PREDICTIONS_TEXT)),
        F.lit("</scores>\nAnswer with one JSON object with the keys " + ", ".join(REPORT_KEYS) + "."),
    )
    return joined.select(KEY, prompt.alias("prompt"))


def classification_prompts(tickets):
    """One row per ticket asking for its category; long descriptions are cut."""
    shown = F.substring(F.coalesce("description", F.lit("")), 1, fv.PROMPT_DESCRIPTION_CHARS)
    prompt = F.concat_ws(
        "\n",
        F.lit("Name the category, complexity_assessment and rationale of this ticket as JSON."),
        F.concat(F.lit("Key: "), F.coalesce("issue_key", F.lit("N/A"))),
        F.concat(F.lit("Summary: "), F.coalesce("summary", F.lit(""))),
        F.concat(F.lit("Description: "), shown),
        F.concat(F.lit("Type: "), F.coalesce("issue_type", F.lit(""))),
        F.concat(F.lit("Status: "), F.coalesce("status", F.lit(""))),
        F.concat(F.lit("Story Points: "), F.coalesce("story_points", F.lit(0.0)).cast("string")),
    )
    return tickets.select("issue_key", prompt.alias("prompt"))


def explanation_prompts(predictions, importance, k=fv.TOP_FACTORS, context=fv.NO_CONTEXT_TEXT):
    """One row per ticket asking why it is at risk, with its factors as lines, built in place."""
    lines = F.transform(
        factor_list(predictions, importance, k),
        lambda factor: F.concat(
            F.lit("- "),
            factor["feature"],
            F.lit(": value="),
            factor["value"].cast("string"),
            F.lit(", importance="),
            factor["importance"].cast("string"),
        ),
    )
    prompt = F.concat_ws(
        "\n",
        F.lit("Explain in two or three sentences why this ticket is at risk."),
        F.concat(F.lit("Key: "), F.coalesce("issue_key", F.lit("N/A"))),
        F.concat(F.lit("Summary: "), F.coalesce("summary", F.lit(""))),
        F.concat(F.lit("Status: "), F.coalesce("status", F.lit(""))),
        F.concat(F.lit("Risk Score: "), percent(F.coalesce("risk_score", F.lit(0.0)))),
        F.concat(F.lit("Risk Level: "), F.coalesce("risk_level", F.lit("Unknown"))),
        F.array_join(lines, "\n"),
        F.lit(context or fv.NO_CONTEXT_TEXT),
    )
    return predictions.select("issue_key", prompt.alias("prompt"))


def anomaly_prompts(anomalies, keep=fv.ANOMALIES_KEPT):
    """One row per anomaly to be looked into."""
    prompt = F.concat(
        F.lit("Sentiment of project "),
        F.col(KEY),
        F.lit(" dropped in the window "),
        F.col("window_start"),
        F.lit(" to "),
        fixed(F.col("avg_sentiment"), 3),
        F.lit(" (z-score "),
        fixed(F.col("z_score"), 2),
        F.lit(") over "),
        F.col("message_count").cast("string"),
        F.lit(" messages. Answer with JSON keys hypothesis, recommended_action, severity (low, medium, high)."),
    )
    return first_anomalies(anomalies, keep).select(KEY, "window_start", prompt.alias("prompt"))
