"""Model replies as a table: JSON out of text, citations, anomaly analyses."""

from pyspark.sql import functions as F

from lateline import fixed_values as fv
from lateline.operators.sentiment import first_anomalies

_FENCE = "```"


def reply_text(raw):
    """The reply without blanks around it and, if it opens with a fence, without fence lines."""
    text = F.btrim(raw, F.lit(fv.WHITE_SPACE_CHARACTERS))
    lines = F.filter(
        F.split(text, "\n"),
        lambda line: ~F.btrim(line, F.lit(fv.WHITE_SPACE_CHARACTERS)).startswith(_FENCE),
    )
    return F.when(text.startswith(_FENCE), F.array_join(lines, "\n")).otherwise(text)


def parse_replies(df, raw="raw"):
    """Add `parsed` (variant) and `parse_error`.

    Where the whole text is no JSON, the part from the first { to the last } is
    tried; where that fails too, `parsed` is null and the raw text says the rest.
    """
    read = df.withColumn("_text", reply_text(F.col(raw)))
    inner = F.regexp_extract("_text", r"(?s)\{.*\}", 0)
    parsed = F.coalesce(F.try_parse_json("_text"), F.try_parse_json(F.nullif(inner, F.lit(""))))
    return read.withColumn("parsed", parsed).withColumn("parse_error", F.col("parsed").isNull()).drop("_text")


def cited_tickets(reports, key, parsed="parsed"):
    """The tickets each report cites under its critical risks, in order."""
    risks = F.try_variant_get(F.col(parsed), "$.critical_risks", "array<variant>")
    cited = reports.select(key, F.posexplode(risks).alias("risk_position", "_risk")).select(
        key, "risk_position", F.try_variant_get("_risk", "$.affected_tickets", "variant").alias("_cited")
    )
    many = F.try_variant_get("_cited", "$", "array<string>")
    one = F.when(F.schema_of_variant("_cited") == "STRING", F.array(F.try_variant_get("_cited", "$", "string")))
    tickets = cited.select(key, "risk_position", F.posexplode(F.coalesce(many, one)).alias("position", "ticket"))
    return tickets.where(F.col("ticket").isNotNull())


def anomaly_analysis(anomalies, replies, keys=("project_key", "window_start"), raw="raw", keep=fv.ANOMALIES_KEPT):
    """The first anomalies with the reply to each as JSON, or a stand-in where none came."""
    kept = first_anomalies(anomalies, keep)
    read = parse_replies(replies, raw)
    unread = F.to_json(F.struct(F.col(raw).alias("raw_response"), F.lit(True).alias("parse_error")))
    answer = read.select(*keys, F.coalesce(F.to_json("parsed"), unread).alias("analysis"))
    missing = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in fv.MISSING_ANALYSIS.items()]))
    return kept.join(answer, list(keys), "left").withColumn("analysis", F.coalesce("analysis", missing))
