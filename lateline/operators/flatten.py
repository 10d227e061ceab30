"""Nested API records to flat tickets and messages, and flat records to export rows."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lateline import fixed_values as fv
from lateline.functions.numbers import iso_text, moment, number, rounded
from lateline.functions.sprint import parse_sprint_history
from lateline.functions.text import is_issue_key, is_project_key
from lateline.operators.sentiment import score_text, sent_at


def resolve_field(fields, name):
    """The id of the tracker field with this name. The last of several wins.

    The id becomes part of the read schema, so this one value is looked up when
    the query is built.
    """
    placed = fields.where(F.col("name") == name).withColumn("_place", F.monotonically_increasing_id())
    found = placed.orderBy(F.col("_place").desc()).first()
    if found is None:
        raise KeyError(f"no field named {name!r}")
    return found["id"]


def _items(pages, items, *carry):
    """One row per item of a page. The outer form keeps Spark from putting a filter on
    the array below, which would parse a page twice."""
    return pages.select(*carry, F.explode_outer(items).alias("item")).where(F.col("item").isNotNull())


def explode_issues(pages):
    return _items(pages, "issues").select("item.*")


def flatten_issues(issues, points_field, sprint_field, ingested_at=None):
    """Issues (id, key, fields) as 22-column tickets. Any object may be null."""
    field = F.col("fields")
    links = F.transform(
        field["issuelinks"],
        lambda link: F.struct(
            link["type"]["name"].alias("type"),
            F.when(link["outwardIssue"].isNotNull(), "outward").otherwise("inward").alias("direction"),
            F.coalesce(link["outwardIssue"]["key"], link["inwardIssue"]["key"]).alias("linked_issue"),
        ),
    )
    texts = F.array().cast("array<string>")
    no_links = F.array().cast("array<struct<type:string,direction:string,linked_issue:string>>")
    return issues.select(
        F.col("id").alias("issue_id"),
        F.col("key").alias("issue_key"),
        field["project"]["key"].alias("project_key"),
        field["summary"].alias("summary"),
        field["description"].alias("description"),
        field["status"]["name"].alias("status"),
        field["status"]["statusCategory"]["name"].alias("status_category"),
        field["priority"]["name"].alias("priority"),
        field["issuetype"]["name"].alias("issue_type"),
        field["assignee"]["displayName"].alias("assignee"),
        field["reporter"]["displayName"].alias("reporter"),
        field["created"].alias("created"),
        field["updated"].alias("updated"),
        field["duedate"].alias("due_date"),
        field["resolutiondate"].alias("resolution_date"),
        number(field[points_field]).alias("story_points"),
        F.coalesce(field["labels"], texts).alias("labels"),
        F.coalesce(field["components"]["name"], texts).alias("components"),
        parse_sprint_history(field[sprint_field]).alias("sprint_history"),
        F.coalesce(links, no_links).alias("issue_links"),
        F.coalesce(field["comment"]["total"], F.lit(0)).cast("long").alias("comment_count"),
        iso_text(moment(ingested_at)).alias("ingested_at"),
    )


def explode_messages(pages):
    return _items(pages, "messages", "channel").select("channel", "item.*")


def flatten_messages(messages, oldest=None, latest=None, ingested_at=None, lexicon=None):
    """Raw channel messages as scored message records.

    Joins, leaves, bot posts and blank texts are dropped; `oldest` and `latest`
    are epoch seconds and bound the range.
    """
    text = F.coalesce("text", F.lit(""))
    blank = F.btrim(text, F.lit(fv.WHITE_SPACE_CHARACTERS)) == ""
    notice = F.coalesce("subtype", F.lit("")).isin(*fv.SKIPPED_MESSAGE_SUBTYPES)
    kept = messages.where(~notice & ~blank)
    if oldest is not None:
        kept = kept.where(number(F.col("ts")) >= float(oldest))
    if latest is not None:
        kept = kept.where(number(F.col("ts")) <= float(latest))
    reactions = F.aggregate(
        "reactions", F.lit(0).cast("long"), lambda total, r: total + F.coalesce(r["count"], F.lit(0).cast("long"))
    )
    return kept.select(
        F.col("channel").alias("channel_id"),
        F.col("ts").alias("message_ts"),
        F.col("user").alias("user_id"),
        text.alias("text"),
        score_text(text, lexicon).alias("sentiment_score"),
        "thread_ts",
        F.coalesce("reply_count", F.lit(0)).cast("long").alias("reply_count"),
        F.coalesce(reactions, F.lit(0)).cast("long").alias("reaction_count"),
        iso_text(sent_at(F.col("ts"))).alias("datetime_utc"),
        iso_text(moment(ingested_at)).alias("ingested_at"),
    )


def split_by_key(df, column, kind="project"):
    """(valid, invalid) rows by the format of a project or issue key."""
    good = (is_project_key if kind == "project" else is_issue_key)(F.col(column))
    return df.where(good), df.where(~good)


def export_clean(df):
    """Rows fit for export: no private columns, no NaN or infinity, ISO timestamps."""
    shown = []
    for field in df.schema:
        if field.name.startswith("_"):
            continue
        column = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = column.cast("double")
            broken = column.isNull() | F.isnan(column) | (F.abs(column) == float("inf"))
            column = F.when(broken, 0.0).otherwise(rounded(column, 4))
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = column.cast("timestamp")
            whole = F.unix_micros(column) % 1_000_000 == 0
            column = F.when(whole, F.date_format(column, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(
                F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
            )
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        shown.append(column.alias(field.name))
    return df.select(*shown)


def nested_to_json(df):
    """Array, map and struct columns as JSON text, chosen by the schema."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    names = [f.name for f in df.schema if isinstance(f.dataType, nested)]
    return df.withColumns({name: F.to_json(F.col(name)) for name in names}) if names else df
