"""Declared record schemas. Nothing on a hot path is inferred."""

from pyspark.sql import types as T

_S, _D, _L = T.StringType(), T.DoubleType(), T.LongType()


def _struct(**fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


SPRINT = _struct(sprint_id=_S, sprint_name=_S, sprint_state=_S, start_date=_S, end_date=_S, complete_date=_S)
LINK = _struct(type=_S, direction=_S, linked_issue=_S)

TICKET = _struct(
    issue_id=_S,
    issue_key=_S,
    project_key=_S,
    summary=_S,
    description=_S,
    status=_S,
    status_category=_S,
    priority=_S,
    issue_type=_S,
    assignee=_S,
    reporter=_S,
    created=_S,
    updated=_S,
    due_date=_S,
    resolution_date=_S,
    story_points=_D,
    labels=T.ArrayType(_S),
    components=T.ArrayType(_S),
    sprint_history=T.ArrayType(SPRINT),
    issue_links=T.ArrayType(LINK),
    comment_count=_L,
    ingested_at=_S,
)

MESSAGE = _struct(
    channel_id=_S,
    message_ts=_S,
    user_id=_S,
    text=_S,
    sentiment_score=_D,
    thread_ts=_S,
    reply_count=_L,
    reaction_count=_L,
    datetime_utc=_S,
    ingested_at=_S,
)

SENTIMENT_SERIES = _struct(window_start=_S, avg_sentiment=_D, message_count=_L, std_dev=_D)

FEEDBACK = _struct(project_key=_S, timestamp=_S, feedback_type=_S, original_report=_S, edited_report=_S)

REDACTION = _struct(
    fields_scanned=T.ArrayType(_S),
    pii_detected=T.BooleanType(),
    entity_types_found=T.ArrayType(_S),
    redaction_incomplete=T.BooleanType(),
    secrets_found=_L,
)

SPAN = _struct(type=_S, score=_D, begin=T.IntegerType(), end=T.IntegerType())

BASELINE = _struct(
    feature=_S, mean=_D, std=_D, median=_D, p25=_D, p75=_D, min=_D, max=_D, count=_L
)

ALERT = _struct(alert_type=_S, project_key=_S, payload=_S, created_at=_S)

STATE = _struct(project_key=_S, last_ingest_date=_S)

REJECT = _struct(project_key=_S, file=_S, raw=_S, reason=_S)

# a raw message as the chat API returns it
_RAW_MESSAGE = _struct(
    type=_S,
    subtype=_S,
    user=_S,
    text=_S,
    ts=_S,
    thread_ts=_S,
    reply_count=_L,
    reactions=T.ArrayType(_struct(name=_S, count=_L)),
)
MESSAGE_PAGE = _struct(channel=_S, messages=T.ArrayType(_RAW_MESSAGE), has_more=T.BooleanType())

_NAMED = _struct(name=_S)
_PERSON = _struct(displayName=_S)
_KEYED = _struct(key=_S)


def raw_issue(points_field, sprint_field):
    """A raw issue as the tracker returns it; two custom field ids vary by site.

    Both custom fields are read as text: points are cast later so a bad value
    is null, and a sprint entry may be an object or a serialized string.
    """
    fields = _struct(
        project=_KEYED,
        summary=_S,
        description=_S,
        status=_struct(name=_S, statusCategory=_NAMED),
        priority=_NAMED,
        issuetype=_NAMED,
        assignee=_PERSON,
        reporter=_PERSON,
        created=_S,
        updated=_S,
        duedate=_S,
        resolutiondate=_S,
        labels=T.ArrayType(_S),
        components=T.ArrayType(_NAMED),
        issuelinks=T.ArrayType(_struct(type=_NAMED, outwardIssue=_KEYED, inwardIssue=_KEYED)),
        comment=_struct(total=_L),
    )
    custom = [T.StructField(points_field, _S), T.StructField(sprint_field, T.ArrayType(_S))]
    return _struct(id=_S, key=_S, fields=T.StructType(fields.fields + custom))


def issue_page(points_field, sprint_field):
    return _struct(startAt=_L, total=_L, issues=T.ArrayType(raw_issue(points_field, sprint_field)))


# one entry of the tracker's field list
FIELD = _struct(id=_S, name=_S, custom=T.BooleanType())
