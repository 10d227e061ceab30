"""Tickets, messages and documents read from the star-schema tables.

An order is a ticket, its line items are its sprints, links and comments, an
event is a chat message. Sprints and links stay in the line-item table and are
counted there by one aggregation, so no ticket carries an array that could grow
with a hot order.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lateline.functions.numbers import choose, iso_text
from lateline.functions.text import word_count
from lateline.operators.sentiment import score_text
from lateline.sources.staging import spread

AS_OF = "2001-12-01T00:00:00Z"
MESSAGES_AS_OF = "2024-01-31T00:00:00Z"

PRIORITY = {"1-URGENT": "Highest", "2-HIGH": "High", "3-MEDIUM": "Medium", "5-LOW": "Low"}
STATUS = {"F": "Done", "P": "In Progress", "O": "To Do"}
ISSUE_TYPES = ("Bug", "Story", "Task", "Epic", "Sub-task", "Spike", "Other")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SPRINT_DISCOUNT, LINK_DISCOUNT = 0.08, 0.02

EVENT_TEXT = {
    "click": "Merged the change and it looks good, thanks!",
    "error": "We are blocked: an outage broke the build and the rollback failed.",
    "purchase": "Shipped the feature, milestone resolved and on track.",
    "signup": "Not sure about this hotfix, it is a workaround and adds tech debt.",
    "view": "Reviewed the weekly notes.",
}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark, sf_dir, name="documents"):
    """A table whose rows take real work, spread over the cores where it is small."""
    return spread(table(spark, sf_dir, name))


def _number_list(column, values):
    cases = {position: value for position, value in enumerate(values[:-1])}
    return choose(column, cases, values[-1])


def order_measures(lineitem):
    """What a ticket's line items say: points, comments, sprints and links."""
    sprint = F.col("l_discount") >= SPRINT_DISCOUNT
    link = F.col("l_discount") <= LINK_DISCOUNT
    return lineitem.groupBy("l_orderkey").agg(
        F.count("*").cast("double").alias("story_points"),
        F.sum("l_linenumber").cast("long").alias("comment_count"),
        F.count_if(sprint).alias("sprint_count"),
        F.concat(F.lit("Sprint "), F.max(F.when(sprint, F.col("l_linenumber")))).alias("current_sprint_name"),
        F.count_if(link).alias("link_count"),
        F.count_if(link & (F.col("l_returnflag") == "R")).alias("blocker_count"),
    )


def ticket_heads(spark, sf_dir, order_key=None):
    """The ticket columns that come from orders and customers alone; of one order if its key is given."""
    if order_key is None:
        orders = texts(spark, sf_dir, "orders")
    else:
        orders = table(spark, sf_dir, "orders").where(F.col("o_orderkey") == order_key)
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    created = F.col("o_orderdate").cast("timestamp")
    as_of = F.lit(AS_OF).cast("timestamp")
    idle = ((key * 13 + customer * 7) % 30) * F.when(key % 10 == 0, 5).otherwise(1)
    resolved = F.when(
        F.col("o_orderstatus") == "F", created + F.make_interval(days=((key * 37) % 120).cast("int"))
    )
    return joined.select(
        key.alias("order_key"),
        key.cast("string").alias("issue_id"),
        F.concat_ws("-", "c_mktsegment", key.cast("string")).alias("issue_key"),
        F.col("c_mktsegment").alias("project_key"),
        F.concat(F.lit("Order "), key.cast("string"), F.lit(" "), F.col("o_orderpriority")).alias("summary"),
        choose(F.col("o_orderstatus"), STATUS, None).alias("status"),
        choose(F.col("o_orderstatus"), STATUS, None).alias("status_category"),
        choose(F.col("o_orderpriority"), PRIORITY, None).alias("priority"),
        _number_list(key % 7, ISSUE_TYPES).alias("issue_type"),
        F.when(customer % 17 != 0, F.concat(F.lit("engineer_"), (customer % 50).cast("string"))).alias("assignee"),
        F.concat(F.lit("pm_"), (customer % 5).cast("string")).alias("reporter"),
        created.alias("created"),
        F.greatest(created, as_of - F.make_interval(days=idle.cast("int"))).alias("updated"),
        F.when(key % 2 == 0, created + F.make_interval(days=F.lit(60))).alias("due_date"),
        resolved.alias("resolution_date"),
        (key * 7919 % 10000 / 10000).alias("rule_score"),
    )


def tickets(spark, sf_dir, description="words", order_key=None):
    """Tickets with their measures; that of one order if its key is given.

    description="words" counts the words of each document once, before the join,
    so no text is shuffled; a number carries so many characters of the text; None
    leaves it out.
    """
    heads = ticket_heads(spark, sf_dir, order_key)
    items = table(spark, sf_dir, "lineitem")
    measures = order_measures(items if order_key is None else items.where(F.col("l_orderkey") == order_key))
    joined = heads.join(measures, heads.order_key == measures.l_orderkey, "left").drop("l_orderkey")
    zeros = {name: F.coalesce(name, F.lit(0)) for name in ("comment_count", "sprint_count", "link_count", "blocker_count")}
    joined = joined.withColumns(zeros)
    if description is None:
        return joined
    documents = texts(spark, sf_dir)
    size = table(spark, sf_dir, "documents").agg(F.count("*")).scalar()
    if description == "words":
        carried = documents.select("doc_id", word_count(F.col("text")).alias("description_word_count"))
    else:
        carried = documents.select("doc_id", F.substring("text", 1, description).alias("description"))
    pointed = joined.withColumn("doc_id", F.col("order_key") % size)
    return pointed.join(carried, "doc_id", "left").drop("doc_id")


def raw_messages(spark, sf_dir):
    """Events as chat messages, scored by their value."""
    return messages_of(texts(spark, sf_dir, "events"))


def messages_of(events):
    sent = F.col("ts").cast("timestamp")
    channel = F.col("user_id") % 5
    return events.select(
        "event_id",
        _number_list(channel, SEGMENTS).alias("project_key"),
        F.concat(F.lit("C"), channel.cast("string")).alias("channel_id"),
        (F.unix_micros(sent) / 1_000_000).cast("decimal(18,6)").cast("string").alias("message_ts"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_id"),
        choose(F.col("event_type"), EVENT_TEXT, None).alias("text"),
        F.lit(None).cast("string").alias("thread_ts"),
        F.lit(0).cast("long").alias("reply_count"),
        F.get_json_object("props", "$.k").cast("long").alias("reaction_count"),
        iso_text(sent).alias("datetime_utc"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (50 - F.col("value")) / 100)).alias("sentiment_score"),
    )


def scored_messages(spark, sf_dir):
    """The same messages scored from their text."""
    return raw_messages(spark, sf_dir).withColumn("sentiment_score", score_text(F.col("text")))


POINTS_FIELD, SPRINT_FIELD = "customfield_10016", "customfield_10020"


def raw_issues(spark, sf_dir):
    """Orders as nested tracker issues (id, key, fields), with the oddities of real ones:
    null objects, points that are no number, sprints as objects and as texts."""
    return _orders_with_segments(spark, sf_dir).select(*_issue_columns())


def _orders_with_segments(spark, sf_dir):
    orders = texts(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customers, orders.o_custkey == customers.c_custkey)


def _issue_columns():
    """id, key and fields of an order's issue."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    text = key.cast("string")

    def named(column):
        return F.when(column.isNotNull(), F.struct(column.alias("name")))

    def person(column):
        return F.when(column.isNotNull(), F.struct(column.alias("displayName")))

    status = choose(F.col("o_orderstatus"), STATUS, None)
    sprint_object = F.to_json(
        F.struct(
            text.alias("id"),
            F.concat(F.lit("Sprint "), text).alias("name"),
            F.lit("closed").alias("state"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("startDate"),
        )
    )
    sprint_text = F.concat(
        F.lit("com.example.Sprint@"), text, F.lit("[id="), text, F.lit(",name=Late "), text, F.lit(",state=ACTIVE,completeDate=<null>]")
    )
    sprints = F.when(key % 3 == 0, F.array(F.parse_json(sprint_object))).when(
        key % 3 == 1, F.array(F.parse_json(sprint_object), sprint_text.cast("variant"), F.lit("unreadable").cast("variant"))
    )
    other = F.struct(F.concat(F.col("c_mktsegment"), F.lit("-"), (key + 1).cast("string")).alias("key"))
    links = F.when(
        key % 4 == 0,
        F.array(
            F.struct(F.struct(F.lit("Blocks").alias("name")).alias("type"), other.alias("outwardIssue"), F.lit(None).cast("struct<key:string>").alias("inwardIssue")),
            F.struct(F.struct(F.lit("Relates").alias("name")).alias("type"), F.lit(None).cast("struct<key:string>").alias("outwardIssue"), other.alias("inwardIssue")),
        ),
    )
    fields = F.struct(
        F.struct(F.col("c_mktsegment").alias("key")).alias("project"),
        F.concat(F.lit("Order "), text).alias("summary"),
        F.when(
            key % 11 != 0,
            F.concat(F.lit("Ask buyer"), customer.cast("string"), F.lit("@example.com about host 10.0."), (key % 250).cast("string"), F.lit(".7 and order "), text),
        ).alias("description"),
        F.struct(status.alias("name"), named(status).alias("statusCategory")).alias("status"),
        named(choose(F.col("o_orderpriority"), PRIORITY, None)).alias("priority"),
        named(_number_list(key % 7, ISSUE_TYPES)).alias("issuetype"),
        person(F.when(customer % 17 != 0, F.concat(F.lit("engineer_"), (customer % 50).cast("string")))).alias("assignee"),
        person(F.concat(F.lit("pm_"), (customer % 5).cast("string"))).alias("reporter"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'").alias("created"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'").alias("updated"),
        F.when(key % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("duedate"),
        F.when(key % 13 == 0, "unknown").otherwise((key % 14).cast("string")).alias(POINTS_FIELD),
        sprints.alias(SPRINT_FIELD),
        F.array(F.lit("backend"), choose(F.col("o_orderstatus"), STATUS, None)).alias("labels"),
        F.array(F.struct(F.concat(F.lit("part "), (key % 9).cast("string")).alias("name"))).alias("components"),
        links.alias("issuelinks"),
        F.struct((key % 21).alias("total")).alias("comment"),
    )
    return text.alias("id"), F.concat_ws("-", "c_mktsegment", text).alias("key"), fields.alias("fields")


def raw_issue_pages(spark, sf_dir):
    """One landed page, as JSON text in `value`, per issue."""
    issue = F.struct("id", "key", "fields")
    page = F.struct(F.lit(0).alias("startAt"), F.lit(1).alias("total"), F.array(issue).alias("issues"))
    return raw_issues(spark, sf_dir).select(F.to_json(page).alias("value"))


PAGE_SIZE = 10


def issue_page_sets(spark, sf_dir):
    """Each project's issues as pages of PAGE_SIZE, as JSON text in `value`, damaged on their way in all projects but one.

    Every 17th page is lost, every 23rd cut short, every 29th landed twice.
    """
    # numbered as orders, which are a seventh of their issues
    ordered = Window.partitionBy("project").orderBy("o_orderkey")
    orders = _orders_with_segments(spark, sf_dir).withColumn("project", F.col("c_mktsegment"))
    issues = orders.withColumns({"pos": F.row_number().over(ordered) - 1, "total": F.count("*").over(Window.partitionBy("project"))})
    issues = issues.select("project", "pos", "total", *_issue_columns())
    page = F.floor(F.col("pos") / PAGE_SIZE).alias("page")
    pages = issues.groupBy("project", "total", page).agg(
        F.min("pos").cast("long").alias("startAt"), F.collect_list(F.struct("id", "key", "fields")).alias("issues")
    )
    value = F.to_json(F.struct("startAt", "total", "issues"))
    hurt = F.col("project") != "MACHINERY"
    cut, twice = hurt & (F.col("page") % 23 == 7), hurt & (F.col("page") % 29 == 3)
    half = F.substr(value, F.lit(1), F.floor(F.length(value) / 2).cast("int"))
    landed = pages.where(~(hurt & (F.col("page") % 17 == 5)))
    landed = landed.select("project", F.when(cut, half).otherwise(value).alias("value"), F.when(twice & ~cut, 2).otherwise(1).alias("times"))
    return landed.select("project", "value", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")).drop("time")


def raw_message_pages(spark, sf_dir):
    """Events as landed channel pages, as JSON text in `value`; some are notices or blank."""
    events = texts(spark, sf_dir, "events")
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    message = F.struct(
        F.when(kind == "signup", "channel_join").alias("subtype"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user"),
        F.when(kind == "view", " \n").otherwise(choose(kind, EVENT_TEXT, None)).alias("text"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy").alias("team"),
        F.col("event_id").cast("string").alias("ts"),
        F.when(k % 2 == 0, k).alias("reply_count"),
        F.when(k % 3 != 0, F.array(F.struct(F.lit("up").alias("name"), k.alias("count")), F.struct(F.lit("eyes").alias("name"), F.lit(1).alias("count")))).alias("reactions"),
    )
    channel = F.concat(F.lit("C"), (F.col("user_id") % 5).cast("string"))
    return events.select(F.to_json(F.struct(channel.alias("channel"), F.array(message).alias("messages"))).alias("value"))


def sprint_texts(lineitem):
    """A serialized sprint per line item: some without brackets, some with a repeated
    key or an equals sign in a value."""
    n = F.col("l_linenumber").cast("string")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    name = (
        F.when(F.col("l_linenumber") == 3, F.concat(F.lit("Old "), n, F.lit(",name= New "), n))
        .when(F.col("l_linenumber") == 5, F.concat(F.lit("a=b "), n))
        .otherwise(F.concat(F.lit("Sprint "), n))
    )
    text = F.concat(
        F.lit("com.example.Sprint@1f[id="), n, F.lit(",name="), name, F.lit(",state="), F.col("l_linestatus"),
        F.lit(",goal,startDate="), day, F.lit(",endDate=<null>]"),
    )
    return lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("no sprint "), n)).otherwise(text).alias("entry"),
    )


def replies(events):
    """A model reply per event: fenced JSON, JSON in prose, plain JSON, prose, broken JSON."""
    number = F.col("event_id").cast("string")
    risk = F.concat(F.lit('{"title":"r","affected_tickets":["A-'), number, F.lit('","B-'), number, F.lit('"]}'))
    single = F.concat(F.lit('{"title":"s","affected_tickets":"C-'), number, F.lit('"}'))
    body = F.concat(F.lit('{"hypothesis":"load '), number, F.lit('","severity":"high","critical_risks":['), risk, F.lit(","), single, F.lit("]}"))
    raw = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.col("event_type") == "error", F.concat(F.lit("Here it is: "), body, F.lit(" as asked.")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("  "), body, F.lit("\n")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("No JSON in reply "), number))
        .otherwise(F.concat(F.lit('Broken {"hypothesis": '), number, F.lit(",}")))
    )
    return events.select("event_id", raw.alias("raw"))


def alert_envelopes(events):
    """A delivered alert per event: drift alerts, quality alerts, malformed messages."""
    drift = F.to_json(F.struct(F.lit("MODEL_DRIFT_DETECTED").alias("alert_type"), F.col("value").alias("overall_drift_pct")))
    quality = F.to_json(F.struct(F.lit("DATA_QUALITY_VIOLATION").alias("alert_type"), F.lit("P").alias("project_key")))
    message = (
        F.when(F.col("event_type") == "error", drift)
        .when(F.col("event_type") == "view", quality)
        .otherwise(F.concat(F.lit("not json "), F.col("event_id").cast("string")))
    )
    record = F.struct(F.struct(message.alias("Message")).alias("Sns"))
    return events.select("event_id", F.to_json(F.struct(F.array(record).alias("Records"))).alias("envelope"))


# what the secret of each kind stands in; the text is read by both engines
_PLANTED = (
    "concat(chr(10), 'AKIA', upper(substr(md5(coalesce(text, '')), 1, 16)), ' is our access')",
    "concat(chr(10), 'api_key: \"', md5(coalesce(text, '')), '\"')",
    "concat(chr(10), 'see postgres://app:', md5(coalesce(text, '')), '@db.internal:5432/app for rows')",
    "concat(chr(10), '-----BEGIN RSA PRIVATE KEY-----', chr(10), md5(coalesce(text, '')), chr(10), '-----END RSA PRIVATE KEY-----', chr(10))",
)
SECRETS_SQL = "concat(coalesce(text, ''), {})".format(
    ", ".join(f"CASE WHEN doc_id % 7 IN ({kind}, 4) THEN {secret} ELSE '' END" for kind, secret in enumerate(_PLANTED))
)


def with_secrets(documents):
    """Texts with one secret of the kind doc_id mod 7 (0 to 3) or all four (4) at their end; the rest as they are."""
    return documents.withColumn("text", F.expr(SECRETS_SQL))
