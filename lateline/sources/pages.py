"""Landed API pages: files with one JSON page per line or file."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lateline.operators.flatten import explode_issues, explode_messages, flatten_issues, flatten_messages
from lateline.schemas import FIELD, MESSAGE_PAGE, issue_page


_BROKEN = "_broken"


def _read_pages(spark, path, schema, multi_line):
    return parsed_pages(page_texts(spark.read, path, multi_line), schema)


def page_texts(reader, path, multi_line=False):
    """(file, value) of landed pages, by a batch or a stream reader."""
    return reader.text(path, wholetext=multi_line).select(F.col("_metadata.file_path").alias("file"), "value")


def parsed_pages(pages, schema):
    """The rows of `pages` (file, value) that are not blank, with `page`; where it cannot be read, page._broken has the text."""
    marked = T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())])
    read = F.from_json("value", marked, {"columnNameOfCorruptRecord": _BROKEN, "mode": "PERMISSIVE"})
    return pages.where(F.trim("value") != "").withColumn("page", read)


def _named_project():
    """The project that a folder project=KEY on a file's way names, or null."""
    return F.try_url_decode(F.nullif(F.regexp_extract("file", r"/project=([^/]+)/", 1), F.lit("")))


def _unreadable():
    return F.coalesce(F.col(f"page.{_BROKEN}").isNotNull() | F.col("page").isNull(), F.lit(True))


def tickets_and_rejects(pages, points_field, sprint_field, ingested_at=None):
    """(tickets, rejects) of landed issue pages (file, value), each page in one of them."""
    read = parsed_pages(pages, issue_page(points_field, sprint_field)).withColumn("_bad", _unreadable())
    whole = explode_issues(read.where(~F.col("_bad")).select("page.*").drop(_BROKEN))
    rejects = read.where("_bad").select(_named_project().alias("project_key"), "file", F.col("value").alias("raw"), F.lit("unreadable page").alias("reason"))
    return flatten_issues(whole, points_field, sprint_field, ingested_at), rejects


def rejected_pages(spark, path, schema, multi_line=False):
    """(file, raw) of the landed pages that are no JSON of the declared schema.

    The readers below give no rows for such a page; here it is kept as it landed.
    """
    filled = _read_pages(spark, path, schema, multi_line)
    return filled.where(F.col(f"page.{_BROKEN}").isNotNull()).select("file", F.col("value").alias("raw"))


def issue_page_places(spark, path, points_field, sprint_field, multi_line=False):
    """(page_set, project_key, start, n, total, rejected, file, raw) of every landed issue page.

    The pages of one folder are one set. Its project is named by a folder
    project=KEY on the way, else by the issues. `raw` is null unless the page is rejected.
    """
    read = _read_pages(spark, path, issue_page(points_field, sprint_field), multi_line)
    folder, named = F.regexp_extract("file", r"^(.*)/[^/]*$", 1), _named_project()
    inside = F.array_min(F.transform("page.issues", lambda issue: issue["fields"]["project"]["key"]))
    rejected = _unreadable()
    return read.select(
        folder.alias("page_set"),
        F.coalesce(named, inside).alias("project_key"),
        F.col("page.startAt").alias("start"),
        F.coalesce(F.array_size("page.issues"), F.lit(0)).cast("long").alias("n"),
        F.col("page.total").alias("total"),
        rejected.alias("rejected"),
        "file",
        F.when(rejected, F.col("value")).alias("raw"),
    )


def rejected_issue_pages(spark, path, points_field, sprint_field, multi_line=False):
    return rejected_pages(spark, path, issue_page(points_field, sprint_field), multi_line)


def rejected_message_pages(spark, path, multi_line=False):
    return rejected_pages(spark, path, MESSAGE_PAGE, multi_line)


def read_fields(spark, path):
    """The tracker's field list."""
    return spark.read.schema(FIELD).json(path)


def read_issue_pages(spark, path, points_field, sprint_field, ingested_at=None, multi_line=False):
    """Tickets from landed issue pages."""
    pages = spark.read.schema(issue_page(points_field, sprint_field)).option("multiLine", multi_line).json(path)
    return flatten_issues(explode_issues(pages), points_field, sprint_field, ingested_at)


def read_message_pages(spark, path, oldest=None, latest=None, ingested_at=None, multi_line=False):
    """Scored messages from landed channel pages."""
    pages = spark.read.schema(MESSAGE_PAGE).option("multiLine", multi_line).json(path)
    return flatten_messages(explode_messages(pages), oldest, latest, ingested_at)
