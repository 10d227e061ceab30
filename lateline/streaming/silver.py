"""Landed pages to redacted silver tickets, each file once; into a folder, or into the lake with their rejects."""

from pyspark.sql import functions as F

from lateline import fixed_values as fv
from lateline.functions.numbers import moment
from lateline.operators.flatten import explode_issues, flatten_issues
from lateline.operators.redaction import redact_records
from lateline.plans.ingestion import REJECTS
from lateline.schemas import issue_page
from lateline.sources.pages import page_texts, tickets_and_rejects
from lateline.sources.staging import settled


def page_stream(spark, path, points_field, sprint_field, files_per_trigger=1000):
    """Issue pages as they land in a folder, with a declared schema."""
    reader = spark.readStream.schema(issue_page(points_field, sprint_field))
    return reader.option("maxFilesPerTrigger", files_per_trigger).json(path)


def silver_tickets(pages, points_field, sprint_field, run_date=None):
    tickets = flatten_issues(explode_issues(pages), points_field, sprint_field, run_date)
    clean = redact_records(tickets, fv.TICKET_TEXT_FIELDS)
    day = F.date_format(moment(run_date), "yyyy-MM-dd")
    return clean.withColumns({"project": F.col("project_key"), "date": day})


def write_silver(tickets, path, checkpoint):
    """Process what has landed, then stop. The checkpoint remembers the files."""
    writer = tickets.writeStream.format("parquet").partitionBy("project", "date")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def page_batch(lake, points_field, sprint_field, run_date=None, source="jira", stream="pages"):
    """What stores one batch (file, value) of landed pages in a lake: tickets in bronze and silver, unreadable pages as rejects.

    The batch is a run of the lake named after the stream and the batch, so one that is
    repeated after a failure replaces what it stored before, in all three places.
    """

    def store(batch, batch_id):
        run_id = f"{stream}-{batch_id:012d}"
        tickets, rejects = tickets_and_rejects(batch, points_field, sprint_field, run_date)
        lake.write_bronze(rejects, source + REJECTS, run_date, run_id=run_id)
        # a source can repeat its batch; kept in memory, the texts of a large one would go to the executors' disks
        with settled(tickets, "fresh") as fresh:
            lake.write_bronze(fresh, source, run_date, run_id=run_id)
            lake.write_silver(redact_records(fresh, fv.TICKET_TEXT_FIELDS), source, run_date, run_id=run_id)

    return store


def stream_pages(lake, path, points_field, sprint_field, checkpoint, files_per_trigger=1000, multi_line=False, **batch):
    """Landed issue pages into the lake as they come; processes what is there, then stops.

    Pages are read as text, so none vanishes for being no JSON of the declared schema.
    """
    reader = lake.spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    writer = page_texts(reader, path, multi_line).writeStream.option("checkpointLocation", checkpoint)
    return writer.foreachBatch(page_batch(lake, points_field, sprint_field, **batch)).trigger(availableNow=True).start()
