"""Ingestion as one batch job for all projects or channels."""

from pyspark.sql import functions as F

from lateline import fixed_values as fv
from lateline.operators.alerts import quality_alerts
from lateline.operators.completeness import incomplete_projects, page_sets
from lateline.operators.incremental import advance_marks, ingestion_summary, since_mark, undated
from lateline.operators.quality import quality_report
from lateline.operators.redaction import redact_records, redaction_counts
from lateline.operators.sentiment import sentiment_anomalies, sentiment_series
from lateline.schemas import REJECT
from lateline.sources.lake import new_run_id
from lateline.sources.pages import issue_page_places, read_issue_pages
from lateline.sources.staging import settle, settled

REJECTS = "_rejects"  # behind a source's name: what could not be read


def ingest_tickets(lake, tickets, as_of=None, source="jira", rules=None, run_id=None, asked=None, errors=None, rejects=None):
    """Tickets to bronze and, redacted, to silver; alerts for projects failing a check.

    Only tickets at or after their project's mark are taken, and those whose update
    cannot be read, which are noted beside the `rejects` (project_key, file, raw, reason) of
    the load, in bronze under the source's name and REJECTS. With a `run_id` a run
    that failed half-way can be repeated: it replaces what it stored before, and the
    marks move last. Returns the summary per project, with the projects `asked` for
    that brought nothing and those in `errors` (project_key, error), whose marks stay.
    """
    state = lake.load_state()
    with settled(since_mark(tickets, state), "fresh") as fresh:
        lake.write_bronze(fresh, source, as_of, run_id=run_id)
        unclear = undated(fresh).select("project_key", F.lit(None).cast("string").alias("file"), F.to_json(F.struct(*fresh.columns)).alias("raw"), F.lit("unreadable update").alias("reason"))
        lake.write_bronze(unclear if rejects is None else unclear.unionByName(rejects), source + REJECTS, as_of, run_id=run_id)
        clean = settle(redact_records(fresh, fv.TICKET_TEXT_FIELDS), "clean")
        lake.write_silver(clean, source, as_of, run_id=run_id)
        report = quality_report(clean, rules, ["project_key"])
        lake.append_alerts(quality_alerts(report, as_of=as_of), run_id)
        whole = fresh if errors is None else fresh.join(errors.select("project_key"), "project_key", "left_anti")
        moved = advance_marks(state, whole).join(state.withColumnRenamed("last_ingest_date", "_before"), "project_key", "left")
        lake.save_state(moved.where(~F.col("last_ingest_date").eqNullSafe(F.col("_before"))).drop("_before"))
    return ingestion_summary(clean, report.summary, asked=asked, errors=errors)


def ingest_issue_pages(lake, path, points_field, sprint_field, as_of=None, source="jira", rules=None, run_id=None, asked=None, multi_line=False):
    """Landed issue pages to the lake: tickets as ingest_tickets has them, and what is wrong with the pages.

    Pages that cannot be read are stored as rejects. A project with a page lost or
    unreadable has the outcome `error`: what did arrive is stored, but its mark stays,
    so the next load asks for all of it again. Returns (summary, page sets).
    """
    run_id = run_id or new_run_id()
    places = settle(issue_page_places(lake.spark, path, points_field, sprint_field, multi_line), "places")
    sets = settle(page_sets(places), "sets")
    lost = places.where("rejected").select("project_key", "file", "raw", F.lit("unreadable page").alias("reason"))
    tickets = read_issue_pages(lake.spark, path, points_field, sprint_field, as_of, multi_line)
    errors = settle(incomplete_projects(sets), "errors")
    return ingest_tickets(lake, tickets, as_of, source, rules, run_id, asked, errors, lost), sets


def read_rejects(lake, source="jira"):
    """What loads of a source could not read: (project_key, file, raw, reason, project, date)."""
    return lake.read_bronze(source + REJECTS, REJECT)


def ingest_messages(lake, messages, as_of=None, source="slack", window_hours=24, threshold=fv.ANOMALY_SIGMAS, run_id=None):
    """Scored messages to bronze and silver, their series to gold.

    A run with an id replaces what it stored before; of the series readers take the
    newest run. Returns (counts per channel, series, anomalies).
    """
    run_id = run_id or new_run_id()
    fresh = settle(messages, "messages")
    lake.write_bronze(fresh, source, as_of, run_id=run_id)
    clean = settle(redact_records(fresh, fv.MESSAGE_TEXT_FIELDS), "clean")
    lake.write_silver(clean, source, as_of, run_id=run_id)
    series = settle(sentiment_series(clean, window_hours), "series")
    lake.write_gold(series, fv.SENTIMENT_FEATURE_SET, as_of, run_id=run_id)
    return redaction_counts(clean, ["project_key", "channel_id"]), series, sentiment_anomalies(series, threshold)
