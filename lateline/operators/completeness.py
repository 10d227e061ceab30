"""Are all pages of a result there? Page ranges merged and held against the declared total.

A crawler asks for a result page by page; every page says where it starts and
how many records the whole result has. A page that was lost, landed twice or cannot be
read leaves a gap or an overlap in the ranges of its set.

Ranges are merged without gathering a set: positions are cut into slices, each slice knows
how far the slices before it reach, and a running maximum inside a slice does
the rest. So a set of very many pages is spread over tasks.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

SLICE = 1 << 20  # positions; a window over one set sees one row per slice
_SET = ("page_set", "project_key")


def _ranges(pages, slice_size):
    """Readable pages with records: their range, and the furthest end of all pages that start before."""
    start, end = F.coalesce("start", F.lit(0)), F.coalesce("start", F.lit(0)) + F.col("n")
    pages = pages.where(~F.col("rejected") & (F.col("n") > 0))
    ranges = pages.select("page_set", "project_key", start.alias("start"), end.alias("end"), F.floor(start / slice_size).alias("slice"))
    reach = ranges.groupBy("page_set", "slice").agg(F.max("end").alias("reach"))
    earlier = Window.partitionBy("page_set").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    reach = reach.select(F.col("page_set").alias("of"), F.col("slice").alias("at"), F.coalesce(F.max("reach").over(earlier), F.lit(0)).alias("carried"))
    placed = ranges.join(reach, (F.col("page_set").eqNullSafe(F.col("of"))) & (F.col("slice") == F.col("at"))).drop("of", "at")
    before = Window.partitionBy("page_set", "slice").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.max("end").over(before), F.lit(0))
    return placed.withColumn("reached", F.greatest("carried", inside)).drop("slice", "carried")


def page_sets(pages, slice_size=SLICE):
    """One row per set of `pages` (page_set, project_key, start, n, total, rejected).

    `total` is the largest declared; `received` counts records, `repeated` positions that were
    there before, `missing` positions up to the total that no page covers. A set is
    complete if nothing is missing and no page was rejected. A page without a start
    begins at 0; without any total the furthest end counts; a null page_set is a set.
    """
    facts = pages.groupBy("page_set").agg(
        F.min("project_key").alias("project_key"),
        F.count("*").alias("pages"),
        F.count_if("rejected").alias("rejects"),
        F.max(F.when(~F.col("rejected"), F.col("total"))).alias("declared"),
    )
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reached"))
    covered = _ranges(pages, slice_size).groupBy(F.col("page_set").alias("of")).agg(
        F.sum(F.col("end") - F.col("start")).alias("received"),
        F.sum(new).alias("covered"),
        F.max("end").alias("furthest"),
    )
    joined = facts.join(covered, F.col("page_set").eqNullSafe(F.col("of")), "left")
    received, seen = (F.coalesce(name, F.lit(0)) for name in ("received", "covered"))
    total = F.greatest(F.coalesce("declared", F.lit(0)), F.coalesce("furthest", F.lit(0)))
    missing = total - seen
    return joined.select(
        "page_set",
        "project_key",
        "pages",
        "rejects",
        total.alias("total"),
        received.alias("received"),
        (received - seen).alias("repeated"),
        missing.alias("missing"),
        ((missing == 0) & (F.col("rejects") == 0)).alias("complete"),
    )


def page_gaps(pages, slice_size=SLICE):
    """(page_set, project_key, gap_start, gap_end) of every run of positions that no page of a set covers."""
    ranges = _ranges(pages, slice_size)
    inner = ranges.where(F.col("start") > F.col("reached")).select("page_set", F.col("reached").alias("gap_start"), F.col("start").alias("gap_end"))
    # a set none of whose pages has records has no range: its gap starts at 0
    ends = ranges.groupBy(F.col("page_set").alias("of")).agg(F.max("end").alias("furthest"))
    sets = pages.groupBy("page_set").agg(F.min("project_key").alias("project_key"), F.max(F.when(~F.col("rejected"), F.col("total"))).alias("declared"))
    outer = sets.join(ends, F.col("page_set").eqNullSafe(F.col("of")), "left")
    outer = outer.select("page_set", F.coalesce("furthest", F.lit(0)).alias("gap_start"), F.col("declared").alias("gap_end")).where("gap_end > gap_start")
    gaps = inner.distinct().unionByName(outer).withColumnRenamed("page_set", "of")
    return gaps.join(sets, F.col("page_set").eqNullSafe(F.col("of"))).select("page_set", "project_key", "gap_start", "gap_end")


def incomplete_projects(sets):
    """(project_key, error) of projects with an incomplete set, in words for the ingestion summary."""
    broken = sets.where(~F.col("complete") & F.col("project_key").isNotNull())
    summed = broken.groupBy("project_key").agg(F.sum("missing").alias("missing"), F.sum("total").alias("total"), F.sum("rejects").alias("rejects"))
    words = F.concat(F.lit("missing "), F.col("missing"), F.lit(" of "), F.col("total"), F.lit(" records, unreadable pages: "), F.col("rejects"))
    return summed.select("project_key", words.alias("error"))
