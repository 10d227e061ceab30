"""Boilerplate lines by their frequency within a site.

A line is boilerplate on a host when the pages of that host that hold it are more
than a given share of all its pages. Lines are counted as 64-bit hashes of their
trimmed text, once per page; counts are partial sums, so a host with a third of
all pages is spread over all tasks. What remains per host is short: a page has on
average L lines, so at most L / ratio lines can stand on more than that share of
the pages. Only these lists meet the texts.
"""

from pyspark.sql import functions as F

from lateline.llm.common import SPACE, free_name
from lateline.sources.staging import settle

RATIO = 0.005  # share of a host's pages above which a line is boilerplate: licence lines stand on 0.6 % and more, copied pages on less
MIN_PAGES = 5  # on fewer pages than these a line is no boilerplate, so small sites keep their text


def _lines(text):
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def _hash(line):
    return F.xxhash64(F.trim(line, F.lit(SPACE)))


def boilerplate(docs, host, ratio=RATIO, min_pages=MIN_PAGES):
    """(host, line) hashes of the lines on more than `ratio` of a host's pages and at least `min_pages`.

    `host` is a column; a null host is a site like any other. Lines of white
    space only are never counted.
    """
    filled = F.filter(_lines(F.col("text")), lambda line: F.trim(line, F.lit(SPACE)) != "")
    pages = docs.select(F.coalesce(host.cast("string"), F.lit("")).alias("host"), host.isNull().alias("no_host"), F.array_distinct(F.transform(filled, _hash)).alias("lines"))
    totals = pages.groupBy("host", "no_host").agg(F.count("*").alias("pages"))
    counts = pages.select("host", "no_host", F.explode("lines").alias("line")).groupBy("host", "no_host", "line").agg(F.count("*").alias("n"))
    frequent = counts.where(F.col("n") >= min_pages).join(totals, ["host", "no_host"])
    return frequent.where(F.col("n") > F.col("pages") * ratio).select("host", "no_host", "line", "n", "pages")


def drop_boilerplate(docs, host="source", ratio=RATIO, min_pages=MIN_PAGES):
    """`docs` without boilerplate lines, with `n_lines_dropped`.

    `docs` has `text` and the column named by `host`; extra columns stay, one named
    n_lines_dropped is replaced. Every copy of a boilerplate line goes; other
    lines, order and white space stay. A null text stays null. No row is dropped,
    a page of boilerplate alone is left with an empty text.
    """
    docs = docs.drop("n_lines_dropped")
    found = boilerplate(docs, F.col(host), ratio, min_pages)
    bad, site, no_site, hits, kept_lines = (free_name(docs, f"__{name}") for name in ("bad", "host", "no_host", "hit", "kept"))
    lists = settle(found.groupBy("host", "no_host").agg(F.collect_list("line").alias(bad)), "boilerplate")
    lists = lists.withColumnsRenamed({"host": site, "no_host": no_site})
    keyed = docs.withColumns({site: F.coalesce(F.col(host).cast("string"), F.lit("")), no_site: F.col(host).isNull()})
    joined = keyed.join(lists, [site, no_site], "left")
    # few of a page's lines are on the list, so each line is compared with those few only
    own = F.array_intersect(F.transform(_lines(F.col("text")), _hash), F.coalesce(bad, F.array().cast("array<bigint>")))
    joined = joined.withColumn(hits, F.when(F.col(bad).isNotNull(), own))
    hit = F.coalesce(F.size(hits) > 0, F.lit(False)) & F.col("text").isNotNull()
    stays = F.filter(_lines(F.col("text")), lambda line: (F.trim(line, F.lit(SPACE)) == "") | ~F.array_contains(hits, _hash(line)))
    joined = joined.withColumn(kept_lines, F.when(hit, stays))
    return joined.withColumns(
        {
            "n_lines_dropped": F.when(hit, F.size(_lines(F.col("text"))) - F.size(kept_lines)).otherwise(0).cast("long"),
            "text": F.when(hit, F.array_join(kept_lines, "\n")).otherwise(F.col("text")),
        }
    ).select(*docs.columns, "n_lines_dropped")


def query(spark, sf_dir):
    """Every document after its source's boilerplate lines went: what is left, as counts and a digest."""
    from lateline.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    cleaned = drop_boilerplate(docs, "source")
    return cleaned.select("doc_id", "n_lines_dropped", F.length("text").cast("long").alias("n_chars_left"), F.md5("text").alias("text_md5"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, source FROM documents),
l AS (
  SELECT rid, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM d WHERE text IS NOT NULL),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM l),
pages AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
counts AS (SELECT source, body, count(DISTINCT rid) AS n FROM t WHERE body <> '' GROUP BY source, body),
bad AS (
  SELECT c.source, body FROM counts c JOIN pages p ON c.source IS NOT DISTINCT FROM p.source
  WHERE n >= {MIN_PAGES} AND n > pages * {RATIO}),
kept AS (
  SELECT rid, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE b.body IS NULL) AS text,
         count(b.body) AS dropped
  FROM t LEFT JOIN bad b ON t.source IS NOT DISTINCT FROM b.source AND t.body = b.body GROUP BY rid)
SELECT doc_id, CAST(coalesce(dropped, 0) AS BIGINT) AS n_lines_dropped,
       CASE WHEN d.text IS NOT NULL THEN CAST(length(coalesce(k.text, '')) AS BIGINT) END AS n_chars_left,
       CASE WHEN d.text IS NOT NULL THEN md5(coalesce(k.text, '')) END AS text_md5
FROM d LEFT JOIN kept k ON d.rid = k.rid
"""
