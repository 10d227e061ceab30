"""Documents to training sequences: five stages, each over all that the one before it kept."""

from pyspark.sql import functions as F

from lateline.llm import line_dedup, packing, quality_rules, simhash, weak_labels
from lateline.llm.common import ready, table
from lateline.sources.staging import settle


def quality_classifier(spark, docs, sf_dir):
    """Documents that the weakly supervised classifier, fitted on this input, does not reject."""
    ready(spark)
    return weak_labels.judge(docs).where("kept").select(*docs.columns)


def quality_rules_stage(spark, docs, sf_dir):
    """Documents that pass the current policy of quality rules."""
    ready(spark)
    return quality_rules.ledger(docs).where(~quality_rules.fails(quality_rules.CURRENT)).select(*docs.columns)


def site_line_dedup(spark, docs, sf_dir):
    """All documents, without the lines that are boilerplate within their source; n_chars counts what is left."""
    ready(spark)
    cleaned = line_dedup.drop_boilerplate(docs, "source")
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def simhash_near_dedup(spark, docs, sf_dir):
    """One document of each group of near-duplicates: that of the smallest doc_id.

    Of rows with the same doc_id one stays. A row without doc_id names no group and
    stays.
    """
    ready(spark)
    marked = settle(simhash.near_duplicates(docs), "marked")
    dropped = marked.where("doc_id <> component_id").select("doc_id").distinct()
    repeated = marked.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = docs.join(settle(dropped, "dropped"), "doc_id", "left_anti")
    repeated = settle(repeated, "repeated")
    once = kept.join(repeated, "doc_id", "left_anti")
    return once.unionByName(kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*docs.columns)


def binary_packing(spark, docs, sf_dir):
    """The pieces of all documents, with their ids, each a sequence of its own."""
    ready(spark)
    return packing.pieces(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules_stage),
    ("line_dedup", site_line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("packing", binary_packing),
]

ORACLE_SQL = None  # SQL has no expectation-maximisation, SimHash or tokenizer


def run(spark, sf_dir):
    """The stages applied to the table documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
