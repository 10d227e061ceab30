"""Redaction of records."""

from pyspark.sql import functions as F

from lateline.functions.redaction import (
    apply_spans,
    count_secrets,
    entity_gaps,
    entity_hits,
    entity_type,
    fill_gaps,
    redact_secrets,
    text_chunks,
)
from lateline.sources.staging import attach


def redact_records(df, fields, extra=(), aws_secret=False):
    """Redact the text fields and add the `_pii_redaction` summary.

    Secrets are replaced first and counted apart: `pii_detected` speaks of
    personal entities only. Expressions cannot fail half-way, so
    `redaction_incomplete` is always false; it is kept for readers of the record.
    Names and postal addresses need a language model and are not found here.
    """
    kept = df.columns
    step = df.withColumns({f"_clean_{f}": redact_secrets(F.col(f), extra, aws_secret) for f in fields})
    step = step.withColumns({f"_hits_{f}": entity_hits(F.col(f"_clean_{f}")) for f in fields})
    step = step.withColumns(
        {f"_types_{f}": F.coalesce(F.transform(f"_hits_{f}", entity_type), F.array().cast("array<string>")) for f in fields}
    )
    redacted, secrets = {}, F.lit(0).cast("long")
    for f in fields:
        clean, types = F.col(f"_clean_{f}"), F.col(f"_types_{f}")
        filled = fill_gaps(entity_gaps(clean, F.col(f"_hits_{f}")), types)
        redacted[f] = F.when(F.size(types) > 0, filled).otherwise(clean).alias(f)
        changed = F.coalesce(clean != F.col(f), F.lit(False))
        secrets = secrets + F.when(changed, count_secrets(F.col(f), extra, aws_secret)).otherwise(0)
    found = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"_types_{f}") for f in fields]))))
    summary = F.struct(
        F.array(*[F.lit(f) for f in fields]).alias("fields_scanned"),
        (F.size(found) > 0).alias("pii_detected"),
        found.alias("entity_types_found"),
        F.lit(False).alias("redaction_incomplete"),
        secrets.alias("secrets_found"),
    ).alias("_pii_redaction")
    return step.select(*[redacted.get(name, F.col(name)) for name in kept], summary)


def redaction_counts(df, keys=()):
    """Records, records with personal data, and secrets per group."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("records"),
        F.count_if(F.col("_pii_redaction.pii_detected")).alias("pii_detected"),
        F.sum("_pii_redaction.secrets_found").cast("long").alias("secrets_found"),
    )


def apply_span_table(documents, spans, key, text="text"):
    """Redact documents by a table of detected spans (key, type, begin, end).

    A document's spans are gathered next to its text; they cannot outnumber the
    characters of that text.
    """
    gathered = spans.groupBy(key).agg(F.collect_list(F.struct("type", "begin", "end")).alias("_spans"))
    joined = attach(documents, gathered, key)
    return joined.withColumn(text, apply_spans(F.col(text), F.col("_spans"))).drop("_spans")


def chunk_documents(documents, max_bytes, key, text="text"):
    """One row per chunk: key, position, text."""
    return documents.select(key, F.posexplode(text_chunks(max_bytes)(F.col(text))).alias("position", "chunk"))


