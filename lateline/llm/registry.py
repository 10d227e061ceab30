"""The registered corpus queries and their SQL."""

import corpus_pipeline
from lateline.llm import (
    bpe,
    embeddings,
    line_dedup,
    packing,
    quality_rules,
    quotes,
    repair,
    simhash,
    token_ids,
    urls,
    warc,
    weak_labels,
    whitening,
)

_OPERATORS = {
    "op1_quote_threads": quotes,
    "op2_weak_label_quality": weak_labels,
    "op3_simhash_near_duplicates": simhash,
    "op4_bpe_round_trip": bpe,
    "op5_arc_to_warc": warc,
    "op6_binary_packing": packing,
    "op7_site_line_dedup": line_dedup,
    "op8_embedding_near_duplicates": embeddings,
    "op9_url_filter": urls,
    "op10_rule_ledger": quality_rules,
    "op11_auction_repair": repair,
    "op12_simple8b_token_ids": token_ids,
    "op13_qdwh_whitening": whitening,
}


def queries():
    found = {name: module.query for name, module in _OPERATORS.items()}
    return {**found, "pipeline": corpus_pipeline.run}


def oracle_sql():
    """SQL of the operators that SQL can express; the others are tested against brute force."""
    found = {name: module.SQL for name, module in _OPERATORS.items() if hasattr(module, "SQL")}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
