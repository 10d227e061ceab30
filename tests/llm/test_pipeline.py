"""The pipeline against plain versions of its stages, run one after the other."""

import os
import zlib
from collections import Counter

import numpy as np
import pytest
import test_line_dedup
import test_quality_rules
import test_simhash
from tokenizers import Tokenizer

import corpus_pipeline
from lateline.llm import quality_rules, simhash, weak_labels
from lateline.llm.bpe import VOCABULARY, public_tokenizers

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string"


def plain_classifier(rows):
    seen = {r[0]: weak_labels.observe(r[1]) for r in rows}
    patterns = {i: weak_labels.votes_of(m) for i, (m, _, _) in seen.items()}
    counts = Counter(patterns.values())
    model = weak_labels.fit_labels(counts)
    posterior = dict(zip(counts, model.posterior(list(counts)), strict=True))
    every = {(patterns[i], tuple(b.tolist()), tuple(v.tolist())) for i, (_, b, v) in seen.items()}
    weights = weak_labels.fit_scorer([(np.array(b), np.array(v), posterior[p]) for p, b, v in sorted(every)])
    return [r for r in rows if weak_labels.score_of(r[1], weights) < weak_labels.THRESHOLD]


def plain_rules(rows):
    kept = []
    for row in rows:
        n, chars, symbols, dup, _, base = test_quality_rules.plain(row[1])
        words = (row[1] or "").split()
        lines = sum(bool(line.strip(" \t\n\x0b\x0c\r")) for line in (row[1] or "").split("\n"))
        bars, shouts = words.count("|"), sum(w.endswith("!!") for w in words)
        more = 100 * symbols > 60 * n or (lines >= 4 and 100 * dup > 50 * lines) or chars > 20 * n
        if not (base or more or 100 * bars > 20 * n or 100 * shouts > 30 * n):
            kept.append(row)
    return kept


def plain_lines(rows):
    done = {r[0]: r for r in test_line_dedup.plain([(r[0], r[1], r[3]) for r in rows])}
    pages, counts = Counter(r[3] for r in rows), Counter()
    strip = lambda line: line.strip(" \t\n\x0b\x0c\r")
    for r in rows:
        counts.update((r[3], line) for line in {strip(x) for x in (r[1] or "").split("\n")} - {""})
    bad = {k for k, n in counts.items() if n >= test_line_dedup.line_dedup.MIN_PAGES and n > test_line_dedup.line_dedup.RATIO * pages[k[0]]}
    out = []
    for r in rows:
        text = r[1] if r[1] is None else "\n".join(x for x in r[1].split("\n") if (r[3], strip(x)) not in bad)
        assert done[r[0]][2] == (None if text is None else len(text))
        out.append((r[0], text, r[2], r[3], None if text is None else len(text), *r[5:]))
    return out


def plain_copies(rows):
    first = {r[0]: r[2] for r in test_simhash.plain_components([(r[0], r[1]) for r in rows])}
    return [r for r in rows if first[r[0]] == r[0]]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_stages_and_run_against_plain_versions(spark, tmp_path):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, columns = given, docs.columns
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (plain_classifier, plain_rules, plain_lines, plain_copies), strict=False):
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        before, rows = rows, plain(rows)
        assert sorted(map(tuple, docs.collect())) == sorted(rows), name
        assert len(rows) < len(before) or rows != before, f"{name} decides nothing"
    library = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    found = corpus_pipeline.run(spark, SF).collect()
    assert len({r["sequence_id"] for r in found}) == len(found)
    packed = {}
    for r in sorted(found, key=lambda r: (r["doc_id"], r["start"])):
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        packed[r["doc_id"]] = packed.get(r["doc_id"], b"") + bytes(r["ids"])
    want = {r[0]: np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for r in rows}
    assert packed == want


def test_odd_rows_and_empty_table(spark):
    text = " ".join(f"word{i} and" for i in range(60)) + "."
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, "x"), (None, text, "en", "a", 1, "y"), (3, text, "en", "a", 1, None), (3, text, "en", "a", 1, None)]
    rows += [(4, text, "en", None, 1, "x"), (5, "word " * 50_000, "en", "a", 1, "x")]
    for given in (rows, []):
        docs = spark.createDataFrame(given, SCHEMA)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, None)
            assert after.columns == docs.columns and after.count() <= len(given), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, None).count() >= len(given)
    kept = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, SCHEMA), None)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, 5, None]


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "line_dedup", "simhash_near_dedup", "packing"]
    assert quality_rules.CURRENT in quality_rules.POLICIES


def test_near_dedup_sends_no_keys_to_the_driver(spark, monkeypatch):
    """The stage's join of keys, many times the rows it is sized by, is shuffled however small the table is."""
    plans, linked = [], simhash.linked_fingerprints

    def seen(classes):
        found = linked(classes)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(simhash, "linked_fingerprints", seen)
    docs = spark.createDataFrame([(n, f"one text of its own {n}", "en", "a", 1, "x") for n in range(40)], SCHEMA)
    assert corpus_pipeline.simhash_near_dedup(spark, docs, None).count() <= 40
    assert len(plans) == 1 and "BroadcastExchange" not in plans[0]
