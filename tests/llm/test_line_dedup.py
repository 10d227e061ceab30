"""Boilerplate lines against a plain count."""

import hashlib
import random
from collections import Counter

from lateline.llm import line_dedup

SCHEMA = "doc_id long, text string, source string, n_lines_dropped string"
SPACE = " \t\n\x0b\x0c\r"


def plain(rows):
    pages, counts = Counter(r[2] for r in rows), Counter()
    for _, text, host, *_ in rows:
        for line in {line.strip(SPACE) for line in (text or "").split("\n")} - {""}:
            counts[host, line] += 1
    bad = {k for k, n in counts.items() if n >= line_dedup.MIN_PAGES and n > line_dedup.RATIO * pages[k[0]]}
    out = []
    for doc_id, text, host, *_ in rows:
        if text is None:
            out.append((doc_id, 0, None, None))
            continue
        lines = text.split("\n")
        left = "\n".join(line for line in lines if (host, line.strip(SPACE)) not in bad)
        dropped = sum((host, line.strip(SPACE)) in bad for line in lines)
        out.append((doc_id, dropped, len(left), hashlib.md5(left.encode()).hexdigest()))
    return sorted(out, key=str)


def test_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(0, None, "a", "x"), (1, "", "a", "x"), (None, "menu\nno id", "b", None), (2, "menu", None, None), (3, "é " * 50_000, "a", "x")]
    for i in range(400):
        lines = [f"line {rng.randrange(5000)}" for _ in range(rng.randrange(6))]
        lines += rng.choice([[], ["menu"], ["  menu "], ["menu", "", "menu"], ["footer ©"], ["\t"]])
        rng.shuffle(lines)
        rows.append((10 + i // 2, "\n".join(lines), rng.choice(["a", "a", "a", "b", "c", None, ""]), "x"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, line_dedup.query(spark, str(tmp_path)).collect()), key=str)
    assert got == plain(rows) and any(r[1] for r in got)


def test_licence_lines_go_and_rare_passages_stay(spark):
    licence, passage = "Released under the MIT License.", "a passage of many words " * 12
    rows = []
    for i in range(1500):  # the licence stands on 1 % of the pages, the passage on 0.4 %
        lines = [f"own line {i}", *([licence] if i % 100 == 0 else []), *([passage] if i % 250 == 1 else []), f"end {i}"]
        rows.append((i, "\n".join(lines), "big", None))
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(r["n_lines_dropped"] for r in got.values()) == 15
    for doc_id, text, *_ in rows:
        assert got[doc_id]["text"] == text.replace(licence + "\n", "")


def test_small_sites_and_columns_stay(spark):
    rows = [(i, "same\nown %d" % i, "tiny", "z") for i in range(line_dedup.MIN_PAGES - 1)]
    kept = line_dedup.drop_boilerplate(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "source", "n_lines_dropped"]
    assert sorted(r["text"] for r in kept.collect()) == sorted(r[1] for r in rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert line_dedup.query(spark, str(tmp_path)).count() == 0


def test_helper_names_are_the_callers_own(spark):
    clashing = "__host string, __no_host string, __bad string, __HIT string, __kept string"
    rows = [(i, "same\nown %d" % i, "big", *"abcde") for i in range(200)]
    got = line_dedup.drop_boilerplate(spark.createDataFrame(rows, f"doc_id long, text string, source string, {clashing}"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, "own %d" % i, "big", *"abcde", 1) for i in range(200))


def test_a_line_exactly_at_the_share_stays(spark):
    rows = [(i, f"own {i}" + ("\nat the share" if i < 10 else "\nabove it" if i < 21 else ""), "s", None) for i in range(2000)]
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(r["n_lines_dropped"] == (10 <= i < 21) for i, r in got.items()) and got[3]["text"] == "own 3\nat the share"
