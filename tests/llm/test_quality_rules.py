"""Rule ledger against a plain evaluation."""

import random
import re

from lateline.llm import quality_rules as rules

SCHEMA = "doc_id long, text string, m string, failed_bits int"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for window in windows:
        seen[window] = seen.get(window, 0) + 1
    covered = {i + k for i, window in enumerate(windows) if seen[window] > 1 for k in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    n, dup = len(words), len(lines) - len(set(lines))
    base = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), symbols, dup, len(covered), base


def texts():
    rng = random.Random(2)
    found = [None, "", " \n\t\x0b\x0c\r", "one", "a b c d e f g h", "a b c d e f g h i", "a " * 30, "# * | <x> 🎉é y"]
    found += ["l1\nl1\n\n \nl1 \nl2\nl1", "one two three four five six seven eight nine " * 3, "|".join("abc") * 50]
    for _ in range(120):
        found.append(rng.choice([" ", "\n", " \t "]).join(rng.choice("abcdef") for _ in range(rng.randrange(80))))
    block = " ".join(f"w{i}" for i in range(50))
    found += [block + " x " + block, " ".join(f"v{i % 5000}" for i in range(20_000)), "word " * 20_000]
    return found


def test_query(spark, tmp_path):
    rows = [(i, text, "x", 3) for i, text in enumerate(texts())] + [(3, "one", None, None), (None, "null id", "y", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r)[:7] for r in rules.query(spark, str(tmp_path)).collect()), key=str)
    assert sorted((r[:1] + plain(r[1]) for r in rows), key=str) == sorted((g[:7] for g in (tuple(x)[:7] for x in got)), key=str)


def test_policies_and_ablations(spark):
    docs = [(i, text) for i, text in enumerate(texts())] + [(1000, " ".join(f"word{i}!!" for i in range(50)))]
    judged = rules.ledger(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "failed_bits", rules.fails("v1").alias("v1"), rules.fails("v2").alias("v2")).collect()
    bits = {r["doc_id"]: r["failed_bits"] for r in judged}
    assert bits[1000] == rules.BIT["shouting"]
    assert all(r["v1"] == bool(r["failed_bits"] & rules.POLICIES["v1"]) for r in judged)
    assert any(r["v2"] and not r["v1"] for r in judged)
    found = rules.ablations(rules.ledger(spark.createDataFrame(docs, "doc_id long, text string")))
    for row in found.collect():
        mask, bit = rules.POLICIES[row["policy"]], rules.BIT[row["rule"]]
        inside = [b & mask for b in bits.values()]
        assert row["n_failed"] == sum(b & bit != 0 for b in inside)
        assert row["n_failed_alone"] == sum(b == bit for b in inside)
        assert row["n_kept_without"] == sum(b & ~bit == 0 for b in inside)
    assert found.count() == sum(m.bit_count() for m in rules.POLICIES.values())


def test_no_python_and_no_shuffle(spark):
    plan = rules.ledger(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert rules.query(spark, str(tmp_path)).count() == 0


def test_helper_names_are_the_callers_own(spark):
    rows = [(1, "some words", "kept", 7)]
    got = rules.ledger(spark.createDataFrame(rows, "doc_id long, text string, __words string, __Lines int")).first()
    assert got["__words"] == "kept" and got["__Lines"] == 7 and got["m"]["n_words"] == 2
