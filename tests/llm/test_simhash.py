"""SimHash links against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lateline.llm import simhash

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [plain_fingerprint(text) for _, text in rows]
    name = list(range(len(rows)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                name[b] = a
    first = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            first[root(i)] = min(doc_id, first.get(root(i), doc_id))
    return sorted(
        ((doc_id, f"{prints[i]:016x}", first.get(root(i))) for i, (doc_id, _) in enumerate(rows)), key=str
    )


def run(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    return sorted((tuple(r)[:3] for r in simhash.query(spark, str(tmp_path)).collect()), key=str)


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta", "é", "zeta", "eta x"]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "one two"), (5, "ONE two"), (None, "one two"), (5, "ONE two")]
    for i in range(60):
        rows.append((100 + i, " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 60)))))
    base = [f"w{i}" for i in range(400)]
    for i in range(40):
        copy = list(base)
        copy[rng.randrange(400)] = f"x{i}"
        rows.append((300 - i, ("\n" if i % 2 else "  ").join(copy)))
    rows.append((400, "long " * 120_000))
    assert run(spark, tmp_path, rows) == plain_components(rows)


def test_empty_table_and_clashing_columns(spark, tmp_path):
    schema = "fp string, doc_id int, text string, component_id int, key int"
    assert run(spark, tmp_path / "a", [], schema) == []
    rows = [("x", 2, "a b c d", 7, 1), ("y", 1, "A b  c d", None, None)]
    assert [r[0::2] for r in run(spark, tmp_path / "b", rows, schema)] == [(1, 1), (2, 1)]


def test_every_pair_of_at_most_four_errors_shares_a_key_once(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 64, 400, np.uint64)
    flipped = values.copy()
    for i in range(len(flipped)):
        for bit in rng.choice(64, i % 5, replace=False):
            flipped[i] ^= np.uint64(1) << np.uint64(bit)
    every = np.unique(np.concatenate([values, flipped]))
    df = spark.createDataFrame([(int(v),) for v in every.view(np.int64)], "fp long")
    found = simhash.linked_fingerprints(df).groupBy("left", "right").count()
    rows = {(r["left"], r["right"]): r["count"] for r in found.collect()}
    signed = every.view(np.int64)
    close = np.bitwise_count(every[:, None] ^ every[None, :]) <= 4
    want = {(min(a, b), max(a, b)) for a, b in ((int(signed[i]), int(signed[j])) for i, j in zip(*np.nonzero(close))) if a != b}
    assert set(rows) == want and len(want) >= 300
    assert max(rows.values()) <= 6 and sum(n == 1 for n in rows.values()) > 0.9 * len(rows)


def test_code_is_perfect():
    code = simhash.golay()
    assert set(code.count.tolist()) == {1, 6}
    words = np.arange(0, 1 << 23, 997, dtype=np.int64)
    near, count = code.near(words)
    nearest = (near[:, 0] << 11) | code.remainders[near[:, 0]]
    assert (np.bitwise_count(nearest ^ words) <= 3).all()


def test_components_of_chains_stars_and_loops(spark):
    from lateline.llm.components import components

    edges = [(i, i + 1) for i in range(50)] + [(1000, 100 + i) for i in range(200)] + [(7, 7), (2000, 2001), (2001, 2000), (None, 3)]
    rows = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {rows[i] for i in range(51)} == {0} and {rows[100 + i] for i in range(200)} == {100}
    assert rows[2001] == rows[2000] == 2000 and len(rows) == 51 + 201 + 2
    assert components(spark.createDataFrame([], "a long, b long")).agg(F.count("*")).first()[0] == 0


def test_keys_are_never_broadcast(spark):
    """A table of fingerprints far below the broadcast threshold makes 48 times as many keys: their join is shuffled."""
    from lateline.sources.staging import settle

    classes = settle(spark.range(500).select(F.xxhash64("id").alias("fp")), "classes")
    linked = simhash.linked_fingerprints(classes)
    linked.collect()
    plan = linked._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
