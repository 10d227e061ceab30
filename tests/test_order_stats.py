import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lateline.operators import order_stats as O

PROBS = {"q1": 0.25, "mid": 0.5, "q3": 0.75, "low": 0.0, "top": 1.0}


def values(seed=1, hot=True):
    """Groups of very different size, one holding most rows and one value a third of all."""
    maker = random.Random(seed)
    rows = [("hot", round(maker.gauss(0, 3), 1)) for _ in range(3000)] if hot else []
    rows += [("hot", 7.0)] * 2000
    rows += [("small", float(v)) for v in (1, 2, 3, 10)] + [("one", 5.0), ("none", None)]
    return rows


@pytest.mark.parametrize("slices", [1, 40])
def test_quantiles_match_numpy(spark, slices):
    rows = values()
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in O.exact_quantiles(df, ["g"], "v", PROBS, slices).collect()}
    assert set(got) == {"hot", "small", "one"}
    for group, row in got.items():
        mine = [v for g, v in rows if g == group]
        assert row["count"] == len(mine)
        for name, p in PROBS.items():
            assert row[name] == pytest.approx(np.quantile(mine, p))


@pytest.mark.parametrize("slices", [None, 25])
def test_quantiles_without_groups(spark, slices):
    rows = [(float(v),) for v in random.Random(2).sample(range(10_000), 301)]
    df = spark.createDataFrame(rows, "v double")
    row = O.exact_quantiles(df, [], "v", {"mid": 0.5}, slices).first()
    assert (row["count"], row["mid"]) == (301, np.median([r[0] for r in rows]))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert O.exact_quantiles(df, [], "v", {"mid": 0.5}).count() <= 1


@pytest.mark.parametrize("slices", [None, 7])
def test_running_totals(spark, slices):
    rows = [("a", i, i % 4) for i in range(200)] + [("b", i, 2) for i in range(10)]
    staged = spark.createDataFrame(rows, "g string, k int, n int")
    got = {(r["g"], r["k"]): (r["cum_n"], r["total_n"]) for r in O.running_totals(staged, ["g"], "k", ["n"], slices).collect()}
    for group in "ab":
        mine = [(k, n) for g, k, n in rows if g == group]
        seen = 0
        for k, n in mine:
            seen += n
            assert got[group, k] == (seen, sum(n for _, n in mine))


def test_ordinals_are_the_sorted_positions(spark):
    keys = random.Random(5).sample(range(100_000), 997)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    numbered, rows = O.with_ordinal(df, [F.col("k").asc()], slices=7)
    assert rows == 997
    assert [(r["k"], r["ordinal"]) for r in numbered.orderBy("k").collect()] == [(k, i) for i, k in enumerate(sorted(keys))]


def test_ordinals_use_no_global_sort(spark):
    df = spark.range(1000)
    plan = O.with_ordinal(df, [F.col("id").asc()])[0]._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window")[0]  # only the sizes of slices meet in one task
