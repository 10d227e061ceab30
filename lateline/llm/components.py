"""Connected components by repeated contraction.

Every round maps each node to its smallest neighbour, renames the ends of all
edges and drops what became a loop; no edge list, label list or neighbourhood is
ever gathered. Rounds are written to the cluster's shared folder, which cuts the
lineage and lets adaptive execution split the joins at a node with many edges.
"""

from pyspark.sql import functions as F

from lateline.sources.staging import settle


def components(edges):
    """(node, component) for every node of `edges`; component is the smallest node reachable.

    `edges` has two integer columns in any order. Loops, repeated edges and rows
    with a null are allowed and say nothing; a node with nothing else is left out.
    """
    a, b = (F.col(name) for name in edges.columns[:2])
    edges = settle(
        edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges"
    )
    rounds = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("b"))
        near = settle(near.select(F.col("a").alias("node"), F.least("a", "b").alias("next")), "near")
        step = settle(_follow(near, near), "step")  # two steps at once
        rounds.append(step)
        edges = _rename(_rename(edges, step, "a"), step, "b")
        edges = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = settle(edges.distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds[0]
    for step in rounds[1:]:
        found = settle(_follow(found, step), "found")
    return found.withColumnRenamed("next", "component")


def _follow(found, step):
    onward = step.select(F.col("node").alias("next"), F.col("next").alias("onward"))
    joined = found.join(onward, "next", "left")
    return joined.select("node", F.coalesce("onward", "next").alias("next"))


def _rename(edges, step, end):
    other = "b" if end == "a" else "a"
    named = step.select(F.col("node").alias(end), F.col("next").alias("named"))
    return edges.join(named, end, "left").select(F.coalesce("named", end).alias(end), other)
