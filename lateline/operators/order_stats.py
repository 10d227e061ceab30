"""Ordinals, running totals and exact quantiles without one task seeing everything.

A value histogram is counted first, so copies of a value collapse before the
shuffle. The histogram is cut into slices by a range partitioning, summed slice by
slice, and shifted by what the earlier slices hold, in the same way at every size.
"""

from pyspark.sql import functions as F
from pyspark.sql import Window

from lateline.sources.staging import settle

_POSITION_BITS = 33  # monotonically_increasing_id: row number within its partition


def running_totals(counted, groups, order, sums, slices=None):
    """Add `cum_<name>` and `total_<name>` per name in `sums`: its total up to and
    including the row, and over the whole group.

    Runs within `groups` along `order`, which must be unique in a group. Rows are
    range-partitioned into slices, written once, summed slice by slice, and shifted
    by what the earlier slices of their group hold.
    """
    groups, sums = list(groups), list(sums)
    slices = slices or int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = settle(
        counted.repartitionByRange(slices, *groups, order).withColumn("_slice", F.spark_partition_id()), "slices"
    )
    per_slice = sliced.groupBy(*groups, "_slice").agg(*[F.sum(name).alias(name) for name in sums])
    # a group has one row per slice it touches, so these windows are small
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_slice.select(
        *groups,
        "_slice",
        *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_before_{name}") for name in sums],
        *[F.sum(name).over(whole).alias(f"total_{name}") for name in sums],
    )
    frame = (
        Window.partitionBy(*groups, "_slice")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = {f"cum_{name}": F.sum(name).over(frame) + F.col(f"_before_{name}") for name in sums}
    return (
        sliced.join(shifts, [*groups, "_slice"])
        .withColumns(totals)
        .drop("_slice", *[f"_before_{name}" for name in sums])
    )


def value_counts(df, groups, value):
    """(groups, value, n), nulls left out."""
    return df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"))


def quantile_parts(value, probabilities):
    """(aggregates, results) that read interpolated quantiles off running totals of `n`.

    Aggregate the first per group, then select the second. `probabilities` maps
    an output column to a probability.
    """
    first = F.col("cum_n") - F.col("n")

    def at(rank):
        return F.max(F.when((first <= rank) & (rank < F.col("cum_n")), F.col(value)))

    aggregates, results = [], []
    for name, p in probabilities.items():
        position = (F.col("total_n") - 1) * F.lit(float(p))
        low, high, part = (F.col(f"_{which}_{name}") for which in ("low", "high", "part"))
        aggregates += [
            at(F.floor(position)).alias(f"_low_{name}"),
            at(F.ceil(position)).alias(f"_high_{name}"),
            F.max(position - F.floor(position)).alias(f"_part_{name}"),
        ]
        results.append((low + (high - low) * part).alias(name))
    return aggregates, results


def exact_quantiles(df, groups, value, probabilities, slices=None):
    """Exact, linearly interpolated quantiles and the count; one row per group."""
    groups = list(groups)
    ranked = running_totals(value_counts(df, groups, value), groups, value, ["n"], slices)
    aggregates, results = quantile_parts(value, probabilities)
    picked = ranked.groupBy(*groups).agg(F.max("total_n").alias("count"), *aggregates)
    return picked.select(*groups, "count", *results)


def with_ordinal(df, order, name="ordinal", slices=None):
    """Number the rows 0, 1, 2 ... along `order`; returns (frame, row count).

    `order` must be unique. Rows are range-partitioned and sorted, written once,
    and numbered by their place in their slice plus the sizes of earlier slices.
    """
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    placed = settle(
        df.repartitionByRange(slices, *order)
        .sortWithinPartitions(*order)
        .withColumns({"_slice": F.spark_partition_id(), "_place": place}),
        "ordered",
    )
    sizes = placed.groupBy("_slice").agg(F.count("*").alias("_rows"))
    # one row per slice, so this window holds no more rows than there are partitions
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rows").over(before), F.lit(0))
    shifts = sizes.select("_slice", shift.alias("_before"))
    numbered = placed.join(shifts, "_slice").withColumn(name, F.col("_before") + F.col("_place"))
    return numbered.drop("_slice", "_place", "_before"), placed.count()
