"""Feature profiles and drift between two of them."""

from pyspark.sql import functions as F

from lateline import fixed_values as fv
from lateline.functions.numbers import number, rounded
from lateline.operators.order_stats import exact_quantiles

QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}
PROFILE = ["mean", "std", "median", "p25", "p75", "min", "max", "count"]


def long_form(df, keys=(), features=fv.MODEL_FEATURES):
    """(keys, feature, value) with missing values left out."""
    present = [name for name in features if name in df.columns]
    typed = df.select(*keys, *[number(F.col(name)).alias(name) for name in present])
    return typed.unpivot(list(keys), present, "feature", "value").where(F.col("value").isNotNull())


def _moments(df, keys, features):
    """Mean, std, range and count per feature (and key), in one wide partial aggregate."""
    present = [name for name in features if name in df.columns]
    typed = df.select(*keys, *[number(F.col(name)).alias(name) for name in present])
    measures = [
        F.struct(
            F.lit(name).alias("feature"), F.avg(name).alias("mean"), F.stddev_samp(name).alias("std"),
            F.min(name).alias("min"), F.max(name).alias("max"), F.count(name).alias("count"),
        ).alias(f"_{name}")
        for name in present
    ]
    wide = typed.groupBy(*keys).agg(*measures)
    return wide.select(*keys, F.inline(F.array(*[F.col(f"_{name}") for name in present]))).where("count > 0")


def feature_profile(df, keys=(), features=fv.MODEL_FEATURES):
    """Mean, std, quartiles, range and count per feature (and key). One value alone has no deviation.

    Only the quartiles need the values in order, and so a histogram.
    """
    groups = [*keys, "feature"]
    quartiles = exact_quantiles(long_form(df, keys, features), groups, "value", QUARTILES).drop("count")
    return _moments(df, keys, features).join(quartiles, groups).select(*groups, *PROFILE)


def drift_report(baseline, current, threshold=fv.DRIFT_THRESHOLD_PCT, keys=()):
    """Compare two profiles feature by feature; a feature gone missing counts as drifted."""
    groups = [*keys, "feature"]
    now = current.select(
        *groups,
        F.lit(True).alias("_present"),
        F.col("mean").alias("current_mean"),
        F.col("median").alias("_median"),
        (F.col("p75") - F.col("p25")).alias("_iqr"),
    )
    unit = F.when(F.coalesce("std", F.lit(1.0)) == 0, 1.0).otherwise(F.coalesce("std", F.lit(1.0)))
    old_iqr = F.col("p75") - F.col("p25")
    compared = baseline.join(now, groups, "left").withColumns(
        {
            "_mean_shift": F.abs(F.col("current_mean") - F.col("mean")) / unit,
            "_median_shift": F.abs(F.col("_median") - F.col("median")) / unit,
            "_iqr_change": F.abs(F.col("_iqr") - old_iqr) / F.greatest(old_iqr, F.lit(fv.MIN_BASELINE_IQR)) * 100,
        }
    )
    moved = (F.col("_mean_shift") > threshold / 100 * 3) | (F.col("_iqr_change") > threshold * 2)
    status = F.when(F.col("_present").isNull(), "missing").when(moved, "drifted").otherwise("stable")
    return compared.select(
        *groups,
        status.alias("status"),
        rounded(F.col("_mean_shift"), 4).alias("mean_shift_std"),
        rounded(F.col("_median_shift"), 4).alias("median_shift_std"),
        rounded(F.col("_iqr_change"), 2).alias("iqr_change_pct"),
        F.col("mean").alias("baseline_mean"),
        "current_mean",
    )


def drift_summary(report, threshold=fv.DRIFT_THRESHOLD_PCT, keys=()):
    """Share of drifted features and whether that calls for retraining.

    The list of names is as long as the feature list at most.
    """
    drifted = F.col("status") != "stable"
    share = F.col("drifted_count") / F.greatest(F.col("total_features"), F.lit(1)) * 100
    counted = report.groupBy(*keys).agg(
        F.count("*").alias("total_features"),
        F.count_if(drifted).alias("drifted_count"),
        F.array_sort(F.collect_list(F.when(drifted, F.col("feature")))).alias("drifted_features"),
    )
    return counted.select(
        *keys,
        rounded(share, 2).alias("overall_drift_pct"),
        (share > threshold).alias("needs_retrain"),
        "drifted_features",
        "total_features",
        "drifted_count",
    )
