"""Risk levels and fold metrics."""

from pyspark.sql import functions as F

from lateline import fixed_values as fv
from lateline.functions.numbers import rounded
from lateline.operators.order_stats import running_totals, with_ordinal


def risk_level(score, high=fv.RISK_HIGH, medium=fv.RISK_MEDIUM):
    return F.when(score >= high, "High").when(score >= medium, "Medium").otherwise("Low")


def with_risk(df, probability, high=fv.RISK_HIGH, medium=fv.RISK_MEDIUM):
    """Add risk_score (four decimals) and risk_level, the level read off the score."""
    score = rounded(probability, 4)
    return df.withColumn("risk_score", score).withColumn("risk_level", risk_level(F.col("risk_score"), high, medium))


def walk_forward(df, order=("created", "issue_key"), folds=fv.FOLDS, slices=None):
    """Add `test_fold`: the fold a row is tested in, null for the leading block.

    With n rows a test block has n // (folds + 1) rows; the blocks end with the
    last row. A fold trains on every row before its block.
    """
    keys = [F.col(name).asc_nulls_last() if i == 0 else F.col(name).asc() for i, name in enumerate(order)]
    numbered, rows = with_ordinal(df, keys, slices=slices)
    block = rows // (folds + 1)
    if block == 0:
        raise ValueError(f"{rows} rows are too few for {folds} folds")
    first = rows - folds * block
    fold = F.floor((F.col("ordinal") - first) / block).cast("int")
    return numbered.withColumn("test_fold", F.when(F.col("ordinal") >= first, fold))


def training_rows(folded, fold):
    return folded.where(F.col("test_fold").isNull() | (F.col("test_fold") < fold))


def positive_weights(folded, label="is_delayed", folds=fv.FOLDS):
    """Per fold: positives, negatives and the positive weight of its training rows.

    Rows are counted once per block; a fold's training rows are the blocks before it.
    """
    blocks = folded.groupBy(F.coalesce("test_fold", F.lit(-1)).alias("block")).agg(
        F.sum(label).cast("long").alias("p"), F.sum(1 - F.col(label)).cast("long").alias("n")
    )
    # at most folds + 1 rows by now
    trained = blocks.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("block < fold")
    summed = trained.groupBy("fold").agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    weight = F.when(F.col("positives") > 0, F.col("negatives") / F.col("positives"))
    return summed.withColumn("positive_weight", weight.otherwise(fv.DEFAULT_POSITIVE_WEIGHT))


def area_under_curve(df, label, score, groups):
    """ROC-AUC per group by ranks, ties counting half; 0 where only one class occurs.

    Works on the histogram of scores, summed along the score slice by slice.
    """
    hits = df.groupBy(*groups, score).agg(
        F.sum(label).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg")
    )
    summed = running_totals(hits, groups, score, ["neg"])
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") / 2
    totals = summed.groupBy(*groups).agg(
        F.sum(F.col("pos") * below).alias("_wins"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n")
    )
    return totals.select(
        *groups, F.coalesce(F.try_divide(F.col("_wins"), F.col("_p") * F.col("_n")), F.lit(0.0)).alias("auc_roc")
    )


def classification_metrics(df, label="is_delayed", score="risk_score", fold="test_fold", cut=0.5):
    """Recall, precision, F1, ROC-AUC, size and positive rate per test fold."""
    tested = df.where(F.col(fold).isNotNull())
    yes, real = F.col(score) > cut, F.col(label) == 1
    counts = tested.groupBy(fold).agg(
        F.count_if(yes & real).alias("tp"),
        F.count_if(yes & ~real).alias("fp"),
        F.count_if(~yes & real).alias("fn"),
        F.count("*").alias("test_size"),
        F.avg(label).alias("positive_rate"),
    )

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    measured = counts.select(
        fold,
        ratio(tp, tp + fn).alias("recall"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp * 2, tp * 2 + fp + fn).alias("f1"),
        "test_size",
        "positive_rate",
    )
    return measured.join(area_under_curve(tested, label, score, [fold]), fold)


def metric_averages(metrics):
    return metrics.agg(*[F.avg(name).alias(name) for name in ("recall", "precision", "f1", "auc_roc")])


def most_important(importance, k=fv.TOP_FACTORS):
    """The k most important of a model's list of (feature, importance), most important first."""
    return sorted(importance, key=lambda item: (-item[1], item[0]))[:k]


def factor_list(df, importance, k=fv.TOP_FACTORS):
    """An array column: the k most important features with the ticket's own values.

    `importance` is the model's list of (feature, importance). It is the same
    for every ticket, so the k are chosen once and each row lists them in place.
    """
    ranked = most_important(importance, k)
    rows = [
        F.struct(
            F.lit(rank).alias("rank"),
            F.lit(feature).alias("feature"),
            (F.coalesce(F.col(feature).cast("double"), F.lit(0.0)) if feature in df.columns else F.lit(0.0)).alias("value"),
            F.lit(float(weight)).alias("importance"),
        )
        for rank, (feature, weight) in enumerate(ranked, 1)
    ]
    return F.array(*rows)


def top_factors(df, importance, keys, k=fv.TOP_FACTORS):
    """The factors of every ticket as rows."""
    return df.select(*keys, F.inline(factor_list(df, importance, k)))
