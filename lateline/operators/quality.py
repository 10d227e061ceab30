"""Data-quality constraints: one aggregation for all checks, then rows.

Invalid categories are found apart: a pass that emits offending values only,
so a clean table shuffles nothing for them.
"""

from functools import cached_property

from pyspark.sql import Window
from pyspark.sql import functions as F

from lateline import fixed_values as fv
from lateline.functions.numbers import number, rounded
from lateline.functions.text import percent


def _profile(df, rules, keys):
    measures = [F.count("*").alias("row_count")]
    for name, rule in rules.items():
        if name not in df.columns:
            continue
        measures.append(F.count(name).alias(f"{name}:filled"))
        if rule.get("type") == "numeric":
            value = number(F.col(name))
            measures += [
                F.avg(value).alias(f"{name}:mean"),
                F.stddev_samp(value).alias(f"{name}:std"),
                F.min(value).alias(f"{name}:min"),
                F.max(value).alias(f"{name}:max"),
            ]
        if "uniqueness" in rule:
            measures.append(F.count_distinct(name).alias(f"{name}:distinct"))
    return df.groupBy(*keys).agg(*measures)


def _offenders(df, rules, keys):
    """Distinct values outside the allowed ones: (keys, column, value)."""
    checks = []
    for name, rule in rules.items():
        if rule.get("type") == "categorical" and rule.get("allowed_values") and name in df.columns:
            value = F.col(name).cast("string")
            bad = value.isNotNull() & ~value.isin(*rule["allowed_values"])
            checks.append(F.when(bad, F.struct(F.lit(name).alias("column"), value.alias("value"))))
    if not checks:
        return None
    found = df.select(*keys, F.explode(F.array_compact(F.array(*checks))).alias("_bad"))
    return found.select(*keys, "_bad.column", "_bad.value").distinct()


def _offender_summary(offenders, keys):
    """Per column: how many invalid values there are, and the first few."""
    groups = [*keys, "column"]
    counted = offenders.groupBy(*groups).agg(F.count("*").alias("invalid_count"))
    order = Window.partitionBy(*groups).orderBy("value")
    first = offenders.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= fv.OFFENDERS_SHOWN)
    shown = first.groupBy(*groups).agg(F.array_sort(F.collect_list("value")).alias("invalid_values"))
    return counted.join(shown, groups)


def _field(name, part):
    return F.col(f"`{name}:{part}`")


def _violation(broken, column, rule, expected=None, actual=None, message=None):
    row = F.struct(
        F.lit(column).alias("column"),
        F.lit(rule).alias("rule"),
        F.lit(expected).cast("double").alias("expected"),
        (F.lit(None) if actual is None else actual).cast("double").alias("actual"),
        message.alias("message"),
    )
    return F.when(broken, row)


def _checks(rules, columns):
    violations, metrics = [], []

    def metric(column, name, value):
        metrics.append(
            F.struct(F.lit(column).alias("column"), F.lit(name).alias("metric"), value.cast("double").alias("value"))
        )

    for name, rule in rules.items():
        if name not in columns:
            violations.append(
                _violation(F.lit(True), name, "column_exists", message=F.lit(f"Required column '{name}' not found"))
            )
            continue
        complete = F.try_divide(_field(name, "filled"), F.col("row_count"))
        metric(name, "completeness", rounded(complete, 4))
        least = float(rule.get("completeness", 0))
        text = F.concat(F.lit("Completeness "), percent(complete, 1), F.lit(f" < {least * 100:.1f}%"))
        violations.append(_violation(complete < least, name, "completeness", least, rounded(complete, 4), text))
        if rule.get("type") == "numeric":
            for part in ("mean", "std", "min", "max"):
                metric(name, part, rounded(_field(name, part), 4))
            low, high = _field(name, "min"), _field(name, "max")
            if "min" in rule:
                text = F.concat(F.lit("Min value "), low.cast("string"), F.lit(f" < {rule['min']}"))
                violations.append(_violation(low < rule["min"], name, "min_value", rule["min"], low, text))
            if "max" in rule:
                text = F.concat(F.lit("Max value "), high.cast("string"), F.lit(f" > {rule['max']}"))
                violations.append(_violation(high > rule["max"], name, "max_value", rule["max"], high, text))
        if "uniqueness" in rule:
            unique = _field(name, "distinct") / F.greatest(_field(name, "filled"), F.lit(1))
            metric(name, "uniqueness", rounded(unique, 4))
            least = float(rule["uniqueness"])
            text = F.concat(F.lit("Uniqueness "), percent(unique, 1), F.lit(f" < {least * 100:.1f}%"))
            violations.append(_violation(unique < least, name, "uniqueness", least, rounded(unique, 4), text))
    return violations, metrics


class QualityReport:
    """The outcome of the checks; each table is made when it is first asked for.

    All of them are lazy: they hang on one aggregate for the profile, which Spark
    computes once in a plan, and one pass over `df` for invalid categories.
    """

    def __init__(self, df, rules, keys):
        self.df, self.rules, self.keys = df, rules, keys

    @cached_property
    def _profile(self):
        """One row per group."""
        return _profile(self.df, self.rules, self.keys)

    @cached_property
    def metrics(self):
        """One row per group, column and metric."""
        measured = _checks(self.rules, self.df.columns)[1]
        return self._profile.select(*self.keys, F.inline(F.array(*measured))).where(F.col("value").isNotNull())

    @cached_property
    def violations(self):
        """One row per group and broken rule."""
        checks = _checks(self.rules, self.df.columns)[0]
        broken = self._profile.select(*self.keys, F.explode(F.array_compact(F.array(*checks))).alias("_v"))
        found = broken.select(*self.keys, "_v.*", F.lit(None).cast("array<string>").alias("invalid_values"))
        offenders = _offenders(self.df, self.rules, self.keys)
        if offenders is not None:
            bad = _offender_summary(offenders, self.keys)
            text = F.concat(F.lit("Found "), F.col("invalid_count").cast("string"), F.lit(" invalid categorical values"))
            found = found.unionByName(
                bad.select(
                    *self.keys,
                    "column",
                    F.lit("allowed_values").alias("rule"),
                    F.lit(None).cast("double").alias("expected"),
                    F.lit(None).cast("double").alias("actual"),
                    text.alias("message"),
                    "invalid_values",
                )
            )
        return found

    @cached_property
    def summary(self):
        """One row per group: passed, number of checks and violations, rows, columns."""
        broken = self.violations.groupBy(*self.keys).agg(F.count("*").alias("violations_count"))
        heads = self._profile.select(*self.keys, "row_count")
        if self.keys:
            joined = heads.join(broken, self.keys, "left")
        else:
            joined = heads.withColumn("violations_count", broken.scalar())
        count = F.coalesce("violations_count", F.lit(0))
        return joined.select(
            *self.keys,
            (count == 0).alias("passed"),
            F.lit(sum(len(rule) for rule in self.rules.values())).alias("total_checks"),
            count.alias("violations_count"),
            "row_count",
            F.lit(len(self.df.columns)).alias("column_count"),
        )


def quality_report(df, rules=None, keys=()):
    """Check `df` against the rules, as a whole or per group."""
    return QualityReport(df, rules or fv.QUALITY_RULES, list(keys))
