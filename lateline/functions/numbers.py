"""Numeric column expressions."""

from pyspark.sql import functions as F


def rounded(column, places):
    """Round half up, the same way in every SQL engine."""
    scale = float(10**places)
    return F.floor(column * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def number(column):
    """The column as a double; text that is no number and NaN become null."""
    value = column.try_cast("double")
    return F.when(~F.isnan(value), value)


def number_or_zero(column):
    return F.coalesce(number(column), F.lit(0.0))


def exact_mean(column):
    """Mean of values with few decimals, summed exactly: the same in whatever order rows come."""
    return F.try_divide(F.sum(column.cast("decimal(20,10)")).cast("double"), F.count(column))


def choose(column, mapping, default):
    """Value of `column` under a small fixed mapping, as one CASE expression."""
    result = None
    for key, value in mapping.items():
        matched = column == key
        result = F.when(matched, value) if result is None else result.when(matched, value)
    return result.otherwise(default)


def bind(column, body):
    """`body` of the column's value, computed once however often `body` uses it."""
    return F.get(F.transform(F.array(column), body), F.lit(0))


def running(values, combine):
    """The array whose i-th entry combines (sum, greatest, ...) entries 0 to i of `values`; no entry may be null.

    Distances double, so n entries take n log n steps in place, without a shuffle
    and without an array that grows entry by entry. The column should be bound.
    """
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda step: step < F.size(values))

    def reach(seen, step):
        return F.transform(seen, lambda value, i: F.when(i < step, value).otherwise(combine(F.get(seen, i - step), value)))

    return F.aggregate(steps, values, reach)


def days_between(start, end):
    """Days from start to end, never negative, null as 0, one decimal."""
    micros_per_day = F.lit(86_400_000_000.0)
    days = (F.unix_micros(end) - F.unix_micros(start)) / micros_per_day
    return rounded(F.greatest(F.coalesce(days, F.lit(0.0)), F.lit(0.0)), 1)


def moment(as_of=None):
    """A timestamp column from a column, a text, a datetime, or the query's start."""
    if as_of is None:
        return F.current_timestamp()
    if hasattr(as_of, "_jc"):
        return as_of
    return F.lit(as_of).cast("timestamp")


def iso_text(column):
    """A timestamp as 2024-01-31T09:00:00Z."""
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")
