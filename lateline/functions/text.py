"""Text column expressions."""

from pyspark.sql import functions as F

from lateline.fixed_values import ISSUE_KEY_PATTERN, PROJECT_KEY_PATTERN, WHITE_SPACE_CHARACTERS
from lateline.functions.numbers import rounded


def word_count(column):
    """Number of white-space separated words; null and empty text have none.

    All white space becomes a blank first, since splitting at one plain
    character is more than twice as fast as splitting at a pattern.
    """
    blanks = " " * len(WHITE_SPACE_CHARACTERS)
    words = F.split(F.translate(column, WHITE_SPACE_CHARACTERS, blanks), " ")
    return F.coalesce(F.array_size(F.array_remove(words, "")), F.lit(0)).cast("long")


def is_project_key(column):
    return F.coalesce(column.rlike(PROJECT_KEY_PATTERN), F.lit(False))


def is_issue_key(column):
    return F.coalesce(column.rlike(ISSUE_KEY_PATTERN), F.lit(False))


def project_of(issue_key):
    """The part of an issue key before its first dash."""
    return F.substring_index(issue_key, "-", 1)


def percent(share, places=0):
    """0.85 -> '85%' (or '85.0%'), rounding half up."""
    value = rounded(share * 100, places)
    shown = value.cast("long").cast("string") if places == 0 else fixed(value, places)
    return F.concat(shown, F.lit("%"))


def fixed(column, places):
    """A number with exactly `places` decimals, rounding half up."""
    scale = 10**places
    units = F.floor(F.abs(column) * F.lit(float(scale)) + F.lit(0.5)).cast("long")
    sign = F.when((column < 0) & (units > 0), F.lit("-")).otherwise(F.lit(""))
    whole = F.floor(units / scale).cast("long").cast("string")
    if places == 0:
        return F.concat(sign, whole)
    return F.concat(sign, whole, F.lit("."), F.lpad((units % scale).cast("string"), places, "0"))
