"""Words as native columns: runs of characters other than the space and the control characters 9 to 13."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
_SPACES = " \t\n\x0b\f\r"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(text: Column | str) -> Column:
    return F.trim(F.coalesce(as_column(text), F.lit("")), F.lit(_SPACES))


def words(text: Column | str) -> Column:
    """The words of a text; an empty array where it has none."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE))


def n_words(text: Column | str) -> Column:
    t = trimmed(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE))).cast("long")


def without_spaces(text: Column | str) -> Column:
    return F.translate(F.coalesce(as_column(text), F.lit("")), _SPACES, "")
