"""Activity masks: the days of a 32-day window as bits of a long, bit i for i days before the anchor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW_DAYS, RETENTION_DAYS = 32, 90


def day_bit(day: Column, anchor: Column) -> Column:
    """The bit of a day; null outside of the window, so that bit_or skips it."""
    back = F.datediff(anchor.cast("date"), day.cast("date"))
    return F.when((back >= 0) & (back < WINDOW_DAYS), F.call_function("shiftleft", F.lit(1).cast("bigint"), back))


def mask(day: Column, anchor: Column) -> Column:
    """Aggregate: the mask of all days of a group; 0 if none is in the window."""
    return F.coalesce(F.bit_or(day_bit(day, anchor)), F.lit(0).cast("bigint"))


def decoded(bits: Column, anchor: Column) -> Column:
    """ISO days of a mask, ascending."""
    days = F.filter(F.sequence(F.lit(WINDOW_DAYS - 1), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftright", bits, i).bitwiseAND(F.lit(1)) == 1)
    return F.transform(days, lambda i: F.date_format(F.date_sub(anchor.cast("date"), i), "yyyy-MM-dd"))


def overlap(a: Column, b: Column) -> Column:
    """Number of days that two masks of one anchor share."""
    return F.bit_count(a.bitwiseAND(b)).cast("long")


def month(day: Column) -> Column:
    return F.substring(day.cast("string"), 1, 7)
