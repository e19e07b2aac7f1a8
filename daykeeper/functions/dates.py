"""Archive days are text of the form YYYY-MM-DD in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_archive_date(value: Column) -> Column:
    """The trimmed canonical day, or NULL when it is no real day of year 1 or later."""
    text = F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", "")
    real = F.try_to_date(text, "yyyy-MM-dd").isNotNull() & (text >= "0001-01-01")
    # try_to_date must only see text of the right shape: other shapes can raise upgrade errors.
    return F.when(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), real).otherwise(F.lit(False)), text)


def day_text(ts: Column) -> Column:
    return ts.cast("date").cast("string")


def previous_day(day: Column) -> Column:
    return F.date_sub(day.cast("date"), 1).cast("string")


def utc_yesterday(now: Column | None = None) -> Column:
    """The UTC day before ``now`` (a timestamp; the clock's, if None), whatever the session time zone."""
    clock = F.current_timestamp() if now is None else now
    return F.date_sub(F.to_utc_timestamp(clock, F.current_timezone()).cast("date"), 1).cast("string")
