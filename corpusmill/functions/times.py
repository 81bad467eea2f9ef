"""Time functions with an injected now."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def millis(iso: Column) -> Column:
    """Milliseconds of an ISO 8601 string, 0 if it is none."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(iso)), F.lit(0))


def ago(then: Column, now: Column) -> Column:
    """How long ago: just now, minutes, hours, days, then the date."""
    s = F.unix_seconds(now) - F.unix_seconds(then)
    return (
        F.when(s < 60, "just now")
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" min ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit(" h ago")))
        .when(s < 7 * 86400, F.concat(F.floor(s / 86400).cast("string"), F.lit(" d ago")))
        .otherwise(F.date_format(then, "yyyy-MM-dd"))
    )


def stamp(at: Column) -> Column:
    """A readable time with its weekday."""
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss EEEE")
