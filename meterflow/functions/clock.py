"""Local time as Column expressions. The session time zone is UTC; zones are always named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL_TZ = "America/Chicago"


def local_time(ts: Column | str, tz: str = LOCAL_TZ) -> Column:
    return F.from_utc_timestamp(ts, tz)


def with_local_columns(df: DataFrame, ts: str = "ts", tz: str = LOCAL_TZ) -> DataFrame:
    """Adds local, month (yyyy-MM), month_num, hour, weekday (0 = Monday) and date of an interval's start."""
    return df.withColumn("local", local_time(F.col(ts), tz)).withColumns(
        {
            "month": F.date_format("local", "yyyy-MM"),
            "month_num": F.month("local"),
            "hour": F.hour("local"),
            "weekday": F.weekday("local"),
            "date": F.to_date("local"),
        }
    )


def is_ambiguous(wall: Column, tz: str = LOCAL_TZ) -> Column:
    """Whether a wall-clock time occurs twice: an hour after its first instant the clock shows it again."""
    first = F.to_utc_timestamp(wall, tz)
    return F.from_utc_timestamp(first + F.expr("INTERVAL 1 HOUR"), tz) == wall


def is_missing(wall: Column, tz: str = LOCAL_TZ) -> Column:
    """Whether a wall-clock time falls into the spring gap: no instant shows it."""
    return F.from_utc_timestamp(F.to_utc_timestamp(wall, tz), tz) != wall


def utc_of(wall: Column, second_pass: Column, tz: str = LOCAL_TZ, in_gap: str = "shift") -> Column:
    """The instant of a wall-clock time. second_pass picks the later of two; in_gap: shift to the gap's end, or null."""
    first = F.to_utc_timestamp(wall, tz)
    found = F.when(is_ambiguous(wall, tz) & second_pass, first + F.expr("INTERVAL 1 HOUR")).otherwise(first)
    # The end of the gap: the last full hour shown before it, one hour on.
    end = F.to_utc_timestamp(F.date_trunc("hour", wall) + F.expr("INTERVAL 1 HOUR"), tz)
    return F.when(is_missing(wall, tz), end if in_gap == "shift" else F.lit(None).cast("timestamp")).otherwise(found)


def day_grid(date: Column, tz: str = LOCAL_TZ, minutes: int = 15) -> Column:
    """The instants of a local calendar day's intervals: 92, 96 or 100 quarter-hours."""
    start = F.to_utc_timestamp(date.cast("timestamp"), tz)
    end = F.to_utc_timestamp(F.date_add(date, 1).cast("timestamp"), tz)
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    return F.sequence(start, end - step, step)


def days_in_month(month: Column) -> Column:
    """Of a yyyy-MM string."""
    return F.dayofmonth(F.last_day(F.to_date(F.concat(month, F.lit("-01")))))
