"""Meter readings: duplicates, channels, quality, billing windows and usage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import LOCAL_TZ, days_in_month, with_local_columns

DAY_HOURS = tuple(range(6, 18))
PEAK_HOURS = tuple(range(18, 21))
NIGHT_HOURS = (*range(21, 24), *range(0, 6))
BILLING_MONTHS = 12
COMPLETE_SHARE = 0.99


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; min_by keeps one row per key and task before the exchange, where a window would move all."""
    rest = [c for c in rows.columns if c not in keys]
    one = F.min_by(F.struct(*rest), F.struct(*order)).alias("row")
    return rows.groupBy(*keys).agg(one).select(*keys, "row.*").select(*rows.columns)


def newest_wins(rows: DataFrame, keys: list[str], modified: str = "modified", path: str = "path") -> DataFrame:
    """Of rows with one key the one from the newest file; of equally new files the last by path."""
    rest = [c for c in rows.columns if c not in keys]
    one = F.max_by(F.struct(*rest), F.struct(modified, path)).alias("row")
    return rows.groupBy(*keys).agg(one).select(*keys, "row.*").select(*rows.columns)


def aligned_channels(readings: DataFrame) -> DataFrame:
    """(meter_id, ts, import_kwh, export_kwh) from (meter_id, ts, channel, kwh); a channel without a reading is 0."""
    of = lambda c: F.coalesce(F.max(F.when(F.col("channel") == c, F.col("kwh"))), F.lit(0.0)).alias(f"{c}_kwh")
    return readings.groupBy("meter_id", "ts").agg(of("import"), of("export"))


def missing_grid(intervals: DataFrame, minutes: int = 15) -> DataFrame:
    """(meter_id, ts) of the grid between a meter's first and last interval that have no row."""
    span = intervals.groupBy("meter_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    grid = span.select("meter_id", F.explode(F.sequence("first", "last", F.expr(f"INTERVAL {minutes} MINUTES"))).alias("ts"))
    return grid.join(intervals.select("meter_id", "ts"), ["meter_id", "ts"], "left_anti")


def missing_counts(intervals: DataFrame, minutes: int = 15) -> DataFrame:
    """(meter_id, start, end, rows, missing): by arithmetic on the grid, without building it."""
    seconds = F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))
    on_grid = F.floor(seconds / (60 * minutes)) + 1
    return intervals.groupBy("meter_id").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count_distinct("ts").alias("rows"), (on_grid - F.count_distinct("ts")).cast("long").alias("missing")
    )


def usage_metrics(intervals: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    """(meter_id, days, import_kwh, export_kwh, net_kwh)."""
    return with_local_columns(intervals, tz=tz).groupBy("meter_id").agg(
        F.count_distinct("date").alias("days"),
        F.sum("import_kwh").alias("import_kwh"),
        F.sum("export_kwh").alias("export_kwh"),
        F.sum(F.col("import_kwh") - F.col("export_kwh")).alias("net_kwh"),
    )


def monthly_usage(intervals: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    """(meter_id, month, import_kwh, export_kwh, net_kwh)."""
    return with_local_columns(intervals, tz=tz).groupBy("meter_id", "month").agg(
        F.sum("import_kwh").alias("import_kwh"), F.sum("export_kwh").alias("export_kwh"), F.sum(F.col("import_kwh") - F.col("export_kwh")).alias("net_kwh")
    )


def hour_month_pivot(intervals: DataFrame, months: list[str], hours_per_interval: float = 0.25, tz: str = LOCAL_TZ) -> DataFrame:
    """(hour, one column per month): mean net kW. The months are given, so no extra pass looks for them."""
    net = (F.col("import_kwh") - F.col("export_kwh")) / hours_per_interval
    return with_local_columns(intervals, tz=tz).groupBy("hour").pivot("month", months).agg(F.avg(net))


def day_peak_night(intervals: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    """(meter_id, period, net_kwh) for Day, Peak and Night."""
    net = F.col("import_kwh") - F.col("export_kwh")
    of = lambda hours: F.coalesce(F.sum(F.when(F.col("hour").isin(*hours), net)), F.lit(0.0))
    sums = with_local_columns(intervals, tz=tz).groupBy("meter_id").agg(of(DAY_HOURS).alias("Day"), of(PEAK_HOURS).alias("Peak"), of(NIGHT_HOURS).alias("Night"))
    return sums.unpivot("meter_id", ["Day", "Peak", "Night"], "period", "net_kwh")


def month_states(intervals: DataFrame, rows_per_day: int = 96, tz: str = LOCAL_TZ) -> DataFrame:
    """(meter_id, month, rows, complete)."""
    counts = with_local_columns(intervals, tz=tz).groupBy("meter_id", "month").agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("complete", F.col("rows") >= days_in_month(F.col("month")) * rows_per_day * COMPLETE_SHARE)


def billing_months(intervals: DataFrame, rows_per_day: int = 96, months: int = BILLING_MONTHS, tz: str = LOCAL_TZ) -> DataFrame:
    """(meter_id, month, rows, complete, kept): the latest complete months, or the latest of any kind where too few are complete."""
    states = month_states(intervals, rows_per_day, tz)
    by = Window.partitionBy("meter_id")
    ranked = states.withColumns(
        {
            "n_complete": F.count_if("complete").over(by),
            "rank_any": F.row_number().over(by.orderBy(F.desc("month"))),
            "rank_complete": F.sum(F.col("complete").cast("int")).over(by.orderBy(F.desc("month"))),
        }
    )
    by_complete = F.col("complete") & (F.col("rank_complete") <= months)
    kept = F.when(F.col("n_complete") >= months, by_complete).otherwise(F.col("rank_any") <= months)
    return ranked.select("meter_id", "month", "rows", "complete", kept.alias("kept"))


def billing_windows(states: DataFrame, months: int = BILLING_MONTHS) -> DataFrame:
    """One row per meter from billing_months: months_available, months_used, start, end, trimmed, partial_months, months_kept, reliable, note."""
    kept = F.col("kept")
    out = states.groupBy("meter_id").agg(
        F.count(F.lit(1)).alias("months_available"),
        F.count_if(kept).alias("months_used"),
        F.min(F.when(kept, F.col("month"))).alias("start"),
        F.max(F.when(kept, F.col("month"))).alias("end"),
        F.count_if(kept & ~F.col("complete")).alias("partial_months"),
        F.array_sort(F.collect_list(F.when(kept, F.col("month")))).alias("months_kept"),
    )
    out = out.withColumns({"trimmed": F.col("months_used") < F.col("months_available"), "reliable": F.col("months_used") >= months})
    note = (
        F.when(F.col("trimmed"), F.concat_ws("", F.lit("latest "), "months_used", F.lit(" of "), "months_available", F.lit(" months")))
        .when(~F.col("reliable"), F.concat_ws("", F.lit("only "), "months_used", F.lit(" months, not a full year")))
        .when(F.col("partial_months") > 0, F.concat_ws("", "partial_months", F.lit(" months lack days")))
        .otherwise("complete")
    )
    return out.withColumn("note", note)


def in_billing_window(intervals: DataFrame, states: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    """The intervals of kept months, by membership: a month left out between two kept ones stays out."""
    kept = states.where("kept").select("meter_id", "month")
    return with_local_columns(intervals, tz=tz).join(kept, ["meter_id", "month"], "left_semi").select(*intervals.columns)
