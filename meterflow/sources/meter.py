"""Interval exports of meters (CSV): two channels, local time labels, daylight saving by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clock import LOCAL_TZ, day_grid, utc_of
from ..operators import usage
from .files import csv_rows, file_lines

# Columns of the export and its channel labels.
COLUMNS = {
    "esiid": ["ESIID"],
    "usage_date": ["USAGE_DATE"],
    "revision_date": ["REVISION_DATE"],
    "start": ["USAGE_START_TIME"],
    "end": ["USAGE_END_TIME"],
    "kwh": ["USAGE_KWH"],
    "estimated": ["ESTIMATED_ACTUAL"],
    "label": ["CONSUMPTION_SURPLUSGENERATION"],
}
CHANNELS = {"Consumption": "import", "Surplus Generation": "export"}


def raw_rows(files: DataFrame) -> DataFrame:
    """All rows as strings, with file and row order; `channel` is null for an unknown label."""
    rows = csv_rows(files, COLUMNS)
    channel = F.coalesce(*(F.when(F.col("label") == label, F.lit(c)) for label, c in CHANNELS.items()))
    return rows.withColumns({"meter_id": F.regexp_replace("esiid", "^'+", ""), "channel": channel})


def readings(rows: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    """(path, modified, meter_id, channel, ts, kwh, row, blank, by_position) of rows with a known channel.

    A day with as many rows as its local calendar day has quarter-hours is dated by position, whatever
    its labels say; any other by its labels: the second row of a repeated label is the later pass, a
    label in the spring gap is dropped. Blank and unreadable readings count as 0.
    """
    known = rows.where("channel IS NOT NULL").withColumn("date", F.to_date(F.expr("try_to_timestamp(usage_date, 'MM/dd/yyyy')")))
    day = Window.partitionBy("path", "meter_id", "channel", "usage_date")
    same = Window.partitionBy("path", "meter_id", "channel", "usage_date", "start")
    known = known.withColumns(
        {
            "rows": F.count(F.lit(1)).over(day),
            "position": F.row_number().over(day.orderBy("row")),
            "occurrence": F.row_number().over(same.orderBy("row")),
            "grid": day_grid(F.col("date"), tz),
        }
    )
    wall = F.expr("try_to_timestamp(concat(usage_date, ' ', start), 'MM/dd/yyyy HH:mm')")
    whole = F.col("rows") == F.size("grid")
    ts = F.when(whole, F.try_element_at("grid", F.col("position"))).otherwise(utc_of(wall, F.col("occurrence") > 1, tz, in_gap="null"))
    kwh = F.coalesce(F.expr("try_cast(trim(kwh) AS DOUBLE)"), F.lit(0.0))
    blank = F.coalesce(F.trim("kwh"), F.lit("")) == ""
    out = known.select("path", "modified", "meter_id", "channel", ts.alias("ts"), kwh.alias("kwh"), "row", blank.alias("blank"), (F.col("estimated") == "E").alias("estimated"), whole.alias("by_position"))
    return out


def intervals(read: DataFrame) -> DataFrame:
    """(meter_id, ts, import_kwh, export_kwh): the first row within a file, the newest file across files, channels side by side."""
    dated = read.where("ts IS NOT NULL")
    first = usage.keep_first(dated, ["path", "meter_id", "channel", "ts"], ["row"])
    # A file's interval holds both channels, one it lacks as 0, before files are compared.
    of = lambda c: F.coalesce(F.max(F.when(F.col("channel") == c, F.col("kwh"))), F.lit(0.0)).alias(f"{c}_kwh")
    per_file = first.groupBy("path", "modified", "meter_id", "ts").agg(of("import"), of("export"))
    return usage.newest_wins(per_file, ["meter_id", "ts"]).select("meter_id", "ts", "import_kwh", "export_kwh")


def quality(read: DataFrame) -> DataFrame:
    """Per file and meter: rows per channel, blanks, estimates, duplicates, dropped rows, days dated by label, and the grid's gaps."""
    per = ["path", "meter_id"]
    first = read.where("ts IS NOT NULL").groupBy(*per, "channel", "ts").agg(F.count(F.lit(1)).alias("n"))
    kept = first.groupBy(*per).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("channel", F.lit(0).cast("long"))))).alias("_"), F.sum(F.col("n") - 1).alias("duplicates"))
    rows = first.groupBy(*per, "channel").agg(F.count(F.lit(1)).alias("n")).groupBy(*per).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "n")))).alias("rows_per_channel"))
    counts = read.groupBy(*per).agg(
        F.count_if("blank").alias("blanks"), F.count_if("estimated").alias("estimated"), F.count_if(F.col("ts").isNull()).alias("dropped"), F.count_if(~F.col("by_position")).alias("rows_by_label")
    )
    span = first.groupBy(*per).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count_distinct("ts").alias("found"))
    gaps = span.withColumn("missing", ((F.unix_timestamp("end") - F.unix_timestamp("start")) / 900 + 1 - F.col("found")).cast("long")).drop("found")
    return counts.join(rows, per, "left").join(kept.drop("_"), per, "left").join(gaps, per, "left")


def unknown_labels(rows: DataFrame) -> DataFrame:
    """(path, label) that belong to no channel; their rows are ignored."""
    return rows.where("channel IS NULL AND label IS NOT NULL").select("path", "label").distinct()


def load(spark: SparkSession, path: str, pattern: str = "IntervalData*.csv", tz: str = LOCAL_TZ) -> DataFrame:
    """The intervals of all exports under path."""
    return intervals(readings(raw_rows(file_lines(spark, path, pattern)), tz))
