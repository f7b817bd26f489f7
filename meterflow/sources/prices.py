"""Wholesale price files: CSV, and workbooks where a reader is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import LOCAL_TZ, utc_of
from ..operators.prices import averaged
from .files import csv_rows, file_lines, headers

# Spellings of price headers.
COLUMNS = {
    "delivery_date": ["Delivery Date", "DeliveryDate"],
    "delivery_hour": ["Delivery Hour", "DeliveryHour"],
    "delivery_interval": ["Delivery Interval", "DeliveryInterval"],
    "settlement_point_name": ["Settlement Point Name", "SettlementPointName"],
    "settlement_point_price": ["Settlement Point Price", "SettlementPointPrice"],
    "repeated_hour_flag": ["Repeated Hour Flag", "RepeatedHourFlag"],
    "dst_flag": ["DSTFlag", "DST Flag"],
}
REQUIRED = ("delivery_date", "delivery_hour", "delivery_interval", "settlement_point_name", "settlement_point_price")


def dated(rows: DataFrame, zone: str | None = None, tz: str = LOCAL_TZ) -> DataFrame:
    """(zone, ts, price_usd_kwh) from raw string rows.

    Local time is date + (hour - 1) h + (interval - 1) * 15 min. A repeated-hour flag of Y is the later
    pass; where that column is absent, a DST flag of Y is the earlier one. Times in the spring gap move
    to its end. Rows without date, hour, interval or price are left out.
    """
    date = F.coalesce(F.expr("try_to_timestamp(delivery_date, 'MM/dd/yyyy')"), F.expr("try_to_timestamp(delivery_date)"))
    number = lambda c: F.expr(f"try_cast(trim({c}) AS DOUBLE)")
    minutes = ((number("delivery_hour") - 1) * 60 + (number("delivery_interval") - 1) * 15).cast("int")
    wall = date + F.make_interval(mins=minutes)
    yes = lambda c: F.coalesce(F.upper(F.trim(c)) == "Y", F.lit(False))
    second = F.when(F.col("has_repeated_flag"), yes("repeated_hour_flag")).when(F.col("has_dst_flag"), ~yes("dst_flag")).otherwise(F.lit(False))
    point = F.upper(F.trim("settlement_point_name"))
    rows = rows if zone is None else rows.where(point == zone.strip().upper())
    out = rows.select(point.alias("zone"), utc_of(wall, second, tz, in_gap="shift").alias("ts"), (number("settlement_point_price") / 1000.0).alias("price_usd_kwh"))
    return out.where("ts IS NOT NULL AND price_usd_kwh IS NOT NULL")


def missing_columns(files: DataFrame) -> DataFrame:
    """(path, missing): files without a required column."""
    plain = lambda n: "".join(c for c in n.lower() if c.isalnum())
    lacks = F.array_compact(F.array(*(F.when(~F.arrays_overlap("header", F.array(*(F.lit(plain(s)) for s in COLUMNS[c]))), F.lit(c)) for c in REQUIRED)))
    return headers(files).select("path", lacks.alias("missing")).where("size(missing) > 0")


def csv_prices(files: DataFrame) -> DataFrame:
    plain = lambda names: F.array(*(F.lit("".join(c for c in n.lower() if c.isalnum())) for n in names))
    flags = headers(files).select("path", F.arrays_overlap("header", plain(COLUMNS["repeated_hour_flag"])).alias("has_repeated_flag"), F.arrays_overlap("header", plain(COLUMNS["dst_flag"])).alias("has_dst_flag"))
    return csv_rows(files, COLUMNS).join(flags, "path")


def workbook_prices(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of every sheet of .xlsx files; needs openpyxl, which is imported only here."""
    import openpyxl  # noqa: F401

    names = list(COLUMNS)

    def run(frames):
        import io

        import pandas as pd

        plain = {"".join(x for x in s.lower() if x.isalnum()): c for c, spellings in COLUMNS.items() for s in spellings}
        for frame in frames:
            for at, content in zip(frame["path"], frame["content"], strict=True):
                for sheet in pd.read_excel(io.BytesIO(content), sheet_name=None, dtype=str).values():
                    sheet = sheet.rename(columns={c: plain.get("".join(x for x in str(c).lower() if x.isalnum()), c) for c in sheet.columns})
                    out = sheet.reindex(columns=names).assign(path=at, has_repeated_flag="repeated_hour_flag" in sheet.columns, has_dst_flag="dst_flag" in sheet.columns)
                    yield out[["path", *names, "has_repeated_flag", "has_dst_flag"]]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).where("NOT _metadata.file_name LIKE '~$%'")
    schema = "path string, " + ", ".join(f"{c} string" for c in names) + ", has_repeated_flag boolean, has_dst_flag boolean"
    return files.select("path", "content").mapInPandas(run, schema)


def load(spark: SparkSession, path: str, zone: str = "LZ_SOUTH", tz: str = LOCAL_TZ) -> DataFrame:
    """One zone's price series from the CSV files under path: duplicates averaged."""
    files = file_lines(spark, path, "*.csv")
    bad = missing_columns(files).first()
    if bad:
        raise ValueError(f"{bad.path}: missing expected columns {bad.missing}")
    return averaged(dated(csv_prices(files), zone, tz))
