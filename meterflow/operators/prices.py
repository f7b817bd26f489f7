"""Wholesale price series: duplicates, alignment to usage, gap estimation, indexed rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import LOCAL_TZ, local_time

#: A gap of at most this share of a meter's intervals is estimated.
MAX_GAP = 0.02
LOOKBACK_DAYS = 30


def averaged(prices: DataFrame) -> DataFrame:
    """One row per (zone, ts): the mean of duplicates; null prices and times do not count."""
    return prices.where("ts IS NOT NULL AND price_usd_kwh IS NOT NULL").groupBy("zone", "ts").agg(F.avg("price_usd_kwh").alias("price_usd_kwh"))


def rtw_rate(price: Column, rtw: Column) -> Column:
    """$/kWh of an indexed rate: price * multiplier + adder, cut at the cap, then raised to the floor; null price: null."""
    raw = price * F.coalesce(rtw["multiplier"], F.lit(1.0)) + F.coalesce(rtw["adder_ckwh"], F.lit(0.0)) / 100.0
    capped = F.when(rtw["cap_ckwh"].isNull(), raw).otherwise(F.least(raw, rtw["cap_ckwh"] / 100.0))
    return F.when(price.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(capped, F.coalesce(rtw["floor_ckwh"], F.lit(0.0)) / 100.0))


def gap_profile(prices: DataFrame, lookback_days: int = LOOKBACK_DAYS, tz: str = LOCAL_TZ) -> tuple[DataFrame, DataFrame]:
    """((hour, minute, profile), (overall,)): means by local time of day over the last days of the whole series."""
    known = prices.where("price_usd_kwh IS NOT NULL")
    last = known.agg((F.max("ts") - F.expr(f"INTERVAL {lookback_days} DAYS")).alias("cutoff"))
    recent = known.join(F.broadcast(last), F.col("ts") >= F.col("cutoff")).withColumn("wall", local_time("ts", tz))
    profile = recent.groupBy(F.hour("wall").alias("p_hour"), F.minute("wall").alias("p_minute")).agg(F.avg("price_usd_kwh").alias("profile"))
    return profile, recent.agg(F.avg("price_usd_kwh").alias("overall"))


def aligned(intervals: DataFrame, prices: DataFrame, max_gap: float = MAX_GAP, lookback_days: int = LOOKBACK_DAYS, tz: str = LOCAL_TZ) -> tuple[DataFrame, DataFrame]:
    """(intervals with price and estimated, gap report per meter).

    prices has one zone. A meter that lacks prices for at most max_gap of its intervals has them
    estimated from the mean at the same local time of day (else the overall mean); beyond that its
    gaps stay null. The report: missing, total, filled, within_tolerance, fraction.
    The price side is a calendar (35,040 rows a year), so it is broadcast when its size allows.
    """
    joined = intervals.join(prices.select("ts", F.col("price_usd_kwh").alias("published")), "ts", "left")
    report = joined.groupBy("meter_id").agg(F.count_if(F.col("published").isNull()).alias("missing"), F.count(F.lit(1)).alias("total"))
    profile, overall = gap_profile(prices, lookback_days, tz)
    # One row; null over an empty series, in which case nothing can be filled.
    report = report.join(F.broadcast(overall))
    within = (F.col("missing") <= max_gap * F.col("total")) & (F.col("overall").isNotNull() | (F.col("missing") == 0))
    report = report.select(
        "meter_id",
        "missing",
        "total",
        F.when(within, F.col("missing")).otherwise(F.lit(0)).cast("long").alias("filled"),
        within.alias("within_tolerance"),
        (F.col("missing") / F.col("total")).alias("fraction"),
        "overall",
    )
    wall = local_time("ts", tz)
    out = joined.join(report.select("meter_id", "within_tolerance", "overall"), "meter_id").withColumns({"p_hour": F.hour(wall), "p_minute": F.minute(wall)})
    out = out.join(F.broadcast(profile), ["p_hour", "p_minute"], "left")
    estimate = F.when(F.col("within_tolerance"), F.coalesce("profile", "overall"))
    out = out.select(*intervals.columns, F.coalesce("published", estimate).alias("price"), (F.col("published").isNull() & estimate.isNotNull()).alias("estimated"))
    return out, report.drop("overall")
