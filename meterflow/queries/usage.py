"""Queries over meter readings and prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock
from ..operators import prices as price_ops
from ..operators import usage as ops
from ..plans import schema
from . import adapters as a


def _r(df, *columns, digits=6):
    """Money and energy rounded in the last projection only."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def usage_interval_grid(spark, sf):
    return _r(clock.with_local_columns(a.usage15(spark, sf)).drop("local"), "import_kwh", "export_kwh").withColumn("date", F.col("date").cast("string"))


def usage_monthly(spark, sf):
    return _r(ops.monthly_usage(a.usage15(spark, sf)), "import_kwh", "export_kwh", "net_kwh")


def usage_hour_month_pivot(spark, sf):
    return _r(ops.hour_month_pivot(a.usage15(spark, sf), ["2023-12", "2024-01"]), "2023-12", "2024-01")


def usage_day_peak_night(spark, sf):
    return _r(ops.day_peak_night(a.usage15(spark, sf)), "net_kwh")


def usage_metrics(spark, sf):
    return _r(ops.usage_metrics(a.usage15(spark, sf)), "import_kwh", "export_kwh", "net_kwh")


def usage_quality(spark, sf):
    return ops.missing_counts(a.usage15(spark, sf)).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm") for c in ("start", "end")})


def usage_missing_grid(spark, sf):
    return ops.missing_grid(a.usage15(spark, sf)).groupBy("meter_id").agg(F.count(F.lit(1)).alias("missing"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm").alias("first_gap"))


def _readings(spark, sf):
    """events as raw readings of two channels, with the id as order in a file and the user's parity as file."""
    e = a.table(spark, sf, "events")
    bucket = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return e.select(
        (F.col("user_id") % 20).cast("string").alias("meter_id"),
        bucket.alias("ts"),
        F.when(F.col("event_type").isin(*a.IMPORT_TYPES), "import").otherwise("export").alias("channel"),
        F.col("value").alias("kwh"),
        F.col("event_id").alias("row"),
        (F.col("user_id") % 3).alias("modified"),
        F.concat(F.lit("file"), F.col("user_id").cast("string")).alias("path"),
    )


def dedup_keep_first(spark, sf):
    kept = ops.keep_first(_readings(spark, sf), ["meter_id", "ts", "channel"], ["row"])
    return kept.select("meter_id", F.date_format("ts", "yyyy-MM-dd HH").alias("ts"), "channel", "kwh", "row")


def dedup_newest_wins(spark, sf):
    first = ops.keep_first(_readings(spark, sf), ["meter_id", "ts", "channel", "path"], ["row"])
    kept = ops.newest_wins(first, ["meter_id", "ts", "channel"])
    return kept.select("meter_id", F.date_format("ts", "yyyy-MM-dd HH").alias("ts"), "channel", "kwh", "path")


def channel_align(spark, sf):
    kept = ops.keep_first(_readings(spark, sf), ["meter_id", "ts", "channel"], ["row"])
    return ops.aligned_channels(kept).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH"))


def interval_violations(spark, sf):
    raw = _readings(spark, sf).select("meter_id", "ts", (F.col("kwh") - 5).alias("import_kwh"), F.lit(0.0).alias("export_kwh"))
    return schema.interval_violations(raw)


def month_completeness(spark, sf):
    return ops.month_states(a.one_meter(spark, sf), rows_per_day=1)


def billing_window_last12(spark, sf):
    windows = ops.billing_windows(ops.billing_months(a.usage_daily(spark, sf), rows_per_day=1))
    return windows.withColumn("months_kept", F.array_join("months_kept", ",")).drop("note")


def window_membership(spark, sf):
    usage = a.usage_daily(spark, sf)
    kept = ops.in_billing_window(usage, ops.billing_months(usage, rows_per_day=1))
    return _r(ops.monthly_usage(kept), "import_kwh", "export_kwh", "net_kwh")


def price_dup_mean(spark, sf):
    e = a.table(spark, sf, "events")
    raw = e.select(F.col("event_type").alias("zone"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), (F.col("value") / 1000.0).alias("price_usd_kwh"))
    return _r(price_ops.averaged(raw), "price_usd_kwh", digits=9).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH"))


def price_join_left(spark, sf):
    joined = a.usage15(spark, sf).join(a.gappy_prices(spark, sf).select("ts", "price_usd_kwh"), "ts", "left")
    return joined.groupBy("meter_id").agg(F.count(F.lit(1)).alias("rows"), F.count("price_usd_kwh").alias("priced"), F.round(F.sum(F.col("import_kwh") * F.col("price_usd_kwh")), 6).alias("cost"))


def price_gap_fill(spark, sf):
    """One series' gaps against the full quarter-hour calendar: few enough to be estimated."""
    calendar = a.hourly_prices(spark, sf).select(F.lit("all").alias("meter_id"), "ts", F.lit(1.0).alias("import_kwh"), F.lit(0.0).alias("export_kwh"))
    filled, _ = price_ops.aligned(calendar, a.gappy_prices(spark, sf))
    return filled.select(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), F.round("price", 9).alias("price"), "estimated")


def price_gap_report(spark, sf):
    _, report = price_ops.aligned(a.usage15(spark, sf), a.gappy_prices(spark, sf))
    return _r(report, "fraction")


def rtw_clip(spark, sf):
    formula = F.struct(F.lit(1.05).alias("multiplier"), F.lit(0.5).alias("adder_ckwh"), F.lit(30.0).alias("cap_ckwh"), F.lit(20.0).alias("floor_ckwh"))
    p = a.hourly_prices(spark, sf)
    return p.select(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), F.round(price_ops.rtw_rate(F.col("price_usd_kwh"), formula), 9).alias("usd_kwh"))


QUERIES = {
    f.__name__: f
    for f in (
        usage_interval_grid, usage_monthly, usage_hour_month_pivot, usage_day_peak_night, usage_metrics, usage_quality, usage_missing_grid, dedup_keep_first, dedup_newest_wins,
        channel_align, interval_violations, month_completeness, billing_window_last12, window_membership, price_dup_mean, price_join_left, price_gap_fill, price_gap_report, rtw_clip,
    )
}

_U, _L, _P = a.USAGE15_SQL, a.LOCAL_SQL, a.PRICES_SQL
_READINGS = """r AS (SELECT (user_id % 20)::VARCHAR AS meter_id, date_trunc('hour', ts) AS ts, CASE WHEN event_type IN ('view','click','signup') THEN 'import' ELSE 'export' END AS channel,
  value AS kwh, event_id AS row, user_id % 3 AS modified, 'file' || user_id::VARCHAR AS path FROM events)"""
_GAPPY = "gappy AS (SELECT * FROM prices WHERE (epoch(ts)::BIGINT // 3600) % 64 <> 0)"
_STATES = """states AS (SELECT meter_id, month, count(*) AS rows, count(*) >= day(last_day((month || '-01')::DATE)) * 0.99 AS complete FROM loc GROUP BY 1, 2),
  ranked AS (SELECT *, count(*) FILTER (WHERE complete) OVER (PARTITION BY meter_id) AS n, row_number() OVER (PARTITION BY meter_id ORDER BY month DESC) AS any_rank,
    sum(complete::INT) OVER (PARTITION BY meter_id ORDER BY month DESC) AS complete_rank FROM states),
  kept AS (SELECT *, CASE WHEN n >= 12 THEN complete AND complete_rank <= 12 ELSE any_rank <= 12 END AS kept FROM ranked)"""

ORACLE_SQL = {
    "usage_interval_grid": f"WITH {_U}, {_L} SELECT meter_id, ts, round(import_kwh, 6) AS import_kwh, round(export_kwh, 6) AS export_kwh, month, month_num, hour, weekday, date::VARCHAR AS date FROM loc",
    "usage_monthly": f"WITH {_U}, {_L} SELECT meter_id, month, round(sum(import_kwh), 6) AS import_kwh, round(sum(export_kwh), 6) AS export_kwh, round(sum(import_kwh - export_kwh), 6) AS net_kwh FROM loc GROUP BY 1, 2",
    "usage_hour_month_pivot": f"""WITH {_U}, {_L} SELECT hour, round(avg((import_kwh - export_kwh) / 0.25) FILTER (WHERE month = '2023-12'), 6) AS "2023-12",
        round(avg((import_kwh - export_kwh) / 0.25) FILTER (WHERE month = '2024-01'), 6) AS "2024-01" FROM loc GROUP BY hour""",
    "usage_day_peak_night": f"""WITH {_U}, {_L}, p AS (SELECT meter_id, coalesce(sum(import_kwh - export_kwh) FILTER (WHERE hour BETWEEN 6 AND 17), 0) AS d,
        coalesce(sum(import_kwh - export_kwh) FILTER (WHERE hour BETWEEN 18 AND 20), 0) AS k, coalesce(sum(import_kwh - export_kwh) FILTER (WHERE hour >= 21 OR hour < 6), 0) AS n FROM loc GROUP BY 1)
        SELECT meter_id, 'Day' AS period, round(d, 6) AS net_kwh FROM p UNION ALL SELECT meter_id, 'Peak', round(k, 6) FROM p UNION ALL SELECT meter_id, 'Night', round(n, 6) FROM p""",
    "usage_metrics": f"WITH {_U}, {_L} SELECT meter_id, count(DISTINCT date) AS days, round(sum(import_kwh), 6) AS import_kwh, round(sum(export_kwh), 6) AS export_kwh, round(sum(import_kwh - export_kwh), 6) AS net_kwh FROM loc GROUP BY 1",
    "usage_quality": f"""WITH {_U} SELECT meter_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS start, strftime(max(ts), '%Y-%m-%d %H:%M') AS "end", count(*) AS rows,
        (epoch(max(ts) - min(ts))::BIGINT // 900 + 1 - count(*))::BIGINT AS missing FROM usage GROUP BY 1""",
    "usage_missing_grid": f"""WITH {_U}, g AS (SELECT meter_id, unnest(generate_series(min(ts), max(ts), INTERVAL 15 MINUTE)) AS ts FROM usage GROUP BY 1)
        SELECT meter_id, count(*) AS missing, strftime(min(ts), '%Y-%m-%d %H:%M') AS first_gap FROM g ANTI JOIN usage USING (meter_id, ts) GROUP BY 1""",
    "dedup_keep_first": f"""WITH {_READINGS} SELECT meter_id, strftime(ts, '%Y-%m-%d %H') AS ts, channel, kwh, row FROM r QUALIFY row_number() OVER (PARTITION BY meter_id, ts, channel ORDER BY row) = 1""",
    "dedup_newest_wins": f"""WITH {_READINGS}, f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY meter_id, ts, channel, path ORDER BY row) = 1)
        SELECT meter_id, strftime(ts, '%Y-%m-%d %H') AS ts, channel, kwh, path FROM f QUALIFY row_number() OVER (PARTITION BY meter_id, ts, channel ORDER BY modified DESC, path DESC) = 1""",
    "channel_align": f"""WITH {_READINGS}, f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY meter_id, ts, channel ORDER BY row) = 1),
        i AS (SELECT * FROM f WHERE channel = 'import'), e AS (SELECT * FROM f WHERE channel = 'export')
        SELECT coalesce(i.meter_id, e.meter_id) AS meter_id, strftime(coalesce(i.ts, e.ts), '%Y-%m-%d %H') AS ts, coalesce(i.kwh, 0.0) AS import_kwh, coalesce(e.kwh, 0.0) AS export_kwh
        FROM i FULL JOIN e ON i.meter_id = e.meter_id AND i.ts = e.ts""",
    "interval_violations": f"""WITH {_READINGS} SELECT meter_id, 'duplicate interval start' AS violation, count(*) AS n FROM (SELECT meter_id, ts FROM r GROUP BY ALL HAVING count(*) > 1) GROUP BY 1
        UNION ALL SELECT meter_id, 'reading negative or missing', count(*) FROM r WHERE kwh - 5 < 0 GROUP BY 1""",
    "month_completeness": f"WITH {a.daily_sql(1)}, {_L}, {_STATES} SELECT meter_id, month, rows, complete FROM states",
    "billing_window_last12": f"""WITH {a.daily_sql(20)}, {_L}, {_STATES} SELECT meter_id, count(*) AS months_available, count(*) FILTER (WHERE kept) AS months_used, min(month) FILTER (WHERE kept) AS start,
        max(month) FILTER (WHERE kept) AS "end", count(*) FILTER (WHERE kept AND NOT complete) AS partial_months, string_agg(month, ',' ORDER BY month) FILTER (WHERE kept) AS months_kept,
        count(*) FILTER (WHERE kept) < count(*) AS trimmed, count(*) FILTER (WHERE kept) >= 12 AS reliable FROM kept GROUP BY 1""",
    "window_membership": f"""WITH {a.daily_sql(20)}, {_L}, {_STATES} SELECT meter_id, month, round(sum(import_kwh), 6) AS import_kwh, round(sum(export_kwh), 6) AS export_kwh,
        round(sum(import_kwh - export_kwh), 6) AS net_kwh FROM loc SEMI JOIN (SELECT meter_id, month FROM kept WHERE kept) k USING (meter_id, month) GROUP BY 1, 2""",
    "price_dup_mean": "SELECT event_type AS zone, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS ts, round(avg(value / 1000.0), 9) AS price_usd_kwh FROM events GROUP BY 1, 2",
    "price_join_left": f"WITH {_U}, {_P}, {_GAPPY} SELECT meter_id, count(*) AS rows, count(price_usd_kwh) AS priced, round(sum(import_kwh * price_usd_kwh), 6) AS cost FROM usage LEFT JOIN gappy USING (ts) GROUP BY 1",
    "price_gap_fill": f"""WITH {_P}, {_GAPPY}, recent AS (SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS l FROM gappy WHERE ts >= (SELECT max(ts) FROM gappy) - INTERVAL 30 DAY),
        profile AS (SELECT hour(l) AS h, minute(l) AS m, avg(price_usd_kwh) AS p FROM recent GROUP BY 1, 2), few AS (SELECT (SELECT count(*) FROM prices ANTI JOIN gappy USING (ts)) <= 0.02 * (SELECT count(*) FROM prices) AS ok)
        SELECT strftime(c.ts, '%Y-%m-%d %H:%M') AS ts, round(coalesce(g.price_usd_kwh, CASE WHEN ok THEN coalesce(p, (SELECT avg(price_usd_kwh) FROM recent)) END), 9) AS price, g.price_usd_kwh IS NULL AND ok AS estimated
        FROM (SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS l FROM prices) c CROSS JOIN few LEFT JOIN gappy g ON g.ts = c.ts LEFT JOIN profile ON h = hour(c.l) AND m = minute(c.l)""",
    "price_gap_report": f"""WITH {_U}, {_P}, {_GAPPY}, x AS (SELECT meter_id, count(*) FILTER (WHERE price_usd_kwh IS NULL) AS missing, count(*) AS total FROM usage LEFT JOIN gappy USING (ts) GROUP BY 1)
        SELECT meter_id, missing, total, CASE WHEN missing <= 0.02 * total THEN missing ELSE 0 END AS filled, missing <= 0.02 * total AS within_tolerance, round(missing / total, 6) AS fraction FROM x""",
    "rtw_clip": f"WITH {_P} SELECT strftime(ts, '%Y-%m-%d %H:%M') AS ts, round(greatest(least(price_usd_kwh * 1.05 + 0.005, 0.3), 0.2), 9) AS usd_kwh FROM prices",
}
