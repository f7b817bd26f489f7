"""Queries over files: the driver's tables written out as the files the sources read, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clock import local_time
from ..sources import market, meter, prices
from ..sources.files import csv_rows
from . import adapters as a

METERS = 10


def _file(rows, key, header, order, name):
    """One text per key: the header and the key's lines in order."""
    text = rows.groupBy(key.alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]), "\n").alias("body"))
    return text.select(F.concat(F.lit(name), F.col("key").cast("string"), F.lit(".csv")).alias("path"), F.concat(F.lit(name), F.col("key").cast("string"), F.lit(".csv")).alias("name"), F.to_timestamp(F.lit("2024-02-01")).alias("modified"), F.concat(F.lit(header + "\n"), "body").alias("text"))


def _exports(spark, sf):
    """events as interval exports, one file per meter; labels are local times, the last readings are left blank."""
    e = a.table(spark, sf, "events")
    wall = local_time(F.col("ts").cast("timestamp"))
    start = F.date_trunc("hour", wall) + F.make_interval(mins=(F.floor(F.minute(wall) / 15) * 15).cast("int"))
    label = F.when(F.col("event_type").isin(*a.IMPORT_TYPES), "Consumption").when(F.col("event_type") == "purchase", "Surplus Generation").otherwise("Other")
    kwh = F.when(F.col("event_id") % 50 == 0, "").otherwise(F.col("value").cast("string"))
    line = F.concat_ws(",", F.concat(F.lit("'"), (F.col("user_id") % METERS).cast("string")), F.date_format(start, "MM/dd/yyyy"), F.lit(""), F.date_format(start, "HH:mm"), F.lit(""), kwh, F.when(F.col("event_id") % 9 == 0, "E").otherwise("A"), label)
    rows = e.select((F.col("user_id") % METERS).alias("m"), "event_id", line.alias("line"))
    return _file(rows, F.col("m"), "ESIID,USAGE_DATE,REVISION_DATE,USAGE_START_TIME,USAGE_END_TIME,USAGE_KWH,ESTIMATED_ACTUAL,CONSUMPTION_SURPLUSGENERATION", ["event_id"], "IntervalData")


def meter_export_scan(spark, sf):
    """Intervals of the exports: first row in a file, channels side by side, blanks as 0."""
    read = meter.intervals(meter.readings(meter.raw_rows(_exports(spark, sf))))
    return read.select("meter_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), "import_kwh", "export_kwh")


def meter_export_quality(spark, sf):
    read = meter.quality(meter.readings(meter.raw_rows(_exports(spark, sf))))
    return read.select("meter_id", "blanks", "estimated", "duplicates", "dropped", "missing", F.try_element_at("rows_per_channel", F.lit("import")).alias("import_rows"), F.try_element_at("rows_per_channel", F.lit("export")).alias("export_rows"))


def unknown_channels(spark, sf):
    return meter.unknown_labels(meter.raw_rows(_exports(spark, sf)))


def price_file_scan(spark, sf):
    """Price files in two header spellings, another zone's rows and duplicates among them."""
    p = a.hourly_prices(spark, sf).withColumn("wall", local_time("ts"))
    hour, quarter = F.hour("wall") + 1, (F.minute("wall") / 15 + 1).cast("int")
    line = lambda zone, price: F.concat_ws(",", F.date_format("wall", "MM/dd/yyyy"), hour.cast("string"), quarter.cast("string"), F.lit(zone), price.cast("string"), F.lit("N"))
    mwh = F.round(F.col("price_usd_kwh") * 1000, 4)
    rows = p.select("ts", line(" lz_south ", mwh).alias("line")).unionByName(p.select("ts", line("LZ_WEST", mwh + 1).alias("line"))).unionByName(p.where("minute(ts) = 0").select("ts", line("LZ_SOUTH", mwh + 2).alias("line")))
    files = _file(rows, F.date_format("ts", "yyyy-MM"), "Delivery Date,Delivery Hour,Delivery Interval,Settlement Point Name,Settlement Point Price,Repeated Hour Flag", ["ts"], "prices")
    read = prices.averaged(prices.dated(prices.csv_prices(files), "LZ_SOUTH"))
    return read.select("zone", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), F.round("price_usd_kwh", 7).alias("price_usd_kwh"))


def market_list_scan(spark, sf):
    """Customers as a market-list file with quoted cells."""
    from ..operators import market as ops

    c = a.table(spark, sf, "customer").withColumn("line", F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), "c_name", F.lit(', Inc."')), F.col("c_mktsegment"), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, "Y").otherwise("N"), F.format_string("%.2f", "c_acctbal")))
    files = _file(c, F.lit(0), "[idKey],[RepCompany],[Product],[TermValue],[TimeOfUse],[kwh500]", ["c_custkey"], "list")
    read = ops.tidy(csv_rows(files, ops.HEADERS).drop("path", "name", "modified", "row"))
    return read.select(F.col("plan_id").cast("long").alias("id"), "retailer", "plan_name", "term_months", "tou", "kwh500")


def md_table_scan(spark, sf):
    """Parts as a plan index in Markdown: rows that do not fit, other sections and headings are left out."""
    p = a.table(spark, sf, "part")
    cells = lambda *x: F.concat(F.lit("| "), F.concat_ws(" | ", *x), F.lit(" |"))
    export = F.element_at(F.array(*map(F.lit, ("5.5¢/kWh", "Real time wholesale", "None", "0¢/kWh"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    line = cells(F.lit("Oncor"), "p_brand", F.concat("p_name", F.when(F.col("p_partkey") % 6 == 0, " + Battery").otherwise("")), F.col("p_size").cast("string"), F.concat((F.col("p_size") / 2).cast("string"), F.lit("¢/kWh")), export, F.when(F.col("p_partkey") % 3 == 0, "None").otherwise("$9.95"), F.when(F.col("p_partkey") % 2 == 0, "$20 per month remaining").otherwise("$150"), F.col("p_partkey").cast("string"))
    line = F.when(F.col("p_partkey") % 10 == 9, F.concat(line, F.lit(" extra |"))).otherwise(line)
    rows = p.select("p_partkey", line.alias("line"))
    body = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"]), "\n").alias("body"))
    head = "# Index\nGenerated: 2026-01-02T03:04:05\n\n## Top Plans\n| TDU | Plan |\n|---|---|\n| Oncor | no |\n\n## Competitor Plan Availability\n\n| TDU | Provider | Plan | Term | Import rate | Export credit | Base fee | Early termination fee | Source |\n|---|---|---|---|---|---|---|---|---|\n"
    files = body.select(F.lit("i.md").alias("path"), F.lit("i.md").alias("name"), F.to_timestamp(F.lit("2026-01-02")).alias("modified"), F.concat(F.lit(head), "body", F.lit("\n\n## Notes\n| a | b |\n")).alias("text"))
    return market.tidy_index(market.index_rows(files)).drop("raw_row", "generated")


def file_facts(spark, sf):
    """Facts about files from two sources, the later one winning where it speaks."""
    c = a.table(spark, sf, "customer")
    first = c.select(F.col("c_custkey").alias("file"), F.col("c_mktsegment").alias("name"), F.lit("list").alias("via"))
    second = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("file"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"), F.lit("found").alias("via"))
    return market.lookup(first, second)


def listing_resolution(spark, sf):
    c = a.table(spark, sf, "customer")
    listings = c.select(F.col("c_mktsegment").alias("retailer"), F.col("c_name").alias("plan_name"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey").cast("string")).alias("efl_url"))
    files = c.where("c_custkey % 4 <> 0").select(F.col("c_custkey").cast("string").alias("efl_url"), F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("file"))
    parsed = c.where("c_custkey % 3 <> 0").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("file"))
    return market.resolution(listings, files, parsed)


QUERIES = {f.__name__: f for f in (meter_export_scan, meter_export_quality, unknown_channels, price_file_scan, market_list_scan, md_table_scan, file_facts, listing_resolution)}

_ROWS = """r AS (SELECT (user_id % 10)::VARCHAR AS meter_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'import' WHEN event_type = 'purchase' THEN 'export' END AS channel,
  event_id, CASE WHEN event_id % 50 = 0 THEN 0.0 ELSE value END AS kwh FROM events), f AS (SELECT * FROM r WHERE channel IS NOT NULL QUALIFY row_number() OVER (PARTITION BY meter_id, channel, ts ORDER BY event_id) = 1)"""
ORACLE_SQL = {
    "meter_export_scan": f"""WITH {_ROWS} SELECT meter_id, strftime(ts, '%Y-%m-%d %H:%M') AS ts, coalesce(max(kwh) FILTER (WHERE channel = 'import'), 0.0) AS import_kwh, coalesce(max(kwh) FILTER (WHERE channel = 'export'), 0.0) AS export_kwh FROM f GROUP BY meter_id, f.ts""",
    "meter_export_quality": f"""WITH {_ROWS}, d AS (SELECT meter_id, count(*) AS kept, count(*) FILTER (WHERE channel = 'import') AS import_rows, count(*) FILTER (WHERE channel = 'export') AS export_rows,
        (epoch(max(ts) - min(ts))::BIGINT // 900 + 1 - count(DISTINCT ts))::BIGINT AS missing FROM f GROUP BY 1)
        SELECT r.meter_id, count(*) FILTER (WHERE event_id % 50 = 0) AS blanks, count(*) FILTER (WHERE event_id % 9 = 0) AS estimated, (count(*) - any_value(kept))::BIGINT AS duplicates, 0::BIGINT AS dropped, any_value(missing) AS missing,
        any_value(import_rows) AS import_rows, any_value(export_rows) AS export_rows FROM r JOIN d USING (meter_id) WHERE channel IS NOT NULL GROUP BY 1""",
    "unknown_channels": "SELECT DISTINCT 'IntervalData' || (user_id % 10)::VARCHAR || '.csv' AS path, 'Other' AS label FROM events WHERE event_type = 'error'",
    "price_file_scan": f"""WITH {a.PRICES_SQL}, m AS (SELECT ts, round(price_usd_kwh * 1000, 4) AS p FROM prices) SELECT 'LZ_SOUTH' AS zone, strftime(ts, '%Y-%m-%d %H:%M') AS ts, round(CASE WHEN minute(ts) = 0 THEN (p + p + 2) / 2 ELSE p END / 1000, 7) AS price_usd_kwh FROM m""",
    "market_list_scan": "SELECT c_custkey AS id, c_name || ', Inc.' AS retailer, c_mktsegment AS plan_name, c_nationkey::BIGINT AS term_months, c_custkey % 2 = 0 AS tou, round(c_acctbal, 2) AS kwh500 FROM customer",
    "md_table_scan": """SELECT 'Oncor' AS tdu, p_brand AS retailer, p_name || CASE WHEN p_partkey % 6 = 0 THEN ' + Battery' ELSE '' END AS plan_name, p_size AS term_months, p_size / 2.0 AS import_ckwh, ['fixed', 'rtw', 'none', 'none'][p_partkey % 4 + 1] AS export_kind,
        [5.5, NULL, NULL, 0.0][p_partkey % 4 + 1]::DOUBLE AS export_ckwh, CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE 9.95 END::DOUBLE AS base_usd_month, CASE WHEN p_partkey % 2 = 0 THEN 20.0 ELSE 150.0 END::DOUBLE AS etf_usd, p_partkey % 2 = 0 AS etf_per_month_remaining,
        p_partkey % 6 = 0 AS battery_required, p_partkey::VARCHAR AS source_url FROM part WHERE p_partkey % 10 <> 9""",
    "file_facts": "SELECT c_custkey AS file, CASE WHEN c_custkey % 6 = 0 THEN c_name ELSE c_mktsegment END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'found' ELSE 'list' END AS via FROM customer",
    "listing_resolution": """SELECT c_mktsegment AS retailer, c_name AS plan_name, CASE WHEN c_custkey % 5 = 0 THEN 'no url' WHEN c_custkey % 4 = 0 THEN 'not downloaded' WHEN c_custkey % 3 = 0 THEN 'parse failed' ELSE 'parsed' END AS state FROM customer""",
}
