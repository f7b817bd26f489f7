"""The driver's tables as the library's inputs, and the same as SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schema import PLAN, TARIFF, VARIABLE_RATES

IMPORT_TYPES = ("view", "click", "signup")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Instants are UTC throughout; local time is always worked out from a named zone.
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as quarter-hour readings of one meter per user."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    bucket = F.date_trunc("hour", F.col("ts").cast("timestamp")) + F.make_interval(mins=(F.floor(F.minute("ts") / 15) * 15).cast("int"))
    imported = F.col("event_type").isin(*IMPORT_TYPES)
    return e.groupBy(F.col("user_id").cast("string").alias("meter_id"), bucket.alias("ts")).agg(
        F.coalesce(F.sum(F.when(imported, F.col("value"))), F.lit(0.0)).alias("import_kwh"),
        F.coalesce(F.sum(F.when(~imported, F.col("value"))), F.lit(0.0)).alias("export_kwh"),
    )


def usage_daily(spark: SparkSession, sf_dir: str, meters: int = 20) -> DataFrame:
    """orders as daily readings (at noon Chicago time in winter) of a few meters over many months."""
    o = table(spark, sf_dir, "orders")
    ts = F.date_trunc("day", F.col("o_orderdate").cast("timestamp")) + F.expr("INTERVAL 18 HOURS")
    spent = F.col("o_totalprice") / 100.0
    imported = F.col("o_orderstatus") != "F"
    return o.groupBy((F.col("o_custkey") % meters).cast("string").alias("meter_id"), ts.alias("ts")).agg(
        F.coalesce(F.sum(F.when(imported, spent)), F.lit(0.0)).alias("import_kwh"), F.coalesce(F.sum(F.when(~imported, spent)), F.lit(0.0)).alias("export_kwh")
    )


def one_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as the daily readings of one meter."""
    return usage_daily(spark, sf_dir, 1)


def hourly_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as wholesale prices: the hour's mean value over 1000, on its four quarter-hours."""
    e = table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    means = e.groupBy(hour.alias("hour")).agg((F.avg("value") / 1000.0).alias("price_usd_kwh"))
    quarters = F.explode(F.array(*(F.lit(m) for m in (0, 15, 30, 45)))).alias("m")
    return means.select("hour", "price_usd_kwh", quarters).select(F.lit("LZ_SOUTH").alias("zone"), (F.col("hour") + F.make_interval(mins=F.col("m"))).alias("ts"), "price_usd_kwh")


def gappy_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hourly_prices without every 64th hour of the calendar."""
    return hourly_prices(spark, sf_dir).where((F.floor(F.unix_timestamp("ts") / 3600) % 64) != 0)


def rate(ckwh=None, rtw=None, window=None, exempt=False, label=""):
    return {"rate_ckwh": ckwh, "rtw": rtw, "window": window, "label": label, "tdu_exempt": exempt}


def window(months=(), weekdays=(), hours=()):
    return {"months": list(months), "weekdays": list(weekdays), "hours": list(hours)}


def rtw(multiplier=1.0, adder=0.0, cap=None, floor=0.0):
    return {"multiplier": multiplier, "adder_ckwh": adder, "cap_ckwh": cap, "floor_ckwh": floor}


def buyback(kind="none", ckwh=None, rtw=None, rates=(), scope="all_charges", cap=None, rollover=True, cash_out=False):
    return {"kind": kind, "rate_ckwh": ckwh, "rtw": rtw, "rates": list(rates), "offset_scope": scope, "monthly_credit_cap": cap, "rollover": rollover, "cash_out": cash_out}


def plan(id, retailer, name, rates, term=12, base=0.0, credits=(), ev=None, passthrough=True, fee=0.0, bb=None, **more):
    return {
        "id": id, "retailer": retailer, "name": name, "term_months": term, "tdu": "ONCOR", "base_charge_usd": base, "energy_rates": rates,
        "buyback": bb or buyback(), "bill_credits": [dict(zip(("min_kwh", "max_kwh", "credit_usd"), c, strict=True)) for c in credits],
        "ev_free_charging": ev, "tdu_passthrough": passthrough, "signup_fee_usd": fee, "rate_type": "fixed", "source": "manual",
        "needs_review": False, "excludes_solar": False, "etf_usd": 0.0, "etf_per_month_remaining": False, "notes": "",
    } | more


NIGHT = (21, 22, 23, 0, 1, 2, 3, 4, 5)
#: A catalogue with a plan for every branch of the billing rules.
PLANS = [
    plan("flat", "Alder Power LLC", "Alder Flat 12", [rate(10.0)], base=5.0),
    plan("night_free", "Birch Energy", "Birch Nights 12", [rate(0.0, window=window(hours=NIGHT)), rate(20.0)], base=9.95),
    plan("night_exempt", "Birch Energy", "Birch Clean Nights 12", [rate(0.0, window=window(hours=NIGHT), exempt=True), rate(21.5)]),
    plan("weekend", "Cedar Retail Energy", "Cedar Weekends 24", [rate(0.0, window=window(weekdays=(5, 6))), rate(15.0)], term=24),
    plan("tou", "Cedar Retail Energy", "Cedar Clock 12", [rate(24.0, window=window(months=(1, 2, 12), weekdays=(0, 1, 2, 3, 4), hours=(17, 18, 19, 20))), rate(7.5, window=window(hours=NIGHT)), rate(11.0)], base=4.95),
    plan("bundled", "Dogwood Electric", "Dogwood All In 12", [rate(0.0, window=window(hours=(0, 1, 2, 3))), rate(16.2)], passthrough=False),
    plan("tiers", "Dogwood Electric", "Dogwood Credit 12", [rate(13.0)], credits=((1000.0, None, 100.0), (2000.0, 4000.0, 25.0), (0.0, 500.0, 5.0))),
    plan("fee", "Elm Energy", "Elm Green 5", [rate(9.1)], fee=49.99, base=1.0),
    plan("sell_fixed", "Elm Energy", "Elm Solar 12", [rate(12.0)], bb=buyback("fixed", 8.0)),
    plan("sell_energy_only", "Fir Power", "Fir Solar 12", [rate(14.0)], base=12.0, bb=buyback("fixed", 50.0, scope="energy_only")),
    plan("sell_capped", "Fir Power", "Fir Solar Match 12", [rate(14.0)], base=12.0, bb=buyback("fixed", 50.0, scope="energy_only", cap="energy_charge")),
    plan("sell_cash", "Grove Energy", "Grove Cash 12", [rate(15.0)], bb=buyback("fixed", 30.0, cash_out=True)),
    plan("sell_lapses", "Grove Energy", "Grove Lapse 12", [rate(15.0)], bb=buyback("fixed", 30.0, rollover=False)),
    plan("sell_windows", "Hazel Power", "Hazel Shift 12", [rate(13.5)], bb=buyback("windows", rates=[rate(20.0, window=window(hours=(17, 18))), rate(5.0)])),
    plan("sell_indexed", "Hazel Power", "Hazel Real 12", [rate(13.0)], bb=buyback("rtw", rtw=rtw(cap=25.0))),
    plan("indexed", "Iris Energy", "Iris Wholesale", [rate(rtw=rtw(1.05, 0.5, 40.0, 1.0))], term=1, rate_type="indexed"),
    plan("indexed_day", "Iris Energy", "Iris Day 12", [rate(9.0, window=window(hours=NIGHT)), rate(rtw=rtw(0.9, 1.0))]),
    plan("car", "Juniper Motors", "Juniper Drive 12", [rate(15.5)], base=10.0, ev={"window": window(hours=(0, 1, 2, 3, 4, 5)), "monthly_kwh_cap": 300.0, "label": "car", "covers_delivery": False}),
    plan("car_delivered", "Juniper Motors", "Juniper Home 12", [rate(15.5)], ev={"window": window(hours=(22, 23, 0, 1, 2, 3, 4, 5)), "monthly_kwh_cap": 500.0, "label": "car", "covers_delivery": True}),
    plan("short", "Kelp Power Inc", "Kelp First Month 1", [rate(2.02)], term=1),
    plan("short_nights", "Kelp Power LLC", "Kelp Nights 3", [rate(0.0, window=window(hours=NIGHT)), rate(8.0)], term=3, base=3.0),
    plan("short_unknown", "Lime Energy", "Lime Start 6", [rate(6.5)], term=6),
    plan("all_zero", "Maple Energy", "Maple Tiered 12", [rate(0.0), rate(0.0)][-1:]),
    plan("unpriceable", "Maple Energy", "Maple Apartment 12", [rate(8.9)], unpriceable_reason="usage tiers"),
    plan("sell_flat_copy", "Oak Electric", "Oak Flat 12", [rate(10.0)], base=5.0),
]

D = dt.date
TARIFFS = [
    {"tdu": "ONCOR", "effective": D(1995, 1, 1), "fixed_usd_month": 3.10, "volumetric_ckwh": 3.9},
    {"tdu": "ONCOR", "effective": D(1998, 9, 1), "fixed_usd_month": 3.42, "volumetric_ckwh": 4.6},
    {"tdu": "ONCOR", "effective": D(2023, 9, 1), "fixed_usd_month": 4.06, "volumetric_ckwh": 6.12},
    {"tdu": "ONCOR", "effective": D(2024, 3, 1), "fixed_usd_month": 4.23, "volumetric_ckwh": 5.58},
]
HISTORIES = [
    {"history_ord": 0, "retailers": ["Other Power"], "source": "own", "tdu": {"ONCOR": [{"effective": D(2000, 1, 1), "energy_ckwh": 11.0}]}},
    {
        "history_ord": 1, "retailers": ["Kelp Power, LLC", "Kelp"], "source": "own",
        "tdu": {"ONCOR": [{"effective": D(2000, 11, 15), "energy_ckwh": 12.0}, {"effective": D(2001, 1, 20), "energy_ckwh": 14.0}, {"effective": D(2001, 2, 10), "energy_ckwh": 13.0}, {"effective": D(2001, 5, 1), "energy_ckwh": 11.9}]},
    },
    {"history_ord": 2, "retailers": ["Kelp Power"], "source": "own", "tdu": {"ONCOR": [{"effective": D(1999, 1, 1), "energy_ckwh": 99.0}]}},
]


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def plans(spark: SparkSession) -> DataFrame:
    """The catalogue with its load order."""
    return _rows(spark, [p | {"ord": i} for i, p in enumerate(PLANS)], PLAN + ", ord int")


def tariffs(spark: SparkSession) -> DataFrame:
    return _rows(spark, TARIFFS, TARIFF)


def tariff(spark: SparkSession) -> DataFrame:
    """The tariff in force in January 2024."""
    return _rows(spark, TARIFFS[2:3], TARIFF)


def histories(spark: SparkSession) -> DataFrame:
    return _rows(spark, HISTORIES, VARIABLE_RATES)


# The same as SQL ---------------------------------------------------------------------------------


def _sql(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(_sql, x)) + "]::INTEGER[]"
    if isinstance(x, D):
        return f"DATE '{x}'"
    return repr(float(x)) + "::DOUBLE" if isinstance(x, float) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def values(rows: list[dict], columns: dict[str, str]) -> str:
    """SELECT over VALUES with typed columns."""
    body = ", ".join("(" + ", ".join(_sql(r[c]) for c in columns) + ")" for r in rows)
    return f"SELECT {', '.join(f'{c}::{t} AS {c}' for c, t in columns.items())} FROM (VALUES {body}) v({', '.join(columns)})"


def _rule_rows() -> list[dict]:
    out = []
    for p in PLANS:
        b = p["buyback"]
        export = {"none": [], "windows": b["rates"], "fixed": [rate(b["rate_ckwh"])], "rtw": [rate(rtw=b["rtw"])]}[b["kind"]]
        for side, rules in (("energy", p["energy_rates"]), ("export", export)):
            for i, r in enumerate(rules):
                w, x = r["window"] or window(), r["rtw"] or {"multiplier": None, "adder_ckwh": None, "cap_ckwh": None, "floor_ckwh": None}
                out.append({"plan_id": p["id"], "side": side, "n": i, "rate_ckwh": r["rate_ckwh"], "is_rtw": r["rtw"] is not None, "exempt": r["tdu_exempt"]} | x | w)
    return out


def plan_ctes() -> str:
    """plans(...) and rules(...) as SQL."""
    heads = [
        {
            "plan_id": p["id"], "ord": i, "term_months": p["term_months"], "retailer": p["retailer"], "base": p["base_charge_usd"], "passthrough": p["tdu_passthrough"], "fee": p["signup_fee_usd"],
            "kind": p["buyback"]["kind"], "scope": p["buyback"]["offset_scope"], "cap": p["buyback"]["monthly_credit_cap"], "rollover": p["buyback"]["rollover"], "cash_out": p["buyback"]["cash_out"],
            "ev_cap": (p["ev_free_charging"] or {}).get("monthly_kwh_cap"), "ev_hours": (p["ev_free_charging"] or {"window": {"hours": []}})["window"]["hours"], "ev_covers": (p["ev_free_charging"] or {}).get("covers_delivery"),
            "reason": p.get("unpriceable_reason"),
        }
        for i, p in enumerate(PLANS)
    ]
    credits = [{"plan_id": p["id"]} | c for p in PLANS for c in p["bill_credits"]]
    head_types = {
        "plan_id": "VARCHAR", "ord": "INTEGER", "term_months": "INTEGER", "retailer": "VARCHAR", "base": "DOUBLE", "passthrough": "BOOLEAN", "fee": "DOUBLE", "kind": "VARCHAR", "scope": "VARCHAR", "cap": "VARCHAR",
        "rollover": "BOOLEAN", "cash_out": "BOOLEAN", "ev_cap": "DOUBLE", "ev_hours": "INTEGER[]", "ev_covers": "BOOLEAN", "reason": "VARCHAR",
    }
    rule_types = {
        "plan_id": "VARCHAR", "side": "VARCHAR", "n": "INTEGER", "rate_ckwh": "DOUBLE", "is_rtw": "BOOLEAN", "exempt": "BOOLEAN", "multiplier": "DOUBLE", "adder_ckwh": "DOUBLE", "cap_ckwh": "DOUBLE",
        "floor_ckwh": "DOUBLE", "months": "INTEGER[]", "weekdays": "INTEGER[]", "hours": "INTEGER[]",
    }
    return (
        f"plans AS ({values(heads, head_types)}), rules AS ({values(_rule_rows(), rule_types)}), "
        f"credits AS ({values(credits, {'plan_id': 'VARCHAR', 'min_kwh': 'DOUBLE', 'max_kwh': 'DOUBLE', 'credit_usd': 'DOUBLE'})})"
    )


USAGE15_SQL = """usage AS (SELECT user_id::VARCHAR AS meter_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts,
  coalesce(sum(value) FILTER (WHERE event_type IN ('view','click','signup')), 0.0) AS import_kwh,
  coalesce(sum(value) FILTER (WHERE event_type NOT IN ('view','click','signup')), 0.0) AS export_kwh
  FROM events GROUP BY 1, 2)"""


def daily_sql(meters: int) -> str:
    return f"""usage AS (SELECT (o_custkey % {meters})::VARCHAR AS meter_id, date_trunc('day', o_orderdate::TIMESTAMP) + INTERVAL 18 HOUR AS ts,
  coalesce(sum(o_totalprice / 100.0) FILTER (WHERE o_orderstatus <> 'F'), 0.0) AS import_kwh,
  coalesce(sum(o_totalprice / 100.0) FILTER (WHERE o_orderstatus = 'F'), 0.0) AS export_kwh
  FROM orders GROUP BY 1, 2)"""


LOCAL_SQL = """loc AS (SELECT *, strftime(local, '%Y-%m') AS month, month(local)::INTEGER AS month_num, hour(local)::INTEGER AS hour,
  (isodow(local) - 1)::INTEGER AS weekday, local::DATE AS date FROM (SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS local FROM usage))"""

PRICES_SQL = """prices AS (SELECT hour + to_minutes(m) AS ts, p AS price_usd_kwh FROM
  (SELECT date_trunc('hour', ts) AS hour, avg(value) / 1000.0 AS p FROM events GROUP BY 1), (VALUES (0), (15), (30), (45)) q(m))"""
