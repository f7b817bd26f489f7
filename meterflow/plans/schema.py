"""Table types of the library and the checks a plan must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERVALS = "meter_id string, ts timestamp, import_kwh double, export_kwh double"
PRICES = "zone string, ts timestamp, price_usd_kwh double"
WINDOW = "struct<months:array<int>,weekdays:array<int>,hours:array<int>>"
RTW = "struct<multiplier:double,adder_ckwh:double,cap_ckwh:double,floor_ckwh:double>"
RATE = f"struct<rate_ckwh:double,rtw:{RTW},window:{WINDOW},label:string,tdu_exempt:boolean>"
BUYBACK = f"struct<kind:string,rate_ckwh:double,rtw:{RTW},rates:array<{RATE}>,offset_scope:string,monthly_credit_cap:string,rollover:boolean,cash_out:boolean>"
CREDIT = "struct<min_kwh:double,max_kwh:double,credit_usd:double>"
EV = f"struct<window:{WINDOW},monthly_kwh_cap:double,label:string,covers_delivery:boolean>"
PLAN = (
    "id string, retailer string, name string, term_months int, tdu string, base_charge_usd double, "
    f"energy_rates array<{RATE}>, buyback {BUYBACK}, bill_credits array<{CREDIT}>, ev_free_charging {EV}, "
    "tdu_passthrough boolean, etf_usd double, etf_per_month_remaining boolean, signup_fee_usd double, rate_type string, "
    "renewable_pct double, source string, retrieved date, source_sha256 string, efl_url string, enroll_url string, "
    "notes string, needs_review boolean, unpriceable_reason string, excludes_solar boolean"
)
TARIFF = "tdu string, effective date, fixed_usd_month double, volumetric_ckwh double"
VARIABLE_RATES = "history_ord int, retailers array<string>, source string, tdu map<string,array<struct<effective:date,energy_ckwh:double>>>"
MONTHLY = (
    "month", "coverage", "import_kwh", "export_kwh", "energy_cost", "ev_free_kwh", "base", "tdu", "bill_credit",
    "credit_earned", "credit_used", "rollover_out", "bill", "paid_kwh", "tdu_volumetric",
)


def _outside(values: Column, low: int, high: int) -> Column:
    return F.exists(F.coalesce(values, F.array().cast("array<int>")), lambda x: (x < low) | (x > high))


def _bad_window(w: Column) -> Column:
    return w.isNotNull() & (_outside(w["months"], 1, 12) | _outside(w["weekdays"], 0, 6) | _outside(w["hours"], 0, 23))


def violations(plans: DataFrame) -> DataFrame:
    """(id, violation): each rule a plan breaks, one row each; also ids that occur more than once."""
    rates = F.coalesce("energy_rates", F.array().cast(f"array<{RATE}>"))
    export = F.coalesce(F.col("buyback.rates"), F.array().cast(f"array<{RATE}>"))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    one = lambda r: r["rate_ckwh"].isNull() == r["rtw"].isNull()
    kind = F.col("buyback.kind")
    checks = {
        "no energy rate": F.size(rates) == 0,
        "last energy rate is not a catch-all": (F.size(rates) > 0) & last(rates)["window"].isNotNull(),
        "a rate needs exactly one of rate_ckwh and rtw": F.exists(F.concat(rates, export), one),
        "window out of range": F.exists(F.concat(rates, export), lambda r: _bad_window(r["window"])) | F.coalesce(_bad_window(F.col("ev_free_charging.window")), F.lit(False)),
        "unknown buyback kind": ~kind.isin("none", "fixed", "rtw", "windows"),
        "fixed buyback needs rate_ckwh": (kind == "fixed") & F.col("buyback.rate_ckwh").isNull(),
        "rtw buyback needs rtw": (kind == "rtw") & F.col("buyback.rtw").isNull(),
        "windows buyback must end in a catch-all": (kind == "windows") & ((F.size(export) == 0) | last(export)["window"].isNotNull()),
        "unknown offset scope": ~F.col("buyback.offset_scope").isin("energy_only", "all_charges"),
        "unknown credit cap": F.col("buyback.monthly_credit_cap").isNotNull() & (F.col("buyback.monthly_credit_cap") != "energy_charge"),
        "unknown rate type": ~F.col("rate_type").isin("fixed", "variable", "indexed"),
        "ev cap must be positive": F.col("ev_free_charging").isNotNull() & ~F.coalesce(F.col("ev_free_charging.monthly_kwh_cap") > 0, F.lit(False)),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items())))
    own = plans.select("id", F.explode(found).alias("violation"))
    twice = plans.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("violation"))
    return own.unionByName(twice)


def interval_violations(intervals: DataFrame) -> DataFrame:
    """(meter_id, violation, n) where intervals break the contract: duplicate starts, negative or missing readings."""
    twice = intervals.groupBy("meter_id", "ts").count().where("count > 1").groupBy("meter_id").agg(F.count(F.lit(1)).alias("n"))
    bad = intervals.where("import_kwh < 0 OR export_kwh < 0 OR import_kwh IS NULL OR export_kwh IS NULL OR isnan(import_kwh) OR isnan(export_kwh)")
    bad = bad.groupBy("meter_id").agg(F.count(F.lit(1)).alias("n"))
    return twice.select("meter_id", F.lit("duplicate interval start").alias("violation"), "n").unionByName(
        bad.select("meter_id", F.lit("reading negative or missing").alias("violation"), "n")
    )
