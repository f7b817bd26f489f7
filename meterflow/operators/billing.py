"""Bills of many meters under many plans, as one plan of joins and aggregations.

Rules are data. The first matching rule of every plan is worked out once for each of the 2,016 slots
(month of the year, weekday, hour); usage then finds its rule by position in that array. Plans
without an indexed rate or an allowance are billed from usage summed to slots, so their cost does not
grow with the length of an interval; the others from the intervals. Both give the same monthly parts.

Carry-forward over months has a closed form: with d = earned - max(offsettable, 0) and S its running
sum, the balance is S - min(0, running minimum of S), so two window functions replace the loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import LOCAL_TZ, days_in_month, with_local_columns
from ..plans.schema import RATE
from .prices import aligned, rtw_rate

#: Plans beyond this number are not broadcast; the arrays of one take some 16 KB.
BROADCAST_PLANS = 4000


def slot(month_num: Column, weekday: Column, hour: Column) -> Column:
    """0 to 2015."""
    return ((month_num - 1) * 7 + weekday) * 24 + hour


def window_matches(window: Column, month_num: Column, weekday: Column, hour: Column) -> Column:
    """Empty lists match anything, as does a null window."""
    part = lambda name, x: F.coalesce(F.size(window[name]), F.lit(0)).isin(0, -1) | F.array_contains(window[name], x)
    return window.isNull() | (part("months", month_num) & part("weekdays", weekday) & part("hours", hour))


def first_match(rates: Column) -> Column:
    """For each slot the position, from 1, of the first rule that matches; 0 where none does."""

    def at(s: Column) -> Column:
        month_num = (F.floor(s / 168) + 1).cast("int")
        weekday = (F.floor(s / 24) % 7).cast("int")
        hour = (s % 24).cast("int")
        return F.array_position(F.transform(rates, lambda r: window_matches(r["window"], month_num, weekday, hour)), True).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(2015)), at)


def prepared(plans: DataFrame) -> DataFrame:
    """Plans with their slot arrays and flags; `ord` (load order) breaks ties in the ranking."""
    none = F.array().cast(f"array<{RATE}>")
    export = F.coalesce(F.col("buyback.rates"), none)
    kind = F.coalesce(F.col("buyback.kind"), F.lit("none"))
    # Every kind of buyback is a list of rules: a fixed or an indexed one has a single catch-all.
    single = F.array(
        F.struct(
            F.when(kind == "fixed", F.col("buyback.rate_ckwh")).alias("rate_ckwh"),
            F.when(kind == "rtw", F.col("buyback.rtw")).alias("rtw"),
            F.lit(None).cast(RATE.split("window:")[1].split(",label")[0]).alias("window"),
            F.lit("").alias("label"),
            F.lit(False).alias("tdu_exempt"),
        )
    ).cast(f"array<{RATE}>")
    export = F.when(kind == "windows", export).when(kind == "none", none).otherwise(single)
    indexed = lambda rates: F.exists(rates, lambda r: r["rtw"].isNotNull())
    out = plans.withColumns({"export_rates": export, "buyback_kind": kind})
    return out.withColumns(
        {
            "energy_slots": first_match(F.col("energy_rates")),
            "export_slots": first_match(F.col("export_rates")),
            "by_interval": indexed(F.col("energy_rates")) | indexed(F.col("export_rates")) | F.col("ev_free_charging").isNotNull(),
        }
    )


def refused(plans: DataFrame) -> DataFrame:
    """(id, reason) of plans that must not be ranked: marked unpriceable, or every energy rate zero."""
    zero = ~F.exists("energy_rates", lambda r: r["rtw"].isNotNull() | (F.coalesce(r["rate_ckwh"], F.lit(0.0)) != 0))
    reason = F.when(F.coalesce("unpriceable_reason", F.lit("")) != "", F.col("unpriceable_reason")).when(zero, F.lit("every energy rate is zero"))
    return plans.select("id", reason.alias("reason")).where("reason IS NOT NULL")


def _rate(rule: Column, price: Column | None) -> Column:
    flat = rule["rate_ckwh"] / 100.0
    return flat if price is None else F.coalesce(flat, rtw_rate(price, rule["rtw"]))


PLAN_COLUMNS = (
    "id", "ord", "energy_rates", "export_rates", "energy_slots", "export_slots", "buyback_kind", "tdu_passthrough", "ev_free_charging", "by_interval",
)


def _plan_side(plans: DataFrame, by_interval: bool, count: int | None = None) -> DataFrame:
    side = plans.where(F.col("by_interval") == by_interval).select(F.col("id").alias("plan_id"), *PLAN_COLUMNS[1:-1])
    # A plan catalogue is small; one beyond the bound meets the usage partition by partition instead.
    return F.broadcast(side) if (plans.count() if count is None else count) <= BROADCAST_PLANS else side


def _charged(usage: DataFrame, price: Column | None) -> DataFrame:
    """Usage under plans with energy_rate, tdu_exempt, export_rate, matched and which of them are indexed."""
    found = usage.withColumns(
        {
            "energy_at": F.element_at("energy_slots", F.col("slot") + 1),
            "export_at": F.element_at("export_slots", F.col("slot") + 1),
        }
    )
    energy = F.when(F.col("energy_at") > 0, F.element_at("energy_rates", F.greatest("energy_at", F.lit(1))))
    export = F.when(F.col("export_at") > 0, F.element_at("export_rates", F.greatest("export_at", F.lit(1))))
    found = found.withColumns({"energy_rule": energy, "export_rule": export})
    return found.withColumns(
        {
            "energy_rate": _rate(F.col("energy_rule"), price),
            "tdu_exempt": F.coalesce(F.col("energy_rule.tdu_exempt"), F.lit(False)),
            "export_rate": F.when(F.col("buyback_kind") == "none", 0.0).otherwise(_rate(F.col("export_rule"), price)),
            "energy_indexed": F.coalesce(F.col("energy_rule.rtw").isNotNull(), F.lit(False)),
            "export_indexed": F.coalesce(F.col("export_rule.rtw").isNotNull(), F.lit(False)),
        }
    )


def _parts(charged: DataFrame, freed: Column, covers: Column, energy_charge: Column) -> DataFrame:
    """Monthly sums per (meter_id, plan_id, month)."""
    exempt, free_rate = F.col("tdu_exempt"), F.coalesce(F.col("energy_rate") == 0, F.lit(False))
    passthrough = F.col("tdu_passthrough")
    free_here = free_rate & (exempt | ~passthrough)
    free = F.when(free_here, F.col("import_kwh")).otherwise(F.when(covers | (~passthrough & F.col("ev_free_charging").isNotNull()), freed).otherwise(0.0))
    delivered = F.when(exempt, 0.0).otherwise(F.col("import_kwh") - F.when(covers, freed).otherwise(0.0))
    needs = (F.col("energy_indexed") & (F.col("import_kwh") > 0) & F.col("energy_rate").isNull()) | (
        F.col("export_indexed") & (F.col("export_kwh") > 0) & F.col("export_rate").isNull()
    )
    return charged.groupBy("meter_id", "plan_id", "ord", "month").agg(
        F.sum("import_kwh").alias("import_kwh"),
        F.sum("export_kwh").alias("export_kwh"),
        F.sum(energy_charge).alias("energy_cost"),
        F.sum(freed).alias("ev_free_kwh"),
        F.sum(free).alias("free_kwh"),
        F.sum(delivered).alias("tdu_import_kwh"),
        F.sum(F.col("export_kwh") * F.col("export_rate")).alias("export_credit_raw"),
        F.bool_or(F.col("energy_indexed") | F.col("export_indexed")).alias("indexed"),
        F.count_if(F.col("energy_rule").isNull() | (F.col("export_rule").isNull() & (F.col("buyback_kind") != "none"))).alias("unmatched"),
        F.count_if(needs).alias("unpriced"),
        F.min(F.when(needs, F.col("ts"))).alias("unpriced_first"),
    )


def interval_parts(intervals: DataFrame, plans: DataFrame, tz: str = LOCAL_TZ, count: int | None = None) -> DataFrame:
    """Monthly parts of plans that need intervals; intervals have `price` ($/kWh, null where unknown)."""
    usage = with_local_columns(intervals, tz=tz).withColumn("slot", slot(F.col("month_num"), F.col("weekday"), F.col("hour")))
    charged = _charged(usage.join(_plan_side(plans, True, count)), F.col("price"))
    ev = F.col("ev_free_charging")
    inside = ev.isNotNull() & window_matches(ev["window"], F.col("month_num"), F.col("weekday"), F.col("hour"))
    charged = charged.withColumn("window_kwh", F.when(inside, F.col("import_kwh")).otherwise(0.0))
    # The allowance is spent in order of time; only plans that have one pay for the sort.
    by = Window.partitionBy("meter_id", "plan_id", "month").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.greatest(ev["monthly_kwh_cap"] - (F.sum("window_kwh").over(by) - F.col("window_kwh")), F.lit(0.0))
    with_ev = charged.where("ev_free_charging IS NOT NULL").withColumn("freed", F.least(left, F.col("window_kwh")))
    charged = charged.where("ev_free_charging IS NULL").withColumn("freed", F.lit(0.0)).unionByName(with_ev)
    share = F.when(F.col("import_kwh") > 0, F.greatest(F.least(F.col("freed") / F.col("import_kwh"), F.lit(1.0)), F.lit(0.0))).otherwise(0.0)
    covers = F.coalesce(ev["covers_delivery"], F.lit(False))
    return _parts(charged, F.col("freed"), covers, F.col("import_kwh") * F.col("energy_rate") * (1.0 - share))


def cube(intervals: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    """Usage by (meter_id, month, slot)."""
    usage = with_local_columns(intervals, tz=tz).withColumn("slot", slot(F.col("month_num"), F.col("weekday"), F.col("hour")))
    return usage.groupBy("meter_id", "month", "month_num", "weekday", "hour", "slot").agg(
        F.sum("import_kwh").alias("import_kwh"), F.sum("export_kwh").alias("export_kwh"), F.min("ts").alias("ts")
    )


def cube_parts(slots: DataFrame, plans: DataFrame, count: int | None = None) -> DataFrame:
    """Monthly parts of flat-rate plans from usage by slot."""
    charged = _charged(slots.join(_plan_side(plans, False, count)), None)
    return _parts(charged, F.lit(0.0), F.lit(False), F.col("import_kwh") * F.col("energy_rate"))


def month_coverage(intervals: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    """(meter_id, month, coverage): the share of the month's local dates that have readings."""
    days = with_local_columns(intervals, tz=tz).groupBy("meter_id", "month").agg(F.count_distinct("date").alias("days"))
    return days.select("meter_id", "month", F.least(F.col("days") / days_in_month(F.col("month")), F.lit(1.0)).alias("coverage"))


def bill_credit(credits: Column, import_kwh: Column) -> Column:
    """All tiers that hold the month's import, added up."""
    hit = lambda c: (import_kwh >= F.coalesce(c["min_kwh"], F.lit(0.0))) & (c["max_kwh"].isNull() | (import_kwh < c["max_kwh"]))
    return F.aggregate(F.filter(F.coalesce(credits, F.array().cast("array<struct<min_kwh:double,max_kwh:double,credit_usd:double>>")), hit), F.lit(0.0), lambda a, c: a + c["credit_usd"])


def monthly_bills(parts: DataFrame, coverage: DataFrame, plans: DataFrame, tariff: DataFrame) -> DataFrame:
    """Monthly bills from monthly parts. tariff: (tdu, fixed_usd_month, volumetric_ckwh), one row per utility."""
    header = plans.select(
        F.col("id").alias("plan_id"),
        F.coalesce("base_charge_usd", F.lit(0.0)).alias("base_charge_usd"),
        "bill_credits",
        "buyback",
        "buyback_kind",
        F.col("tdu_passthrough").alias("passthrough"),
        F.upper("tdu").alias("utility"),
    )
    rates = tariff.select(F.upper("tdu").alias("utility"), "fixed_usd_month", "volumetric_ckwh")
    rows = parts.join(coverage, ["meter_id", "month"]).join(header.join(rates, "utility", "left"), "plan_id")
    passes = F.col("passthrough")
    rows = rows.withColumns(
        {
            "base": F.col("base_charge_usd") * F.col("coverage"),
            "tdu_volumetric": F.when(passes, F.col("volumetric_ckwh") / 100.0 * F.col("tdu_import_kwh")).otherwise(0.0),
            "bill_credit": bill_credit(F.col("bill_credits"), F.col("import_kwh")),
            "credit_earned": F.when(F.col("buyback_kind") == "none", 0.0)
            .when(F.col("buyback.monthly_credit_cap") == "energy_charge", F.least("export_credit_raw", "energy_cost"))
            .otherwise(F.col("export_credit_raw")),
            "paid_kwh": F.col("import_kwh") - F.col("free_kwh"),
        }
    )
    rows = rows.withColumn("tdu", F.when(passes, F.col("fixed_usd_month") * F.col("coverage") + F.col("tdu_volumetric")).otherwise(0.0))
    all_charges = F.col("energy_cost") + F.col("base") + F.col("tdu") - F.col("bill_credit")
    offsettable = F.when(F.col("buyback.offset_scope") == "energy_only", F.col("energy_cost")).otherwise(all_charges)
    return carried(rows.withColumns({"all_charges": all_charges, "offsettable": offsettable})).select(
        "meter_id", "plan_id", "ord", "month", "coverage", "import_kwh", "export_kwh", "energy_cost", "ev_free_kwh", "base", "tdu", "bill_credit",
        "credit_earned", "credit_used", "rollover_out", (F.col("all_charges") - F.col("credit_used")).alias("bill"), "paid_kwh", "tdu_volumetric",
        "indexed", "unmatched", "unpriced", "unpriced_first",
    )


def carried(rows: DataFrame) -> DataFrame:
    """Adds credit_used and rollover_out from credit_earned, offsettable and buyback, month by month."""
    by = Window.partitionBy("meter_id", "plan_id").orderBy("month")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolls = F.coalesce(F.col("buyback.rollover"), F.lit(True)) & ~F.coalesce(F.col("buyback.cash_out"), F.lit(False))
    need = F.greatest("offsettable", F.lit(0.0))
    rows = rows.withColumn("running", F.sum(F.col("credit_earned") - need).over(so_far))
    rows = rows.withColumn("balance", F.when(rolls, F.col("running") - F.least(F.lit(0.0), F.min("running").over(so_far))).otherwise(0.0))
    before = F.coalesce(F.lag("balance").over(by), F.lit(0.0))
    used = (
        F.when(F.coalesce(F.col("buyback.cash_out"), F.lit(False)), F.col("credit_earned"))
        .when(rolls, F.col("credit_earned") + before - F.col("balance"))
        .otherwise(F.least("credit_earned", need))
    )
    return rows.withColumns({"credit_used": used, "rollover_out": F.col("balance")})


def looped_balance(months: Column) -> Column:
    """The same carry-forward as a fold over array<struct<earned,offsettable>>: [(used, balance)...]; a cross-check of `carried`."""
    start = F.struct(F.lit(0.0).alias("balance"), F.array().cast("array<struct<used:double,balance:double>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        pool = m["earned"] + acc["balance"]
        used = F.least(pool, F.greatest(m["offsettable"], F.lit(0.0)))
        return F.struct((pool - used).alias("balance"), F.concat(acc["out"], F.array(F.struct(used.alias("used"), (pool - used).alias("balance")))).alias("out"))

    return F.aggregate(months, start, step)["out"]


def simulated(intervals: DataFrame, plans: DataFrame, tariff: DataFrame, prices: DataFrame | None = None, tz: str = LOCAL_TZ) -> DataFrame:
    """Monthly bills of every meter under every plan.

    prices: one zone's (ts, price_usd_kwh), aligned and gap-filled per meter; without them an indexed
    rate has no price. Rows keep what `ranked` needs to tell a bill from a plan that cannot be billed.
    """
    ready = prepared(plans if "ord" in plans.columns else plans.withColumn("ord", F.lit(0)))
    usage = intervals.select("meter_id", "ts", "import_kwh", "export_kwh")
    priced = usage.withColumn("price", F.lit(None).cast("double")) if prices is None else aligned(usage, prices, tz=tz)[0].drop("estimated")
    # How many plans take each way: a way without any is left out of the job.
    ways = dict(ready.groupBy("by_interval").count().collect())
    made = [interval_parts(priced, ready, tz, ways[True])] if True in ways else []
    if False in ways or not made:
        made.append(cube_parts(cube(usage, tz), ready, ways.get(False, 0)))
    parts = made[0] if len(made) == 1 else made[0].unionByName(made[1])
    return monthly_bills(parts, month_coverage(usage, tz), ready, tariff)


def yearly(bills: DataFrame, plans: DataFrame) -> DataFrame:
    """One row per meter and plan: first_year_net (the sign-up fee counted once), final balance, average price, and why it cannot be billed."""
    fee = plans.select(F.col("id").alias("plan_id"), F.coalesce("signup_fee_usd", F.lit(0.0)).alias("fee"))
    sums = bills.groupBy("meter_id", "plan_id", "ord").agg(
        F.sum("bill").alias("bills"),
        F.sum("import_kwh").alias("import_kwh"),
        F.sum("energy_cost").alias("energy_cost"),
        F.sum("tdu_volumetric").alias("tdu_volumetric"),
        F.sum("paid_kwh").alias("paid_kwh"),
        F.max_by("rollover_out", "month").alias("final_balance"),
        F.bool_or("indexed").alias("uses_rtw"),
        F.sum("unmatched").alias("unmatched"),
        F.sum("unpriced").alias("unpriced"),
        F.min("unpriced_first").alias("unpriced_first"),
        F.count(F.lit(1)).alias("months"),
    )
    rows = sums.join(fee, "plan_id").withColumn("first_year_net", F.col("bills") + F.col("fee"))
    skip = F.when(F.col("unmatched") > 0, F.lit("no matching rate")).when(
        F.col("unpriced") > 0, F.concat(F.lit("no price for "), F.col("unpriced").cast("string"), F.lit(" intervals from "), F.date_format("unpriced_first", "yyyy-MM-dd HH:mm"))
    )
    return rows.select(
        "meter_id",
        "plan_id",
        "ord",
        "first_year_net",
        "final_balance",
        F.when(F.col("import_kwh") != 0, F.col("first_year_net") / F.col("import_kwh") * 100.0).otherwise(0.0).alias("avg_import_price_ckwh"),
        F.when(F.col("paid_kwh") != 0, 100.0 * (F.col("energy_cost") + F.col("tdu_volumetric")) / F.col("paid_kwh")).otherwise(0.0).alias("paid_ckwh"),
        "uses_rtw",
        "months",
        skip.alias("skipped"),
    )


def ranked(intervals: DataFrame, plans: DataFrame, tariff: DataFrame, prices: DataFrame | None = None, tz: str = LOCAL_TZ) -> tuple[DataFrame, DataFrame]:
    """(ranking per meter, skipped (plan_id, meter_id, reason)); costs equal to a millionth keep the plans' load order."""
    out = refused(plans)
    allowed = plans.join(out.select("id"), "id", "left_anti")
    years = yearly(simulated(intervals, allowed, tariff, prices, tz), allowed)
    by = Window.partitionBy("meter_id").orderBy(F.round("first_year_net", 6), "ord", "plan_id")
    best = years.where("skipped IS NULL").withColumn("rank", F.row_number().over(by)).drop("skipped")
    skipped = out.select(F.col("id").alias("plan_id"), F.lit(None).cast("string").alias("meter_id"), "reason").unionByName(
        years.where("skipped IS NOT NULL").select("plan_id", "meter_id", F.col("skipped").alias("reason"))
    )
    return best, skipped


def notes(years: DataFrame, windows: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """(meter_id, note): what a reader of the ranking must know, each said once per meter.

    The billing window's note unless it is a whole, untrimmed year; the estimated prices' share where a
    plan priced by them is ranked.
    """
    span = windows.where("trimmed OR NOT reliable").select("meter_id", "note")
    if gaps is None:
        return span.distinct()
    indexed = years.where("uses_rtw AND skipped IS NULL").select("meter_id").distinct()
    share = gaps.where("filled > 0").join(indexed, "meter_id", "left_semi")
    return span.unionByName(share.select("meter_id", F.concat(F.lit("prices estimated for "), F.format_string("%.1f", F.col("fraction") * 100), F.lit(" % of intervals")).alias("note"))).distinct()


def with_estimated_share(years: DataFrame, gaps: DataFrame) -> DataFrame:
    """Adds prices_estimated_fraction: the share of estimated intervals for plans priced by them, else 0."""
    share = gaps.select("meter_id", F.when(F.col("filled") > 0, F.col("fraction")).otherwise(0.0).alias("_f"))
    return years.join(share, "meter_id", "left").withColumn("prices_estimated_fraction", F.when(F.col("uses_rtw"), F.coalesce("_f", F.lit(0.0))).otherwise(0.0)).drop("_f")
