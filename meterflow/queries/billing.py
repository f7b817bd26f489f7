"""Queries over simulated bills."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import billing as ops
from ..operators import rollover, usage
from ..operators.sizes import checked
from ..plans import catalogue
from . import adapters as a

MONEY = ("import_kwh", "export_kwh", "energy_cost", "ev_free_kwh", "base", "tdu", "bill_credit", "credit_earned", "credit_used", "rollover_out", "bill", "paid_kwh", "tdu_volumetric")


def _round(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns if c in df.columns})


def _bills(spark, sf, ids=None):
    plans = a.plans(spark) if ids is None else a.plans(spark).where(F.col("id").isin(*ids))
    return ops.simulated(a.usage15(spark, sf), plans, a.tariff(spark), a.hourly_prices(spark, sf))


def first_match_rate(spark, sf):
    """Which rule each slot of each plan falls under; the lookup the bills are made with."""
    ready = ops.prepared(a.plans(spark))
    return ready.select(F.col("id").alias("plan_id"), F.posexplode("energy_slots").alias("slot", "rule"))


def window_mask(spark, sf):
    """Usage inside a window of months, weekdays and hours."""
    from ..functions.clock import with_local_columns

    w = F.struct(F.array(F.lit(1), F.lit(2)).alias("months"), F.array(*map(F.lit, (0, 1, 2, 3, 4))).alias("weekdays"), F.array(*map(F.lit, (17, 18, 19))).alias("hours"))
    rows = with_local_columns(a.usage15(spark, sf)).where(ops.window_matches(w, F.col("month_num"), F.col("weekday"), F.col("hour")))
    return _round(rows.groupBy("meter_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("import_kwh").alias("import_kwh")), "import_kwh")


def monthly_bills(spark, sf):
    """Every meter's monthly bill under every plan."""
    return _round(_bills(spark, sf).select("meter_id", "plan_id", "month", F.round("coverage", 9).alias("coverage"), *MONEY, "indexed"), *MONEY)


def yearly_costs(spark, sf):
    return _round(ops.yearly(_bills(spark, sf), a.plans(spark)).drop("ord"), "first_year_net", "final_balance", "avg_import_price_ckwh", "paid_ckwh")


def rank_plans(spark, sf):
    """The ranking of all plans for each meter."""
    best, _ = ops.ranked(a.usage15(spark, sf), a.plans(spark), a.tariff(spark), a.hourly_prices(spark, sf))
    return best.select("meter_id", "plan_id", "rank", F.round("first_year_net", 4).alias("first_year_net"))


def rank_skipped(spark, sf):
    """Plans refused, and those without a price series to be billed with."""
    _, skipped = ops.ranked(a.usage15(spark, sf), a.plans(spark), a.tariff(spark), None)
    return skipped.withColumn("reason", F.regexp_replace("reason", " from .*", ""))


def flat_bill_rank(spark, sf):
    """The slice that needs no prices: flat and time-of-use plans, ranked by cost per meter."""
    ids = ("flat", "night_free", "night_exempt", "weekend", "tou", "bundled", "tiers", "fee", "sell_flat_copy")
    best, _ = ops.ranked(a.usage15(spark, sf), a.plans(spark).where(F.col("id").isin(*ids)), a.tariff(spark))
    return best.select("meter_id", "plan_id", "rank", F.round("first_year_net", 6).alias("first_year_net"))


def carry_forward(spark, sf):
    """Export credits carried over years of months of one meter."""
    ids = ("sell_fixed", "sell_energy_only", "sell_capped", "sell_cash", "sell_lapses")
    bills = ops.simulated(a.one_meter(spark, sf), a.plans(spark).where(F.col("id").isin(*ids)), a.tariff(spark))
    return bills.select("meter_id", "plan_id", "month", *(F.round(c, 8).alias(c) for c in ("credit_earned", "credit_used", "rollover_out", "bill")))


def tariff_asof(spark, sf):
    """The delivery tariff in force on each day with orders; none before the first."""
    days = a.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("on")).distinct().withColumn("tdu", F.lit("ONCOR"))
    return rollover.tariff_on(days, a.tariffs(spark)).withColumns({c: F.col(c).cast("string") for c in ("on", "effective")})


def variable_rate_asof(spark, sf):
    """Each short plan's month-to-month rate on the 15th of every month; the earliest before the history starts."""
    months = a.table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()
    series = rollover.histories_of(a.plans(spark), a.histories(spark))
    return months.join(checked(series)).select("plan_id", "month", "history_ord", rollover.rate_on(F.col("series"), F.to_date(F.concat("month", F.lit("-15")))).alias("rate_ckwh"))


def _rolled(spark, sf):
    daily = a.usage_daily(spark, sf)
    daily = usage.in_billing_window(daily, usage.billing_months(daily, rows_per_day=1))
    plans = a.plans(spark).where(F.col("id").isin("short", "short_nights", "short_unknown", "fee", "flat"))
    ready = ops.prepared(plans)
    coverage = ops.month_coverage(daily)
    schedule = rollover.schedules(plans, coverage.select("meter_id", "month"), a.histories(spark))
    parts = rollover.with_rollover(ops.cube_parts(ops.cube(daily), ready), schedule)
    return ops.monthly_bills(parts, coverage, ready, a.tariff(spark)), schedule, plans


def contract_rollover(spark, sf):
    bills, _, _ = _rolled(spark, sf)
    # Daily amounts have four decimals and rates up to five: eight decimals are exact.
    return bills.select("meter_id", "plan_id", "month", *(F.round(c, 8).alias(c) for c in ("energy_cost", "tdu", "bill")))


def rollover_tag(spark, sf):
    bills, schedule, plans = _rolled(spark, sf)
    years = ops.yearly(bills, plans).select("meter_id", "plan_id", F.round("first_year_net", 6).alias("first_year_net"))
    return years.join(rollover.tags(schedule), ["meter_id", "plan_id"], "left")


def plan_validation(spark, sf):
    from ..plans.schema import violations

    return violations(catalogue.with_faults(a.plans(spark)))


def sibling_groups(spark, sf):
    """Plans that are the same deal under different names; the cheapest position leads."""
    return catalogue.siblings(a.plans(spark)).select("id", "leader", "siblings")


def plan_inputs(spark, sf):
    """Plans as flat rows, nested lists as JSON."""
    flat = catalogue.flattened(a.plans(spark))
    return flat.select("id", "retailer", "name", "term_months", "base_charge_usd", "n_rates", "buyback_kind", "buyback_offset_scope", "buyback_cash_out")


def plan_summary(spark, sf):
    return catalogue.summary(a.plans(spark))


QUERIES = {
    f.__name__: f
    for f in (
        flat_bill_rank, first_match_rate, window_mask, monthly_bills, yearly_costs, rank_plans, rank_skipped, carry_forward, tariff_asof, variable_rate_asof, contract_rollover, rollover_tag,
        plan_validation, sibling_groups, plan_inputs, plan_summary,
    )
}


def _bill_sql(final: str, usage: str = a.USAGE15_SQL, prices: bool = True, ids: tuple[str, ...] | None = None, rolled: bool = False, window: bool = False) -> str:
    only = f"WHERE p.plan_id IN ({', '.join(repr(i) for i in ids)})" if ids else ""
    price = "l.price_usd_kwh"
    hit = "(len(r.months) = 0 OR list_contains(r.months, l.month_num)) AND (len(r.weekdays) = 0 OR list_contains(r.weekdays, l.weekday)) AND (len(r.hours) = 0 OR list_contains(r.hours, l.hour))"
    usd = f"""CASE WHEN r.is_rtw THEN CASE WHEN {price} IS NULL THEN NULL ELSE greatest(CASE WHEN r.cap_ckwh IS NULL THEN {price} * r.multiplier + r.adder_ckwh / 100
        ELSE least({price} * r.multiplier + r.adder_ckwh / 100, r.cap_ckwh / 100) END, r.floor_ckwh / 100) END ELSE r.rate_ckwh / 100 END"""
    match = lambda s: f"""{s} AS (SELECT l.meter_id, l.ts, r.plan_id, arg_min(struct_pack(usd := {usd}, exempt := r.exempt, rtw := r.is_rtw), r.n) AS m
        FROM priced l JOIN rules r ON r.side = '{s}' AND {hit} GROUP BY 1, 2, 3)"""  # noqa: E731
    history = a.values(a.HISTORIES[1]["tdu"]["ONCOR"], {"effective": "DATE", "energy_ckwh": "DOUBLE"})
    states = """counts AS (SELECT meter_id, month, count(*) AS n FROM loc0 GROUP BY 1, 2), states AS (SELECT *, n >= day(last_day((month || '-01')::DATE)) * 0.99 AS complete FROM counts),
      ranked_months AS (SELECT *, count(*) FILTER (WHERE complete) OVER (PARTITION BY meter_id) AS nc, row_number() OVER (PARTITION BY meter_id ORDER BY month DESC) AS ra, sum(complete::INT) OVER (PARTITION BY meter_id ORDER BY month DESC) AS rc FROM states),
      loc AS (SELECT loc0.* FROM loc0 SEMI JOIN (SELECT * FROM ranked_months WHERE CASE WHEN nc >= 12 THEN complete AND rc <= 12 ELSE ra <= 12 END) k USING (meter_id, month)),"""
    local = a.LOCAL_SQL.replace("loc AS", "loc0 AS") + ", " + states if window else a.LOCAL_SQL + ","
    variable = f"""history AS ({history}), turns AS (SELECT meter_id, month, row_number() OVER (PARTITION BY meter_id ORDER BY month) AS turn FROM (SELECT DISTINCT meter_id, month FROM loc)),
      variable AS (SELECT t.meter_id, p.plan_id, t.month, coalesce((SELECT arg_max(energy_ckwh, effective) FROM history WHERE effective <= (t.month || '-15')::DATE), (SELECT arg_min(energy_ckwh, effective) FROM history)) AS v
        FROM turns t JOIN plans p ON t.turn > p.term_months AND p.plan_id IN ('short', 'short_nights')),""" if rolled else "variable AS (SELECT '' AS meter_id, '' AS plan_id, '' AS month, 0.0::DOUBLE AS v WHERE false),"  # noqa: E501
    t = a.TARIFFS[2]
    return f"""WITH {usage}, {local} {a.PRICES_SQL if prices else 'prices AS (SELECT NULL::TIMESTAMP AS ts, NULL::DOUBLE AS price_usd_kwh WHERE false)'}, {a.plan_ctes()},
    priced AS (SELECT loc.*, prices.price_usd_kwh FROM loc LEFT JOIN prices USING (ts)), {match('energy')}, {match('export')}, {variable}
    x AS (SELECT l.*, p.*, CASE WHEN v.v IS NULL THEN e.m.usd ELSE v.v / 100 END AS er, CASE WHEN v.v IS NULL THEN coalesce(e.m.exempt, false) ELSE false END AS exempt, coalesce(e.m.rtw, false) AS ertw, CASE WHEN p.kind = 'none' THEN 0.0 ELSE s.m.usd END AS sr,
        coalesce(s.m.rtw, false) AS srtw, v.v AS v, CASE WHEN p.ev_cap IS NOT NULL AND list_contains(p.ev_hours, l.hour) THEN l.import_kwh ELSE 0.0 END AS wk
      FROM priced l CROSS JOIN plans p LEFT JOIN energy e ON e.meter_id = l.meter_id AND e.ts = l.ts AND e.plan_id = p.plan_id LEFT JOIN export s ON s.meter_id = l.meter_id AND s.ts = l.ts AND s.plan_id = p.plan_id
      LEFT JOIN variable v ON v.meter_id = l.meter_id AND v.plan_id = p.plan_id AND v.month = l.month {only}),
    y AS (SELECT *, CASE WHEN ev_cap IS NULL THEN 0.0 ELSE least(greatest(ev_cap - (sum(wk) OVER (PARTITION BY meter_id, plan_id, month ORDER BY ts ROWS UNBOUNDED PRECEDING) - wk), 0), wk) END AS freed FROM x),
    z AS (SELECT *, import_kwh * er * (1 - CASE WHEN import_kwh > 0 THEN freed / import_kwh ELSE 0 END) AS charge, (er = 0 AND (exempt OR NOT passthrough) AND v IS NULL) AS free_here, coalesce(ev_covers, false) AS covers FROM y),
    parts AS (SELECT meter_id, plan_id, any_value(ord) AS ord, month, least(count(DISTINCT date) / day(last_day((month || '-01')::DATE)), 1.0) AS coverage, sum(import_kwh) AS import_kwh, sum(export_kwh) AS export_kwh, sum(charge) AS energy_cost,
        sum(freed) AS ev_free_kwh, sum(CASE WHEN coalesce(free_here, false) THEN import_kwh WHEN covers OR (NOT passthrough AND ev_cap IS NOT NULL) THEN freed ELSE 0 END) AS free_kwh,
        sum(CASE WHEN exempt THEN 0 ELSE import_kwh - CASE WHEN covers THEN freed ELSE 0 END END) AS delivered, sum(export_kwh * sr) AS raw, bool_or(ertw OR srtw) AS indexed,
        count(*) FILTER (WHERE (ertw AND import_kwh > 0 AND er IS NULL) OR (srtw AND export_kwh > 0 AND sr IS NULL)) AS unpriced, any_value(base) AS b, any_value(passthrough) AS passthrough, any_value(kind) AS kind, any_value(scope) AS scope,
        any_value(cap) AS cap, any_value(rollover) AS rollover, any_value(cash_out) AS cash_out, any_value(fee) AS fee, any_value(reason) AS reason FROM z GROUP BY meter_id, plan_id, month),
    m1 AS (SELECT *, b * coverage AS base, CASE WHEN passthrough THEN {t['volumetric_ckwh']} / 100 * delivered ELSE 0 END AS tdu_volumetric, import_kwh - free_kwh AS paid_kwh,
        coalesce((SELECT sum(credit_usd) FROM credits c WHERE c.plan_id = parts.plan_id AND import_kwh >= min_kwh AND (max_kwh IS NULL OR import_kwh < max_kwh)), 0.0) AS bill_credit,
        CASE WHEN kind = 'none' THEN 0.0 WHEN cap = 'energy_charge' THEN least(raw, energy_cost) ELSE raw END AS credit_earned FROM parts),
    m2 AS (SELECT *, CASE WHEN passthrough THEN {t['fixed_usd_month']} * coverage + tdu_volumetric ELSE 0 END AS tdu FROM m1),
    m3 AS (SELECT *, energy_cost + base + tdu - bill_credit AS charges, CASE WHEN scope = 'energy_only' THEN energy_cost ELSE energy_cost + base + tdu - bill_credit END AS offsettable FROM m2),
    m4 AS (SELECT *, sum(credit_earned - greatest(offsettable, 0)) OVER (PARTITION BY meter_id, plan_id ORDER BY month) AS s FROM m3),
    m5 AS (SELECT *, CASE WHEN rollover AND NOT cash_out THEN s - least(0, min(s) OVER (PARTITION BY meter_id, plan_id ORDER BY month)) ELSE 0.0 END AS rollover_out FROM m4),
    m6 AS (SELECT *, CASE WHEN cash_out THEN credit_earned WHEN rollover THEN credit_earned + coalesce(lag(rollover_out) OVER (PARTITION BY meter_id, plan_id ORDER BY month), 0) - rollover_out ELSE least(credit_earned, greatest(offsettable, 0)) END AS credit_used FROM m5),
    monthly AS (SELECT *, charges - credit_used AS bill FROM m6),
    years AS (SELECT meter_id, plan_id, any_value(ord) AS ord, sum(bill) + any_value(fee) AS first_year_net, arg_max(rollover_out, month) AS final_balance, CASE WHEN sum(import_kwh) <> 0 THEN (sum(bill) + any_value(fee)) / sum(import_kwh) * 100 ELSE 0 END AS avg_import_price_ckwh,
        CASE WHEN sum(paid_kwh) <> 0 THEN 100 * (sum(energy_cost) + sum(tdu_volumetric)) / sum(paid_kwh) ELSE 0 END AS paid_ckwh, bool_or(indexed) AS uses_rtw, count(*) AS months, sum(unpriced) AS unpriced, any_value(reason) AS reason FROM monthly GROUP BY 1, 2)
    {final}"""


_REFUSED = "'all_zero', 'unpriceable'"
_FLAT = ("flat", "night_free", "night_exempt", "weekend", "tou", "bundled", "tiers", "fee", "sell_flat_copy")
_rounded = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)

ORACLE_SQL = {
    "first_match_rate": f"""WITH {a.plan_ctes()}, slots AS (SELECT s::INTEGER AS slot, (s // 168 + 1)::INTEGER AS mo, ((s // 24) % 7)::INTEGER AS wd, (s % 24)::INTEGER AS h FROM range(2016) t(s))
        SELECT plan_id, slot, (min(n) + 1)::INTEGER AS rule FROM slots JOIN rules r ON side = 'energy' AND (len(months) = 0 OR list_contains(months, mo)) AND (len(weekdays) = 0 OR list_contains(weekdays, wd)) AND (len(hours) = 0 OR list_contains(hours, h)) GROUP BY 1, 2""",
    "window_mask": f"WITH {a.USAGE15_SQL}, {a.LOCAL_SQL} SELECT meter_id, count(*) AS rows, round(sum(import_kwh), 6) AS import_kwh FROM loc WHERE month_num IN (1, 2) AND weekday < 5 AND hour IN (17, 18, 19) GROUP BY 1",
    "monthly_bills": _bill_sql(f"SELECT meter_id, plan_id, month, round(coverage, 9) AS coverage, {_rounded(*MONEY)}, indexed FROM monthly"),
    "yearly_costs": _bill_sql(f"SELECT meter_id, plan_id, {_rounded('first_year_net', 'final_balance', 'avg_import_price_ckwh', 'paid_ckwh')}, uses_rtw, months, NULL::VARCHAR AS skipped FROM years"),
    "rank_plans": _bill_sql(f"SELECT meter_id, plan_id, row_number() OVER (PARTITION BY meter_id ORDER BY round(first_year_net, 6), ord, plan_id)::INTEGER AS rank, round(first_year_net, 4) AS first_year_net FROM years WHERE plan_id NOT IN ({_REFUSED})"),
    "rank_skipped": _bill_sql(
        f"""SELECT plan_id, meter_id, 'no price for ' || unpriced::BIGINT::VARCHAR || ' intervals' AS reason FROM years WHERE plan_id NOT IN ({_REFUSED}) AND unpriced > 0
        UNION ALL SELECT 'all_zero', NULL, 'every energy rate is zero' UNION ALL SELECT 'unpriceable', NULL, 'usage tiers'""",
        prices=False,
    ),
    "flat_bill_rank": _bill_sql("SELECT meter_id, plan_id, row_number() OVER (PARTITION BY meter_id ORDER BY round(first_year_net, 6), ord, plan_id)::INTEGER AS rank, round(first_year_net, 6) AS first_year_net FROM years", prices=False, ids=_FLAT),
    "carry_forward": _bill_sql(f"SELECT meter_id, plan_id, month, {', '.join(f'round({c}, 8) AS {c}' for c in ('credit_earned', 'credit_used', 'rollover_out', 'bill'))} FROM monthly", usage=a.daily_sql(1), prices=False, ids=("sell_fixed", "sell_energy_only", "sell_capped", "sell_cash", "sell_lapses")),
    "tariff_asof": f"""WITH t AS ({a.values(a.TARIFFS, {'tdu': 'VARCHAR', 'effective': 'DATE', 'fixed_usd_month': 'DOUBLE', 'volumetric_ckwh': 'DOUBLE'})}), d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)
        SELECT d::VARCHAR AS "on", 'ONCOR' AS tdu, effective::VARCHAR AS effective, fixed_usd_month, volumetric_ckwh FROM d ASOF LEFT JOIN t ON d.d >= t.effective""",
    "variable_rate_asof": f"""WITH h AS ({a.values(a.HISTORIES[1]['tdu']['ONCOR'], {'effective': 'DATE', 'energy_ckwh': 'DOUBLE'})}), m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders)
        SELECT p.id AS plan_id, month, 1 AS history_ord, coalesce((SELECT arg_max(energy_ckwh, effective) FROM h WHERE effective <= (month || '-15')::DATE), (SELECT arg_min(energy_ckwh, effective) FROM h)) AS rate_ckwh
        FROM m, (VALUES ('short'), ('short_nights')) p(id)""",
    "contract_rollover": _bill_sql(f"SELECT meter_id, plan_id, month, round(energy_cost, 8) AS energy_cost, round(tdu, 8) AS tdu, round(bill, 8) AS bill FROM monthly", usage=a.daily_sql(20), prices=False, ids=("short", "short_nights", "short_unknown", "fee", "flat"), rolled=True, window=True),
    "rollover_tag": _bill_sql(
        """SELECT y.meter_id, y.plan_id, round(first_year_net, 6) AS first_year_net, CASE WHEN y.plan_id IN ('short', 'short_nights') AND v.n > 0 THEN 'history' WHEN y.plan_id IN ('short_unknown', 'fee') AND y.months > p.term_months THEN 'assumed' END AS rollover, low_ckwh, high_ckwh
        FROM years y JOIN plans p USING (plan_id) LEFT JOIN (SELECT meter_id, plan_id, count(*) AS n, min(v) AS low_ckwh, max(v) AS high_ckwh FROM variable GROUP BY 1, 2) v ON v.meter_id = y.meter_id AND v.plan_id = y.plan_id""",
        usage=a.daily_sql(20), prices=False, ids=("short", "short_nights", "short_unknown", "fee", "flat"), rolled=True, window=True,
    ),
}
