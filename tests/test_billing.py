"""Bills whose figures follow from arithmetic by hand."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from meterflow.operators import billing, prices, reports, rollover, usage
from meterflow.plans import catalogue, schema
from meterflow.queries import adapters as a

PER_DAY = 96


def frame(spark, start, days, imp=0.0, exp=0.0, meter="m"):
    """Constant readings on the local grid of some days."""
    df = spark.sql(f"SELECT explode(sequence(DATE'{start}', date_add(DATE'{start}', {days - 1}))) AS d")
    from meterflow.functions.clock import day_grid

    return df.select(F.lit(meter).alias("meter_id"), F.explode(day_grid(F.col("d"))).alias("ts"), F.lit(float(imp)).alias("import_kwh"), F.lit(float(exp)).alias("export_kwh"))


def plans(spark, *items):
    return a._rows(spark, [p | {"ord": i} for i, p in enumerate(items)], schema.PLAN + ", ord int")


def tariff(spark, fixed=0.0, ckwh=0.0):
    return spark.createDataFrame([("ONCOR", dt.date(2024, 1, 1), fixed, ckwh)], schema.TARIFF)


def bill(spark, usage_frame, plan, prices_frame=None, fixed=0.0, ckwh=0.0):
    return billing.simulated(usage_frame, plans(spark, plan), tariff(spark, fixed, ckwh), prices_frame).orderBy("month").collect()


def test_flat_rate_with_delivery_and_proration(spark):
    (m,) = bill(spark, frame(spark, "2024-01-08", 2, 1.0), a.plan("p", "R", "n", [a.rate(10.0)], base=5.0), fixed=10.0, ckwh=5.0)
    assert m.energy_cost == pytest.approx(19.20)
    assert m.coverage == pytest.approx(2 / 31)
    assert m.tdu == pytest.approx(10 * 2 / 31 + 9.60)
    assert m.bill == pytest.approx(19.20 + m.tdu + 5 * 2 / 31)


def test_free_nights_and_weekends(spark):
    night = [a.rate(0.0, window=a.window(hours=a.NIGHT)), a.rate(20.0)]
    assert bill(spark, frame(spark, "2024-01-08", 2, 1.0), a.plan("p", "R", "n", night))[0].energy_cost == pytest.approx(24.0)
    weekend = [a.rate(0.0, window=a.window(weekdays=(5, 6))), a.rate(15.0)]
    assert bill(spark, frame(spark, "2024-01-08", 7, 1.0), a.plan("p", "R", "n", weekend))[0].energy_cost == pytest.approx(72.0)


def test_exempt_nights_carry_no_delivery_and_are_no_paid_kwh(spark):
    night = [a.rate(0.0, window=a.window(hours=a.NIGHT), exempt=True), a.rate(20.0)]
    (m,) = bill(spark, frame(spark, "2024-01-08", 2, 1.0), a.plan("p", "R", "n", night), ckwh=5.0)
    assert m.tdu_volumetric == pytest.approx(120 * 0.05) and m.paid_kwh == pytest.approx(120)


def test_car_allowance_binding_and_not(spark):
    car = {"window": a.window(hours=range(6)), "monthly_kwh_cap": 20.0, "label": "", "covers_delivery": False}
    (m,) = bill(spark, frame(spark, "2024-01-08", 2, 1.0), a.plan("p", "R", "n", [a.rate(10.0)], ev=car), ckwh=5.0)
    assert (m.ev_free_kwh, m.energy_cost, m.tdu_volumetric) == (pytest.approx(20), pytest.approx(17.20), pytest.approx(9.60))
    loose = {"window": a.window(hours=(0, 1)), "monthly_kwh_cap": 500.0, "label": "", "covers_delivery": True}
    (m,) = bill(spark, frame(spark, "2024-01-08", 1, 1.0), a.plan("p", "R", "n", [a.rate(10.0)], ev=loose), ckwh=5.0)
    assert (m.ev_free_kwh, m.energy_cost, m.tdu_volumetric) == (pytest.approx(8), pytest.approx(8.80), pytest.approx(4.40))


def test_credits_by_scope_cap_and_payout(spark):
    one = frame(spark, "2024-01-08", 1, 0.5, 0.5)
    of = lambda **b: a.plan("p", "R", "n", [a.rate(10.0)], bb=a.buyback("fixed", 50.0, **b))
    (m,) = bill(spark, one, of(scope="energy_only"))
    assert (m.credit_earned, m.credit_used, m.rollover_out) == tuple(map(pytest.approx, (24.0, 4.8, 19.2)))
    assert bill(spark, one, of())[0].bill == pytest.approx(0.0)
    (m,) = bill(spark, frame(spark, "2024-01-08", 1, 0.5, 0.3), of(cap="energy_charge"))
    assert m.credit_earned == pytest.approx(4.8)
    (m,) = bill(spark, frame(spark, "2024-01-08", 1, 0.2, 1.0), of(cash_out=True))
    assert (m.bill, m.rollover_out) == (pytest.approx(1.92 - 48.0), 0.0)


def test_bill_credit_tiers_stack_on_month_import(spark):
    p = a.plan("p", "R", "n", [a.rate(10.0)], credits=((0.0, 100.0, 0.0), (100.0, None, 5.0), (90.0, 130.0, 1.0)))
    (m,) = bill(spark, frame(spark, "2024-01-08", 1, 1.25), p)
    assert (m.import_kwh, m.bill_credit, m.bill) == tuple(map(pytest.approx, (120.0, 6.0, 6.0)))


def test_window_buyback(spark):
    bb = a.buyback("windows", rates=[a.rate(20.0, window=a.window(hours=(17, 18))), a.rate(5.0)])
    (m,) = bill(spark, frame(spark, "2024-01-08", 1, 0.0, 1.0), a.plan("p", "R", "n", [a.rate(10.0)], bb=bb))
    assert (m.credit_earned, m.rollover_out) == (pytest.approx(6.0), pytest.approx(6.0))


def four(spark, values):
    t = [dt.datetime(2024, 1, 8, 6, 15 * i) for i in range(4)]
    used = spark.createDataFrame([("m", x, 1.0, 0.0) for x in t], schema.INTERVALS)
    sold = spark.createDataFrame([("m", x, 0.0, 1.0) for x in t], schema.INTERVALS)
    series = spark.createDataFrame([("Z", x, v) for x, v in zip(t, values, strict=True) if v is not None], schema.PRICES)
    return used, sold, series


def test_indexed_rates_are_cut(spark):
    used, _, series = four(spark, [0.10, 0.20, 0.05, 0.30])
    (m,) = bill(spark, used, a.plan("p", "R", "n", [a.rate(rtw=a.rtw(cap=15.0))]), series)
    assert m.energy_cost == pytest.approx(0.45)
    _, sold, series = four(spark, [0.10, 0.60, 0.05, 3.00])
    (m,) = bill(spark, sold, a.plan("p", "R", "n", [a.rate(10.0)], bb=a.buyback("rtw", rtw=a.rtw(cap=25.0))), series)
    assert m.credit_earned == pytest.approx(0.65)


def test_plans_that_cannot_be_billed_are_skipped_with_a_reason(spark):
    used, sold, series = four(spark, [0.1, None, 0.1, 0.1])
    catalogue_ = plans(spark, a.plan("ix", "R", "n", [a.rate(rtw=a.rtw())]), a.plan("flat", "R", "n", [a.rate(10.0)]), a.plan("zero", "R", "n", [a.rate(0.0)]), a.plan("bad", "R", "n", [a.rate(1.0)], unpriceable_reason="tiers"))
    best, skipped = billing.ranked(used, catalogue_, tariff(spark), series)
    assert [r.plan_id for r in best.collect()] == ["flat"]
    assert {r.plan_id: r.reason for r in skipped.collect()} == {"ix": "no price for 1 intervals from 2024-01-08 06:15", "zero": "every energy rate is zero", "bad": "tiers"}
    # Without usage a missing price does no harm.
    best, _ = billing.ranked(sold, catalogue_, tariff(spark), series)
    assert {r.plan_id for r in best.collect()} == {"ix", "flat"}


def test_ties_keep_load_order_and_fees_count_once(spark):
    two = plans(spark, a.plan("b", "R", "n", [a.rate(10.0)]), a.plan("a", "R", "n", [a.rate(10.0)]), a.plan("fee", "R", "n", [a.rate(10.0)], fee=50.0))
    usage_frame = frame(spark, "2024-01-30", 4, 1.0)
    best, _ = billing.ranked(usage_frame, two, tariff(spark))
    rows = best.orderBy("rank").collect()
    assert [r.plan_id for r in rows] == ["b", "a", "fee"]
    assert rows[2].first_year_net == pytest.approx(rows[0].first_year_net + 50)


def test_cube_and_interval_branches_agree(spark):
    flat = [p for p in a.PLANS if p["ev_free_charging"] is None and not any(r["rtw"] for r in p["energy_rates"]) and p["buyback"]["kind"] != "rtw"]
    usage_frame = frame(spark, "2024-02-26", 9, 0.7, 0.4).withColumn("import_kwh", F.col("import_kwh") + F.minute("ts") / 100)
    ready = billing.prepared(plans(spark, *flat))
    forced = ready.withColumn("by_interval", F.lit(True))
    one = billing.cube_parts(billing.cube(usage_frame), ready)
    two = billing.interval_parts(usage_frame.withColumn("price", F.lit(None).cast("double")), forced)
    key = lambda df: {(r.plan_id, r.month): r.asDict() for r in df.collect()}
    left, right = key(one), key(two)
    assert left.keys() == right.keys()
    for k, r in left.items():
        for c in ("import_kwh", "energy_cost", "free_kwh", "tdu_import_kwh", "export_credit_raw"):
            assert r[c] == pytest.approx(right[k][c]), (k, c)


def test_carry_forward_equals_the_loop(spark):
    rng, rows, want = random.Random(2), [], {}
    for p in range(20):
        balance = 0.0
        for m in range(15):
            earned, off = rng.uniform(-5, 50), rng.uniform(-20, 60)
            pool = earned + balance
            used = min(pool, max(off, 0.0))
            balance = pool - used
            want[p, m] = (used, balance)
            rows.append(("m", str(p), f"2024-{m:02d}", earned, off, (True, False)))
    df = spark.createDataFrame(rows, "meter_id string, plan_id string, month string, credit_earned double, offsettable double, buyback struct<rollover:boolean,cash_out:boolean>")
    for r in billing.carried(df).collect():
        assert (r.credit_used, r.rollover_out) == tuple(map(pytest.approx, want[int(r.plan_id), int(r.month[-2:])]))
    folded = df.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("month", F.col("credit_earned").alias("earned"), "offsettable"))).alias("m"))
    for r in folded.select("plan_id", billing.looped_balance(F.col("m")).alias("out")).collect():
        for m, x in enumerate(r.out):
            assert (x.used, x.balance) == tuple(map(pytest.approx, want[int(r.plan_id), m]))


def test_short_contracts_go_on_at_the_published_rate(spark):
    used = frame(spark, "2023-12-01", 31 + 31 + 29, 1.0)
    history = spark.createDataFrame([(0, ["Kelp"], "", {"ONCOR": [(dt.date(2023, 11, 15), 12.0), (dt.date(2024, 1, 20), 14.0), (dt.date(2024, 2, 10), 13.0)]})], schema.VARIABLE_RATES)

    def energy(term, rates):
        p = plans(spark, a.plan("p", "Kelp Power LLC", "n", rates, term=term))
        coverage = billing.month_coverage(used)
        schedule = rollover.schedules(p, coverage.select("meter_id", "month"), history)
        parts = rollover.with_rollover(billing.cube_parts(billing.cube(used), billing.prepared(p)), schedule)
        return {r.month: r.energy_cost for r in parts.collect()}, rollover.tags(schedule).first()

    got, tag = energy(1, [a.rate(2.0)])
    assert got == {"2023-12": pytest.approx(31 * 96 * 0.02), "2024-01": pytest.approx(31 * 96 * 0.12), "2024-02": pytest.approx(29 * 96 * 0.13)}
    assert (tag.rollover, tag.low_ckwh, tag.high_ckwh) == ("history", 12.0, 13.0)
    got, _ = energy(2, [a.rate(0.0, window=a.window(hours=range(6))), a.rate(8.0)])
    assert got["2024-01"] == pytest.approx(31 * 72 * 0.08) and got["2024-02"] == pytest.approx(29 * 96 * 0.13)
    early = history.select(rollover.rate_on(F.col("tdu")["ONCOR"], F.lit(dt.date(2020, 1, 1)))).first()[0]
    assert early == 12.0


def test_gaps_are_filled_by_time_of_day_or_refused(spark):
    days = frame(spark, "2024-01-01", 365, 1.0)
    series = days.select(F.lit("Z").alias("zone"), "ts", F.when(F.hour(F.from_utc_timestamp("ts", "America/Chicago")) < 12, 0.20).otherwise(0.02).alias("price_usd_kwh"))
    short, report = prices.aligned(days, series.where("ts < '2024-12-29 06:00:00'"))
    assert report.first().filled == 192
    filled = short.where("estimated").groupBy("price").count().orderBy("price").collect()
    assert [(round(r.price, 6), r["count"]) for r in filled] == [(0.02, 96), (0.2, 96)]
    refused, report = prices.aligned(days, series.where("ts < '2024-11-21 06:00:00'"))
    assert report.first().filled == 0 and not report.first().within_tolerance
    assert refused.where("price IS NULL").count() == 40 * 96


def test_billing_window_prefers_complete_months(spark):
    frame14 = frame(spark, "2023-01-01", 31 + 28 + 365 - 59, 1.0).unionByName(frame(spark, "2024-01-01", 45, 1.0))
    gap = frame14.where("NOT (ts >= '2023-08-05' AND ts < '2023-08-20')")
    w = usage.billing_windows(usage.billing_months(gap)).first()
    assert (w.months_available, w.months_used, w.start, w.end, w.trimmed, w.partial_months) == (14, 12, "2023-01", "2024-01", True, 0)
    assert "2023-08" not in w.months_kept and "2024-02" not in w.months_kept
    kept = usage.in_billing_window(gap, usage.billing_months(gap))
    assert {r.month for r in usage.monthly_usage(kept).collect()} == set(w.months_kept)


def test_catalogue_changes(spark):
    p = a.plans(spark)
    assert schema.violations(p).count() == 0
    saved = p.where("id = 'flat'").withColumns({"id": F.lit("flat2"), "base_charge_usd": F.lit(9.0)})
    after = catalogue.upserted(p, saved, F.lit("flat"))
    ids = {r.id for r in after.select("id").collect()}
    assert "flat2" in ids and "flat" not in ids and len(ids) == p.count()
    assert catalogue.deleted(p, p.select("id"), "tou").count() == 1
    assert {(r.id, r.leader) for r in catalogue.siblings(p).where("id <> leader").collect()} == {("sell_flat_copy", "flat")}


def test_workbook_sheets(spark, tmp_path):
    used, p = frame(spark, "2024-01-08", 2, 1.0), a.plans(spark).where("id IN ('flat', 'tou')")
    bills = billing.simulated(used, p, tariff(spark))
    sheets = reports.workbook(billing.yearly(bills, p).withColumn("rank", F.lit(1)), bills, p.where("id = 'flat'"), used)
    reports.write_workbook(sheets, str(tmp_path))
    rows = {r.plan_id: r for r in spark.read.parquet(f"{tmp_path}/summary").collect()}
    assert rows["tou"].retailer == "(removed)" and rows["flat"].name == "Alder Flat 12"
    assert set(spark.read.parquet(f"{tmp_path}/monthly_detail").columns) == {"meter_id", "plan_id", *schema.MONTHLY}


def test_audit_orders_by_cost(spark):
    rows = [("p", "energy_ckwh", 10.0, 12.0), ("p", "base_usd_month", 5.0, 10.0), ("q", "etf_usd", 1.0, 1.0)]
    got = reports.audit_impact(spark.createDataFrame(rows, "plan_id string, field string, stored double, read double")).collect()
    assert [(r.field, r.impact_usd) for r in got] == [("energy_ckwh", 240.0), ("base_usd_month", 60.0)]
