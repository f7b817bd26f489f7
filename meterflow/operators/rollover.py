"""Months past a short contract: dated tariffs and month-to-month rates, and the schedule they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import checked

COMPARISON_MONTHS = 12
#: Words that carry no retailer identity.
LEGAL_WORDS = ("llc", "inc", "lp", "dba")


def tariff_on(days: DataFrame, tariffs: DataFrame, day: str = "on") -> DataFrame:
    """days (tdu, on, ...) with the tariff in force: the last one effective by that day; none before the first.

    The tariff side is a handful of dated rows per utility, so each day meets its utility's rows and
    keeps the latest by aggregation, without a sort.
    """
    dated = tariffs.groupBy("tdu").agg(F.collect_list(F.struct("effective", "fixed_usd_month", "volumetric_ckwh")).alias("dated"))
    past = F.filter("dated", lambda t: t["effective"] <= F.col(day))
    return days.join(dated, "tdu", "left").withColumn("t", F.try_element_at(F.array_sort(past), F.lit(-1))).select(
        *days.columns, F.col("t.effective").alias("effective"), F.col("t.fixed_usd_month").alias("fixed_usd_month"), F.col("t.volumetric_ckwh").alias("volumetric_ckwh")
    )


def rate_on(series: Column, day: Column) -> Column:
    """The rate of array<struct<effective,energy_ckwh>> in force on a day; before the first the earliest; null without any."""
    past = F.filter(series, lambda p: p["effective"] <= day)
    best = F.coalesce(F.try_element_at(F.array_sort(past), F.lit(-1)), F.try_element_at(F.array_sort(series), F.lit(1)))
    return best["energy_ckwh"]


def retailer_key(name: Column) -> Column:
    """Lower-case words without punctuation and legal forms."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9 ]+", " ")), " +")
    return F.array_join(F.filter(words, lambda w: ~w.isin("", *LEGAL_WORDS)), " ")


def histories_of(plans: DataFrame, histories: DataFrame) -> DataFrame:
    """(plan_id, history_ord, series): the first history that names the retailer by prefix and has the plan's utility.

    histories: (history_ord, retailers, tdu map). Both sides are dimensions; the histories are broadcast if their size allows.
    """
    names = histories.select("history_ord", F.col("tdu").alias("by_tdu"), F.explode("retailers").alias("name")).withColumn("key", retailer_key(F.col("name"))).where("key <> ''")
    wanted = plans.select(F.col("id").alias("plan_id"), retailer_key(F.col("retailer")).alias("own"), F.upper(F.coalesce("tdu", F.lit(""))).alias("utility"))
    hits = wanted.join(checked(names), F.col("own").startswith(F.col("key"))).withColumn("series", F.try_element_at("by_tdu", F.col("utility")))
    return hits.where("size(series) > 0").groupBy("plan_id").agg(F.min_by(F.struct("history_ord", "series"), "history_ord").alias("h")).select("plan_id", "h.*")


def rolls_over(plans: DataFrame) -> Column:
    """Whether a plan's term ends inside the year with a schedule that has an end: no indexed energy rate."""
    return (F.col("term_months") < COMPARISON_MONTHS) & ~F.exists("energy_rates", lambda r: r["rtw"].isNotNull())


def schedules(plans: DataFrame, months: DataFrame, histories: DataFrame) -> DataFrame:
    """Per meter and short plan, each billing month's phase and rate: (meter_id, plan_id, month, phase, rate_ckwh).

    months: (meter_id, month). The first term_months of a meter's months are contract months; a
    later one has the retailer's rate in force on its 15th. Plans without a history: phase assumed,
    the contract goes on.
    """
    short = plans.where(rolls_over(plans)).select(F.col("id").alias("plan_id"), "term_months")
    found = short.join(histories_of(plans, histories), "plan_id", "left")
    ranked = months.withColumn("turn", F.dense_rank().over(Window.partitionBy("meter_id").orderBy("month")))
    rows = ranked.join(checked(found))
    later = F.col("turn") > F.col("term_months")
    day = F.to_date(F.concat("month", F.lit("-15")))
    return rows.select(
        "meter_id",
        "plan_id",
        "month",
        F.when(~later, "contract").when(F.col("series").isNull(), "assumed").otherwise("variable").alias("phase"),
        F.when(later & F.col("series").isNotNull(), rate_on(F.col("series"), day)).alias("rate_ckwh"),
    )


def with_rollover(parts: DataFrame, schedule: DataFrame) -> DataFrame:
    """Monthly parts in which months past the contract carry the variable rate on all their import.

    A month-to-month rate is flat, so the month's import is all the charge needs; nothing in such a
    month is exempt from delivery or free unless the rate itself is zero.
    """
    variable = schedule.where("phase = 'variable'").select("meter_id", "plan_id", "month", F.col("rate_ckwh").alias("variable_ckwh"))
    rows = parts.join(variable, ["meter_id", "plan_id", "month"], "left")
    rolled = F.col("variable_ckwh").isNotNull()
    return rows.withColumns(
        {
            "energy_cost": F.when(rolled, F.col("import_kwh") * F.col("variable_ckwh") / 100.0).otherwise(F.col("energy_cost")),
            "tdu_import_kwh": F.when(rolled, F.col("import_kwh")).otherwise(F.col("tdu_import_kwh")),
            "free_kwh": F.when(rolled, 0.0).otherwise(F.col("free_kwh")),
            "unmatched": F.when(rolled, F.lit(0)).otherwise(F.col("unmatched")),
        }
    ).drop("variable_ckwh")


def tags(schedule: DataFrame) -> DataFrame:
    """(meter_id, plan_id, rollover, low_ckwh, high_ckwh): history, assumed, or null where no month lies past the contract."""
    return schedule.groupBy("meter_id", "plan_id").agg(
        F.when(F.bool_or(F.col("phase") == "variable"), "history").when(F.bool_or(F.col("phase") == "assumed"), "assumed").alias("rollover"),
        F.min("rate_ckwh").alias("low_ckwh"),
        F.max("rate_ckwh").alias("high_ckwh"),
    )
