"""The plan catalogue as tables: flat rows, summaries, the same deal under several names, saves and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _number(x: Column) -> Column:
    """Up to four decimals, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.4f", x), "0+$", ""), r"\.$", "")


def rate_summary(rates: Column) -> Column:
    """One line: the rates in order, and how many there are."""
    part = lambda r: F.when(r["rate_ckwh"].isNotNull(), F.concat(_number(r["rate_ckwh"]), F.lit("c/kWh"))).when(r["rtw"].isNotNull(), "indexed").otherwise("?")
    n = F.size(rates)
    return F.when(n > 0, F.concat(F.array_join(F.transform(rates, part), " / "), F.lit(" ("), n.cast("string"), F.when(n == 1, " rate)").otherwise(" rates)"))).otherwise("-")


def export_label(buyback: Column) -> Column:
    """What exports earn, in words."""
    rate = F.when(buyback["kind"] == "fixed", F.concat(_number(buyback["rate_ckwh"]), F.lit("c/kWh"))).when(buyback["kind"] == "rtw", "wholesale").when(buyback["kind"] == "windows", "by time of day").otherwise("none")
    limits = F.concat_ws(
        ", ",
        F.when(buyback["offset_scope"] == "energy_only", "energy charges only"),
        F.when(buyback["monthly_credit_cap"] == "energy_charge", "capped at the energy charge"),
        F.when(buyback["cash_out"], "paid out").when(~buyback["rollover"], "lapses monthly"),
    )
    return F.when(F.coalesce(buyback["kind"], F.lit("none")) == "none", "none").otherwise(F.when(limits == "", rate).otherwise(F.concat(rate, F.lit(" ("), limits, F.lit(")"))))


def etf_label(usd: Column, per_month: Column) -> Column:
    return F.when(F.coalesce(usd, F.lit(0.0)) == 0, "none").otherwise(F.concat(F.lit("$"), _number(usd), F.when(per_month, " per month left").otherwise("")))


def hours_label(hours: Column) -> Column:
    """Hours of the day as spans, a span over midnight as one: 21:00-06:00; no hours: all day."""
    sorted_ = F.array_sort(F.array_distinct(hours))
    starts = F.filter(sorted_, lambda h: ~F.array_contains(hours, ((h + 23) % 24).cast("int")))
    length = lambda s: F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), F.lit(24)), lambda n: ~F.array_contains(hours, ((s + n) % 24).cast("int")))), F.lit(24))
    clock = lambda h: F.format_string("%02d:00", (h % 24).cast("int"))
    return F.when(F.coalesce(F.size(hours), F.lit(0)).isin(-1, 0, 24), "all day").otherwise(F.array_join(F.transform(starts, lambda s: F.concat(clock(s), F.lit("-"), clock(s + length(s)))), ", "))


def draft_summary(drafts: DataFrame) -> DataFrame:
    """One row per draft: identity, rates, the least confidence of any field, the review mark."""
    return drafts.select("id", "retailer", "name", "term_months", rate_summary(F.col("energy_rates")).alias("rates"), F.array_min(F.map_values("confidence")).alias("least_confidence"), F.coalesce("needs_review", F.lit(False)).alias("needs_review"))


def shown(plans: DataFrame, with_review: bool = False, with_solar_excluding: bool = False) -> DataFrame:
    """The plans a comparison lists: by default neither those under review nor those not sold to homes with panels."""
    rows = plans if with_review else plans.where("NOT coalesce(needs_review, false)")
    return rows if with_solar_excluding else rows.where("NOT coalesce(excludes_solar, false)")


def summary(plans: DataFrame) -> DataFrame:
    """One labelled row per plan."""
    return plans.select(
        "id",
        "retailer",
        "name",
        F.concat(F.col("term_months").cast("string"), F.lit(" months")).alias("term"),
        rate_summary(F.col("energy_rates")).alias("rates"),
        export_label(F.col("buyback")).alias("export"),
        etf_label(F.col("etf_usd"), F.col("etf_per_month_remaining")).alias("early_termination"),
        F.col("needs_review"),
    )


def flattened(plans: DataFrame) -> DataFrame:
    """Nested lists as JSON, buyback fields with a prefix."""
    fields = [f.name for f in plans.schema["buyback"].dataType.fields]
    simple = [c for c in plans.columns if c not in ("energy_rates", "bill_credits", "buyback", "ev_free_charging")]
    return plans.select(
        *simple,
        F.size("energy_rates").alias("n_rates"),
        F.to_json("energy_rates").alias("energy_rates"),
        F.to_json("bill_credits").alias("bill_credits"),
        F.to_json("ev_free_charging").alias("ev_free_charging"),
        *(F.to_json("buyback.rates").alias("buyback_rates") if n == "rates" else F.to_json("buyback.rtw").alias("buyback_rtw") if n == "rtw" else F.col(f"buyback.{n}").alias(f"buyback_{n}") for n in fields),
    )


def fingerprint() -> Column:
    """What a plan costs, as a digest: everything the bill depends on, nothing that names it."""
    rates = F.transform("energy_rates", lambda r: F.struct(r["rate_ckwh"], r["rtw"], r["window"], r["tdu_exempt"]))
    return F.sha2(
        F.to_json(F.struct("term_months", F.upper("tdu").alias("tdu"), "base_charge_usd", rates.alias("rates"), "buyback", F.array_sort("bill_credits").alias("credits"), "ev_free_charging", "tdu_passthrough", "signup_fee_usd", "rate_type")),
        256,
    )


def siblings(plans: DataFrame) -> DataFrame:
    """(id, leader, siblings): plans of one fingerprint; the first in load order leads, the others are its siblings."""
    groups = plans.select("id", "ord", fingerprint().alias("deal")).groupBy("deal").agg(F.array_sort(F.collect_list(F.struct("ord", "id"))).alias("members"))
    return groups.select(F.explode("members").alias("m"), F.element_at("members", 1)["id"].alias("leader"), F.col("members")).select(
        F.col("m.id").alias("id"), "leader", F.array_join(F.transform(F.filter("members", lambda x: x["id"] != F.col("m.id")), lambda x: x["id"]), ",").alias("siblings")
    )


def upserted(plans: DataFrame, saved: DataFrame, renamed_from: Column | None = None) -> DataFrame:
    """plans with the rows of `saved` in place of those with their id (and of the id a row was renamed from)."""
    gone = saved.select("id")
    if renamed_from is not None:
        gone = gone.unionByName(saved.select(renamed_from.alias("id")).where("id IS NOT NULL"))
    return plans.join(gone.distinct(), "id", "left_anti").unionByName(saved, allowMissingColumns=True)


def deleted(plans: DataFrame, ids: DataFrame, current_id: str | None = None) -> DataFrame:
    """plans without the given ids; the current plan stays."""
    gone = ids.select("id") if current_id is None else ids.select("id").where(F.col("id") != current_id)
    return plans.join(gone.distinct(), "id", "left_anti")


def renamed(plans: DataFrame, old: str, new: str, current_id: str | None = None) -> DataFrame:
    """plans with one id changed; an id in use and the current plan's stay as they are."""
    taken = plans.where(F.col("id") == new).agg(F.count(F.lit(1)).alias("n"))
    allowed = (F.col("id") == old) & (F.lit(old) != F.lit(current_id or "")) & (F.col("n") == 0)
    return plans.join(taken).withColumn("id", F.when(allowed, F.lit(new)).otherwise(F.col("id"))).drop("n")


def demoted(plans: DataFrame, drafts: DataFrame, ids: DataFrame, current_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(plans, drafts): the given plans back among the drafts, under review; the current plan stays."""
    gone = ids.select("id").distinct() if current_id is None else ids.select("id").distinct().where(F.col("id") != current_id)
    back = plans.join(gone, "id", "left_semi").withColumn("needs_review", F.lit(True))
    return plans.join(gone, "id", "left_anti"), drafts.join(back.select("id"), "id", "left_anti").unionByName(back, allowMissingColumns=True)


def stale_first(plans: DataFrame, today: str, days: int = 90) -> DataFrame:
    """Plans whose data is old, or of unknown age from a seed report, before the others."""
    old = F.coalesce(F.datediff(F.lit(today).cast("date"), "retrieved") > days, F.col("source").startswith("report"))
    return plans.withColumn("stale", old).orderBy(F.desc("stale"), "id")


def with_faults(plans: DataFrame) -> DataFrame:
    """The catalogue with rows that break its rules, for checks of the checks."""
    bad = plans.where("id IN ('night_free', 'tou', 'sell_fixed', 'sell_windows')")
    faults = bad.withColumns(
        {
            "id": F.concat(F.lit("bad_"), "id"),
            "energy_rates": F.when(F.col("id") == "night_free", F.slice("energy_rates", 1, 1)).when(F.col("id") == "tou", F.transform("energy_rates", lambda r: r.withField("rate_ckwh", F.lit(None).cast("double")))).otherwise(F.col("energy_rates")),
            "buyback": F.when(F.col("id") == "sell_fixed", F.col("buyback").withField("rate_ckwh", F.lit(None).cast("double")))
            .when(F.col("id") == "sell_windows", F.col("buyback").withField("rates", F.slice("buyback.rates", 1, 1)).withField("offset_scope", F.lit("none_at_all")))
            .otherwise(F.col("buyback")),
        }
    )
    return plans.unionByName(faults).unionByName(plans.where("id = 'flat'"))


def quarantined(plans: DataFrame, current_id: str) -> Column:
    """Whether a refresh takes a plan out before reading its sources again: market rows, never the current plan."""
    return (F.col("source").startswith("ptc") | F.col("source").startswith("efl:") | (F.col("source") == "meterplan")) & (F.col("id") != current_id)


def first_of(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The leader of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_n = 1").drop("_n")
