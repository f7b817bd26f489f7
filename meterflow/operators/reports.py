"""The tables of the comparison workbook, and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalogue import etf_label, export_label, flattened
from . import usage


def summary(ranking: DataFrame, plans: DataFrame) -> DataFrame:
    """A row per ranked plan; a plan that is no longer in the catalogue keeps its figures under its id."""
    facts = plans.select(F.col("id").alias("plan_id"), "retailer", "name", "term_months", export_label(F.col("buyback")).alias("export"), etf_label(F.col("etf_usd"), F.col("etf_per_month_remaining")).alias("early_termination"), "needs_review")
    rows = ranking.join(facts, "plan_id", "left")
    return rows.select(
        "meter_id",
        "rank",
        "plan_id",
        F.coalesce("retailer", F.lit("(removed)")).alias("retailer"),
        F.coalesce("name", "plan_id").alias("name"),
        "term_months",
        F.round("first_year_net", 2).alias("first_year_net"),
        F.round(F.col("first_year_net") / 12, 2).alias("per_month"),
        F.round("avg_import_price_ckwh", 2).alias("avg_import_price_ckwh"),
        F.round("paid_ckwh", 2).alias("paid_ckwh"),
        F.round("final_balance", 2).alias("final_balance"),
        "export",
        "early_termination",
        "uses_rtw",
        F.coalesce("needs_review", F.lit(False)).alias("needs_review"),
    )


def monthly_detail(bills: DataFrame) -> DataFrame:
    from ..plans.schema import MONTHLY

    return bills.select("meter_id", "plan_id", *MONTHLY)


def workbook(ranking: DataFrame, bills: DataFrame, plans: DataFrame, intervals: DataFrame) -> dict[str, DataFrame]:
    """The four sheets."""
    return {"summary": summary(ranking, plans), "monthly_detail": monthly_detail(bills), "usage": usage.monthly_usage(intervals), "plan_inputs": flattened(plans)}


def write_workbook(sheets: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """A folder per sheet."""
    for name, sheet in sheets.items():
        sheet.write.mode("overwrite").format(form).save(f"{path}/{name}")


def audit_impact(readings: DataFrame, kwh_per_year: float = 12000.0) -> DataFrame:
    """Disagreements between stored and independent readings (plan_id, field, stored, read), by what they would cost a year.

    Rates count by a year's usage, monthly charges twelve times, other fields once.
    """
    gap = F.abs(F.col("stored") - F.col("read"))
    cost = F.when(F.col("field").endswith("_ckwh"), gap * kwh_per_year / 100.0).when(F.col("field").endswith("_usd_month"), gap * 12).otherwise(gap)
    return readings.where("stored IS DISTINCT FROM read").withColumn("impact_usd", F.round(cost, 2)).orderBy(F.desc_nulls_last("impact_usd"), "plan_id", "field")
