"""Market lists (CSV), plan indexes (Markdown tables), offers in pages (JSON-LD), download logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import market
from .files import appended, lines, listing, newest, texts, with_neighbours

# Sections of an index that list plans, its header cells, how its cells state rates and amounts, and the mark of JSON-LD.
SECTIONS = ("Meter Plan Availability", "Competitor Plan Availability")
CELLS = {"tdu": "TDU", "retailer": "Provider", "plan_name": "Plan", "term": "Term", "import": "Import rate", "export": "Export credit", "base": "Base fee", "etf": "Early termination fee", "source_url": "Source"}
RATE = r"(?i)(\d+(?:\.\d+)?)\s*(?:¢|cents?)\s*/?\s*kWh"
DOLLARS = r"\$\s*(\d+(?:\.\d+)?)"
JSON_LD = r'(?is)<script[^>]+type="application/ld\+json"[^>]*>(.*?)</script>'
FACTS_LINK = "electricity facts label"
OFFERS = "array<struct<`@id`:string,name:string,areaServed:array<struct<`@type`:string,name:string>>,additionalProperty:array<struct<name:string,value:string>>>>"


def load_list(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """The newest market list under path, typed; columns of unknown names stay, at the end.

    Bytes that are no UTF-8 show as replacement signs; a byte-order mark is no part of the first name.
    """
    latest = newest(listing(spark, path, pattern, recursive=False)).first()
    if latest is None:
        raise FileNotFoundError(f"no market list in {path}")
    return market.tidy(spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(latest.path))


def _cell(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit("")))


def index_rows(files: DataFrame) -> DataFrame:
    """Rows of an index's plan tables: lines carry their section by the nearest heading above; rows whose cells do not fit the header are dropped."""
    rows = lines(files)
    rows = with_neighbours(rows, F.when(F.regexp_like("line", F.lit(r"^##\s+")), F.trim(F.regexp_replace("line", r"^##\s+", ""))), "section", ["path"], ["row"])
    rows = with_neighbours(rows, F.when(F.regexp_like("line", F.lit(r"^Generated:\s*\S")), F.trim(F.regexp_replace("line", r"^Generated:", ""))), "generated", ["path"], ["row"])
    rows = rows.where(F.col("section").isin(*SECTIONS) & F.startswith(F.trim("line"), F.lit("|")))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))
    rows = rows.withColumn("cells", cells)
    heads = rows.groupBy("path", "section").agg(F.min_by("cells", "row").alias("header"), F.min("row").alias("first"))
    rows = rows.join(heads, ["path", "section"]).where((F.col("row") > F.col("first") + 1) & (F.size("cells") == F.size("header")))
    cell = F.map_from_arrays("header", "cells")
    return rows.select("path", "row", "generated", F.trim("line").alias("raw_row"), *(F.try_element_at(cell, F.lit(h)).alias(f"c_{c}") for c, h in CELLS.items()))


def tidy_index(rows: DataFrame) -> DataFrame:
    """Index rows typed: rates, export kind, fees, term, whether a battery is needed. The source's own cost estimate is never read."""
    none = lambda c: F.regexp_like(_cell(F.col(c)), F.lit("(?i)^none$"))
    rate = lambda c: F.nullif(F.regexp_extract(_cell(F.col(c)), RATE, 1), F.lit("")).try_cast("double")
    usd = lambda c: F.when(none(c), 0.0).otherwise(F.coalesce(F.nullif(F.regexp_extract(_cell(F.col(c)), DOLLARS, 1), F.lit("")).try_cast("double"), F.lit(0.0)))
    indexed = F.regexp_like(_cell(F.col("c_export")), F.lit(r"(?i)real\s*time"))
    export = rate("c_export")
    return rows.select(
        _cell(F.col("c_tdu")).alias("tdu"),
        _cell(F.col("c_retailer")).alias("retailer"),
        _cell(F.col("c_plan_name")).alias("plan_name"),
        F.expr("cast(try_cast(trim(c_term) AS DOUBLE) AS INT)").alias("term_months"),
        rate("c_import").alias("import_ckwh"),
        F.when(indexed, "rtw").when(F.coalesce(export, F.lit(0.0)) == 0, "none").otherwise("fixed").alias("export_kind"),
        F.when(~indexed, export).alias("export_ckwh"),
        usd("c_base").alias("base_usd_month"),
        usd("c_etf").alias("etf_usd"),
        (~none("c_etf") & F.regexp_like(_cell(F.col("c_etf")), F.lit(r"(?i)per\s*month"))).alias("etf_per_month_remaining"),
        F.contains(_cell(F.col("c_plan_name")), F.lit("+ Battery")).alias("battery_required"),
        _cell(F.col("c_source_url")).alias("source_url"),
        F.expr("try_to_timestamp(generated)").alias("generated"),
        "raw_row",
    )


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """The newest index under path."""
    latest = newest(listing(spark, path, "*.md", recursive=False)).select("name")
    return tidy_index(index_rows(texts(spark, path, "*.md").join(latest, "name", "left_semi")))


def filtered_index(index: DataFrame, tdu: str | None = "Oncor") -> DataFrame:
    return index if tdu is None else index.where(F.contains(F.lower("tdu"), F.lit(tdu.lower())))


def offers(pages: DataFrame, tdu: str = "Oncor", html: str = "html", page: str = "page_id") -> DataFrame:
    """(page, offer_id, name, tdu, efl_url) from JSON-LD blocks: offers of the utility's area that carry a fact-sheet link.

    Blocks that are no JSON are skipped; an offer listed more than once counts once, the first.
    """
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(JSON_LD), F.lit(1))
    blocks = pages.select(F.col(page), F.posexplode(found).alias("block", "json"))
    # A block is an object or a list of them.
    text = F.when(F.startswith(F.trim("json"), F.lit("[")), F.col("json")).otherwise(F.concat(F.lit("["), "json", F.lit("]")))
    parsed = blocks.select(page, "block", F.posexplode(F.from_json(text, f"array<struct<itemListElement:{OFFERS}>>")).alias("doc", "d"))
    rows = parsed.select(page, "block", "doc", F.posexplode("d.itemListElement").alias("at", "o"))
    here = F.exists("o.areaServed", lambda a: (a["@type"] == "AdministrativeArea") & (F.lower(F.trim(a["name"])) == tdu.strip().lower()))
    sheet = F.try_element_at(F.filter("o.additionalProperty", lambda p: F.contains(F.lower(p["name"]), F.lit(FACTS_LINK))), F.lit(1))
    rows = rows.where(here).select(page, "block", "doc", "at", F.trim(F.regexp_replace(F.coalesce(F.col("o.`@id`"), F.col("o.name"), F.lit("")), "^#+", "")).alias("offer_id"), F.trim("o.name").alias("name"), F.trim(sheet["value"]).alias("efl_url"))
    rows = rows.where("offer_id <> '' AND coalesce(efl_url, '') <> ''")
    first = rows.groupBy(page, "offer_id").agg(F.min_by(F.struct("name", "efl_url"), F.struct("block", "doc", "at")).alias("r"))
    return first.select(page, "offer_id", "r.name", F.lit(tdu).alias("tdu"), "r.efl_url")


def downloads(spark: SparkSession, path: str) -> DataFrame:
    """The download log: one JSON line per document."""
    return spark.read.schema("retailer string, plan_name string, source_url string, discovered_at timestamp, extraction_method string, llm_confidence double, is_buyback boolean, buyback_ckwh double, file string").json(path)


def log_downloads(rows: DataFrame, path: str) -> None:
    appended(rows, path)


def by_host(rows: DataFrame, work, schema: str, url: str = "url") -> DataFrame:
    """Runs `work` (a function of a batch iterator) host by host: one task holds a host's rows in order, so a host is never asked twice at once."""
    hosts = rows.withColumn("host", F.lower(F.parse_url(F.col(url), F.lit("HOST"))))
    return hosts.repartition("host").sortWithinPartitions("host", url).mapInPandas(work, schema)


def lookup(first: DataFrame, second: DataFrame, key: str = "file") -> DataFrame:
    """Facts about files from two sources; where both speak the second wins, field by field."""
    rows = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    return rows.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_p"))).alias(c) for c in rows.columns if c not in (key, "_p")))


def resolution(listings: DataFrame, files: DataFrame, parsed: DataFrame) -> DataFrame:
    """(retailer, plan_name, state): no url, not downloaded, parse failed, or parsed."""
    rows = listings.join(files.select("efl_url", "file").distinct(), "efl_url", "left").join(parsed.select("file", F.lit(True).alias("ok")).distinct(), "file", "left")
    state = F.when(F.coalesce("efl_url", F.lit("")) == "", "no url").when(F.col("file").isNull(), "not downloaded").when(F.col("ok"), "parsed").otherwise("parse failed")
    return rows.select("retailer", "plan_name", state.alias("state"))
