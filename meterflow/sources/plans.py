"""Plan documents, tariffs and rate histories: JSON tables, and YAML where a parser is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.schema import PLAN, TARIFF, VARIABLE_RATES, violations
from .files import texts

#: Review fields a draft carries that are no part of a plan.
REVIEW = ("_parse", "_llm_suggested")
DRAFT_REVIEW = "struct<confidence:map<string,double>,evidence:map<string,string>,unparsed_notes:array<string>,source_sha256:string>"


def _as_json(files: DataFrame) -> DataFrame:
    """Texts as JSON; YAML files go through PyYAML, imported only where there are any."""

    def run(frames):
        import json

        for frame in frames:
            out = []
            for name, text in zip(frame["name"], frame["text"], strict=True):
                if name.endswith((".yaml", ".yml")):
                    import yaml

                    text = json.dumps(yaml.safe_load(text), default=str)
                out.append(text)
            yield frame.assign(text=out)

    yaml_files = F.regexp_like("name", F.lit(r"\.ya?ml$"))
    rows = files.select("path", "name", "text")
    return rows.where(~yaml_files).unionByName(rows.where(yaml_files).mapInPandas(run, "path string, name string, text string"))


def load_plans(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Plans in file-name order (column ord), checked: a plan that breaks a rule or an id met twice raises."""
    rows = _as_json(texts(spark, path, pattern)).select(F.col("name").alias("_file"), F.from_json("text", PLAN).alias("p")).select("_file", "p.*")
    plans = rows.withColumn("ord", F.row_number().over(Window.orderBy("_file")) - 1).drop("_file")
    bad = violations(plans).first()
    if bad:
        raise ValueError(f"plan {bad.id}: {bad.violation}")
    return plans


def load_drafts(spark: SparkSession, path: str) -> DataFrame:
    """Drafts as they are: nothing is checked, review fields are kept (confidence, evidence, notes, source hash)."""
    rows = _as_json(texts(spark, path)).select(F.from_json("text", f"{PLAN}, _parse {DRAFT_REVIEW}").alias("p")).select("p.*")
    return rows.select("*", F.col("_parse.confidence").alias("confidence"))


def plan_fields(drafts: DataFrame) -> DataFrame:
    """Drafts without their review fields; the document's hash stays with the plan."""
    stamped = F.coalesce("source_sha256", F.col("_parse.source_sha256")) if "_parse" in drafts.columns else F.col("source_sha256")
    return drafts.withColumn("source_sha256", stamped).drop(*REVIEW)


def save_plans(plans: DataFrame, path: str) -> None:
    """Plans as JSON lines; absent fields are left out."""
    plans.write.mode("overwrite").json(path)


def flag_for_review(plans: DataFrame, flags: DataFrame) -> DataFrame:
    """plans with needs_review set and a note added for the ids in flags (id, note)."""
    rows = plans.join(flags.select("id", F.col("note").alias("_note")), "id", "left")
    notes = F.when(F.col("_note").isNotNull(), F.trim(F.concat_ws(" ", F.nullif(F.trim("notes"), F.lit("")), "_note"))).otherwise(F.col("notes"))
    return rows.withColumns({"needs_review": F.coalesce("needs_review", F.lit(False)) | F.col("_note").isNotNull(), "notes": notes}).select(*plans.columns)


def load_tariffs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TARIFF).json(path).orderBy("tdu", "effective")


def load_histories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VARIABLE_RATES).json(path)
