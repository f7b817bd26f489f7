"""Texts of documents: plain files, and PDF where an extractor is installed; what a run has seen, as small tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.html import is_pdf

#: Settings, their environment variables and defaults.
SETTINGS = {"load_zone": ("METERFLOW_LOAD_ZONE", "LZ_SOUTH"), "car_kwh_month": ("METERFLOW_CAR_KWH_MONTH", None), "charger_kw": ("METERFLOW_CHARGER_KW", None)}


def setting(spark: SparkSession, name: str) -> str | None:
    """The environment, then the session (meterflow.<name>), then the default; looked up when asked."""
    variable, default = SETTINGS[name]
    return os.environ.get(variable) or spark.conf.get(f"meterflow.{name}", None) or default


def pdf_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, text, error) of PDF files; needs pdfplumber, imported in the task. Files without the PDF mark have an error and no text."""

    def run(frames):
        import io

        for frame in frames:
            out = []
            for at, sha, good, content in zip(frame["path"], frame["sha256"], frame["good"], frame["content"], strict=True):
                text, error = None, None if good else "no PDF mark"
                if good:
                    try:
                        import pdfplumber

                        with pdfplumber.open(io.BytesIO(content)) as pdf:
                            text = "\n".join(page.extract_text() or "" for page in pdf.pages)
                    except Exception as e:  # noqa: BLE001  one bad file is one row with an error
                        error = str(e)[:200]
                out.append((at, sha, text, error))
            import pandas as pd

            yield pd.DataFrame(out, columns=["path", "sha256", "text", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", F.sha2("content", 256).alias("sha256"), is_pdf(F.col("content")).alias("good"), "content")
    return rows.mapInPandas(run, "path string, sha256 string, text string, error string")


def newest_captures(files: DataFrame) -> DataFrame:
    """The newest file of each site key, the part of its name before the first underscore."""
    keyed = files.withColumn("site", F.substring_index("name", "_", 1))
    newest = Window.partitionBy("site").orderBy(F.desc("modified"), F.desc("path"))
    return keyed.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def written_record(rows: DataFrame, path: str) -> None:
    """A small record of a run (coverage, authority), replaced as a whole."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def read_record(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A run's record; an absent or unreadable one is empty: it claims nothing."""
    try:
        rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
        rows.limit(1).collect()
        return rows
    except Exception:  # noqa: BLE001
        return spark.createDataFrame([], schema)
