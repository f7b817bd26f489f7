"""The corpus pipeline: documents through five of the text operators, each stage on all its predecessor kept.

Every stage takes odd rows as its operator does: null texts count as empty, null ids are never a
reason to drop a row, rows repeated with one id and text leave one (from the exact stage on), very
long texts are read whole, an empty table gives an empty table. Further columns of documents go
through all stages, whatever their names; the last adds n_tokens, ids_sha256 and decoded_sha256 in
place of columns of those names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meterflow.llm import bpe, decontaminate, exact_dedup, near_copies, quality
from meterflow.llm.common import discard, written

#: Below this score a document is rejected.
LEAST_QUALITY = 0.3

#: SQL cannot train the classifier or compare shingles; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; an empty text has the intercept's score."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"), LEAST_QUALITY)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id (null ids last); null and empty texts are equal."""
    return exact_dedup.drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id (null ids last); texts without words are copies of each other."""
    return near_copies.drop_near_copies(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; empty texts have none."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, a null text as the empty one it decodes to, with token count and digests of ids and decoded bytes."""
    import public_tokenizers

    return bpe.roundtrip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", classify),
    ("exact_dedup", dedup),
    ("near_dedup", near_dedup),
    ("decontamination", clean),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder and read again, its predecessor's then removed."""
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before = docs
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
            discard(before)
    return docs
