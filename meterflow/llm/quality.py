"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates.

Features of a text, hashed into DIMENSIONS places by groups of equal weight: tokens (words and runs
of punctuation), pairs of neighbouring tokens, and runs of three token shapes (lower, Capital, CAPS,
digits, mixed, punctuation; each marked when the token repeats the one before it). A place's value is
the square root of its share in the group, so every text has the same length as a vector. Whole
texts are read, in pieces of PIECE_CHARS so that memory stays bounded. Only the text is an input.

The model is fitted on at most SAMPLE labelled rows (a documented bound: those with the smallest hash
of their id, a fixed random sample), PASSES times, by FTRL-proximal updates. Its weights have
DIMENSIONS places whatever the input's size, and are broadcast. Scores are sparse dot products
through the logistic function.

Null texts count as empty; an empty text has no features and gets the intercept's score. Labels with
a null id or a null mark are left out, repeated labels count by their mean (0.5 or more: 1). Without
any label every score is 0.5. Repeated rows each get their score; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, quoted, released, text_of, written

DIMENSIONS = 1 << 18
SAMPLE = 8192
PASSES = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-4
TABLE_ENTRIES = 400_000
PIECE_CHARS = 1 << 20
SHAPES = 7


class Features:
    """Turns texts into (places, values); keeps a bounded table of the tokens met."""

    def __init__(self):
        import re

        self.tokens = re.compile(r"\w+|[^\w\s]+")
        self.table: dict[str, int] = {}

    @staticmethod
    def _code(token: str) -> int:
        """Hash in the high bits, shape in the low three."""
        if token.isdigit():
            shape = 3
        elif not (token[0].isalnum() or token[0] == "_"):
            shape = 5
        elif token.islower():
            shape = 0
        elif token.isupper() and len(token) > 1:
            shape = 2
        elif token[0].isupper() and (len(token) == 1 or token[1:].islower()):
            shape = 1
        else:
            shape = 4
        return zlib.crc32(token.encode("utf-8", "surrogatepass")) << 3 | shape

    def codes(self, text: str) -> np.ndarray:
        table, parts = self.table, []
        for at in range(0, len(text), PIECE_CHARS):
            found = self.tokens.findall(text[at : at + PIECE_CHARS])
            if len(table) > TABLE_ENTRIES:
                table.clear()
            for token in set(found).difference(table):
                table[token] = self._code(token)
            parts.append(np.fromiter(map(table.__getitem__, found), np.int64, len(found)))
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        codes = self.codes(text)
        if not len(codes):
            return np.empty(0, np.int64), np.empty(0, np.float32)
        hashed = (codes >> 3).astype(np.uint64)
        same = np.r_[False, codes[1:] == codes[:-1]]
        shape = (codes & 7) + SHAPES * same
        groups = [hashed * np.uint64(0x9E3779B97F4A7C15)]
        if len(codes) > 1:
            groups.append((hashed[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + hashed[1:]) * np.uint64(0x9E3779B97F4A7C15))
        if len(codes) > 2:
            runs = (shape[:-2] * (2 * SHAPES) + shape[1:-1]) * (2 * SHAPES) + shape[2:]
            groups.append((runs.astype(np.uint64) + np.uint64(1 << 40)) * np.uint64(0x9E3779B97F4A7C15))
        places, values = [], []
        for g in groups:
            place, n = np.unique(g >> np.uint64(64 - DIMENSIONS.bit_length() + 1), return_counts=True)
            places.append(place.astype(np.int64))
            values.append(np.sqrt(n / len(g)))
        place, back = np.unique(np.concatenate(places), return_inverse=True)
        return place, np.bincount(back, np.concatenate(values)).astype(np.float32)


class Ftrl:
    """Logistic regression by FTRL-proximal; the intercept is the place after the last."""

    def __init__(self):
        self.z, self.n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(self, places: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        places, values = np.r_[places, DIMENSIONS], np.r_[values, 1.0]
        w = self.weights(places)
        g = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
        old = self.n[places]
        self.z[places] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / ALPHA * w
        self.n[places] = old + g * g


def bucket(id_col: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null ids: null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, sample: int = SAMPLE) -> np.ndarray:
    """Weights from a bounded, fixed sample of the labelled rows outside the held-out fold."""
    lean(docs.sparkSession)
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (bucket("doc_id", folds) != held_fold))
    marks = marks.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    chosen = marks.withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(sample)
    chosen = F.broadcast(written(chosen, "labels"))  # at most `sample` rows
    chosen = chosen.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    texts = docs.select("doc_id", text_of().alias("text")).join(chosen, "doc_id").select("turn", "doc_id", "label", "text")

    def featurise(frames):
        import pyarrow as pa

        features = Features()
        for batch in frames:
            found = [features.of(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([p.astype(np.int32) for p, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32()))],
                ["turn", "doc_id", "label", "places", "values"],
            )

    def fit(frames):
        import pyarrow as pa

        rows = []
        for batch in frames:
            places, values = batch.column(3), batch.column(4)
            for i, (turn, doc, label) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                rows.append((turn, doc, label, places[i].values.to_numpy(), values[i].values.to_numpy()))
        rows.sort(key=lambda r: r[:3])
        model = Ftrl()
        for _ in range(PASSES):
            for _, _, label, places, values in rows:
                model.learn(places, values, label)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())], ["weights"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    one = texts.mapInArrow(featurise, f"turn long, doc_id {kind}, label int, places array<int>, values array<float>")
    # At most `sample` rows meet in one task; the exchange keeps the scan of all documents on all tasks.
    rows = one.repartition(1).mapInArrow(fit, "weights binary").collect()  # one row of fixed size
    return np.frombuffer(bytes(rows[0][0]), np.float32) if rows else np.zeros(DIMENSIONS + 1, np.float32)


def scored(docs: DataFrame, weights: np.ndarray, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep... and score for each row of docs."""
    spark = lean(docs.sparkSession)
    shared = spark.sparkContext.broadcast(weights)
    # The text goes to Python once, even where it is one of the columns to keep.
    places = tuple(dict.fromkeys((*keep, text)))
    at = places.index(text)
    carried = F.struct(*(F.col(quoted(c)) for c in places)).alias("carried")
    shape = "carried struct<" + ",".join(f"{quoted(c)}:{docs.schema[c].dataType.simpleString()}" for c in places) + ">"

    def run(frames):
        import pyarrow as pa

        released()
        features, w = Features(), shared.value.astype(np.float64)
        for batch in frames:
            margins = np.array([w[-1] + (w[p] @ v) for p, v in (features.of(t or "") for t in batch.column(0).field(at).to_pylist())], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-margins)))], ["carried", "score"])

    return docs.select(carried).mapInArrow(run, f"{shape}, score double").select(*(F.col(f"carried.{quoted(c)}").alias(c) for c in keep), "score")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs, trained on the labels outside the held-out fold."""
    out = scored(docs, train(docs, labels, folds, held_fold))
    held = F.coalesce(bucket("doc_id", folds) == held_fold, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    weights = train(docs, labels)
    own = docs.columns
    marked = scored(docs.withColumnsRenamed({"score": "__score"}), weights, keep=tuple("__score" if c == "score" else c for c in own))
    kept = marked.where(F.col("score") >= threshold).drop("score")
    return kept.withColumnsRenamed({"__score": "score"}).select(*map(quoted, own))
