import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterflow.llm import quality


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(rng.randint(5, 60))).capitalize() + "."
    bad = lambda: rng.choice([" ".join([word()] * 20), " ".join(word().upper() + "!!" for _ in range(20)), " | ".join(word() for _ in range(20))])
    rows = [(i, good() if i % 3 else bad()) for i in range(900)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").cache()
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int").cache()
    return docs, labels


def test_held_out_rows_are_told_apart(corpus):
    rows = quality.classify(*corpus).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert sum((r.predicted == 1) == (r.doc_id % 3 > 0) for r in held) / len(held) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_held_out_labels_are_never_read(corpus, spark):
    docs, labels = corpus
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.train(docs, labels) == quality.train(docs, flipped)).all()


def test_updates_follow_the_formula():
    m = quality.Ftrl()
    places, values = np.array([3, 8]), np.array([0.5, 1.0], np.float32)
    z, n, w = dict.fromkeys([3, 8, "b"], 0.0), dict.fromkeys([3, 8, "b"], 0.0), {}
    for label in (1, 0, 1, 1):
        m.learn(places, values, label)
        x = {3: 0.5, 8: 1.0, "b": 1.0}
        w = {k: 0.0 if abs(z[k]) <= quality.L1 else -(z[k] - np.sign(z[k]) * quality.L1) / ((quality.BETA + n[k] ** 0.5) / quality.ALPHA + quality.L2) for k in x}
        g = 1 / (1 + np.exp(-sum(w[k] * x[k] for k in x))) - label
        for k in x:
            step = g * x[k]
            z[k] += step - ((n[k] + step * step) ** 0.5 - n[k] ** 0.5) / quality.ALPHA * w[k]
            n[k] += step * step
    np.testing.assert_allclose(m.z[[3, 8, quality.DIMENSIONS]], [z[3], z[8], z["b"]])


def test_pieces_do_not_change_features(monkeypatch):
    f, text = quality.Features(), "Ab cd ! " * 30
    whole = f.of(text)
    monkeypatch.setattr(quality, "PIECE_CHARS", 8)
    for a, b in zip(whole, f.of(text), strict=True):
        np.testing.assert_allclose(a, b)


def test_odd_rows_empty_tables_and_bad_labels(odd, empty, spark, corpus):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(odd, none).collect()} == {0.5}
    bad = spark.createDataFrame([(None, 1, 0), (1, None, 0), (100, 0, 0), (100, 1, 0), (101, 0, None)], "doc_id long, quality int, toxic int")
    rows = quality.classify(odd, bad).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(empty, bad).count() == 0


def test_stage_keeps_good_rows_with_all_columns(corpus):
    docs, labels = corpus
    table = docs.withColumn("score", F.lit("mine")).withColumn("carried", F.lit(1))
    kept = quality.keep_good(table, labels)
    assert kept.columns == table.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i in ids if i % 3} == {i for i in range(900) if i % 3}
    assert len([i for i in ids if i % 3 == 0]) < 15
    assert {r.score for r in kept.collect()} == {"mine"}


def brute_features(text):
    """{place: value} in plain Python: tokens, pairs of tokens and runs of three shapes."""
    import re

    mask = 2**64 - 1
    tokens = re.findall(r"\w+|[^\w\s]+", text)

    def shape(t):
        if t.isdigit():
            return 3
        if not (t[0].isalnum() or t[0] == "_"):
            return 5
        if t.islower():
            return 0
        if t.isupper() and len(t) > 1:
            return 2
        return 1 if t[0].isupper() and (len(t) == 1 or t[1:].islower()) else 4

    h = [zlib.crc32(t.encode()) for t in tokens]
    marks = [shape(t) + 7 * (i > 0 and t == tokens[i - 1]) for i, t in enumerate(tokens)]
    groups = [
        [x * 0x9E3779B97F4A7C15 & mask for x in h],
        [((a * 0xC2B2AE3D27D4EB4F + b) & mask) * 0x9E3779B97F4A7C15 & mask for a, b in zip(h, h[1:])],
        [((a * 14 + b) * 14 + c + 2**40) * 0x9E3779B97F4A7C15 & mask for a, b, c in zip(marks, marks[1:], marks[2:])],
    ]
    out = {}
    for g in groups:
        for place in set(p >> 46 for p in g):
            out[place] = out.get(place, 0) + (sum(p >> 46 == place for p in g) / len(g)) ** 0.5
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
def test_query_equals_brute_force_end_to_end(spark, kind):
    """Features, fixed order of the sample, FTRL passes and scores, spelled out; ids of either type."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["Ab", "cd", "EF", "7", "!!", "gh", "cd"]) for _ in range(rng.randint(0, 25))) for _ in range(60)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    marks = {i: int("EF" in t) for i, t in enumerate(texts) if i % 4}
    labels = spark.createDataFrame([(i, m, 0) for i, m in marks.items()], "doc_id long, quality int, toxic int").withColumn("doc_id", F.col("doc_id").cast(kind))
    turn = {int(r.doc_id): r.t for r in table.select("doc_id", F.xxhash64("doc_id").alias("t")).collect()}
    chosen = sorted((i for i in marks if zlib.crc32(str(i).encode()) % 5), key=turn.get)
    z, n = {}, {}

    def weight(k):
        a = z.get(k, 0.0)
        return 0.0 if abs(a) <= quality.L1 else -(a - (1 if a > 0 else -1) * quality.L1) / ((quality.BETA + n.get(k, 0.0) ** 0.5) / quality.ALPHA + quality.L2)

    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    features = [brute_features(t) | {"b": 1.0} for t in texts]
    for _ in range(quality.PASSES):
        for i in chosen:
            w = {k: weight(k) for k in features[i]}
            g = sigmoid(sum(w[k] * x for k, x in features[i].items())) - marks[i]
            for k, x in features[i].items():
                old, step = n.get(k, 0.0), g * x
                z[k] = z.get(k, 0.0) + step - ((old + step * step) ** 0.5 - old**0.5) / quality.ALPHA * w[k]
                n[k] = old + step * step
    want = {i: sigmoid(sum(weight(k) * x for k, x in f.items())) for i, f in enumerate(features)}
    rows = quality.classify(table, labels).collect()
    assert {int(r.doc_id): r.score for r in rows} == pytest.approx(want, abs=1e-5)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
