import hashlib
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Good prose, junk, exact and near copies, and a leaked item, with what each stage should do."""
    rng, at = random.Random(21), tmp_path_factory.mktemp("sf")
    vocabulary = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    item = prose(40)
    docs = [prose(rng.randint(60, 200)) for _ in range(300)]
    docs += [" ".join([rng.choice(vocabulary)] * 30) for _ in range(100)]
    labels = [(i, int(i < 300), 0) for i in range(400)]
    docs += [docs[0], docs[1], docs[1]]  # 400..402
    words = docs[2].split()
    docs.append(" ".join([*words[:30], "changed", *words[31:]]))  # 403, near copy of 2
    docs.append(f"{prose(50)} {item} {prose(50)}")  # 404
    table = {"doc_id": list(range(len(docs))), "text": docs, "lang": ["en"] * len(docs), "source": ["s"] * len(docs), "n_chars": [len(d) for d in docs]}
    pq.write_table(pa.table(table), at / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [a for a, _, _ in labels], "quality": pa.array([b for _, b, _ in labels], pa.int32()), "toxic": pa.array([c for *_, c in labels], pa.int32())}), at / "labels.parquet")
    pq.write_table(pa.table({"item_id": [0, 1], "text": [item, prose(20)]}), at / "benchmark.parquet")
    return str(at), docs


def test_stages_take_effect_in_order(spark, tables):
    sf, texts = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        seen[name] = {r.doc_id: r.asDict() for r in docs.collect()}
    assert list(seen) == ["quality", "exact_dedup", "near_dedup", "decontamination", "byte_bpe"]
    good = set(range(300)) | set(range(400, 405))
    assert good <= set(seen["quality"]) and len(set(seen["quality"]) - good) <= 5
    assert set(seen["quality"]) - set(seen["exact_dedup"]) >= {0, 1, 401}
    assert {400, 402} <= set(seen["exact_dedup"])
    assert set(seen["exact_dedup"]) - set(seen["near_dedup"]) >= {403}
    assert set(seen["near_dedup"]) - set(seen["decontamination"]) == {404}
    assert {2, *range(3, 300)} <= set(seen["decontamination"])
    assert set(seen["byte_bpe"]) == set(seen["decontamination"])
    for r in seen["byte_bpe"].values():
        assert r["text"] == texts[r["doc_id"]] and r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    for name in list(seen)[:-1]:
        assert all(list(r) == ["doc_id", "text", "lang", "source", "n_chars"] for r in seen[name].values())


def test_run_equals_the_stages_one_by_one(spark, tables):
    sf, _ = tables
    ids = sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect())
    assert len(ids) == len(set(ids)) > 290
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def test_stages_take_odd_rows_clashing_columns_and_empty_tables(spark, tables, odd, empty):
    sf, _ = tables
    clash = {c: F.lit(7) for c in ("score", "kept", "sha", "row", "hits", "fp", "carried", "a b`c")}
    names = [*odd.columns, *clash]
    for name, stage in corpus_pipeline.STAGES:
        table = odd.withColumns(clash)
        out = stage(spark, table, sf)
        assert out.columns[: len(names)] == names, name
        rows = out.collect()
        assert 0 < len(rows) <= odd.count()
        assert {r["a b`c"] for r in rows} == {7}
        assert stage(spark, empty.withColumns(clash), sf).count() == 0, name


def test_every_operator_has_its_query():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 11)}
