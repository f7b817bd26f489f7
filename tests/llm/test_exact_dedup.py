import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterflow.llm.exact_dedup import QuotientFilter, drop_exact_copies, exact_groups

fingerprints = st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 5).map(lambda x: x << 44), max_size=60)


@given(st.lists(fingerprints, max_size=5), st.sampled_from([10, 13]))
@settings(max_examples=60, deadline=None)
def test_filters_merge_losslessly_through_their_slices(parts, bits):
    sliced = defaultdict(list)
    for p in parts:
        for number, coded in QuotientFilter.of(np.array(p, np.uint64), bits).slices():
            sliced[number].append(QuotientFilter.from_slice(number, coded))
    got = Counter()
    for filters in sliced.values():
        whole = QuotientFilter.merged(filters)
        assert (np.diff(whole.fingerprints.astype(object)) > 0).all()
        got.update(dict(zip(whole.fingerprints.tolist(), whole.counts.tolist(), strict=True)))
    assert got == Counter(x for p in parts for x in p)


def brute(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in by[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(by[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("weak", [False, True])
def test_groups_equal_brute_force_even_when_fingerprints_collide(odd, weak):
    print_of = (lambda t: F.length(t).cast("long") % 3) if weak else F.xxhash64
    got = Counter(tuple(r) for r in exact_groups(odd, fingerprint=print_of).collect())
    assert got == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_normalisation_joins_what_it_makes_equal(docs):
    got = {r.doc_id: r.keep_id for r in exact_groups(docs(["A b", "a B", "ab"]), normalise=F.lower).collect()}
    assert got == {0: 1, 1: 1, 2: 2}


def test_hot_group_and_empty_table(docs, empty):
    rows = exact_groups(docs(["copy"] * 3000 + ["x", "y"])).collect()
    assert {r.keep_id for r in rows if r.group_size == 3000} == {2999}
    assert sum(r.kept for r in rows) == 3
    assert exact_groups(empty).count() == 0
    assert drop_exact_copies(empty).count() == 0


def test_stage_keeps_one_row_and_all_columns_of_each_text(docs, spark):
    table = docs(["a", "a", "b", None, ""], [5, 7, 1, 2, 3]).withColumn("kept", F.lit("mine")).withColumn("fp", F.lit(1))
    rows = drop_exact_copies(table).collect()
    assert sorted(r.doc_id for r in rows) == [1, 3, 7]
    assert rows[0].asDict().keys() == dict.fromkeys(table.columns).keys()
    assert {r.kept for r in rows} == {"mine"}


def test_stage_leaves_one_of_rows_repeated_with_one_id(docs):
    assert [r.doc_id for r in drop_exact_copies(docs(["a", "a"], [4, 4])).collect()] == [4]


def test_stage_drops_rows_by_id_and_text(docs, odd):
    """A null id or a repeated one does not go with another text of that id."""
    table = docs(["copy", "copy", "alone", "other", "twin", "twin", "own"], [9, None, None, None, 1, 2, 1])
    assert sorted((r.doc_id or -1, r.text) for r in drop_exact_copies(table).collect()) == [(-1, "alone"), (-1, "other"), (1, "own"), (2, "twin"), (9, "copy")]
    assert [r.doc_id for r in drop_exact_copies(odd).where("text = 'no id'").collect()] == [None]


def test_rows_repeated_with_the_id_that_stays_are_all_marked_and_one_is_left(docs):
    table = docs(["a", "a", "a", "z", "z"], [4, 4, 1, None, None])
    got = Counter((r.doc_id, r.keep_id, r.kept) for r in exact_groups(table).collect())
    assert got == Counter({(4, 4, True): 2, (1, 4, False): 1, (None, None, True): 2})
    assert Counter((r.doc_id, r.text) for r in drop_exact_copies(table).collect()) == Counter([(4, "a"), (None, "z")])


def test_written_tables_go_to_the_shared_folder_and_can_be_dropped(spark, docs, tmp_path):
    from pathlib import Path

    from meterflow.llm.common import discard, shared_dir, written

    table = written(docs(["a"]), "x")
    place = Path(table.written_at.removeprefix("file://"))
    assert table.written_at.startswith(shared_dir(spark)) and place.exists() and table.count() == 1
    discard(docs(["b"]))
    discard(table)
    assert not place.exists()
