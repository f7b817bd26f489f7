import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meterflow.llm.decontaminate import Index, MultiIndex, contaminated, drop_contaminated, words_of


@pytest.fixture(scope="module")
def items():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    return [sentence(rng.randint(14, 59)) for _ in range(60)] + [sentence(3), sentence(1), sentence(5)], sentence


def brute(text, item):
    w, d = words_of(item), words_of(text)
    k = min(5, len(w))
    n = len(w) - k + 1
    own = Counter(tuple(w[j : j + k]) for j in range(n))
    best = 0.0
    for s in range(len(d) - len(w) + 1):
        both = sum((Counter(tuple(d[s + j : s + j + k]) for j in range(n)) & own).values())
        best = max(best, both / (2 * n - both))
    return best


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        p = rng.randrange(len(words))
        what = rng.random()
        if what < 0.5:
            words[p] = "other"
        elif what < 0.75:
            words.insert(p, "more")
        elif len(words) > 1:
            del words[p]
    return words


def test_all_windows_at_the_threshold_are_found_and_no_others(items):
    texts, sentence = items
    rng, index = random.Random(6), Index(texts)
    near = 0
    for _ in range(500):
        i = rng.randrange(len(texts))
        body = edited(rng, texts[i].split(), rng.choice([0, 0, 1, 1, 2, 3]))
        text = f"{sentence(40)} {' '.join(body)} {sentence(30)}"
        best = brute(text, texts[i])
        got = {m[0]: m[3] for m in index.matches(text)}
        near += best >= 0.8
        assert (i in got) == (best >= 0.8)
        assert i not in got or got[i] == pytest.approx(best)
    assert near > 150


def test_case_punctuation_and_layout_do_not_matter(items):
    texts, _ = items
    shouted = "Intro. " + texts[0].upper().replace(" ", ",\n ") + "!"
    assert [m[:3] for m in Index(texts).matches(shouted) if m[0] == 0] == [(0, 1, 1 + len(texts[0].split()))]


def test_multi_index_misses_nothing_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 500, dtype=np.uint64)
    index = MultiIndex(prints, 23)
    for p in prints[:20]:
        flips = rng.choice(64, 23, replace=False)
        q = np.uint64(int(p) ^ sum(1 << int(b) for b in flips))
        want = np.flatnonzero(np.bitwise_count(prints ^ q) <= 23)
        assert set(want) == set(index.near(q))


def test_query_in_one_block_and_in_many(spark, docs, items):
    texts, sentence = items
    bench = spark.createDataFrame([*enumerate(texts), (900, None), (901, ""), (902, texts[3])], "item_id long, text string")
    rng = random.Random(8)
    table = docs([f"{sentence(rng.randint(0, 50))} {texts[i % 60]} {sentence(9)}" if i % 4 == 0 else sentence(60) for i in range(80)] + [None, ""])
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    one = rows(contaminated(table, bench))
    many = contaminated(table, bench, block_bytes=2000)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert one == rows(many) and "MapInArrow" not in plan  # written, one block after the other
    kept = rows(drop_contaminated(table, bench))
    assert 0 < len(kept) < table.count() and kept == rows(drop_contaminated(table, bench, block_bytes=2000))
    assert {i for i, *_ in one} >= set(range(0, 80, 4))
    assert {902} <= {x[1] for x in one if x[1] in (3, 902)} or not any(x[1] == 3 for x in one)
    assert rows(contaminated(docs([]), bench)) == []
    assert rows(contaminated(table, bench.limit(0))) == []


def test_odd_rows_and_stage(spark, odd, docs, items):
    texts, _ = items
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    assert contaminated(odd, bench).count() == 0
    table = docs(["clean words here", texts[0], None, texts[0]], [1, 2, 3, 2]).withColumn("hits", F.lit(5)).withColumn("item_id", F.lit(6))
    kept = drop_contaminated(table, bench).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3]
    assert kept[0].asDict().keys() == dict.fromkeys(table.columns).keys()
    assert {r.text for r in kept} == {"clean words here", None}


def brute_short(text, item):
    """brute, with a document of fewer shingles than the item as one window."""
    w, d = words_of(item), words_of(text)
    k = min(5, len(w))
    if not k <= len(d) < len(w):
        return brute(text, item)
    runs = lambda x: Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
    own, window = runs(w), runs(d)
    both = sum((own & window).values())
    return both / (sum(own.values()) + sum(window.values()) - both)


def test_documents_shorter_than_the_item_are_one_window(items):
    texts, _ = items
    rng, index = random.Random(8), Index(texts)
    near = 0
    for i, item in enumerate(texts):
        words = item.split()
        for cut in range(min(len(words), 14)):
            at = rng.randint(0, cut)
            text = " ".join(edited(rng, words[at : len(words) - cut + at], rng.choice([0, 0, 1])))
            best = brute_short(text, item)
            got = {m[0]: m[1:] for m in index.matches(text)}
            near += best >= 0.8 and len(text.split()) < len(words)
            assert (i in got) == (best >= 0.8)
            assert i not in got or got[i][2] == pytest.approx(best) and got[i][1] <= len(words_of(text))
    assert near > 100


def test_recall_by_words_changed():
    """What five words and 0.8 find, by the item's words and the words changed in it: all that reaches 0.8, nothing else."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    shares = {}
    for size in (20, 40, 60, 100):
        texts = [" ".join(word() for _ in range(size)) for _ in range(40)]
        index = Index(texts)
        for edits in (0, 1, 2):
            found = reach = 0
            for i, item in enumerate(texts):
                words = item.split()
                for p in rng.sample(range(size), edits):
                    words[p] = "changed"
                text = f"{word()} {word()} {' '.join(words)} {word()}"
                reach += brute(text, item) >= 0.8
                found += any(m[0] == i for m in index.matches(text))
            assert found == reach
            shares[size, edits] = found / len(texts)
    print(shares)
    assert all(shares[size, 0] == 1 for size in (20, 40, 60, 100))
    assert shares[60, 1] == shares[100, 1] == shares[100, 2] == 1
    assert shares[20, 1] < 0.5 and shares[40, 2] < 0.2
