import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from meterflow.llm import common, simhash
from meterflow.llm.components import components, roots_of
from meterflow.llm.near_copies import drop_near_copies, groups, shingle_set, similar_pairs


def brute_print(text, k=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def partition(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    out = defaultdict(set)
    for n in nodes:
        out[find(n)].add(n)
    return out


def test_fingerprints_equal_brute_force(odd):
    for r in odd.collect():
        assert simhash.fingerprint(simhash.shingle_hashes(r.text or "", 3)) == brute_print(r.text), repr(r.text)[:50]


def test_long_texts_in_pieces(monkeypatch):
    text = "Ab c dé  f\ng " * 40
    whole = np.concatenate(list(simhash.shingle_hashes(text, 3)))
    monkeypatch.setattr(common, "LAZY_BYTES", 10)
    monkeypatch.setattr(common, "WORD_LIST", 5)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert (np.concatenate(list(simhash.shingle_hashes(text, 3))) == whole).all()


@pytest.fixture(scope="module")
def prints():
    rng, out = random.Random(4), set()
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 5, 150])):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64 if rng.random() < 0.5 else 16)
            out.add(x)
    return list(out)


@pytest.mark.parametrize("one_task", [200_000, 0])
def test_links_connect_exactly_what_lies_within_two_bits(spark, prints, one_task):
    a = np.array(prints, np.uint64)
    pairs = [(prints[i], prints[j]) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 2)]
    want = {frozenset(v) for v in partition(prints, pairs).values() if len(v) > 1}
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in prints], "fp long")
    got = defaultdict(set)
    for r in components(simhash.links(df, 2), one_task).collect():
        got[r.root].add(r.node & (2**64 - 1))
    assert {frozenset(v) for v in got.values()} == want


def test_large_postings_look_up_neighbours():
    rng = np.random.default_rng(2)
    run = np.unique(rng.integers(0, 1 << 16, 300).astype(np.uint64) << np.uint64(16))
    a, b = simhash.close_links(run, ~0xFFFF0000 & (2**64 - 1), 2)
    pairs = [(x, y) for x in run for y in run if x < y and bin(int(x) ^ int(y)).count("1") <= 2]
    assert {frozenset(v) for v in partition(run.tolist(), pairs).values()} == {frozenset(v) for v in partition(run.tolist(), zip(a.tolist(), b.tolist(), strict=True)).values()}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(500, 500), (7, -3), (600, 601), (601, 600)] + [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)]
    want = {n: min(c) for c in partition({x for p in links for x in p}, links).values() for n in c}
    for one in (200_000, 0):
        got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), one).collect()}
        assert got == want
    nodes, roots = roots_of(np.array([5, 3]), np.array([3, 9]))
    assert nodes.tolist() == [3, 5, 9] and roots.tolist() == [3, 3, 3]


def test_query_equals_brute_force(odd, empty, docs):
    base = " ".join(f"w{i}" for i in range(400))
    near = [base, base.replace("w7 ", "v7 "), base.upper(), "other words entirely", base + " tail"]
    table = odd.unionByName(docs(near, range(200, 205)))
    rows = table.collect()
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.components_of(table).collect())
    prints = [brute_print(r.text) for r in rows]
    pairs = [(a, b) for a in set(prints) for b in set(prints) if bin(a ^ b).count("1") <= 2]
    label = {}
    for c in partition(set(prints), pairs).values():
        ids = [r.doc_id for r, p in zip(rows, prints, strict=True) if p in c and r.doc_id is not None]
        label |= dict.fromkeys(c, min(ids) if ids else None)
    assert got == sorted((str(r.doc_id), f"{p:016x}", str(label[p])) for r, p in zip(rows, prints, strict=True))
    assert simhash.components_of(empty).count() == 0


# Near copies by similarity


def near_brute(rows):
    sets = [set(shingle_set(t or "").tolist()) for _, t in rows]
    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            union = len(sets[i] | sets[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or union == 0 or both >= 0.8 * union:
                pairs.append((i, j))
    out = partition(range(len(rows)), pairs)
    return [min(c, key=lambda k: (rows[k][0] is None, rows[k][0] if rows[k][0] is not None else 0, k)) for c in out.values()]


def copies(rng, vocabulary, n, words, rate):
    base = [rng.choice(vocabulary) for _ in range(words)]
    out = []
    for _ in range(n):
        w = [rng.choice(vocabulary) if rng.random() < rate else x for x in base]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("blocks", [False, True])
def test_one_text_of_each_group_stays(docs, monkeypatch, blocks):
    from meterflow.llm import near_copies

    if blocks:  # several blocks per posting and cluster
        monkeypatch.setattr(near_copies, "POSTING", 7)
        monkeypatch.setattr(near_copies, "CLUSTER", 6)
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(4000)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = [t for _ in range(8) for t in copies(rng, vocabulary, rng.randint(2, 14), rng.randint(30, 300), rng.choice([0.002, 0.01, 0.02, 0.05]))]
    texts += [f"{' '.join(rng.choice(vocabulary) for _ in range(80))} {shared}" for _ in range(25)]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (1, 2, 4, 5, 6, 40)] + ["a b", "A  b", "", " ", texts[0]]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    kept = sorted(r.doc_id for r in drop_near_copies(docs(texts)).collect())
    assert kept == sorted(near_brute(rows))


def test_odd_rows_stay_once(odd, empty, docs):
    table = odd.withColumn("row", F.lit(9)).withColumn("sha", F.lit("x")).withColumn("segments", F.lit(0))
    kept = drop_near_copies(table).collect()
    assert kept[0].asDict().keys() == dict.fromkeys(table.columns).keys()
    want = near_brute([(r.doc_id, r.text) for r in odd.collect()])
    assert len(kept) == len(want)
    assert drop_near_copies(empty).count() == 0
    assert groups(docs(["one text", "two texts"])).count() == 0


def test_pairs_by_counting_equal_brute_force():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 30, rng.integers(0, 25)).astype(np.uint64)) for _ in range(60)]
    for some in (sets, sets[:2], [sets[0][:0], sets[0][:0]]):
        i, j = similar_pairs(some, 0.5)
        want = {(a, b) for a in range(len(some)) for b in range(a + 1, len(some)) if len(set(some[a]) & set(some[b])) >= 0.5 * len(set(some[a]) | set(some[b]))}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_short_edited_pairs_are_all_found(docs):
    """Pairs of 8 to 100 words with a word or two changed: those within 0.8 by brute force, and no others."""
    rng, texts, want = random.Random(3), [], set()
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    for number in range(600):
        size = rng.choice([8, 10, 13, 20, 40, 84, 100])
        first = [word() for _ in range(size)]
        other = [word(), *first] if number % 3 == 0 else [*first[:-1], word()] if number % 3 == 1 else [*first, word()]
        if size >= 84:
            other[rng.randrange(size)] = word()
        a, b = " ".join(first), " ".join(other)
        runs = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (first, other)]
        if len(runs[0] & runs[1]) >= 0.8 * len(runs[0] | runs[1]):
            want.add(len(texts) + 1)
        texts += [a, b]
    kept = {r.doc_id for r in drop_near_copies(docs(texts)).collect()}
    assert len(want) > 200 and set(range(len(texts))) - kept == want


def test_what_everyone_has_is_no_reason_to_meet(docs, monkeypatch):
    """A passage in all texts: its shingles leave the prefixes, so what is dealt grows with the texts, and no pair is lost."""
    from pyspark.sql import functions as F

    from meterflow.llm import near_copies

    monkeypatch.setattr(near_copies, "POSTING", 20)
    dealt, links = [], near_copies.candidate_links

    def counted(rows, *more):
        postings = rows.select("row", F.explode("segments").alias("segment"))
        dealt.append((postings.count(), postings.groupBy("segment").count().agg(F.max("count")).first()[0]))
        return links(rows, *more)

    monkeypatch.setattr(near_copies, "candidate_links", counted)
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(5000)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(50))
    text = lambda: f"{' '.join(rng.choice(vocabulary) for _ in range(rng.randint(40, 120)))} {shared}"
    texts = [text() for _ in range(200)]
    texts += [t.replace(" ", " extra ", 1) for t in texts[:15]] + [shared] * 3 + [shared + " a", shared + " b", "c " + shared]
    for n in (100, len(texts)):
        some = texts[-n:]
        kept = sorted(r.doc_id for r in drop_near_copies(docs(some)).collect())
        assert kept == sorted(near_brute(list(enumerate(some)))) and len(kept) < n
    assert all(most <= 20 for _, most in dealt)
    assert dealt[1][0] < 2.6 * dealt[0][0]


def test_near_copies_meet_by_the_tally_of_positional_bytes():
    """Postings are values of two positional bytes of the SimHash; pairs just at the threshold share some, texts with one passage in common hardly any."""
    from meterflow.llm import near_copies

    rng = np.random.default_rng(6)
    salts = near_copies._mixed(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for n in (1, 3, 41, 299, 701):
        some = np.sort(rng.integers(0, 1 << 64, n, np.uint64))
        bits = [[int(h) >> b & 1 for s in salts for h in [near_copies._mixed(x ^ s[None])[0]] for b in range(64)] for x in some]
        want = np.packbits(2 * np.sum(bits, 0) > n, bitorder="little")
        assert (near_copies.positional_bytes(some, 64) == want).all()
    word = lambda: f"w{rng.integers(1 << 40)}"
    for n in (8, 13, 19, 24, 100, 400):
        for _ in range(40):
            first = [word() for _ in range(n)]
            other = [*first, *(word() for _ in range(max(1, (n - 4) // 4)))]  # four of five shingles
            passage = [*first[: n // 2], *(word() for _ in range(n - n // 2))]
            (size, carried, a), (_, _, b), (_, _, c) = (near_copies.features(" ".join(x)) for x in (first, other, passage))
            held = near_copies.positional_bytes(shingle_set(" ".join(first)), 2 * len(a))
            assert len(a) == near_copies.choices(0.8, size < near_copies.SHORT)
            assert [(int(p) >> 16, int(p) & 255, int(p) >> 8 & 255) for p in a] == [(k, held[2 * k], held[2 * k + 1]) for k in range(len(a))]
            assert carried.tobytes() == held[:24].tobytes()
            assert len(set(a.tolist()) & set(b.tolist())) > 0
            assert len(set(a.tolist()) & set(c.tolist())) <= 8


def crowd(rng, near, spread):
    """(sizes, prints) of texts in two rough groups, chains, and unrelated ones."""
    centres = rng.integers(0, 1 << 64, (3, 2), np.uint64)
    flips = lambda n, share: np.packbits(rng.random((3, n, 64)) < share, axis=2).view(np.uint64)[..., 0]
    some = centres[:, rng.integers(0, 2, near)] ^ flips(near, spread)
    return rng.choice([40, 44, 300], near + 20), np.concatenate([some, rng.integers(0, 1 << 64, (3, 20), np.uint64)], axis=1)


def test_a_posting_adds_fewer_links_than_members(spark, monkeypatch):
    """Near copies in one posting, of one block or many: links grow with the members, not with their pairs, and connect them all."""
    from meterflow.llm import near_copies

    def links(n):
        rows = spark.createDataFrame([(i, 50, 7, 7, i % 8, [5]) for i in range(n)], "row long, size long, print0 long, print1 long, print2 long, segments array<int>")
        found = near_copies.candidate_links(rows).collect()
        nodes, roots = roots_of(np.array([r.a for r in found]), np.array([r.b for r in found]))
        assert nodes.tolist() == list(range(n)) and not roots.any()
        return len(found)

    assert [links(n) for n in (2, 100, 200)] == [1, 99, 199]
    monkeypatch.setattr(near_copies, "POSTING", 50)
    monkeypatch.setattr(near_copies, "SMALL_POSTING", 16)
    assert links(400) <= 399 + 8 * 7 / 2  # and one for each two blocks


def test_blocks_connect_what_their_pairs_connect():
    """_near and _cross over three blocks against all pairs, with members that the first of a block does not reach."""
    from meterflow.llm import near_copies

    radius, parts = near_copies.radius_of(0.8, False), lambda pairs: sorted(map(sorted, partition(range(m), pairs).values()))
    fit = lambda a, b, bits: (np.minimum(a, b) >= 0.8 * np.maximum(a, b)) & (bits <= radius)
    for seed in range(40):
        rng = np.random.default_rng(seed)
        sizes, prints = crowd(rng, 100, (0.05, 0.12, 0.17, 0.21)[seed % 4])
        m, block = len(sizes), rng.integers(0, 3, len(sizes))
        bits = np.bitwise_count(prints[:, :, None] ^ prints[:, None]).sum(0)
        i, j = np.nonzero(np.triu(fit(sizes[:, None], sizes[None], bits), 1))
        want = parts(zip(i.tolist(), j.tolist(), strict=True))
        assert 22 <= len(want) < m
        by_near, by_cross = [], []
        for x, y in [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]:
            some = np.flatnonzero((block == x) | (block == y))
            a, b = near_copies._near(sizes[some], prints[:, some], block[some], fit, x != y)
            assert len(a) < len(some)
            by_near += zip(some[a].tolist(), some[b].tolist(), strict=True)
            a, b = np.nonzero(np.triu(fit(sizes[some, None], sizes[None, some], bits[np.ix_(some, some)]), 1))
            a, b = near_copies._thinned(*near_copies._cross(block[some], x, y, a, b))
            by_cross += zip(some[a].tolist(), some[b].tolist(), strict=True)
        assert parts(by_near) == want == parts(by_cross)
    lone = near_copies._near(sizes, prints, np.zeros(m), fit, True)
    assert not len(lone[0])  # the other block has no member
