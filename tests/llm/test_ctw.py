import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from meterflow.llm import ctw


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)


class Tree:
    """Context-tree weighting spelled out: one tree of byte contexts for each prefix of a byte's bits."""

    def __init__(self, texts, kept):
        self.counts = defaultdict(lambda: [0, 0])
        self.kept = kept
        for t in texts:
            data = b"\0\0\0" + t
            for i in range(3, len(data)):
                for prefix, bit in self.bits(data[i]):
                    for context in self.path(data[i - 3 : i]):
                        self.counts[prefix, context][bit] += 1
        self.memo = {}

    @staticmethod
    def bits(byte):
        return [((n, byte >> (8 - n)), byte >> (7 - n) & 1) for n in range(8)]

    def path(self, last3):
        """Contexts from the root on; a context of three bytes that is not kept is its parent's rest."""
        a, b, c = last3
        deep = (c, b, a) if (a, b, c) in self.kept else (c, b, "rest")
        return [(), (c,), (c, b), deep]

    def weighted(self, prefix, context):
        key = prefix, context
        if key not in self.memo:
            own = kt(*self.counts.get(key, (0, 0)))
            if len(context) == 3:
                self.memo[key] = own
            else:
                children = sum(self.weighted(prefix, c) for c in self.children(context))
                self.memo[key] = np.logaddexp(own, children) - math.log(2)
        return self.memo[key]

    def children(self, context):
        if len(context) < 2:
            return [(*context, x) for x in range(256)] if not hasattr(self, "used") else [c for c in self.used if len(c) == len(context) + 1 and c[: len(context)] == context]
        return [c for c in self.used if len(c) == 3 and c[:2] == context]

    def log10(self, text):
        self.used = {c for _, c in self.counts}
        data, total = b"\0\0\0" + text, 0.0
        for i in range(3, len(data)):
            for prefix, bit in self.bits(data[i]):
                p = None
                for context in reversed(self.path(data[i - 3 : i])):
                    a, b = self.counts.get((prefix, context), (0, 0))
                    one = (b + 0.5) / (a + b + 1)
                    if len(context) == 3:
                        p = one
                    else:
                        w = math.exp(kt(a, b) - math.log(2) - self.weighted(prefix, context))
                        p = w * one + (1 - w) * p
                total += math.log10(p if bit else 1 - p)
        return total


def model_of(texts, share):
    grams = Counter()
    for block in ctw.grams_of(texts):
        grams.update(block.tolist())
    contexts = Counter()
    for g, n in grams.items():
        contexts[g >> 8] += n
    total = sum(grams.values())
    kept = {c for c, n in contexts.items() if n >= max(1, share * total)}
    two = Counter()
    for g, n in grams.items():
        two[g & 0xFFFFFF] += n
    pair = lambda c: (np.array(sorted(c), np.int64), np.array([c[k] for k in sorted(c)], np.int64))
    model = ctw.Model.of(pair(two), pair({g: n for g, n in grams.items() if g >> 8 in kept}))
    return model, {(c >> 16, c >> 8 & 255, c & 255) for c in kept}


@pytest.mark.parametrize("share", [0.0, 0.02])
def test_scores_equal_the_tree_spelled_out(share):
    corpus = [b"the cat sat on the mat", b"the dog ate the cat", "über den wolken".encode(), b"aaaaaaaaab"]
    model, kept = model_of(corpus, share)
    tree, scorer = Tree(corpus, kept), ctw.Scorer(model)
    for text in [b"the cat", b"", b"zzz \xff\x00", b"aaab the", "über".encode()]:
        assert scorer.log10(text) == pytest.approx(tree.log10(text), rel=1e-5, abs=1e-5)


def test_every_context_is_a_distribution():
    model, _ = model_of([b"some text to learn from, some more text", b"abcabcabc"], 0.0)
    np.testing.assert_allclose((10.0 ** model.table.astype(np.float64)).sum(1), 1, rtol=1e-4)


def test_blocks_do_not_change_long_texts(monkeypatch):
    model, _ = model_of([b"ababab abab"], 0.0)
    scorer, text = ctw.Scorer(model), b"ab ba " * 50
    whole = scorer.log10(text)
    codes = np.sort(np.concatenate(list(ctw.grams_of([text]))))
    monkeypatch.setattr(ctw, "BLOCK", 7)
    assert scorer.log10(text) == pytest.approx(whole)
    assert (np.sort(np.concatenate(list(ctw.grams_of([text])))) == codes).all()


def brute(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = [[*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), "\n"] for _, t in rows]
    c = Counter(w for (i, _), ws in zip(rows, words, strict=True) if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for (i, _), ws in zip(rows, words, strict=True)]


@pytest.mark.parametrize("heavy", [3, 200_000])
def test_base_scores_equal_brute_force(odd, heavy):
    rows = ctw.score(odd, heavy_words=heavy).collect()
    want = sorted(brute([(r.doc_id, r.text) for r in odd.collect()]))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert all(r.score <= 0 for r in rows) and all(r.score == 0 for r in rows if r.n_tokens == 1 and r.bits_per_byte is None)


def test_model_beats_a_uniform_one_on_held_out_text(docs):
    texts = ["the quick brown fox jumps over the lazy dog near the river bank"] * 60
    rows = [r for r in ctw.score(docs(texts)).collect() if r.held_out]
    assert rows and all(r.bits_per_byte < 1 for r in rows)


def test_empty_table_and_no_training_rows(docs, empty):
    assert ctw.score(empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = ctw.score(docs(["ab"], [held])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (2, 0, 0, 0.0)
    assert r.score == pytest.approx(16 * math.log10(0.5))
