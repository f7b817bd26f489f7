"""The whole tree: every context up to ctw.DEPTH bytes, however rare, on all training text."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from meterflow.llm import ctw


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)


def spelled_out(training, texts):
    """log10 of each text, by the tree's definition, context by context."""
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)

    def steps(text):
        data = bytes(ctw.DEPTH) + text.lower()
        for i in range(ctw.DEPTH, len(data)):
            for n in range(8):
                node = n, data[i] >> (8 - n)
                path = [(node, data[i - d : i]) for d in range(ctw.DEPTH + 1)]
                yield path, data[i] >> (7 - n) & 1

    for t in training:
        for path, bit in steps(t):
            for up, down in zip(path, path[1:], strict=False):
                children[up].add(down)
            for at in path:
                counts[at][bit] += 1
    memo = {}

    def weighted(at):
        if at not in memo:
            own = kt(*counts.get(at, (0, 0)))
            memo[at] = own if len(at[1]) == ctw.DEPTH else np.logaddexp(own, sum(map(weighted, children.get(at, ())))) - math.log(2)
        return memo[at]

    out = []
    for t in texts:
        total = 0.0
        for path, bit in steps(t):
            p = None
            for at in reversed(path):
                a, b = counts.get(at, (0, 0))
                one = (b + 0.5) / (a + b + 1)
                w = 1.0 if p is None else math.exp(kt(a, b) - math.log(2) - weighted(at))
                p = one if p is None else w * one + (1 - w) * p
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


@pytest.mark.parametrize("chunk", [1, 8 << 20])
def test_scores_equal_the_whole_tree(docs, chunk, monkeypatch):
    monkeypatch.setattr(ctw, "CHUNK", chunk)
    texts = ["the cat sat on the mat", "The dog ate the cat", "", None, "über den wolken", "aaaaaaaab", "a rare context once", "\0\0a", "zzz"] * 2
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    assert any(held)
    data = [(t or "").encode() for t in texts]
    want = spelled_out([d for d, h in zip(data, held, strict=True) if not h], data)
    got = {r.doc_id: r.score for r in ctw.score(docs(texts)).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(texts))], want, rtol=1e-5, atol=1e-5)


def test_blocks_and_slices_change_nothing(monkeypatch):
    texts = [b"ab ba " * 20, b"", b"\xff\0", b"x"]
    whole = np.sort(np.concatenate([c[own] for c, own in ctw._deep_codes(texts)]))
    monkeypatch.setattr(ctw, "BLOCK", 7)
    assert (np.sort(np.concatenate([c[own] for c, own in ctw._deep_codes(texts)])) == whole).all() and len(whole) == sum(map(len, texts))
    distinct = np.unique(whole)
    parts = [distinct[at] for _, at in ctw._sliced(distinct, 5)]
    assert (np.sort(np.concatenate([ctw._unpacked(ctw._packed(p)) for p in parts])) == distinct).all()
    np.testing.assert_allclose(ctw.text_logs(texts, distinct, np.ones(len(distinct))), [len(t) for t in texts])
