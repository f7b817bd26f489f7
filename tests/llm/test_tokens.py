import hashlib
import random

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterflow.llm.bpe import Coder, cut, encode_decode, roundtrip, stitch
from meterflow.llm.pretokens import doubtful
from meterflow.llm.token_counts import PieceCounter, count_tokens

PIECES = ["a", "b", " ", "  ", "\n", "\t", "'s", "'re", "'", "1", "23", "é", "\x85", "\x1c", "\x1f", " ", "　", "!", "$$", "<|endoftext|>", "<|endo", "the", " The", "中", "😀", "ß", "\x0b", "٣", "½", "​", "́", "ª", "²", "\U0001f9d1\u200d", "\u3002", "\uff0c", "\u2192", "\u0645\u0631", "\u0939\u093f", "\u0e44", "\ua7dd", "\U00031350", "\u0558", "\U00011de1", "\u180e"]
texts = st.lists(st.sampled_from(PIECES) | st.characters(codec="utf-8"), max_size=25).map("".join)


@pytest.fixture(scope="module")
def counter():
    return PieceCounter(P.path("byte_bpe_50k.json"), table_entries=50)


@pytest.fixture(scope="module")
def coder():
    return Coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, table_entries=50)


@given(st.lists(texts, max_size=4))
@settings(max_examples=300, deadline=None)
def test_counts_equal_the_library(counter, some):
    assert counter.counts(some) == [len(counter.tokenizer.encode(t, add_special_tokens=False).ids) for t in some]


@given(texts)
@settings(max_examples=300, deadline=None)
def test_encoding_equals_the_library_and_decodes_to_the_text(coder, text):
    ids = coder.encode_text(text)
    assert ids == coder.encoding.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


def test_stitched_chunks_have_the_boundaries_of_the_whole(coder):
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 100)))
        if rng.random() < 0.3:
            text += "x" * rng.randint(0, 60) + text
        chunk, overlap = rng.choice([(10, 3), (7, 7), (20, 8), (5, 1), (16, 30)])
        chunks = [(s, [s + e for e in coder.boundaries(p)]) for s, p in cut(text, chunk, overlap)]
        ends = stitch(text, chunks, coder, overlap)
        assert coder.encode([text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]) == coder.encoding.encode_ordinary(text)
        # A chunk may end before a doubtful character and so keep pre-tokens that the whole text has in one unit.
        assert ends == coder.boundaries(text) if not doubtful(text) else ends[-1] == len(text)


SCRIPTS = ["\u4eca\u5929\u5929\u6c14\u3002\u5f88\u597d\uff0c", "\u0645\u0631\u062d\u0628\u0627 \u0628\u0643\u0645 ", "\u0928\u092e\u0938\u094d\u0924\u0947 ", "\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35", "ok \U0001f600\U0001f9d1\u200d\U0001f4bb fine ", "a\ua7ddb new letters \U00031350\U00031351 ", "trade\u2122 \u2192 next\n"]


def test_sure_characters_are_of_one_kind_in_both_engines(coder):
    """Every character but the doubtful ones, by what the library's engine takes for letters, numbers and white space."""
    import regex
    import tiktoken

    from meterflow.llm.pretokens import SPACE

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    marks = doubtful(every)
    single = {bytes([i]): i for i in range(256)}
    for theirs, ours in ((r"\p{L}", r"\p{L}"), (r"\p{N}", r"\p{N}"), (r"\s", f"[{SPACE}]")):
        found = bytes(tiktoken.Encoding("x", pat_str=theirs, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
        assert set(found) ^ set(regex.findall(ours, every)) <= marks
    assert len(marks) < 80_000 and not marks & set("az09 \u4e2d\u0645\U0001f600\u3002")


@pytest.mark.parametrize("script", SCRIPTS)
def test_every_script_goes_through_pieces_and_chunks(docs, coder, counter, script):
    """Short and long texts: the pieces are small, the chunks meet, the results are the library's."""
    text = (script + "and so on. ") * 400
    pieces = coder.pieces(text)
    assert "".join(pieces) == text and len(pieces) > 1000 and max(map(len, pieces)) < 40
    assert bool(doubtful(text)) == ("new letters" in script)
    assert counter.counts([text, script]) == [len(counter.tokenizer.encode(t, add_special_tokens=False).ids) for t in (text, script)]
    ids = coder.encoding.encode_ordinary(text)
    calls = []
    held, coder.encoding = coder.encoding, type("Counted", (), {"encode_ordinary": lambda self, t: calls.append(t) or held.encode_ordinary(t)})()
    try:
        chunks = [(s, [s + e for e in coder.boundaries(p)]) for s, p in cut(text, 500, 100)]
        ends = stitch(text, chunks, coder, 100)
        assert set(ends) >= set(coder.boundaries(text))
        assert coder.encode([text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]) == ids
    finally:
        coder.encoding = held
    assert all(len(t) < 40 for t in calls)  # never a whole text
    row = encode_decode(docs([text]), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, chunk=500, overlap=100).first()
    assert (row.n_tokens, row.decoded_sha256) == (len(ids), hashlib.sha256(text.encode()).hexdigest())


def test_count_query_on_odd_rows(odd, empty, counter):
    rows = count_tokens(odd, P.path("byte_bpe_50k.json")).collect()
    assert len(rows) == odd.count()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(counter.tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)
    assert count_tokens(empty, P.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("chunk", [1 << 15, 64])
def test_codes_on_odd_rows_short_and_in_chunks(odd, empty, coder, chunk):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = encode_decode(odd, path, P.PATTERN, chunk=chunk, overlap=16).collect()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for r in odd.collect():
        ids = coder.encoding.encode_ordinary(r.text or "")
        want.append((str(r.doc_id), len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)
    assert encode_decode(empty, path, P.PATTERN).count() == 0


def test_roundtrip_keeps_columns_and_texts(docs):
    table = docs(["hello  world", None, "z" * 40_000]).withColumn("ends", F.lit(3))
    rows = roundtrip(table, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["hello  world", "", "z" * 40_000]
    assert [r.ends for r in rows] == [3] * 3
    assert rows[0].asDict().keys() == dict.fromkeys([*table.columns, "n_tokens", "ids_sha256", "decoded_sha256"]).keys()
