import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table from texts; ids from 0 unless given."""

    def make(texts, ids=None, schema=DOCS):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in zip(ids, texts, strict=True)], schema)

    return make


#: Texts that no operator may stumble over.
ODD = [None, "", " ", "\n\t", "a", "É́ 中文 😀 ​", "x" * 70_000, "word " * 30_000, "\x1c\x85 z", "<|endoftext|>", "ẞ İ ﬁ", "0", "-", "a\x00b"]


@pytest.fixture
def odd(docs):
    """Odd texts, repeated rows, equal texts under several ids, a null id."""
    texts = [*ODD, "same text", "same text", "same text", "once", "once"]
    ids = [*range(len(ODD)), 100, 101, 102, 103, 103]
    return docs([*texts, "no id", None], [*ids, None, None])


@pytest.fixture
def empty(docs):
    return docs([])
