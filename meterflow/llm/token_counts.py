"""Token counts of texts without token ids.

Per record batch: texts are cut into pre-tokens, each distinct pre-token is given to the tokenizer
once for its number of pieces, and that table is joined by pre-token to the documents' frequencies;
the sum of frequency times pieces is the count. A task keeps the table of pre-tokens it has met, up
to a bound of entries after which it starts anew (a matter of speed, not of results). Nothing is
shuffled: a distributed join would move a row for each distinct pre-token of each document, more
bytes than the texts themselves.

Where the library's pattern engine and ours may differ on a character (pretokens.py), the stretch
between two sure cuts around it is one unit, whose pieces the library counts; the rest of the text
keeps its pre-tokens.

The special string of the vocabulary counts as one token wherever it stands, as the library's
default has it, and cuts the text on both sides.

Null texts count as empty (0 tokens, 0 bytes); repeated rows each get their own count; an empty
table gives an empty table. Only the id and the text are read.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_of
from .pretokens import Splitter

#: The pre-token pattern of the vocabulary (a fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TABLE_ENTRIES = 1_000_000
#: Longer pieces are counted for their text alone.
TABLE_CHARS = 64
#: Texts above so many characters are cut lazily instead of into one list.
LAZY_CHARS = 1 << 20


class PieceCounter:
    """Counts tokens of texts by one tokenizer file of the `tokenizers` library."""

    def __init__(self, path: str, table_entries: int = TABLE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.splitter = Splitter(PRE_TOKEN)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table: dict[str, int] = {}
        self.table_entries = table_entries

    def frequencies(self, text: str) -> Counter:
        if len(text) > LAZY_CHARS:
            return Counter(self.splitter.each(text))
        return Counter(self.splitter.pieces(text))

    def learn(self, pre_tokens: list[str]) -> dict[str, int]:
        """The pieces of each new pre-token, counted once; the table takes all but long ones."""
        found: dict[str, int] = {}
        for at in range(0, len(pre_tokens), 4096):
            part = pre_tokens[at : at + 4096]
            found.update(zip(part, (len(e.ids) for e in self.tokenizer.encode_batch(part, add_special_tokens=False)), strict=True))
        self.table.update((t, n) for t, n in found.items() if len(t) <= TABLE_CHARS)
        return found

    def counts(self, texts: list[str]) -> list[int]:
        special, per_text = [], []
        for text in texts:
            parts = [text]
            for mark in self.special:
                if mark in text:
                    parts = [p for part in parts for p in part.split(mark)]
            special.append(len(parts) - 1)
            own = self.frequencies(parts[0])
            for part in parts[1:]:
                own.update(self.frequencies(part))
            per_text.append(own)
        new = set().union(*per_text).difference(self.table)
        if len(self.table) + len(new) > self.table_entries:
            self.table.clear()
            new = set().union(*per_text)
        long = {t: n for t, n in self.learn(list(new)).items() if len(t) > TABLE_CHARS}
        pieces = self.table.__getitem__ if not long else lambda t: long[t] if len(t) > TABLE_CHARS else self.table[t]
        return [marks + sum(n * pieces(t) for t, n in own.items()) for marks, own in zip(special, per_text, strict=True)]


def batches(texts: list[str], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of about `most` characters each, at least one text."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of docs, by the tokenizer file at `path`."""

    def run(frames):
        import pyarrow as pa

        counter = None
        for batch in frames:
            counter = counter or PieceCounter(path)
            texts, n = batch.column(1), []
            values = texts.to_pylist()
            for a, b in batches(values):
                n += counter.counts(values[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(2)], ["id", "n_tokens", "n_bytes"])

    lean(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    cut = docs.select(F.col(id_col).alias("id"), text_of(text).alias("text"), F.octet_length(text_of(text)).cast("long").alias("n_bytes"))
    out = cut.mapInArrow(run, f"id {kind}, n_tokens long, n_bytes long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
