r"""Benchmark decontamination: windows of each item's size, SimHash, multi-index search, exact check.

Texts and items are lower-cased and read as words (\w+), so layout, case and punctuation do not
matter; shingles are five words (the whole item, if it is shorter). For an item of n shingles, every
window of n shingles of every document counts: it matches when the weighted similarity of the two
shingle multisets (sum of the lesser counts by sum of the greater) is at least 0.8. A document with
fewer shingles than the item is one shorter window, if it has enough to reach the threshold.

1. A window that reaches the threshold shares at least 2t/(1+t) of the n shingles with items of its
   size. A running count of shared shingles leaves out, without loss, the windows that cannot.
2. The other windows get a 64-bit SimHash over their shingles, from running sums per bit.
3. Multi-index search: fingerprints within RADIUS bits agree to within RADIUS // 4 bits in at least
   one of four 16-bit blocks; all block values that near are looked up, so no fingerprint within
   the radius is missed. At similarity 0.8 the distance is near 10 of 64 bits with a deviation
   below 3; the radius lies more than four deviations above.
4. Candidates are verified by the exact weighted similarity; shared shingles are compared word by
   word, not by hash. The best window (then the first) stands for a document and item.

The benchmark is a stated query set: it goes to every task in blocks of at most BLOCK_BYTES of text. Each
block is a job of its own over the documents, whose matches are written before the next one starts: a
task has one Python worker and one block at a time, however large the benchmark is.

What 0.8 over five-word shingles means: a changed word takes up to five shingles with it, so an item
needs some 49 words to be found with one word changed inside, and 94 with two; changes near the ends or
next to each other cost less. tests/llm/test_decontaminate.py holds the shares.

Null texts and texts without words match nothing, nor do items without words; items that are equal
all match. Repeated rows each get their matches. Empty tables give no match. Very long texts are read
in pieces; per word four bytes are held. Other columns of the documents are carried along unread.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, quoted, released, small, text_of, written

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 23
BLOCK_BYTES = 8 << 20
PIECE_CHARS = 1 << 22
WORDS = re.compile(r"\w+")
HITS = "array<struct<item_id:{item},start_word:long,end_word:long,similarity:double>>"


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def _pieces(text: str):
    """Pieces of the text cut at white space (or anywhere, if there is none): no word is split in any common text."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        end = at + PIECE_CHARS
        found = re.compile(r"\s").search(text, end)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _mixed(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k word numbers or hashes."""
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = (out ^ words[i : len(words) - k + 1 + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _signs(hashes: np.ndarray) -> np.ndarray:
    """Plus or minus one for each of the 64 bits."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _near_masks(width: int, most: int) -> np.ndarray:
    values = np.arange(1 << width, dtype=np.uint32)
    return values[np.bitwise_count(values) <= most]


class MultiIndex:
    """Finds all fingerprints within `radius` bits, by four blocks of 16 bits."""

    def __init__(self, fingerprints: np.ndarray, radius: int):
        self.fingerprints, self.radius = fingerprints, radius
        self.masks = _near_masks(16, radius // 4)
        self.blocks = []
        for b in range(4):
            values = self._block(fingerprints, b)
            order = np.argsort(values, kind="stable")
            self.blocks.append((order, np.searchsorted(values[order], np.arange((1 << 16) + 1))))

    @staticmethod
    def _block(fingerprints: np.ndarray, b: int) -> np.ndarray:
        return ((fingerprints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)

    def near(self, fingerprint: np.uint64) -> np.ndarray:
        found = []
        for b, (order, offsets) in enumerate(self.blocks):
            values = self._block(np.array([fingerprint], np.uint64), b)[0] ^ self.masks
            values = values[offsets[values] < offsets[values + 1]]
            found += [order[offsets[v] : offsets[v + 1]] for v in values]
        at = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return at[np.bitwise_count(self.fingerprints[at] ^ fingerprint) <= self.radius]


class Sized:
    """The items of one size: n shingles of k words."""

    def __init__(self, items: list[int], n: int):
        self.items, self.n, self.shingles = items, n, set()
        self.least = int(np.ceil(2 * THRESHOLD / (1 + THRESHOLD) * n - 1e-9))
        self.prints: list[int] = []
        self.counts: list[dict[int, int]] = []


class Index:
    """Items by the words of their shingles (k) and by their size."""

    def __init__(self, texts: list[str], radius: int = RADIUS):
        self.number: dict[str, int] = {}
        words = [words_of(t) for t in texts]
        for w in words:
            for x in w:
                self.number.setdefault(x, len(self.number) + 1)
        self.by_k: dict[int, tuple[np.ndarray, np.ndarray, list[Sized]]] = {}
        lengths = defaultdict(list)
        for i, w in enumerate(words):
            if w:
                lengths[min(SHINGLE, len(w)), len(w)].append(i)
        for k in sorted({k for k, _ in lengths}):
            known: dict[tuple[int, ...], int] = {}
            sized = []
            for (own_k, size), items in sorted(lengths.items()):
                if own_k != k:
                    continue
                group = Sized(items, size - k + 1)
                for i in items:
                    numbers = [self.number[x] for x in words[i]]
                    runs = [tuple(numbers[j : j + k]) for j in range(group.n)]
                    ids = [known.setdefault(r, len(known)) for r in runs]
                    group.counts.append({x: ids.count(x) for x in ids})
                    group.shingles.update(ids)
                    group.prints.append(_packed(_signs(_mixed(word_hashes(words[i]), k)).sum(0, keepdims=True))[0])
                group.index = MultiIndex(np.array(group.prints, np.uint64), radius)
                sized.append(group)
            rows = np.array(list(known), np.int64).reshape(-1, k)
            keys = np.array([_mixed(r, k)[0] for r in rows], np.uint64)
            order = np.argsort(keys, kind="stable")
            for group in sized:
                group.member = np.zeros(len(known), bool)
                group.member[list(group.shingles)] = True
            self.by_k[k] = (keys[order], order, rows, sized)

    def numbers(self, text: str) -> np.ndarray:
        """Word numbers of a text, 0 for words of no item."""
        get, parts = self.number.get, []
        for piece in _pieces(text):
            found = words_of(piece)
            parts.append(np.fromiter((get(w, 0) for w in found), np.int32, len(found)))
        return np.concatenate(parts)

    def shared(self, numbers: np.ndarray, k: int) -> np.ndarray:
        """The known shingle that starts at each word, or -1; equal word by word."""
        keys, order, rows, _ = self.by_k[k]
        out = np.full(len(numbers) - k + 1, -1, np.int64)
        known = numbers > 0
        inside = np.convolve(known, np.ones(k, np.int64), "valid") == k
        at = np.flatnonzero(inside)
        if not len(at):
            return out
        words = numbers[at[:, None] + np.arange(k)].astype(np.int64)
        hashes = np.zeros(len(at), np.uint64)
        for i in range(k):
            hashes = (hashes ^ words[:, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            hashes ^= hashes >> np.uint64(29)
        first = np.searchsorted(keys, hashes)
        # Runs of equal keys (accidents of the hash) are tried one after the other.
        left = np.flatnonzero((first < len(keys)) & (keys[np.minimum(first, len(keys) - 1)] == hashes))
        while len(left):
            ids = order[first[left]]
            equal = (rows[ids] == words[left]).all(1)
            out[at[left[equal]]] = ids[equal]
            left = left[~equal]
            first[left] += 1
            left = left[(first[left] < len(keys)) & (keys[np.minimum(first[left], len(keys) - 1)] == hashes[left])]
        return out

    def matches(self, text: str) -> list[tuple[int, int, int, float]]:
        """(item, first word, word after the last, similarity) of each item found in the text."""
        numbers = self.numbers(text)
        best: dict[int, tuple[float, int, int]] = {}
        hashes = None
        for k, (_, _, _, sized) in self.by_k.items():
            if len(numbers) < k:
                continue
            ids = self.shared(numbers, k)
            if not (ids >= 0).any():
                continue
            if hashes is None:
                hashes = np.concatenate([word_hashes(words_of(p)) for p in _pieces(text)])
            signs_of = _mixed(hashes, k)
            for group in sized:
                n = group.n
                size = min(n, len(ids))
                if size < THRESHOLD * n - 1e-9:
                    continue
                least = group.least if size == n else int(np.ceil(THRESHOLD / (1 + THRESHOLD) * (n + size) - 1e-9))
                hit = np.where(ids >= 0, group.member[ids], False)
                run = np.r_[0, np.cumsum(hit)]
                starts = np.flatnonzero(run[size:] - run[:-size] >= max(1, least))
                for at in range(0, len(starts), 4096):
                    self._verify(group, k, size, ids, signs_of, starts[at : at + 4096], best)
        return [(i, start, end, similarity) for i, (similarity, start, end) in sorted(best.items())]

    def _verify(self, group: Sized, k: int, size: int, ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray, best: dict) -> None:
        n = group.n
        # Running sums only over the stretches that hold windows.
        cuts = np.flatnonzero(np.r_[True, np.diff(starts) > size])
        for a, b in zip(cuts, [*cuts[1:], len(starts)], strict=True):
            low = starts[a]
            sums = np.cumsum(_signs(hashes[low : starts[b - 1] + size]), axis=0)
            sums = np.concatenate((np.zeros((1, 64), sums.dtype), sums))
            prints = _packed(sums[starts[a:b] - low + size] - sums[starts[a:b] - low])
            for start, fingerprint in zip(starts[a:b].tolist(), prints, strict=True):
                near = group.index.near(fingerprint)
                if not len(near):
                    continue
                found, times = np.unique(ids[start : start + size], return_counts=True)
                window = {int(x): int(t) for x, t in zip(found, times, strict=True) if x >= 0}
                for j in near:
                    own = group.counts[j]
                    both = sum(min(t, own.get(x, 0)) for x, t in window.items())
                    similarity = both / (n + size - both)
                    item = group.items[j]
                    if similarity >= THRESHOLD and (item not in best or similarity > best[item][0]):
                        best[item] = (similarity, start, start + size + k - 1)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)) + np.uint64(1)


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark's items in parts of about block_bytes of text."""
    items = benchmark.select("item_id", F.col("text").alias("item")).where("item IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("item") + 32), F.lit(0))).first()[0]
    parts = max(1, -(-total // block_bytes))
    return [items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(parts)) == b) if parts > 1 else items for b in range(parts)]


def marked(docs: DataFrame, block: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """keep... and `hits`: array<struct<item_id,start_word,end_word,similarity>>, for each row of docs and the items of one block."""
    spark = lean(docs.sparkSession)
    kind = block.schema["item_id"].dataType.simpleString()
    hits_type = HITS.format(item=kind)
    # The text goes to Python once, even where it is one of the columns to keep.
    places = dict.fromkeys((*keep, text))
    types = {c: docs.schema[c].dataType.simpleString() for c in places}
    carried = "carried struct<" + ",".join(f"{quoted(c)}:{t}" for c, t in types.items()) + ">"
    at = list(places).index(text)
    rows = block.orderBy("item_id", "item").collect()  # at most about block_bytes
    shared = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))

    def run(frames):
        import pyarrow as pa

        released()
        item_ids, texts = shared.value
        index, hits_kind = Index(texts), None
        for batch in frames:
            found = [[{"item_id": item_ids[i], "start_word": a, "end_word": z, "similarity": s} for i, a, z, s in index.matches(t or "")] for t in batch.column(0).field(at).to_pylist()]
            hits_kind = hits_kind or batch.column(1).type
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, hits_kind)], ["carried", "hits"])

    frame = docs.select(F.struct(*(F.col(quoted(c)) for c in places)).alias("carried"), F.array().cast(hits_type).alias("hits"))
    frame = frame.mapInArrow(run, f"{carried}, hits {hits_type}")
    return frame.select(*(F.col(f"carried.{quoted(c)}").alias(c) for c in keep), "hits")


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, similarity) of each item found in each row of docs."""
    blocks = _blocks(benchmark, block_bytes)
    hits = lambda b: marked(docs, b, ("doc_id",)).select("doc_id", F.inline("hits"))
    return hits(blocks[0]) if len(blocks) == 1 else reduce(DataFrame.unionByName, [written(hits(b), "hits") for b in blocks])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, in which no item was found."""
    own = docs.columns
    blocks = _blocks(benchmark, block_bytes)
    if len(blocks) > 1:
        # Only what was found is written, a pass over the documents for each block; a row goes by its id and text.
        slim = docs.select(F.col("doc_id").alias("__id"), text_of().alias("text"))
        found = [written(marked(slim, b, ("__id", "text")).where(F.size("hits") > 0).select("__id", F.sha2("text", 256).alias("__sha")), "hits") for b in blocks]
        gone = written(reduce(DataFrame.unionByName, found).distinct(), "contaminated")
        return docs.join(small(gone, 100_000), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.sha2(text_of(), 256) == F.col("__sha")), "left_anti")
    names = {c: f"__{i}" for i, c in enumerate(own)}
    plain = docs.select(*(F.col(quoted(c)).alias(n) for c, n in names.items()))
    clean = marked(plain, blocks[0], tuple(names.values()), text=names["text"]).where(F.size("hits") == 0)
    return clean.select(*(F.col(n).alias(c) for c, n in names.items()))
