"""Near duplicates by SimHash.

`components_of` links documents whose 64-bit SimHashes differ in at most `radius` bits:

1. A fingerprint per document over its shingles (3 words by default), counted with repeats.
2. Documents of one fingerprint are one class, by partial aggregation; copies are never paired.
3. Byte-position inverted index with count filtering. Fingerprints within `radius` bits share at
   least 8 - radius of their 8 positional bytes. A posting is the value of that many positions, so
   two fingerprints meet in a posting exactly if their tally of shared positional bytes reaches the
   guaranteed minimum; postings of single bytes would hold a 256th of all fingerprints each. For
   radius 2 there are 28 postings per fingerprint. Members of a posting are free in two bytes only,
   so no posting exceeds 65,536 fingerprints, however many documents there are.
4. Every pair of a posting is verified by its differing bits: pair by pair in small postings, in
   large ones by looking up each fingerprint's neighbours, whose number is fixed. A large posting
   sends a spanning star per component, never all its pairs.
5. Components of the links, distributed; the smallest id of a component names it.

Null texts count as empty; texts without words have fingerprint zero and are linked like any other.
Texts of fewer words than a shingle are one shingle. Null ids never name a component unless all ids
in it are null. Repeated rows each get their row. Empty tables give empty tables. Other columns are
not read.

near_copies.py links texts by a similarity of 0.8 or more over shingles of five words.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slots, text_of, whole_groups, words, written
from .components import components, roots_of

SEED = 42
#: Shingles whose bits are added up at a time.
BLOCK = 1 << 18
#: Postings up to this size are compared pair by pair.
SMALL_POSTING = 64


def shingle_hashes(text: str, k: int):
    """Blocks of XXH64 values (seed 42) of the text's k-word shingles, joined by single spaces, repeats included."""
    from xxhash import xxh64_intdigest

    tail: list[bytes] = []
    any_yet = False
    for part in words(text):
        some = tail + part
        if len(some) >= k:
            data = b" ".join(some)
            ends = np.cumsum(list(map(len, some))) + np.arange(len(some))
            starts = np.r_[0, ends[:-1] + 1][: len(some) - k + 1].tolist()
            ends = ends[k - 1 :].tolist()
            for at in range(0, len(starts), BLOCK):
                yield np.array([xxh64_intdigest(data[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], np.uint64)
            any_yet = True
            tail = some[len(some) - k + 1 :] if k > 1 else []
        else:
            tail = some
    if not any_yet and tail:
        yield np.array([xxh64_intdigest(b" ".join(tail), SEED)], np.uint64)


def _bit_rows(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprint(blocks) -> int:
    """The SimHash: a bit is set if it is set in over half of the hashes; 0 of none."""
    total, sums = 0, np.zeros(64, np.int64)
    for hashes in blocks:
        total += len(hashes)
        sums += _bit_rows(hashes).sum(0, dtype=np.int64)
    return int(np.packbits(sums * 2 > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """(id, fp) for each row; fp is the fingerprint as a signed long."""

    def run(frames):
        import pyarrow as pa

        for batch in frames:
            prints = np.array([fingerprint(shingle_hashes(t, k)) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    lean(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_of(text).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def position_masks(radius: int) -> list[int]:
    """The masks of all choices of 8 - radius positional bytes."""
    return [sum(0xFF << (8 * p) for p in chosen) for chosen in combinations(range(8), 8 - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_links(run: np.ndarray, mask: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the sorted fingerprints of one posting exactly as all pairs within radius do."""
    if len(run) <= SMALL_POSTING:
        i, j = np.triu_indices(len(run), 1)
        near = np.bitwise_count(run[i] ^ run[j]) <= radius
        return run[i[near]], run[j[near]]
    free = [b for b in range(64) if not mask >> b & 1]
    a, b = [], []
    for n in range(1, radius + 1):
        for bits in combinations(free, n):
            other = run ^ np.uint64(sum(1 << x for x in bits))
            at = np.searchsorted(run, other)
            found = (at < len(run)) & (run[np.minimum(at, len(run) - 1)] == other) & (run < other)
            a.append(run[found])
            b.append(other[found])
    nodes, roots = roots_of(np.concatenate(a), np.concatenate(b))
    moved = nodes != roots
    return nodes[moved], roots[moved]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) within radius bits, enough to connect what all such pairs connect."""
    masks = position_masks(radius)
    postings = F.inline(F.array(*(F.struct(F.lit(i).alias("positions"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for i, m in enumerate(masks))))
    rows = prints.select("fp", postings).select("positions", "value", "fp").repartition(slots(prints.sparkSession), "positions", "value").sortWithinPartitions("positions", "value")

    def run(frames):
        import pyarrow as pa

        def out(positions, values, fps):
            """Links of the postings in these rows, which are whole postings."""
            ends = np.flatnonzero(np.r_[(positions[1:] != positions[:-1]) | (values[1:] != values[:-1]), True]) + 1
            starts = np.r_[0, ends[:-1]]
            sizes = ends - starts
            a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            two = starts[sizes == 2]
            near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius
            a.append(fps[two[near]])
            b.append(fps[two[near] + 1])
            for s, e in zip(starts[sizes > 2], ends[sizes > 2], strict=True):
                x, y = close_links(np.sort(fps[s:e]), masks[positions[s]], radius)
                a.append(x)
                b.append(y)
            a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1) if len(a) else np.empty((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

        for batch, _, _ in whole_groups(frames, 2):
            yield out(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64))

    return rows.mapInArrow(run, "a long, b long").distinct()


def components_of(docs: DataFrame, k: int = 3, radius: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for each row of docs."""
    rows = written(fingerprints(docs, id_col, text, k), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    found = components(links(classes, radius))
    members = found.join(classes, found["node"] == classes["fp"]).select("fp", "root", "least")
    named = members.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = written(members.join(named, "root").select("fp", "component_id"), "members")
    final = classes.join(of_class, "fp", "left").select("fp", F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return rows.join(final, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
