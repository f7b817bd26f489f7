"""Exact deduplication: counting quotient filters find fingerprints met more than once, bytes decide.

1. Each text gets a 64-bit fingerprint in the JVM. Each input partition builds a counting quotient
   filter of its fingerprints: the high QUOTIENT_BITS bits are the quotient (the slot a run belongs
   to), the rest the remainder, kept sorted within a run, with a count. A filter leaves its task
   as slices of consecutive quotients, in the filter's own coding (occupied and run-end bits,
   remainders, counters).
2. Slices of the same quotients are merged losslessly: runs are merged by sorted remainders and
   counts are added. A text copied a billion times is one entry per partition, so no key is hot.
3. Fingerprints with a count above one go to byte verification: only their texts are compared, by
   grouping on the bytes of the text itself, with partial aggregation before the exchange. Two
   texts that share a fingerprint by accident fall into different groups.

Every row gets keep_id (the largest id among equal texts), group_size, kept and text_sha256. Null
texts count as empty texts and are equal to them. Rows whose id is null never win against others;
if all ids of a group are null, keep_id is null. `kept` is whether a row has the id that stays: of rows
repeated with that id (or of a group of null ids) each counts in group_size and each is marked, for no
column read here tells them apart; `drop_exact_copies` leaves one of them. Texts that share an id are
judged each by its own group. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slots, small, text_of, written

#: Bits of a quotient that count within a slice; the bits before them name the slice, the rest is the remainder.
LOCAL_BITS = 10
#: Slices are the unit of merging: at least 2**SLICE_BITS, and so many that one holds about SLICE_ENTRIES at most.
SLICE_BITS = 10
SLICE_ENTRIES = 1 << 22


class QuotientFilter:
    """A counting quotient filter as sorted arrays: 64-bit fingerprints (quotient, then remainder) and counts."""

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray, slice_bits: int = SLICE_BITS):
        self.fingerprints, self.counts, self.slice_bits = fingerprints, counts, slice_bits

    @classmethod
    def of(cls, fingerprints: np.ndarray, slice_bits: int = SLICE_BITS) -> QuotientFilter:
        values, counts = np.unique(fingerprints.astype(np.uint64), return_counts=True)
        return cls(values, counts.astype(np.int64), slice_bits)

    @classmethod
    def merged(cls, filters: list[QuotientFilter], slice_bits: int = SLICE_BITS) -> QuotientFilter:
        """Runs merged by sorted remainders, counts of equal ones added. Nothing is lost."""
        values = np.concatenate([f.fingerprints for f in filters]) if filters else np.empty(0, np.uint64)
        counts = np.concatenate([f.counts for f in filters]) if filters else np.empty(0, np.int64)
        if not len(values):
            return cls(values, counts, slice_bits)
        order = np.argsort(values, kind="stable")  # the inputs are sorted runs, which a merge sort joins in linear passes
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        return cls(values[first], np.add.reduceat(counts, first), slice_bits)

    def slices(self) -> list[tuple[int, bytes]]:
        """(slice number, coded slice) of the slices that hold anything."""
        if not len(self.fingerprints):
            return []
        numbers = (self.fingerprints >> np.uint64(64 - self.slice_bits)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])
        ends = [*starts[1:], len(numbers)]
        return [(int(numbers[a]), self._coded(slice(a, b))) for a, b in zip(starts, ends, strict=True)]

    def _coded(self, at: slice) -> bytes:
        """Occupied bits of the slice's quotients, a run-end bit and a remainder per entry, counters of those above one."""
        remainder_bits = np.uint64(64 - self.slice_bits - LOCAL_BITS)
        values, counts = self.fingerprints[at], self.counts[at]
        quotients = (values >> remainder_bits) & np.uint64((1 << LOCAL_BITS) - 1)
        occupied = np.zeros(1 << LOCAL_BITS, bool)
        occupied[quotients.astype(np.int64)] = True
        run_end = np.r_[quotients[1:] != quotients[:-1], True]
        many = counts > 1
        remainders = values & ((np.uint64(1) << remainder_bits) - np.uint64(1))
        parts = (np.array([len(values), self.slice_bits], np.int64), np.packbits(occupied), np.packbits(run_end), np.packbits(many), remainders, counts[many])
        return b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_slice(cls, number: int, coded: bytes) -> QuotientFilter:
        n, slice_bits = map(int, np.frombuffer(coded, np.int64, 2))
        remainder_bits = np.uint64(64 - slice_bits - LOCAL_BITS)
        width, bits, at = 1 << LOCAL_BITS, (n + 7) // 8, 16
        occupied = np.unpackbits(np.frombuffer(coded, np.uint8, width // 8, at)).astype(bool)
        at += width // 8
        run_end = np.unpackbits(np.frombuffer(coded, np.uint8, bits, at))[:n].astype(bool)
        many = np.unpackbits(np.frombuffer(coded, np.uint8, bits, at + bits))[:n].astype(bool)
        at += 2 * bits
        remainders = np.frombuffer(coded, np.uint64, n, at)
        counts = np.ones(n, np.int64)
        counts[many] = np.frombuffer(coded, np.int64, int(many.sum()), at + 8 * n)
        runs = np.cumsum(np.r_[0, run_end[:-1]]) if n else np.empty(0, np.int64)
        quotients = np.flatnonzero(occupied)[runs].astype(np.uint64) | np.uint64(number << LOCAL_BITS)
        return cls((quotients << remainder_bits) | remainders, counts, slice_bits)


def repeated_fingerprints(frame: DataFrame, fingerprint: str) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once, by merged counting quotient filters."""
    slice_bits = max(SLICE_BITS, (frame.count() // SLICE_ENTRIES).bit_length())

    def build(frames):
        import pyarrow as pa

        filters: list[QuotientFilter] = []
        for batch in frames:
            filters.append(QuotientFilter.of(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), slice_bits))
            if len(filters) == 64:
                filters = [QuotientFilter.merged(filters, slice_bits)]
        parts = QuotientFilter.merged(filters, slice_bits).slices()
        for i in range(0, len(parts), 256):
            some = parts[i : i + 256]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in some], pa.int32()), pa.array([c for _, c in some], pa.binary())], ["slice", "coded"])

    def merge(table):
        import pyarrow as pa

        number = table.column("slice")[0].as_py()
        whole = QuotientFilter.merged([QuotientFilter.from_slice(number, c) for c in table.column("coded").to_pylist()], slice_bits)
        many = whole.counts > 1
        return pa.table({"fp": pa.array(whole.fingerprints[many].view(np.int64)), "n": pa.array(whole.counts[many])})

    slices = frame.select(F.col(fingerprint).cast("long")).mapInArrow(build, "slice int, coded binary")
    return slices.repartition(min(slots(frame.sparkSession), 1 << slice_bits), "slice").groupBy("slice").applyInArrow(merge, "fp long, n long")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    normalise: Callable[[Column], Column] = lambda t: t,
    fingerprint: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row of docs.

    normalise: what makes texts equal, as a Column function. fingerprint: of the normalised text;
    tests pass a weak one to force accidents.
    """
    texts = docs.select(F.col(id_col).alias("id"), normalise(text_of(text)).alias("text"))
    slim = texts.select("id", fingerprint(F.col("text")).alias("fp"), F.sha2("text", 256).alias("text_sha256"))
    repeated = written(repeated_fingerprints(texts.select(fingerprint(F.col("text")).alias("fp")), "fp"), "repeated")
    suspects = texts.withColumn("fp", fingerprint(F.col("text"))).join(small(repeated.select("fp")), "fp", "left_semi")
    # Byte verification: the grouping key is the text itself.
    verified = suspects.groupBy("fp", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    verified = verified.where("group_size > 1").select("fp", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    verified = written(verified, "verified")
    out = slim.join(small(verified, 100_000), ["fp", "text_sha256"], "left")
    grouped = F.col("group_size").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(grouped, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(grouped, F.col("id").eqNullSafe(F.col("keep_id"))).otherwise(F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose text is the kept one of its group; rows repeated with one id leave one."""
    groups = exact_groups(docs, id_col, text)
    copied = written(groups.where("group_size > 1").select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"), "kept"), "copies")
    # An id may stand for several texts (a null one for many), so a row goes by its id and its text.
    at = F.col(id_col).eqNullSafe(F.col("__id")) & (F.sha2(text_of(text), 256) == F.col("__sha"))
    gone = copied.where("not kept").select("__id", "__sha").distinct()
    again = copied.where("kept").groupBy("__id", "__sha").count().where("count > 1").select("__id", "__sha")
    out = docs.join(small(gone, 100_000), at, "left_anti")
    twice = small(again, 100_000)
    once = out.join(twice, at, "left_semi").dropDuplicates([id_col, text])
    return out.join(twice, at, "left_anti").unionByName(once)
