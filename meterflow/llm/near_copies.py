"""Near copies by SimHash, verified: similarity 0.8 or more over the sets of five-word shingles.

1. A fingerprint per text over its distinct shingles: a SimHash of as many positional bytes as the
   index asks for.
2. Byte-position inverted index with count filtering. At similarity 0.8 some 15 of 100 bits differ, so
   the eight bytes of a plain fingerprint guarantee no shared one; of more bytes, 27 of 100 are shared.
   The bytes are taken two by two. A posting is the values of one such two: being in one is the tally of
   shared positional bytes reaching two, within it. 185 of them leave a pair that is just at 0.8 a
   chance of MISS to share none (three times that where the two have 25 shingles between them, the worst
   of all sizes); at 0.85 it is below one in 10^9. Texts of under SHORT shingles, in which one shingle
   sways more bits, have 379. Texts with nothing in common share a given posting once in 65,536 times,
   and so do, nearly, texts that share a passage: no shingle is a key, however many texts have it.
3. Within a posting, texts whose first 192 bits differ in no more than 5.5 deviations above what
   similarity 0.8 gives (57 bits, 66 in short texts), and whose numbers of shingles could allow the
   similarity, are candidates; unrelated texts differ in some 96. Not the pairs leave the task but
   links that connect what the pairs connect, so a posting of any size adds fewer links than it has
   members. Two blocks of a posting add only what joins the members that each block links by itself.
4. Components of the candidates are small clusters; in them every pair is verified by the exact
   similarity, counted over the texts that hold each shingle, and again connecting links leave.
5. Components of the verified links are the groups. The row with the smallest id stays (rows with
   null ids last).

The numbers of postings and bits follow from the threshold, for other thresholds too.

Postings above POSTING rows and clusters above CLUSTER texts (or CLUSTER_CHARS characters) are dealt
as pairs of blocks to several tasks, so no task gets an unbounded group and every pair still meets.

Exact copies (of the whole text) are one node, found by digest. Null texts count as empty; texts
without words are copies of each other, texts of under five words are one shingle. Rows repeated with
one id and text leave one. Empty tables give empty tables. All columns of the input are kept; only id
and text are read.
"""

from __future__ import annotations

from math import acos, ceil, log, log1p, pi, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, released, slots, small, text_of, whole_groups, written
from .components import components, roots_of
from .simhash import shingle_hashes

SHINGLE = 5
THRESHOLD = 0.8
#: The chance that texts just at the threshold share no posting.
MISS = 1e-6
#: Below so many shingles up to so many times as many bits differ.
SHORT, SHORT_SWAY = 16, 1.24
#: Words of 64 bits that postings carry, and the deviations by which they may differ more than expected.
CARRIED, DEVIATIONS = 3, 5.5
#: The greatest sum of bits that a byte holds.
LANE = 255
POSTING = 4096
#: Postings up to this size are compared many at a time.
SMALL_POSTING = 256
CLUSTER, CLUSTER_CHARS = 1024, 32 << 20


def differing(threshold: float, short: bool) -> float:
    """The share of the bits of two SimHashes that differ at the threshold: their angle, by half a turn."""
    return acos(2 * threshold / (1 + threshold)) / pi * (SHORT_SWAY if short else 1)


def choices(threshold: float, short: bool) -> int:
    """How many choices of two positional bytes leave a chance of MISS that none is shared at the threshold."""
    shared = (1 - differing(threshold, short)) ** 16
    found = 1 if shared == 1 else ceil(log(MISS) / log1p(-shared))
    if found >= 1 << 15:
        raise ValueError(f"a threshold of {threshold} is too low for the index")
    return found


def radius_of(threshold: float, short: bool) -> int:
    """The number of carried bits in which candidates may differ."""
    bits, rate = 64 * CARRIED, differing(threshold, short)
    return ceil(bits * rate + DEVIATIONS * sqrt(bits * rate * (1 - rate)))


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """SplitMix64's finish."""
    z = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def positional_bytes(distinct: np.ndarray, count: int) -> np.ndarray:
    """The SimHash of distinct shingles in `count` positional bytes; fewer are the first of more.

    In texts of up to LANE shingles weights by hash decide the bits that half the shingles have: always
    0 would make short texts alike that have nothing in common.
    """
    salts = _mixed(np.arange(1, -(-count // 8) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sums = np.zeros(64 * len(salts), np.int64)
    for at in range(0, len(distinct), LANE):
        some = _mixed(distinct[at : at + LANE, None] ^ salts).astype("<u8", copy=False)
        bits = np.unpackbits(some.view(np.uint8), axis=1, bitorder="little")
        sums += np.add.reduce(bits.view(np.uint64), axis=0).view(np.uint8)
    ones = 2 * sums > len(distinct)
    if len(distinct) <= LANE and len(even := np.flatnonzero(2 * sums == len(distinct))):
        weights = (_mixed(distinct) >> np.uint64(48)).astype(np.int64) + 1
        ones[even] = 2 * (weights @ bits[:, even]) > weights.sum()
    return np.packbits(ones, bitorder="little")[:count]


def features(text: str, threshold: float = THRESHOLD) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of distinct shingles, the carried words of the SimHash, the postings: values of two positional bytes each)."""
    distinct = shingle_set(text)
    if not len(distinct):
        return 0, np.zeros(CARRIED, np.uint64), np.full(1, -1, np.int32)
    n = choices(threshold, len(distinct) < SHORT)
    found = positional_bytes(distinct, max(2 * n, 8 * CARRIED))
    return len(distinct), found[: 8 * CARRIED].view("<u8"), found[: 2 * n].view("<u2").astype(np.int32) | np.arange(n, dtype=np.int32) << 16


def shingle_set(text: str) -> np.ndarray:
    parts = [np.unique(h) for h in shingle_hashes(text, SHINGLE)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def similar_pairs(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j: all pairs whose Jaccard similarity reaches the threshold; two empty sets are equal."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.float32)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.nonzero([[False, both >= threshold * (sizes.sum() - both) - 1e-4], [False, False]])
    values, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sizes.astype(np.int64))
    order = np.argsort(column, kind="stable")  # the texts that hold each shingle, in ascending order
    holders, ends = row[order], np.cumsum(n)
    at = np.r_[0, np.cumsum(sizes.astype(np.int64))]
    for i in range(m):
        own = column[at[i] : at[i + 1]]
        own = own[n[own] > 1]
        counts = n[own]
        places = np.arange(counts.sum()) + np.repeat(ends[own] - np.cumsum(counts), counts)
        shared = np.bincount(holders[places], minlength=m)[i + 1 :]
        near = np.flatnonzero(shared >= threshold * (sizes[i] + sizes[i + 1 :] - shared) - 1e-4)
        found.append((np.full(len(near), i), near + i + 1))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _blocks(count: Column, of: Column) -> Column:
    """The pairs of blocks (x <= y) that a member with hash `of` belongs to, of `count` blocks."""
    own = F.pmod(of, count).cast("int")
    return F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda o: F.struct(F.least(own, o).alias("x"), F.greatest(own, o).alias("y"), own.alias("own")))


def _cross(own: np.ndarray, x: int, y: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In a group of two blocks only pairs across them count, as pairs of what each block's own group connects."""
    if x == y:
        return i, j
    across = own[i] != own[j]
    home = np.arange(len(own))
    nodes, roots = roots_of(i[~across], j[~across])
    home[nodes] = roots
    return home[i[across]], home[j[across]]


def _links_out(found: list):
    """Links that connect what those found do, at most one for each row but the first of a component."""
    import pyarrow as pa

    a = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.int64)
    b = np.concatenate([y for _, y in found]) if found else np.empty(0, np.int64)
    a, b = _thinned(a, b)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _thinned(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per component instead of all pairs."""
    if len(i) < 2:
        return i, j
    nodes, roots = roots_of(i, j)
    moved = nodes != roots
    return nodes[moved], roots[moved]


def _near(sizes: np.ndarray, prints: np.ndarray, own: np.ndarray, fit, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of positions that connect what all candidate pairs do; across: only pairs of different blocks count.

    prints has CARRIED rows of 64 bits; fit(sizes, sizes, differing bits) tells candidates. Members of a
    block that are near its first are linked to it by the block's own group: across, the first stands for them.
    """
    every = np.arange(len(sizes))
    home = every.copy()
    near = lambda k: fit(sizes[k], sizes, np.bitwise_count(prints[:, k : k + 1] ^ prints).sum(0))
    i, j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if across:
        left, right = every[own == own.min()], every[own != own.min()]
        if not len(right):
            return i[0], j[0]
        of_left, of_right = near(left[0]), near(right[0])
        home[left[of_left[left]]], home[right[of_right[right]]] = left[0], right[0]
        if (of_left & (home == right[0])).any() or (of_right & (home == left[0])).any():  # both firsts' members are one
            i, j = [left[:1]], [right[:1]]
            compared = [(left[~of_left[left]], right), (left[of_left[left]], right[~of_right[right]])]
        else:
            compared = [(left, right)]
    else:  # those near the first are linked by it, and need not be compared with each other
        first = near(0)
        i, j = [np.zeros(first.sum(), np.int64)], [every[first]]
        compared = [(every[~first], every)]
    for left, right in compared:
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            bits = sum(np.bitwise_count(p[some, None] ^ p[None, right]) for p in prints)
            x, y = np.nonzero(fit(sizes[some, None], sizes[None, right], bits))
            x, y = some[x], right[y]
            keep = x != y
            x, y = _thinned(home[x[keep]], home[y[keep]])
            i.append(x)
            j.append(y)
    return _thinned(np.concatenate(i), np.concatenate(j))


def candidate_links(rows: DataFrame, threshold: float = THRESHOLD, radius: int | None = None) -> DataFrame:
    """(a, b) links between row numbers, from (row, size, print0, print1, print2, segments); radius: bits instead of the threshold's."""
    carried = [f"print{k}" for k in range(CARRIED)]
    postings = rows.select("row", "size", *carried, F.explode("segments").alias("segment"))
    hot = written(postings.groupBy("segment").count().where(F.col("count") > POSTING), "hot-segments")
    hot = hot.select("segment", F.ceil(F.col("count") / POSTING).alias("blocks"))
    # At most one segment in POSTING rows is hot.
    dealt = postings.join(small(hot), "segment", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.select("segment", F.inline(_blocks(F.col("blocks"), F.xxhash64("row"))), "size", *carried, "row")
    usual, short = (radius_of(threshold, s) if radius is None else radius for s in (False, True))

    def fit(a, b, bits):
        """Sizes x <= y can reach the threshold only if x >= threshold * y; below some size (4, at 0.8) only equal sets do."""
        least = np.minimum(a, b)
        equal = least * (1 - threshold) < threshold - 1e-9
        return (least >= threshold * np.maximum(a, b) * 0.999) & (bits <= np.where(equal, 0, np.where(least < SHORT, short, usual)))

    def run(frames):
        for batch, starts, ends in whole_groups(frames, 3):
            x, y, own, sizes, *prints, numbers = (batch.column(k).to_numpy() for k in range(1, 6 + CARRIED))
            prints = np.stack(prints).view(np.uint64)
            found = []
            members = ends - starts
            after = np.repeat(np.where(members <= SMALL_POSTING, ends, 0), members) - 1 - np.arange(len(numbers))
            some, step = np.flatnonzero(after > 0), 1
            while len(some):  # each member and the one `step` places on
                other = some + step
                bits = np.bitwise_count(prints[:, some] ^ prints[:, other]).sum(0)
                near = fit(sizes[some], sizes[other], bits) & ((x[some] == y[some]) | (own[some] != own[other]))
                found.append((numbers[some[near]], numbers[other[near]]))
                step += 1
                some = some[after[some] >= step]
            for s, e in zip(starts[members > SMALL_POSTING], ends[members > SMALL_POSTING], strict=True):
                i, j = _near(sizes[s:e], prints[:, s:e], own[s:e], fit, x[s] != y[s])
                found.append((numbers[s:e][i], numbers[s:e][j]))
            yield _links_out(found)

    dealt = dealt.repartition(slots(rows.sparkSession), "segment", "x", "y").sortWithinPartitions("segment", "x", "y")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def verified_links(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) links between row numbers of one cluster, from (cluster, row, text)."""
    sizes = texts.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    blocks = F.greatest(F.ceil(F.col("n") / CLUSTER), F.ceil(F.col("chars") / CLUSTER_CHARS), F.lit(1))
    large = written(sizes.select("cluster", blocks.alias("blocks")).where("blocks > 1"), "large-clusters")
    dealt = texts.join(small(large), "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.select("cluster", F.inline(_blocks(F.col("blocks"), F.xxhash64("row"))), "row", "text")

    def run(frames):
        for batch, starts, ends in whole_groups(frames, 3):
            x, y, own, numbers = (batch.column(k).to_numpy() for k in range(1, 5))
            found = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s > 1:
                    sets = [shingle_set(t) for t in batch.column(5).slice(s, e - s).to_pylist()]
                    i, j = _cross(own[s:e], x[s], y[s], *similar_pairs(sets, threshold))
                    found.append((numbers[s:e][i], numbers[s:e][j]))
            yield _links_out(found)

    dealt = dealt.select("cluster", "x", "y", "own", "row", "text").repartition(slots(texts.sparkSession), "cluster", "x", "y")
    return dealt.sortWithinPartitions("cluster", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _features(frame: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(row, id, sha, size, print0, print1, print2, segments) from (row, id, text, sha)."""
    names = [f"print{k}" for k in range(CARRIED)]

    def run(frames):
        import pyarrow as pa

        released()
        for batch in frames:
            found = [features(t, threshold) for t in batch.column(2).to_pylist()]
            prints = [pa.array(np.array([f[1][k] for f in found], np.uint64).view(np.int64)) for k in range(CARRIED)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array([f[0] for f in found], pa.int64()), *prints, pa.array([f[2] for f in found], pa.list_(pa.int32()))],
                ["row", "id", "sha", "size", *names, "segments"],
            )

    return frame.select("row", "id", "text", "sha").mapInArrow(run, f"row long, id {kind}, sha string, size long, {', '.join(f'{n} long' for n in names)}, segments array<int>")


def _texts(digest: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of (row, own_id, sha, ...), from (id, text, sha)."""
    wanted = wanted.withColumnRenamed("sha", "own_sha")
    return digest.join(small(wanted, 100_000), (F.col("sha") == F.col("own_sha")) & F.col("id").eqNullSafe(F.col("own_id"))).drop("own_id", "own_sha")


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, radius: int | None = None) -> DataFrame:
    """(id, sha, row, group) of the rows that have a copy or near copy; group is the row number that stays."""
    lean(docs.sparkSession)
    digest = docs.select(F.col(id_col).alias("id"), text_of(text).alias("text")).withColumn("sha", F.sha2("text", 256))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = written(_features(digest.withColumn("row", F.monotonically_increasing_id()), kind, threshold), "features")
    keys = rows.select("row", "id", "sha")
    # One node per text: the row that would stay among its exact copies.
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row"))["row"]
    copied = written(keys.groupBy("sha").agg(first.alias("node"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "node"), "copied")
    members = written(keys.join(small(copied, 100_000), "sha").select("row", "node"), "copies")
    spare = small(members.where("row <> node").select("row"))
    nodes = rows.join(spare, "row", "left_anti")

    clusters = components(candidate_links(nodes, threshold, radius))
    chosen = written(nodes.select("row", "id", "sha").join(clusters.withColumnsRenamed({"node": "row", "root": "cluster"}), "row"), "candidates")
    wanted = chosen.select(F.col("id").alias("own_id"), "sha", "row", "cluster")
    texts = _texts(digest, wanted).select("cluster", "row", "text")
    near = components(verified_links(written(texts.dropDuplicates(["row"]), "cluster-texts"), threshold))

    root = members.join(near.withColumnsRenamed({"node": "at", "root": "to"}), F.col("node") == F.col("at"), "left")
    final = root.select("row", F.coalesce("to", "node").alias("root")).unionByName(near.select(F.col("node").alias("row"), "root").join(members.select("row"), "row", "left_anti"))
    final = written(final.join(keys, "row"), "grouped")
    stays = final.groupBy("root").agg(first.alias("group"))
    return written(final.join(stays, "root").select("id", "sha", "row", "group"), "groups")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, with one row of each group of copies and near copies."""
    found = groups(docs, id_col, text, threshold)
    marks = found.groupBy("id", "sha").agg(F.max((F.col("row") == F.col("group")).cast("int")).alias("stays"), F.count(F.lit(1)).alias("n"))
    marks = written(marks.select(F.col("id").alias("__id"), F.col("sha").alias("__sha"), "stays", "n"), "marks")
    at = F.col(id_col).eqNullSafe(F.col("__id")) & (F.sha2(text_of(text), 256) == F.col("__sha"))
    left = docs.join(small(marks.where("stays = 0").select("__id", "__sha"), 100_000), at, "left_anti")
    twice = small(marks.where("stays = 1 AND n > 1").select("__id", "__sha"), 100_000)
    once = left.join(twice, at, "left_semi").dropDuplicates([id_col, text])
    return left.join(twice, at, "left_anti").unionByName(once)
