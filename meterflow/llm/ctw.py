"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions (255 nodes, one per prefix of bits). For each node there is a tree
of byte contexts of depths 0 to DEPTH. Every tree node has a Krichevsky-Trofimov estimate from its
counts of zeros and ones, and a weighted probability: half its own estimate, half the product of its
children's weighted probabilities. Predicting a bit mixes the estimates of all depths on the context
path, each depth weighing what it earned on the training text; the code length of a byte is the sum
over its eight bits.

Every context seen is kept, however rare, so the model grows with the corpus and no task holds it:

1. Per-task counts of grams (DEPTH bytes of context and the next) from every training text, whole,
   are dealt by the two nearest bytes of context to slices, merged and written. All deeper contexts
   of two such bytes are in one slice, so a slice weights its subtrees alone.
2. What the slices' trees earn is added up by nearest byte: depths 1 and 0 are a table of 256 x 255
   rows at any size, and the only part that is broadcast.
3. Documents go in chunks of CHUNK bytes; the distinct grams of a chunk are sent to their slices and
   come back with the logarithm of the byte's probability. The chunk's texts meet them by its number.

Texts are lower-cased (A-Z); a text's first bytes see zero bytes before them. The base score, an
add-one unigram model over words, counts words by an exchange on the word. Of those counts at most
HEAVY_WORDS go to every task as a table (the most frequent, by a histogram of counts); the other
words of the documents are joined to their counts by a shuffle, and summed per row.

Null texts count as empty: one token (the end), score 0. Null ids hash as the empty string. Repeated
rows are counted and scored each. Without training rows the counts are empty and every bit has
probability one half. An empty table gives an empty one. Only id and text are read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slots, text_of, word_counts, written

#: Bytes of context; a gram has one byte more.
DEPTH = 5
#: Bytes of text whose distinct grams are looked up together; distinct grams held by a task.
CHUNK, HELD_GRAMS = 8 << 20, 1 << 21
#: Training words for each slice of the grams, where shuffle partitions are fewer.
SLICE_WORDS = 2_000_000
HEAVY_WORDS = 200_000
#: The token after the last word; it has white space, so it is no word.
END = b"\n"
TABLE_WORDS = 1_000_000
BLOCK = 4 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up: exact to about 1e-12."""
    shift = np.ones_like(x)
    y = x.copy()
    for _ in range(8):
        shift *= y
        y += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - np.log(shift)


def _bits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones seen at the 255 nodes of each row of byte counts, level by level."""
    levels, row = [], counts.astype(np.float64)
    while row.shape[1] > 1:
        pairs = row.reshape(len(row), row.shape[1] // 2, 2)
        levels.append(pairs)
        row = pairs.sum(2)
    both = np.concatenate(levels[::-1], axis=1)
    return both[:, :, 0], both[:, :, 1]


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - 1.1447298858494002 - _log_gamma(zeros + ones + 1)


def _weighted(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log weighted probability, the weight of a node's own estimate)."""
    both = np.logaddexp(own, children) - np.log(2)
    return both, np.exp(own - np.log(2) - both)


def _byte_log10(one: np.ndarray) -> np.ndarray:
    """log10 of the 256 bytes' probabilities from the 255 nodes' probabilities of a one."""
    out, at = np.zeros((len(one), 1)), 0
    for level in range(8):
        p = one[:, at : at + (1 << level)]
        out = np.stack((out + np.log10(1 - p), out + np.log10(p)), axis=2).reshape(len(one), -1)
        at += 1 << level
    return out.astype(np.float32)


class Model:
    """The three-byte tree in memory, for small tables: log10 probabilities of a byte after its context; contexts of depth 3, rests of depth 2, and of depth 1."""

    def __init__(self, contexts2: np.ndarray, counts2: np.ndarray, contexts3: np.ndarray, counts3: np.ndarray):
        """counts2 has a row of 256 for each context of two bytes; counts3 for each kept one of three."""
        parent = np.searchsorted(contexts2, contexts3 & 0xFFFF)
        rest = counts2.astype(np.int64).copy()
        np.subtract.at(rest, parent, counts3)
        counts1 = np.zeros((256, 256), np.int64)
        np.add.at(counts1, contexts2 & 0xFF, counts2)

        below2 = _estimate(*_bits(rest))
        for at in range(0, len(contexts3), 4096):
            np.add.at(below2, parent[at : at + 4096], _estimate(*_bits(counts3[at : at + 4096])))
        log2, weight2 = _weighted(_estimate(*_bits(counts2)), below2)
        below1 = np.zeros((256, 255))
        np.add.at(below1, contexts2 & 0xFF, log2)
        bits1, bits0 = _bits(counts1), _bits(counts1.sum(0, keepdims=True))
        log1, weight1 = _weighted(_estimate(*bits1), below1)
        weight0 = _weighted(_estimate(*bits0), log1.sum(0, keepdims=True))[1]

        one = lambda bits: (bits[1] + 0.5) / (bits[0] + bits[1] + 1)

        def path(first: np.ndarray, depth2: np.ndarray) -> np.ndarray:
            depth1 = weight1[first] * one(bits1)[first] + (1 - weight1[first]) * depth2
            return _byte_log10(weight0 * one(bits0) + (1 - weight0) * depth1)

        def below(rows: np.ndarray, leaf: np.ndarray) -> np.ndarray:
            depth2 = weight2[rows] * one(_bits(counts2[rows])) + (1 - weight2[rows]) * leaf
            return path(contexts2[rows] & 0xFF, depth2)

        tables = [path(np.arange(256), np.full((256, 255), 0.5))]
        for at in range(0, len(contexts2), 4096):
            tables.append(below(np.arange(at, min(at + 4096, len(contexts2))), one(_bits(rest[at : at + 4096]))))
        for at in range(0, len(contexts3), 4096):
            tables.append(below(parent[at : at + 4096], one(_bits(counts3[at : at + 4096]))))
        self.contexts2, self.contexts3, self.table = contexts2.astype(np.int32), contexts3.astype(np.int32), np.concatenate(tables)

    @classmethod
    def of(cls, grams2: tuple[np.ndarray, np.ndarray], grams3: tuple[np.ndarray, np.ndarray]) -> Model:
        """From (gram, count) of grams of three bytes (two of context), and of four bytes whose contexts are kept."""

        def rows(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            contexts, at = np.unique(grams >> 8, return_inverse=True)
            out = np.zeros((len(contexts), 256), np.int64)
            np.add.at(out, (at, grams & 0xFF), counts)
            return contexts, out

        return cls(*rows(*grams2), *rows(*grams3))

    def index(self) -> np.ndarray:
        """The table's row for each of the 2**24 contexts."""
        rows = np.tile(np.arange(256, dtype=np.int32), 1 << 16)
        rows.reshape(256, 1 << 16)[:, self.contexts2] = 256 + np.arange(len(self.contexts2), dtype=np.int32)
        rows[self.contexts3] = 256 + len(self.contexts2) + np.arange(len(self.contexts3), dtype=np.int32)
        return rows


def _codes(data: bytes, depth: int = 3) -> np.ndarray:
    """The gram that ends at each byte of lower-cased data; the first `depth` bytes are context only."""
    b = LOWER[np.frombuffer(data, np.uint8)].astype(np.int64 if depth > 3 else np.uint32)
    out = b[: len(b) - depth]
    for i in range(1, depth + 1):
        out = (out << 8) | b[i : len(b) - depth + i]
    return out


def _places(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts, each after DEPTH zero bytes, and where the codes of each start and end."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + DEPTH) - DEPTH
    return b"".join(bytes(DEPTH) + t for t in texts), ends - sizes, ends


def _deep_codes(texts: list[bytes]):
    """Blocks of (codes, whether the position is a text's own) in order."""
    data, starts, ends = _places(texts)
    turns = np.zeros(len(data) + 1, np.int8)
    np.add.at(turns, starts, 1)
    np.add.at(turns, ends, -1)
    own = np.cumsum(turns, dtype=np.int8) > 0
    for at in range(0, len(data) - DEPTH, BLOCK):
        codes = _codes(data[at : at + BLOCK + DEPTH], DEPTH)
        yield codes, own[at : at + len(codes)]


def _slice_of(grams: np.ndarray, slices: int) -> np.ndarray:
    """By the two nearest bytes of context, mixed."""
    return (((grams >> 8 & 0xFFFF) * 40503 & 0xFFFF) * slices >> 16).astype(np.int32)


def _sliced(grams: np.ndarray, slices: int):
    """(slice, positions of its grams) for ascending grams."""
    number = _slice_of(grams, slices)
    order = np.argsort(number, kind="stable")
    cuts = np.flatnonzero(np.diff(number[order], prepend=-1))
    for some in np.split(order, cuts[1:]):
        if len(some):
            yield int(number[some[0]]), some


def _packed(ascending: np.ndarray) -> bytes:
    return zlib.compress(np.diff(ascending, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct grams and the sums of their counts."""
    grams = np.concatenate([g for g, _ in parts]) if parts else np.empty(0, np.int64)
    counts = np.concatenate([n for _, n in parts]) if parts else np.empty(0, np.int64)
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]][: len(grams)])
    return (grams[starts], np.add.reduceat(counts[order], starts)) if len(grams) else (grams, counts)


#: log Gamma(n + 1/2) and log Gamma(n + 1) of small n.
HALVES, WHOLES = _log_gamma(np.arange(1 << 15) + 0.5), _log_gamma(np.arange(1 << 15) + 1.0)


def _looked_up(table: np.ndarray, n: np.ndarray, more: float) -> np.ndarray:
    out = table[np.minimum(n, len(table) - 1)]
    large = n >= len(table)
    out[large] = _log_gamma(n[large] + more)
    return out


def _estimated(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """_estimate of whole numbers, from tables."""
    return _looked_up(HALVES, zeros, 0.5) + _looked_up(HALVES, ones, 0.5) - 1.1447298858494002 - _looked_up(WHOLES, zeros + ones, 1.0)


def _subtrees(grams: np.ndarray, counts: np.ndarray, top: tuple[np.ndarray, np.ndarray] | None = None):
    """Weights the trees below depth 1 of whole slices' ascending grams, one level of bits after the other.

    Without `top`: (node * 256 + nearest byte, zeros, ones, sum of the children's logs) for depth 1.
    With it (by the same number: what depths 0 and 1 give, and the share they leave to depth 2): the
    log10 of each gram's byte after its context. Grams counted zero times change no other's.
    """
    last, near_first = grams & 0xFF, np.zeros(len(grams), np.int64)
    for i in range(DEPTH):
        near_first |= (grams >> (8 * (i + 1)) & 0xFF) << (8 * (DEPTH - 1 - i))
    found, total = [], np.zeros(len(grams))
    one = lambda z, o: (o + 0.5) / (z + o + 1)
    for level in range(8):
        # The nodes of a depth are runs of this order, with their children's runs inside.
        key = ((1 << level) | last >> (8 - level)) << (8 * DEPTH) | near_first
        order = np.argsort(key, kind="stable")
        bit, n, key = last[order] >> (7 - level) & 1, counts[order], key[order]
        zeros, ones = n * (1 - bit), n * bit
        mixed, path = [], None
        for depth in range(DEPTH, 0, -1):
            if depth < DEPTH:
                key = key >> 8
            turns = np.r_[True, key[1:] != key[:-1]]
            starts = np.flatnonzero(turns)
            key, zeros, ones = key[starts], np.add.reduceat(zeros, starts), np.add.reduceat(ones, starts)
            if depth == DEPTH:
                leaf, path = np.cumsum(turns) - 1, np.arange(len(starts))
                log, p = _estimated(zeros, ones), one(zeros, ones)
                continue
            children, path = np.add.reduceat(log, starts), (np.cumsum(turns) - 1)[path]
            if depth == 1:
                found.append((key, zeros, ones, children))
                break
            log, weight = _weighted(_estimated(zeros, ones), children)
            p = (weight * one(zeros, ones))[path] + (1 - weight)[path] * p
        if top is not None:
            p = (top[0][key][path] + top[1][key][path] * p)[leaf]
            total[order] += np.log10(np.where(bit == 1, p, 1 - p))
    return total if top is not None else [np.concatenate(x) for x in zip(*found, strict=True)]


def grams_of(texts: list[bytes]):
    """Blocks of gram codes of texts, each text after three zero bytes; a long text in several blocks."""
    held, size = [], 0
    for text in texts:
        data = b"\0\0\0" + text
        if len(data) > BLOCK:
            for at in range(0, len(text), BLOCK):
                yield _codes(data[at : at + BLOCK + 3])
        elif text:
            held.append(_codes(data))
            size += len(data)
            if size > BLOCK:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


class Scorer:
    def __init__(self, model: Model):
        self.rows, self.table = model.index(), model.table

    def log10(self, text: bytes) -> float:
        data, total = b"\0\0\0" + text, 0.0
        for at in range(0, len(text), BLOCK):
            codes = _codes(data[at : at + BLOCK + 3])
            total += float(self.table[self.rows[codes >> 8], codes & 0xFF].sum(dtype=np.float64))
        return total


def _training(docs: DataFrame, folds: int, held_fold: int):
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return F.crc32(key) % folds != held_fold


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts, the end token included; each task sends a distinct word once per million met."""

    def run(frames):
        import pyarrow as pa

        counts: Counter = Counter()

        def out():
            items = list(counts.items())
            for at in range(0, len(items), 1 << 16):
                some = items[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], ["word", "n"])

        for batch in frames:
            for text in batch.column(0).to_pylist():
                counts.update(word_counts(text))
                counts[END] += 1
                if len(counts) > TABLE_WORDS:
                    yield from out()
                    counts.clear()
        yield from out()

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def count_grams(texts: DataFrame, slices: int) -> DataFrame:
    """(slice, grams, counts): every gram of the texts' lower-cased bytes, ascending and packed, a row for each slice."""
    kind = "slice int, grams binary, counts binary"

    def out(grams: np.ndarray, counts: np.ndarray):
        import pyarrow as pa

        rows = [(number, _packed(grams[at]), zlib.compress(counts[at].astype("<i8").tobytes(), 1)) for number, at in _sliced(grams, slices)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["slice", "grams", "counts"])

    def run(frames):
        import pyarrow as pa
        import pyarrow.compute as pc

        parts, held = [], 0
        for batch in frames:
            for codes, own in _deep_codes([t.encode() for t in batch.column(0).to_pylist()]):
                met = pc.value_counts(pa.array(codes[own]))
                parts.append((met.field(0).to_numpy(), met.field(1).to_numpy()))
                held += len(met)
                if held > 2 * HELD_GRAMS:
                    parts = [_summed(parts)]
                    held = len(parts[0][0])
                    if held > HELD_GRAMS:
                        yield out(*parts[0])
                        parts, held = [], 0
        yield out(*_summed(parts))

    def merge(table):
        import pyarrow as pa

        grams, counts = _summed([(_unpacked(g), np.frombuffer(zlib.decompress(n), "<i8")) for g, n in zip(table.column(1).to_pylist(), table.column(2).to_pylist(), strict=True)])
        return pa.Table.from_batches([out(grams, counts)])

    sent = texts.mapInArrow(run, kind)
    return sent.repartition(min(slots(texts.sparkSession), slices), "slice").groupBy("slice").applyInArrow(merge, kind)


def top_of(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """What depths 0 and 1 give a one, and the share they leave to depth 2, by node * 256 + nearest byte."""

    def run(frames):
        import pyarrow as pa

        for batch in frames:
            for g, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _subtrees(_unpacked(g), np.frombuffer(zlib.decompress(n), "<i8"))], ["at", "zeros", "ones", "log"])

    sums = grams.mapInArrow(run, "at long, zeros long, ones long, log double").groupBy("at").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "log"))).toArrow()  # at most 65,280 rows
    at = sums.column(0).to_numpy()
    zeros, ones, below = (np.zeros((256, 256)) for _ in range(3))
    for table, column in zip((zeros, ones, below), sums.columns[1:], strict=True):
        table.ravel()[at] = column.to_numpy()
    one = lambda z, o: (o + 0.5) / (z + o + 1)
    log1, weight1 = _weighted(_estimate(zeros, ones), below)
    zeros0, ones0 = zeros.sum(1, keepdims=True), ones.sum(1, keepdims=True)
    weight0 = _weighted(_estimate(zeros0, ones0), log1.sum(1, keepdims=True))[1]
    given = weight0 * one(zeros0, ones0) + (1 - weight0) * weight1 * one(zeros, ones)
    return given.ravel(), ((1 - weight0) * (1 - weight1)).ravel()


def gram_logs(grams: DataFrame, wanted: DataFrame) -> DataFrame:
    """(chunk, grams, logs): log10 of the last byte of each wanted gram, from (slice, grams, counts) and (slice, chunk, grams)."""
    spark = grams.sparkSession
    shared = spark.sparkContext.broadcast(top_of(grams))
    both = grams.select("slice", F.lit(-1).cast("long").alias("chunk"), "grams", "counts").unionByName(wanted.select("slice", "chunk", "grams", F.lit(None).cast("binary").alias("counts")))

    def run(frames):
        import pyarrow as pa

        def out():
            asked = [(g, np.zeros(len(g), np.int64)) for _, _, g in held]
            known, n = _summed([trained, *asked])
            logs = _subtrees(known, n, shared.value).astype("<f4")
            back = [logs[np.searchsorted(known, g)].tobytes() for _, _, g in held]
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.binary()), pa.array(back, pa.binary())], ["chunk", "grams", "logs"])

        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        now, trained, held, size = None, none, [], 0
        for batch in frames:
            for number, chunk, g, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held and (number != now or size > max(HELD_GRAMS, len(trained[0]))):
                    yield out()
                    held, size = [], 0
                if number != now:
                    now, trained = number, none
                if chunk < 0:
                    trained = (_unpacked(g), np.frombuffer(zlib.decompress(n), "<i8"))
                else:
                    held.append((chunk, g, _unpacked(g)))
                    size += len(held[-1][2])
        if held:
            yield out()

    dealt = both.repartition(slots(spark), "slice").sortWithinPartitions("slice", "chunk")
    return dealt.mapInArrow(run, "chunk long, grams binary, logs binary")


def text_logs(texts: list[bytes], grams: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """The sum of each text's logs, from those of the grams that occur."""
    import pyarrow as pa
    import pyarrow.compute as pc

    _, starts, ends = _places(texts)
    known, upto = pa.array(grams), [np.zeros(1)]
    for codes, own in _deep_codes(texts):
        each = np.zeros(len(codes))
        each[own] = logs[pc.index_in(pa.array(codes[own]), known).to_numpy(zero_copy_only=False)]
        upto.append(upto[-1][-1] + np.cumsum(each))
    sums = np.concatenate(upto)
    return sums[ends] - sums[starts]


def score(docs: DataFrame, folds: int = 7, held_fold: int = 2, heavy_words: int = HEAVY_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row of docs."""
    spark = lean(docs.sparkSession)
    frame = docs.select("doc_id", text_of().alias("text"), (~_training(docs, folds, held_fold)).alias("held_out"))
    training = frame.where("not held_out").select("text")
    words = written(count_words(training), "words", "zstd")
    size = F.floor(F.log2("c") * 8)
    histogram = words.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("words"), F.sum("c").alias("tokens")).collect()  # a few hundred rows
    n, v = sum(r.tokens for r in histogram), sum(r.words for r in histogram)
    least, room = float("inf"), heavy_words
    for r in sorted(histogram, key=lambda r: -r.size):
        if r.words > room:
            break
        least, room = r.size, room - r.words
    heavy = words.where(size >= F.lit(least)).toArrow()  # at most heavy_words rows
    slices = min(1 << 16, max(slots(spark), (n or 0) // SLICE_WORDS))
    grams = written(count_grams(training, slices), "grams", "zstd")
    shared = spark.sparkContext.broadcast((heavy.column(0).to_pylist(), heavy.column(1).to_numpy()))

    def run(frames):
        import pyarrow as pa

        import pyarrow.compute as pc

        names, counts = shared.value
        gain = dict(zip((w.encode() for w in names), np.log10(counts + 1.0).tolist(), strict=True))
        asked = pa.list_(pa.struct([("slice", pa.int32()), ("grams", pa.binary())]))

        def closed(held: list[bytes]) -> list[dict]:
            parts = [pc.unique(pa.array(codes[own])).to_numpy() for codes, own in _deep_codes(held)]
            distinct = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)
            return [{"slice": number, "grams": _packed(distinct[at])} for number, at in _sliced(distinct, slices)]

        def with_chunk(columns: list, last: list[dict] | None):
            """The columns of a record batch with its chunk; the chunk's grams go with its last row."""
            rows = len(columns[0])
            ends = [chunk] * rows, [None] * (rows - 1) + [last]
            return pa.RecordBatch.from_arrays([*columns, pa.array(ends[0], pa.int64()), pa.array(ends[1], asked)], [*names_out, "chunk", "wanted"])

        chunk, held, size, waiting = None, [], 0, None
        for batch in frames:
            if not batch.num_rows:
                continue
            if waiting is not None:
                full = size >= CHUNK
                yield with_chunk(waiting, closed(held) if full else None)
                if full:
                    chunk, held, size = None, [], 0
            if chunk is None:
                chunk = batch.column(0)[0].as_py()
            rows = {k: [] for k in ("n_tokens", "n_known", "known_log", "n_bytes")}
            rare_words, rare_counts, rare_ends = [], [], [0]
            for text in batch.column(2).to_pylist():
                tokens = known = 0
                known_log = 0.0
                counts = word_counts(text)
                counts[END] += 1
                for word, n in counts.items():
                    tokens += n
                    g = gain.get(word)
                    if g is None:
                        rare_words.append(word)
                        rare_counts.append(n)
                    else:
                        known += n
                        known_log += n * g
                rare_ends.append(len(rare_words))
                data = text.encode()
                for column, value in zip(rows.values(), (tokens, known, known_log, len(data)), strict=True):
                    column.append(value)
                held.append(data)
                size += len(data)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
            pairs = pa.StructArray.from_arrays([pa.array(rare_words, pa.string()), pa.array(rare_counts, pa.int64())], ["word", "n"])
            rare = pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), pairs)
            columns = [pa.array(x, k) for x, k in zip(rows.values(), kinds, strict=True)]
            names_out = ["row", "doc_id", "held_out", "text", *rows, "rare"]
            waiting = [batch.column(0), batch.column(1), batch.column(3), batch.column(2), *columns, rare]
        if waiting is not None:
            yield with_chunk(waiting, closed(held))

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = frame.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "held_out").mapInArrow(
        run, f"row long, doc_id {kind}, held_out boolean, text string, n_tokens long, n_known long, known_log double, n_bytes long, rare array<struct<word:string,n:long>>, "
        "chunk long, wanted array<struct<slice:int,grams:binary>>",
    )
    scored = written(scored, "scored", "zstd")

    def meet(texts, found):
        import pyarrow as pa

        if not texts.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        grams = np.concatenate([np.empty(0, np.int64), *(_unpacked(g) for g in found.column(1).to_pylist())])
        logs = np.concatenate([np.empty(0, "<f4"), *(np.frombuffer(x, "<f4") for x in found.column(2).to_pylist())])
        return pa.table({"row": texts.column(1).combine_chunks(), "score": text_logs([t.encode() for t in texts.column(2).to_pylist()], grams, logs)})

    logs = gram_logs(grams, scored.select("chunk", F.inline("wanted")))
    scores = scored.select("chunk", "row", "text").groupBy("chunk").cogroup(logs.groupBy("chunk")).applyInArrow(meet, "row long, score double")
    rare = scored.select("row", F.inline("rare")).join(words.where(size < F.lit(least)), "word")
    rare = rare.groupBy("row").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_log"))
    out = scored.drop("rare", "text", "chunk", "wanted").join(scores, "row").join(rare, "row", "left")
    base = F.col("known_log") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("n_bytes"))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
        bits.alias("bits_per_byte"),
    )
