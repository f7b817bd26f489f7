"""Byte-level BPE encoding and decoding of whole texts, long ones in overlapping chunks.

A text of up to `chunk` characters is one chunk. A longer one is cut into chunks of `chunk`
characters that each read `overlap` characters further; the chunks are dealt to tasks of their own
and pre-tokenised there. The pattern never looks back, so the matches from a position on depend only
on what follows it: once two neighbouring chunks share a pre-token boundary inside their overlap,
they agree from there on, and the first shared boundary is where the text is stitched. Where an
overlap has no shared boundary (one endless word, say), the stitcher goes on matching from its last
sure boundary until it meets the later chunk's boundaries. A chunk's boundaries near its end are not
trusted: the pattern may look, or match, past it.

Where the library's pattern engine and ours may differ on a character (pretokens.py), the stretch
between two sure cuts around it is one piece; chunks are stitched around it all the same.

After stitching, each piece is encoded by the ranks; ids of a piece met before come from a table of
bounded size. Decoding joins the raw bytes of the ids, so a character split between ids comes back
whole.

Null texts count as empty: no ids, no bytes. Repeated rows each get their own result. An empty table
gives an empty table. Further columns of the input pass through `roundtrip` unread by the coder;
clashes with its own names are the caller's to rename (`encode_decode` reads only id and text).
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, quoted, released, slots, text_of
from .pretokens import Splitter

#: Characters of a chunk and of what it reads beyond its end.
CHUNK, OVERLAP = 1 << 15, 256
TABLE_ENTRIES = 200_000
#: Longer pieces are encoded anew each time.
TABLE_CHARS = 64


def load_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Coder:
    """Encodes pieces by the ranks of a file and decodes ids; one per task."""

    def __init__(self, path: str, pattern: str, table_entries: int = TABLE_ENTRIES):
        import tiktoken

        ranks = load_ranks(path)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: t for t, i in ranks.items()}
        #: One object per id, which all entries of the table share.
        self.own = {i: i for i in self.bytes_of}
        self.splitter = Splitter(pattern)
        self.table: dict[str, tuple[int, ...]] = {}
        self.table_entries = table_entries

    def boundaries(self, text: str, start: int = 0) -> list[int]:
        """The ends of the pre-tokens from `start` on."""
        return list(self.splitter.ends(text, start))

    def pieces(self, text: str) -> list[str]:
        return self.splitter.pieces(text)

    def encode(self, pieces: list[str]) -> list[int]:
        table, ids = self.table, []
        for piece in pieces:
            got = table.get(piece)
            if got is None:
                got = tuple(map(self.own.__getitem__, self.encoding.encode_ordinary(piece)))
                if len(piece) <= TABLE_CHARS:
                    if len(table) >= self.table_entries:
                        table.clear()
                    table[piece] = got
            ids += got
        return ids

    def encode_text(self, text: str) -> list[int]:
        return self.encode(self.pieces(text))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def cut(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, str]]:
    """(start, what a chunk reads); the next chunk starts `chunk` characters later."""
    for start in range(0, max(1, len(text)), chunk):
        yield start, text[start : start + chunk + overlap]


def stitch(text: str, chunks: list[tuple[int, list[int]]], coder: Coder, overlap: int = OVERLAP) -> list[int]:
    """The boundaries of the whole text from those of its chunks: (start, ends within the text)."""
    out: list[int] = list(chunks[0][1])
    for k in range(1, len(chunks)):
        start, ends = chunks[k]
        reads_to = start + overlap  # where the chunk before stops reading
        if reads_to < len(text):
            # What lies close to the end of the reading is not sure; one sure boundary is enough to go on from.
            del out[bisect.bisect_left(out, reads_to) :]
            if out:
                out.pop()
        known = [start, *ends] if start == 0 else ends
        here = set(known)
        at = bisect.bisect_right(out, start)
        meet = next((x for x in out[at:] if x in here), None)
        if meet is None:
            position = out[-1] if out else 0
            for end in coder.splitter.ends(text, position):
                out.append(end)
                if end in here:
                    meet = end
                    break
            else:
                return out  # matched to the end of the text by itself
        del out[bisect.bisect_right(out, meet) :]
        out += known[bisect.bisect_right(known, meet) :]
    return out


def digest(ids: list[int], raw: bytes) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()


def _codes(coder: Coder, text: str, ids: list[int], with_ids: bool) -> dict:
    raw = coder.decode(ids)
    n, ids_sha, raw_sha = digest(ids, raw)
    out = {"n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": raw_sha}
    return out | ({"ids": ids, "decoded": raw.decode("utf-8")} if with_ids else {})


def encode_decode(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    with_ids: bool = False,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """(id, keep..., n_tokens, ids_sha256, decoded_sha256) for each row; with_ids adds ids and the decoded text."""
    import pyarrow as pa

    lean(docs.sparkSession)
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id_col, *keep)}
    result = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    carried = F.struct(*(F.col(quoted(c)) for c in kinds)).alias("carried")
    frame = docs.select(carried, text_of(text).alias("text"))
    shape = "carried struct<" + ",".join(f"{quoted(c)}:{k}" for c, k in kinds.items()) + ">"
    long_text = F.length("text") > chunk

    def short(frames):
        released()
        coder = None
        for batch in frames:
            coder = coder or Coder(path, pattern)
            rows = [_codes(coder, t, coder.encode_text(t), with_ids) for t in batch.column(1).to_pylist()]
            yield _batch(pa, batch.column(0), rows, with_ids)

    def to_chunks(frames):
        for batch in frames:
            carried_rows, texts = batch.column(0), batch.column(1)
            row_ids = batch.column(2)
            for i in range(batch.num_rows):
                value = texts[i].as_py()
                parts = list(cut(value, chunk, overlap))
                for j in range(0, len(parts), 64):
                    some = parts[j : j + 64]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row_ids[i].as_py()] * len(some), pa.int64()),
                            pa.array([s for s, _ in some], pa.int64()),
                            pa.array([len(value)] * len(some), pa.int64()),
                            pa.array([p for _, p in some], pa.string()),
                            carried_rows.take(pa.array([i] * len(some))) if j == 0 else pa.nulls(len(some), carried_rows.type),
                        ],
                        ["row", "start", "size", "part", "carried"],
                    )

    def pre_tokenise(frames):
        released()
        coder = None
        for batch in frames:
            coder = coder or Coder(path, pattern)
            starts = batch.column(1).to_pylist()
            ends = [[s + e for e in coder.boundaries(p)] for s, p in zip(starts, batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.list_(pa.int64()))], [*batch.schema.names, "ends"])

    def join_chunks(table):
        coder = _coder(path, pattern)
        order = sorted(range(table.num_rows), key=table.column("start").to_pylist().__getitem__)
        table = table.take(pa.array(order))
        starts, parts = table.column("start").to_pylist(), table.column("part").to_pylist()
        whole = "".join(p[:chunk] for p in parts[:-1]) + parts[-1]
        ends = stitch(whole, list(zip(starts, table.column("ends").to_pylist(), strict=True)), coder, overlap)
        ids = coder.encode([whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)])
        out = _batch(pa, table.column("carried").slice(0, 1).combine_chunks(), [_codes(coder, whole, ids, with_ids)], with_ids)
        return pa.Table.from_batches([out])

    done = frame.where(~long_text).mapInArrow(short, f"{shape}, {result}")
    rows = frame.where(long_text).withColumn("row", F.monotonically_increasing_id())
    parts = rows.mapInArrow(to_chunks, f"row long, start long, size long, part string, {shape}")
    ends = parts.repartition(slots(docs.sparkSession), "row", "start").mapInArrow(pre_tokenise, f"row long, start long, size long, part string, {shape}, ends array<long>")
    stitched = ends.groupBy("row").applyInArrow(join_chunks, f"{shape}, {result}")
    return done.unionByName(stitched).select("carried.*", *[c.split()[0] for c in result.split(", ")])


def _batch(pa, carried, rows: list[dict], with_ids: bool):
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    kinds |= {"ids": pa.list_(pa.int32()), "decoded": pa.string()} if with_ids else {}
    return pa.RecordBatch.from_arrays([carried, *(pa.array([r[c] for r in rows], k) for c, k in kinds.items())], ["carried", *kinds])


def _coder(path: str, pattern: str) -> Coder:
    """The worker's coder: groups come one by one, so it is kept between them."""
    held = getattr(_coder, "held", None)
    if held is None or held[0] != (path, pattern):
        held = _coder.held = ((path, pattern), Coder(path, pattern))
    return held[1]


def roundtrip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 added (replacing columns of those names); the text is the decoded one."""
    own = [c for c in docs.columns if c not in ("text", "n_tokens", "ids_sha256", "decoded_sha256")]
    out = encode_decode(docs, path, pattern, keep=tuple(c for c in own if c != "doc_id"), with_ids=True)
    return out.withColumnRenamed("decoded", "text").select(*[quoted(c) for c in docs.columns if c in out.columns or c == "text"], "n_tokens", "ids_sha256", "decoded_sha256")
