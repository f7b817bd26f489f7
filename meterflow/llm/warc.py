r"""WARC derivatives: response records become linked metadata and plain-text conversion records.

A response row has record_id, target_uri, warc_date, status_line, http_headers (lines with \r\n) and
payload (the body, as bytes or as text), and may have block_digest and payload_digest, the digests its
source stated. From each, `derive` makes

* a metadata record (application/warc-fields): the source's status line and headers, its digests,
  title, language and number of links, WARC-Refers-To the response;
* for HTML and plain text, a conversion record (text/plain): the visible text, WARC-Refers-To the
  response, WARC-Concurrent-To the metadata record.

Record ids are UUIDs made from SHA-256 of the kind and the source's id, so a rerun after a lost
executor makes the same records. Digests are "sha256:" and lowercase hex, over blocks and payloads in
UTF-8. Everything is row by row with SQL functions: no exchange, and as many tasks as there are splits.

Null payloads count as empty (an empty body is still a response, and has an empty conversion). A
null target or id becomes an empty header and stays null in its own column. Repeated rows give
repeated records. Empty tables give empty tables. Other columns are not read.

`records_of` and `serialised` read and write WARC files (plain or gzip, a member per record). A file is
inflated as its records are read, in time proportional to its size; bodies stay bytes.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, lean, text_of

CRLF = "\r\n"
#: The date of pages that carry none.
NO_DATE = "1970-01-01T00:00:00Z"
#: Character references turned back, in this order.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
#: Patterns in the syntax that Java and RE2 share: (pattern, replacement).
TO_TEXT = (
    (r"(?is)<!--.*?-->|<(?:script|style|noscript|template)\b[^>]*>.*?</(?:script|style|noscript|template)\s*>|<head\b[^>]*>.*?</head\s*>", " "),
    (r"(?i)<(?:br|/?p|/?div|/?li|/?ul|/?ol|/?tr|/?table|/?h[1-6]|/?article|/?section|/?nav|/?header|/?footer|/?blockquote|/?pre)\b[^>]*>", "\n"),
    (r"<[/!?A-Za-z][^>]*>", ""),
    (r"[ \t\r\f]*\n[ \t\r\f\n]*", "\n"),
    (r"[ \t\r\f]+", " "),
)
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
LANG = r"""(?i)<html\b[^>]*\blang=["']?([A-Za-z-]+)"""
LINK = r"""(?i)<a\s[^>]*\bhref="""


def responses_of(pages: DataFrame, date: str = NO_DATE) -> DataFrame:
    """Response rows for a table of pages (page_id, url, html), as a crawler would have stored them."""
    body = text_of("html")
    size = F.octet_length(body).cast("string")
    headers = F.concat(F.lit(f"Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF))
    return pages.select(
        "page_id",
        _uuid(F.concat(F.lit("response|"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("|"), text_of("url"))).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.lit("HTTP/1.1 200 OK").alias("status_line"),
        headers.alias("http_headers"),
        body.alias("payload"),
    )


def _uuid(name: Column) -> Column:
    h = F.sha2(name, 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cuts)), F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def _decoded(body: Column, headers: Column) -> Column:
    """The body as text by the charset that the headers name."""
    charset = F.lower(F.regexp_extract(headers, r"""(?im)^content-type:[^\r\n]*charset=["']?([A-Za-z0-9_.:-]+)""", 1))
    latin = charset.isin("iso-8859-1", "iso8859-1", "latin1", "latin-1", "us-ascii", "ascii", "windows-1252", "cp1252")
    return F.when(latin, F.decode(body, "ISO-8859-1")).otherwise(F.make_valid_utf8(body.cast("string")))


def plain_text(html: Column) -> Column:
    out = html
    for pattern, replacement in TO_TEXT:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(replacement))
    out = F.btrim(out, F.lit(" \n"))
    for reference, character in REFERENCES:
        out = F.replace(out, F.lit(reference), F.lit(character))
    return out


def derive(responses: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Metadata and conversion records, two rows for a textual response and one for any other."""
    kind = F.lower(F.regexp_extract("http_headers", r"(?im)^content-type:[ \t]*([^;\r\n]*)", 1))
    as_bytes = responses.schema["payload"].dataType.simpleString() == "binary"
    stated = {c: F.col(c).cast("string") if c in responses.columns else F.lit(None).cast("string") for c in ("block_digest", "payload_digest")}
    source = responses.select(
        F.col(id_col).alias("id"),
        stated["block_digest"].alias("stated_block_digest"),
        stated["payload_digest"].alias("stated_payload_digest"),
        "record_id",
        "target_uri",
        "warc_date",
        F.coalesce("status_line", F.lit("")).alias("status_line"),
        F.coalesce("http_headers", F.lit("")).alias("source_headers"),
        (F.coalesce("payload", F.lit(b"")) if as_bytes else text_of("payload").cast("binary")).alias("raw"),
        (_decoded(F.coalesce("payload", F.lit(b"")), F.coalesce("http_headers", F.lit(""))) if as_bytes else text_of("payload")).alias("payload"),
        F.coalesce(kind, F.lit("")).alias("media"),
    ).withColumn("source_block", F.concat(F.concat("status_line", F.lit(CRLF), "source_headers", F.lit(CRLF)).cast("binary"), "raw"))
    facts = source.select(
        "*",
        _digest(F.col("raw")).alias("payload_digest"),
        _digest(F.col("source_block")).alias("response_digest"),
        F.when(F.trim("media").isin("text/html", "application/xhtml+xml"), plain_text(F.col("payload"))).when(F.trim("media").startswith("text/"), F.col("payload")).alias("plain"),
        F.regexp_replace(F.regexp_extract("payload", TITLE, 1), r"[ \t\r\n\f]+", " ").alias("title"),
        F.regexp_extract("payload", LANG, 1).alias("language"),
        F.size(F.regexp_extract_all("payload", F.lit(LINK), F.lit(0))).alias("links"),
        _uuid(F.concat(F.lit("metadata|"), F.coalesce("record_id", F.lit("")))).alias("metadata_id"),
        _uuid(F.concat(F.lit("conversion|"), F.coalesce("record_id", F.lit("")))).alias("conversion_id"),
    ).drop("payload", "raw", "source_block")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    described = F.concat(
        line("source-status", F.col("status_line")),
        F.col("source_headers"),
        line("source-block-digest", F.col("response_digest")),
        line("source-payload-digest", F.col("payload_digest")),
        line("title", F.col("title")),
        line("language", F.col("language")),
        line("links", F.col("links").cast("string")),
    )
    records = facts.select("*", described.alias("described")).select(
        "id",
        "record_id",
        "target_uri",
        "warc_date",
        "source_headers",
        "payload_digest",
        "stated_block_digest",
        "stated_payload_digest",
        F.inline(
            F.filter(
                F.array(
                    F.struct(F.col("metadata_id").alias("own_id"), F.lit("metadata").alias("warc_type"), F.lit(None).cast("string").alias("concurrent_to"), F.lit("application/warc-fields").alias("content_type"), F.col("described").alias("block")),
                    F.struct(F.col("conversion_id").alias("own_id"), F.lit("conversion").alias("warc_type"), F.col("metadata_id").alias("concurrent_to"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("plain").alias("block")),
                ),
                lambda r: r["block"].isNotNull(),
            )
        ),
    )
    return records.select(
        F.col("id").alias(id_col),
        F.col("own_id").alias("record_id"),
        "warc_type",
        F.col("record_id").alias("refers_to"),
        "concurrent_to",
        "target_uri",
        "warc_date",
        "content_type",
        F.octet_length("block").cast("long").alias("content_length"),
        _digest(F.col("block")).alias("block_digest"),
        F.col("payload_digest").alias("source_payload_digest"),
        "stated_block_digest",
        "stated_payload_digest",
        "source_headers",
        "block",
    )


def oracle() -> str:
    """The query over pages as DuckDB SQL: the same patterns, spelled for its functions."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    lit = lambda s: {"\n": "chr(10)"}.get(s, quoted(s))
    plain = "payload"
    for pattern, replacement in TO_TEXT:
        plain = f"regexp_replace({plain}, {quoted(pattern)}, {lit(replacement)}, 'g')"
    plain = f"trim({plain}, ' ' || chr(10))"
    for reference, character in REFERENCES:
        plain = f"replace({plain}, {quoted(reference)}, {quoted(character)})"
    uuid = lambda x: f"(SELECT '<urn:uuid:' || concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) || '>' FROM (SELECT sha256({x}) AS h))"
    crlf = "chr(13) || chr(10)"
    return f"""
    WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
    s AS (SELECT *, 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(payload)::VARCHAR || {crlf} AS source_headers,
                 {uuid("'response|' || coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')")} AS response_id FROM p),
    f AS (SELECT *, 'sha256:' || sha256(payload) AS payload_digest,
                 'sha256:' || sha256('HTTP/1.1 200 OK' || {crlf} || source_headers || {crlf} || payload) AS response_digest,
                 {plain} AS plain,
                 regexp_replace(regexp_extract(payload, {quoted(TITLE)}, 1), '[ \\t\\r\\n\\f]+', ' ', 'g') AS title,
                 regexp_extract(payload, {quoted(LANG)}, 1) AS language,
                 len(regexp_extract_all(payload, {quoted(LINK)})) AS links,
                 {uuid("'metadata|' || response_id")} AS metadata_id, {uuid("'conversion|' || response_id")} AS conversion_id FROM s),
    r AS (SELECT page_id, metadata_id AS record_id, 'metadata' AS warc_type, response_id AS refers_to, NULL::VARCHAR AS concurrent_to, url AS target_uri,
                 'application/warc-fields' AS content_type, payload_digest, source_headers,
                 'source-status: HTTP/1.1 200 OK' || {crlf} || source_headers || 'source-block-digest: ' || response_digest || {crlf}
                 || 'source-payload-digest: ' || payload_digest || {crlf} || 'title: ' || title || {crlf} || 'language: ' || language || {crlf}
                 || 'links: ' || links::VARCHAR || {crlf} AS block FROM f
          UNION ALL
          SELECT page_id, conversion_id, 'conversion', response_id, metadata_id, url, 'text/plain; charset=utf-8', payload_digest, source_headers, plain FROM f)
    SELECT page_id, record_id, warc_type, refers_to, concurrent_to, target_uri, '{NO_DATE}' AS warc_date, content_type,
           strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest, payload_digest AS source_payload_digest,
           NULL::VARCHAR AS stated_block_digest, NULL::VARCHAR AS stated_payload_digest, source_headers, block FROM r
    """


# Files -------------------------------------------------------------------------------------------


def serialised(record: dict) -> bytes:
    """One record of `derive` as WARC/1.1 bytes."""
    names = (
        ("WARC-Type", "warc_type"),
        ("WARC-Record-ID", "record_id"),
        ("WARC-Refers-To", "refers_to"),
        ("WARC-Concurrent-To", "concurrent_to"),
        ("WARC-Target-URI", "target_uri"),
        ("WARC-Date", "warc_date"),
        ("WARC-Block-Digest", "block_digest"),
        ("Content-Type", "content_type"),
    )
    block = record["block"].encode()
    head = "".join(f"{n}: {record[c]}{CRLF}" for n, c in names if record.get(c) is not None)
    return f"WARC/1.1{CRLF}{head}Content-Length: {len(block)}{CRLF}{CRLF}".encode() + block + (CRLF * 2).encode()


class Inflated:
    """The bytes of a WARC file, plain or gzip, from front to back; what was read is let go."""

    STEP = 1 << 16

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.start = memoryview(data), 0, bytearray(), 0
        self.member = zlib.decompressobj(31) if bytes(data[:2]) == b"\x1f\x8b" else None

    def _more(self) -> bool:
        """Another step of bytes, if there are any."""
        if self.at >= len(self.data):
            return False
        step = self.data[self.at : self.at + self.STEP]
        self.at += len(step)
        if self.start > self.STEP:
            del self.held[: self.start]
            self.start = 0
        if self.member is None:
            self.held += step
            return True
        self.held += self.member.decompress(step)
        if self.member.eof:
            # What follows the member within this step is the next one's.
            self.at -= len(self.member.unused_data)
            self.member = zlib.decompressobj(31)
        return True

    def find(self, mark: bytes, begin: int = 0) -> int:
        """How far ahead the mark is, or -1; from `begin` ahead."""
        while True:
            found = self.held.find(mark, self.start + begin)
            if found >= 0:
                return found - self.start
            begin = max(begin, len(self.held) - self.start - len(mark) + 1)
            if not self._more():
                return -1

    def take(self, size: int) -> bytes | None:
        """The next `size` bytes, or None if the file ends before."""
        while len(self.held) - self.start < size:
            if not self._more():
                return None
        out = bytes(self.held[self.start : self.start + size])
        self.start += size
        return out


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of a WARC file, one by one; a cut-off last record is left out."""
    source = Inflated(data)
    try:
        while (ahead := source.find(b"WARC/")) >= 0:
            source.take(ahead)
            end = source.find(b"\r\n\r\n")
            if end < 0:
                return
            lines = source.take(end + 4)[:-4].decode("utf-8", "replace").split(CRLF)[1:]
            headers = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines)}
            block = source.take(int(headers.get("content-length", "0")))
            if block is None:
                return
            yield headers, block
    except zlib.error:  # the file was cut off, or is damaged from here on
        return


def read_responses(spark, path: str) -> DataFrame:
    """Response rows of the WARC files under path, bodies as bytes (a task takes a file, of under 2 GB, and inflates it record by record)."""

    def run(frames):
        import pyarrow as pa

        kinds = [pa.binary() if c == "payload" else pa.string() for c in FIELDS]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], FIELDS)

        for batch in frames:
            for i in range(batch.num_rows):
                name, rows, size = batch.column(0)[i].as_py(), [], 0
                for k, (headers, block) in enumerate(records_of(batch.column(1)[i].as_buffer())):
                    if headers.get("warc-type") == "response":
                        head, _, body = block.partition(b"\r\n\r\n")
                        status, _, lines = head.decode("utf-8", "replace").partition(CRLF)
                        own = (headers.get(n) for n in ("warc-record-id", "warc-target-uri", "warc-date"))
                        rows.append((f"{name}#{k}", *own, status, lines + CRLF if lines else "", body, headers.get("warc-block-digest"), headers.get("warc-payload-digest")))
                        size += len(body)
                    if len(rows) == 256 or size > BATCH_BYTES:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    files = lean(spark).read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'payload' else 'string'}" for c in FIELDS))


FIELDS = ["position", "record_id", "target_uri", "warc_date", "status_line", "http_headers", "payload", "block_digest", "payload_digest"]


def write_files(records: DataFrame, path: str) -> DataFrame:
    """Writes records as gzip members, a row of `content` per batch, under path; returns the table written."""

    def run(frames):
        import pyarrow as pa

        for batch in frames:
            members = [gzip.compress(serialised(r), mtime=0) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary()), pa.array([len(members)], pa.int64())], ["content", "records"])

    records.mapInArrow(run, "content binary, records long").write.mode("overwrite").parquet(path)
    return records.sparkSession.read.parquet(path)
