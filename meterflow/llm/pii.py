r"""Personal data in texts, with SQL functions only.

Regular expressions propose spans; the Luhn checksum (cards), mod-97 (IBANs), value ranges (IP
addresses, social security numbers) confirm them; words near a span raise its score.

Kinds, in the order that breaks ties between spans with one start:

* base, always kept once confirmed: email, ip, card, phone;
* added: iban (15 to 34 characters up to the end of a word, mod-97 equal to 1, the longest) and ssn (ddd-dd-dddd with valid ranges), which
  needs a context word near it to reach the score threshold.

Offsets are code points, end exclusive. Null texts count as empty and have no spans. Repeated rows
each get their own result. An empty table gives an empty table. Columns of the input other than the
id and the text are not read, so their names cannot clash.

Spans are gathered in blocks of BLOCK matches and blocks are joined at the end, so that a text with very
many of them costs in proportion to their number (an array that grows by one is copied each time).

How a span gets its position without a UDF: `split` cuts a text at the matches of a pattern and
`regexp_extract_all` returns the matches, so text = gap0 match0 gap1 match1 ...; lengths give the
offsets. All patterns are written so that Java needs neither recursion nor a second pass over a run
of characters: quantifiers are possessive and a match may start only where a run starts (or where the
previous match ended, `\G`). Both changes keep the leftmost non-overlapping matches: had the
character before a start been part of the run, the match would have started there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, text_of

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Where an IBAN may start; how far it goes, its checksum says.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})"
IBAN_RUN = r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
#: A cheap test of the whole text per kind; a text without it has no match, so the costly pattern is skipped.
NEEDS = {
    "email": "@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]",
    "phone": r"\+[0-9]",
    "iban": "[A-Z]{2}[0-9]{2}",
    "ssn": "[0-9]-[0-9]{2}-[0-9]",
}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN}
BASE = ("email", "ip", "card", "phone")
#: Words that speak for a kind when they stand near a span, in lower case.
CONTEXT = {
    "email": "e-?mail|mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|mastercard|amex|credit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social|security",
}
#: The score a confirmed span starts with.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
CONTEXT_BONUS = 0.2
THRESHOLD = 0.5
NEAR = 48  #: characters on either side in which context words count
BLOCK = 256  #: matches folded at a time
SPANS = "array<struct<start:int,ord:int,end:int,kind:string,score:double>>"
IBAN_TAIL = 60  #: characters an IBAN may have after its first four, with blanks between


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(items: Column) -> Column:
    """An array as an array of arrays of at most BLOCK items."""
    last = lambda of: F.greatest(F.floor((F.size(of) - 1) / BLOCK).cast("int"), F.lit(0))
    return _let(items, lambda of: F.transform(F.sequence(F.lit(0), last(of)), lambda b: F.slice(of, b * BLOCK + 1, F.lit(BLOCK))))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _mod97(iban: Column) -> Column:
    """The remainder of an IBAN: first four characters moved to the end, letters as 10 to 35."""
    code = F.regexp_replace(iban, "\x20", "")
    moved = F.concat(F.substr(code, F.lit(5)), F.left(code, F.lit(4)))
    values = F.filter(F.split(moved, ""), lambda c: c != "")
    step = lambda acc, c: F.when(
        c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97
    ).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(values, F.lit(0), step)


def _iban(run: Column) -> Column:
    """The longest part of a run, from its start and up to where a word ends, whose checksum is right; else null."""
    ends = F.filter(F.sequence(F.length(run), F.lit(15), F.lit(-1)), lambda n: F.regexp_like(F.substr(run, n, F.lit(2)), F.lit(r"^[A-Z0-9](?:[^A-Za-z0-9]|$)")))
    parts = F.transform(ends, lambda n: F.left(run, n))
    return F.get(F.filter(parts, lambda m: _confirmed("iban", m)), F.lit(0))


def _confirmed(kind: str, m: Column) -> Column:
    digits = _digits(m)
    if kind == "ip":
        value = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(value(p)) < 3) | ((F.length(value(p)) == 3) & (value(p) <= "255")))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(m, "\x20", "")).between(15, 34) & (_mod97(m) == 1)
    if kind == "ssn":
        return (
            ~F.left(m, F.lit(3)).isin("000", "666")
            & (F.left(m, F.lit(1)) != "9")
            & (F.substr(m, F.lit(5), F.lit(2)) != "00")
            & (F.right(m, F.lit(4)) != "0000")
        )
    return F.lit(True)


def _score(kind: str, before: Column, after: Column) -> Column:
    """before and after: at least NEAR characters of the text, or all there are."""
    near = F.lower(F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), F.left(after, F.lit(NEAR))))
    found = F.regexp_like(near, F.lit(f"(?<![a-z])(?:{CONTEXT[kind]})(?![a-z])"))
    return F.lit(PRIOR[kind]) + F.when(found, CONTEXT_BONUS).otherwise(0.0)


def _spans(kind: str, gaps: Column, matches: Column) -> Column:
    """The confirmed spans of one kind: array<struct<start,ord,end,kind,score>>, in one pass over the matches."""
    order = list(PATTERNS).index(kind)
    reach = NEAR + (IBAN_TAIL + 1 if kind == "iban" else 0)
    cut = lambda x: F.left(x, F.lit(reach))
    # What follows a match within reach lies in the next gaps and matches; a match has two characters at least.
    heads = F.transform(F.arrays_zip(F.slice(gaps, 2, F.size(matches)).alias("g"), F.slice(matches, 2, F.size(matches)).alias("m")), lambda x: F.concat(cut(x["g"]), F.coalesce(cut(x["m"]), F.lit(""))))
    follow = _let(heads, lambda all_heads: F.transform(matches, lambda m, i: cut(F.array_join(F.slice(all_heads, i + 1, reach // 2 + 1), ""))))
    pieces = F.arrays_zip(gaps.alias("g"), matches.alias("m"), follow.alias("after"))
    none = F.array().cast(SPANS)

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["g"])
        upto = start + F.length(x["m"])
        before = F.right(F.concat(acc["tail"], F.right(x["g"], F.lit(NEAR))), F.lit(NEAR))
        tail = F.right(F.concat(before, x["m"]), F.lit(NEAR))
        if kind == "iban":
            # The run is read to the character after it, so that its last word is known to end there.
            ahead = F.concat(x["m"], x["after"])
            run = F.regexp_extract(ahead, IBAN_RUN, 0)
            found = _iban(F.left(ahead, F.length(run) + 1))
            end = start + F.coalesce(F.length(found), F.lit(0))
            score = _score(kind, before, F.substr(ahead, F.length(found) + 1, F.lit(NEAR)))
            keep = found.isNotNull() & (score >= THRESHOLD) & (start >= acc["free"])
        else:
            end = upto
            score = _score(kind, before, x["after"])
            keep = _confirmed(kind, x["m"]) if kind in BASE else _confirmed(kind, x["m"]) & (score >= THRESHOLD)
        span = F.struct(
            start.cast("int").alias("start"),
            F.lit(order).alias("ord"),
            end.cast("int").alias("end"),
            F.lit(kind).alias("kind"),
            score.alias("score"),
        )
        out = F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        free = F.when(keep, end).otherwise(acc["free"])
        return F.struct(upto.cast("int").alias("pos"), tail.alias("tail"), free.cast("int").alias("free"), out.alias("out"))

    pieces = F.filter(pieces, lambda x: x["m"].isNotNull())
    state = ("pos", "tail", "free")
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("tail"), F.lit(0).alias("free"), F.array().cast(f"array<{SPANS}>").alias("outs"))

    def block(acc: Column, some: Column) -> Column:
        done = F.aggregate(some, F.struct(*(acc[c].alias(c) for c in state), none.alias("out")), step)
        return _let(done, lambda r: F.struct(*(r[c].alias(c) for c in state), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))

    folded = F.flatten(F.aggregate(_blocks(pieces), start, block)["outs"])
    return F.when(matches.isNull() | (F.size(matches) == 0), none).otherwise(folded)


def find_spans(docs: DataFrame, text: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """docs with one column more, `spans`: array<struct<start,ord,end,kind,score>> sorted by start, then kind."""
    own = [F.col(quoted(c)) for c in docs.columns if c not in ("spans",)]
    flagged = docs.select(*own, text_of(text).alias("__t")).withColumns({f"__need_{k}": F.regexp_like("__t", F.lit(NEEDS[k])) for k in kinds})
    cut = flagged.withColumns(
        {f"__g_{k}": F.when(F.col(f"__need_{k}"), F.split("__t", PATTERNS[k], -1)) for k in kinds}
        | {f"__m_{k}": F.when(F.col(f"__need_{k}"), F.regexp_extract_all("__t", F.lit(PATTERNS[k]), F.lit(0))) for k in kinds}
    )
    found = cut.withColumns({f"__s_{k}": _spans(k, F.col(f"__g_{k}"), F.col(f"__m_{k}")) for k in kinds})
    return found.select(*own, F.array_sort(F.concat(*(F.col(f"__s_{k}") for k in kinds))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the spans found replaced by their kind in angle brackets, in the column `redacted`.

    Of overlapping spans the one that starts first is replaced; spans that begin inside it are not.
    """
    found = find_spans(docs, text)
    t = text_of(text)
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("outs"))

    def block(acc: Column, some: Column) -> Column:
        """Spans are cut from the stretch of text that the block covers, not each from the whole text."""
        upto = F.array_max(F.transform(some, lambda s: s["end"]))

        def fold(stretch: Column) -> Column:
            def step(own: Column, s: Column) -> Column:
                piece = F.concat(F.substr(stretch, own["pos"] - acc["pos"] + 1, s["start"] - own["pos"]), F.lit("<"), s["kind"], F.lit(">"))
                return F.when(s["start"] >= own["pos"], F.struct(s["end"].alias("pos"), F.concat(own["out"], F.array(piece)).alias("out"))).otherwise(own)

            return F.aggregate(some, F.struct(acc["pos"].alias("pos"), F.array().cast("array<string>").alias("out")), step)

        done = _let(F.substr(t, acc["pos"] + 1, upto - acc["pos"]), fold)
        return _let(done, lambda r: F.struct(F.coalesce(r["pos"], acc["pos"]).alias("pos"), F.concat(acc["outs"], F.array(F.array_join(r["out"], ""))).alias("outs")))

    folded = F.aggregate(_blocks(F.col("spans")), start, block)
    whole = _let(folded, lambda r: F.concat(F.array_join(r["outs"], ""), F.substr(t, r["pos"] + 1, F.length(t))))
    return found.withColumn("redacted", F.when(F.size("spans") == 0, t).otherwise(whole))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per row of docs; `scores` follows, in the order of `spans`."""
    found = find_spans(docs.select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(count(k) for k in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
