import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from meterflow.llm.pii import digest, find_spans, redact

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def pieces():
    rng = random.Random(7)
    parts = ["a@b.c", "_x@y.z", "a.b+c@d-e.f.g", "@", "1.2.3.4", "256.1.1.1", "0001.2.3.04", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1111", "5500005555555559", "+1 (555) 123-4567", "+49 30 901820", "++1 234567890",
             "+1+2", "12 34", " ", "  ", "é", "😀", "\n", "x", "-", ".", "123-45-6789", "SSN", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "id", ",", "0", "9"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(600)]


@pytest.fixture(scope="module")
def texts():
    return pieces()


def test_base_spans_equal_brute_force(docs, texts):
    rows = digest(docs(texts)).collect()
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in want) for kind in BASE), texts[r.doc_id]
        coded = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(coded.encode()).hexdigest(), texts[r.doc_id]
        assert set(coded.split(",")) <= set(r.spans.split(",")) or not coded


def test_added_kinds_need_checksum_or_context(docs):
    some = ["DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00", "SSN 123-45-6789", "part 123-45-6789", "SSN 000-45-6789"]
    got = {r.doc_id: r.spans for r in digest(docs(some)).collect()}
    assert got[0].startswith("iban:0:27") or "iban:0:27" in got[0]
    assert "iban" not in got[1]
    assert got[2] == "ssn:4:15" and "ssn" not in got[3] and "ssn" not in got[4]


def test_context_raises_scores(docs):
    rows = {r.doc_id: r.scores for r in digest(docs(["call +1 555 123 4567", "zzz +1 555 123 4567"])).collect()}
    assert rows == {0: "0.90", 1: "0.70"}


def test_odd_rows_and_empty_table(odd, empty):
    rows = digest(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)
    assert digest(empty).count() == 0


def test_long_runs_neither_overflow_nor_stall(docs):
    some = ["a" * 200_000, "1 " * 100_000, "1" * 200_000, "a." * 50_000 + "@b.c", "+1" * 50_000, "1." * 60_000, "DE89" + "A" * 100_000]
    assert digest(docs(some)).count() == len(some)


def test_all_work_stays_in_sql(docs):
    plan = digest(docs(["a@b.c"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_other_columns_stay_and_redaction_replaces(docs):
    table = docs(["mail a@b.c now", None]).withColumn("spans", F.lit(1)).withColumn("__x y", F.lit(2))
    rows = {r.doc_id: r for r in find_spans(table).collect()}
    assert rows[0]["__x y"] == 2 and rows[0].spans[0].kind == "email"
    assert [r.redacted for r in redact(docs(["mail a@b.c now", None])).orderBy("doc_id").collect()] == ["mail <email> now", ""]


def test_context_reaches_over_neighbouring_matches(docs):
    numbers = ["123-45-6789", "234-56-7890", "345-67-8901"]
    texts = ["SSN: " + ", ".join(numbers), ", ".join(numbers) + " are SSN", "SSN" + " " * 45 + ", ".join(numbers)]
    got = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans] for r in find_spans(docs(texts)).collect()}
    assert got == {0: numbers, 1: numbers, 2: numbers[:1]}


def test_ibans_end_where_their_checksum_is_right(docs):
    a, b = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    texts = [f"{a} Please pay", f"to {b} BIC COBADEFF", f"{a} {b}", f"{b} {a}.", f"{a}x", f"{a[:-1]}1 Please", b, f"{b} 2 X"]
    got = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "iban"] for r in find_spans(docs(texts)).collect()}
    assert got == {0: [a], 1: [b], 2: [a, b], 3: [b, a], 4: [], 5: [], 6: [b], 7: [b]}


def test_a_text_of_very_many_matches_costs_in_proportion(docs):
    """40,000 addresses and numbers in one text, against brute force and by the clock."""
    import time

    text = " ".join(f"a{i}@b{i}.org 10.0.{i % 256}.{i % 200}" for i in range(20_000))
    start = time.time()
    row = digest(docs([text])).first()
    assert time.time() - start < 60
    coded = ",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(text))
    assert (row.n_email, row.n_ip) == (20_000, 20_000) and row.spans == coded
    few = " ".join(f"a{i}@b.org, SSN 123-45-6789;" for i in range(700))
    assert [r.redacted for r in redact(docs([few])).collect()] == ["<email>, SSN <ssn>; " * 699 + "<email>, SSN <ssn>;"]
