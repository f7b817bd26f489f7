"""Truth tables of plan identity, the gate, staleness, and the end of a refresh."""

import pytest
from pyspark.sql import functions as F

from meterflow.operators import identity, market
from meterflow.plans import schema
from meterflow.queries import adapters as a


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("name", "words"),
    [("Solar BB System FlexSM 12", ["buyback", "flex", "solar", "system"]), ("Smart 2000 Select 12", ["2000", "select", "smart"]), ("Prism Energy LLC", ["prism"]), ("Pollution FreeTM 24mo", ["free", "pollution"]), ("12SM", []), (None, [])],
)
def test_tokens(spark, name, words):
    assert one(spark, identity.tokens(F.lit(name).cast("string"))) == words


@pytest.mark.parametrize(
    ("name", "term"),
    [("Chariot Shine 36", 36), ("Sun Confidence 24 month", 24), ("e-Plus 12 Choice", 12), ("Champ Saver-12", 12), ("Free Nights 9 to 6 24", 24), ("Free Power Weekends 7 to 7", None), ("Conservation 30 Day Plan", None), ("Unlimited", None), ("Deal 99", None), (None, None)],
)
def test_term_from_name(spark, name, term):
    assert one(spark, identity.term_from_name(F.lit(name).cast("string"))) == term


@pytest.mark.parametrize(
    ("synthetic", "real", "covers"),
    [
        (("Reliant Energy", "Solar Payback Match", 12), ("Reliant Energy Retail Services LLC", "Reliant Solar Payback Match 12", 12), True),
        (("TXU", "Solar Buyback", 12), ("TXU Energy", "TXU Solar Buyback Plus 12", 12), False),
        (("Green Mountain", "Solar Max", 12), ("Green Mountain Energy Company", "Renewable Rewards Solar Max 12", 12), True),
        (("Chariot Energy", "Chariot Energy Shine 36", 36), ("Chariot", "Shine 36", 36), True),
        (("Chariot", "Shine", 24), ("Chariot", "Shine", 36), False),
        (("Gexa", "Gexa 12", 12), ("Gexa", "Gexa 12", 12), False),
        (("", "Shine", 12), ("Chariot", "Shine", 12), False),
    ],
)
def test_supersedes(spark, synthetic, real, covers):
    row = lambda x, i: spark.createDataFrame([(i, *x)], "id string, retailer string, name string, term_months int")
    assert identity.superseded(row(synthetic, "s"), row(real, "r")).count() == covers


def test_generic_names_fall_back_to_brand_and_term(spark):
    row = lambda *x: spark.createDataFrame([x], "id string, retailer string, name string, term_months int")
    listing = lambda *x: spark.createDataFrame([x], "retailer string, name string, term_months int")
    assert identity.still_listed(row("g", "Gexa Energy", "Gexa 12", 12), listing("Gexa", "Anything", 12)).count() == 1
    assert identity.still_listed(row("g", "Gexa Energy", "Gexa 12", 12), listing("Gexa", "Anything", 24)).count() == 0
    assert identity.still_listed(row("g", "Gexa Energy", "Gexa 12", 12), listing("Gexa", "Anything", None)).count() == 1


@pytest.mark.parametrize(("name", "bad"), [("PUCT Certificate Number: 10296", True), ("Oncor Electric Company Service Area", True), ("", True), ("Unnamed Plan", True), ("Certificate 12", False), ("Free Nights 12", False)])
def test_names_that_are_none(spark, name, bad):
    assert one(spark, identity.is_not_a_name(F.lit(name))) is bad


@pytest.mark.parametrize(("name", "tidy"), [("AMIGO ENERGY", "Amigo Energy"), ("TARA ENERGY, LLC", "Tara Energy, LLC"), ("Mixed Case CO", "Mixed Case CO"), ("", "")])
def test_tidy_names(spark, name, tidy):
    assert one(spark, identity.tidy_retailer(F.lit(name))) == tidy


def test_gate(spark):
    of = lambda **c: F.create_map(*(F.lit(x) for p in c.items() for x in p))
    assert one(spark, market.passes_gate(of(energy_charge=0.9, base_charge=0.8, other=0.1), F.lit(False)))
    assert not one(spark, market.passes_gate(of(energy_charge=0.9, base_charge=0.79), F.lit(False)))
    assert not one(spark, market.passes_gate(of(other=1.0), F.lit(False)))
    assert not one(spark, market.passes_gate(of(energy_charge=0.9), F.lit(True)))
    assert not one(spark, market.passes_gate(of(energy_charge=0.9), F.lit(None).cast("boolean")))


@pytest.mark.parametrize(("effective", "today", "stale"), [("2026-03-01", "2026-09-25", True), ("2026-03-01", "2026-08-31", False), ("2026-09-01", "2026-12-01", False), ("2025-09-01", "2026-03-02", True), ("2026-03-01", "2026-03-01", False)])
def test_tariff_staleness(spark, effective, today, stale):
    date = lambda d: F.lit(d).cast("date")
    assert one(spark, market.tariff_is_stale(date(effective), date(today))) is stale


def table(spark, rows, extra=""):
    names = ["id", "retailer", "name", "term_months", "source", "needs_review", "source_sha256"]
    base = [{"retailer": "Alder", "term_months": 12, "source": "ptc", "needs_review": False, "energy_rates": [a.rate(1.0)]} | r for r in rows]
    df = a._rows(spark, base, schema.PLAN)
    return df if not extra else df.select(*names)


def test_reconcile_precedence(spark):
    quarantine = table(spark, [
        {"id": "rebuilt", "name": "Oak"}, {"id": "retired", "name": "Elm"}, {"id": "fresh_draft", "name": "Fir", "needs_review": True}, {"id": "same_doc", "name": "Yew", "source_sha256": "h"},
        {"id": "new_doc", "name": "Ash", "source_sha256": "h"}, {"id": "listed", "name": "Lime"}, {"id": "gone", "name": "Plum"}, {"id": "index_row", "name": "Pear", "source": "meterplan"},
    ])
    drafts = table(spark, [{"id": "fresh_draft", "name": "x"}, {"id": "same_doc", "name": "x", "source_sha256": "h"}, {"id": "new_doc", "name": "x", "source_sha256": "i"}])
    listings = spark.createDataFrame([("Alder Energy", "Lime 12", None)], "retailer string, name string, term_months int")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    done = market.reconciled(quarantine, ids("rebuilt"), drafts, listings, ids("retired"), {"ptc_ok": True, "meterplan_ok": False})
    assert {r.id: r.action for r in done.collect()} == {
        "rebuilt": "dropped", "retired": "dropped", "fresh_draft": "dropped", "same_doc": "already_reviewed", "new_doc": "kept_pending_review", "listed": "restored", "gone": "delisted", "index_row": "restored",
    }


def test_end_of_a_refresh(spark):
    plans = table(spark, [{"id": "cur", "name": "Mine"}, {"id": "syn", "name": "Sun Ray", "source": "meterplan"}, {"id": "old_syn", "name": "Not Sold", "source": "meterplan", "retailer": "Birch"}])
    drafts = table(spark, [{"id": "real", "name": "Alder Sun Ray 12", "source": "efl:x.pdf"}, {"id": "weak", "name": "Weak"}]).withColumn(
        "confidence", F.create_map(F.lit("energy_charge"), F.when(F.col("id") == "weak", 0.5).otherwise(0.95))
    )
    coverage = spark.createDataFrame([("Birch Energy", "Something Else 12")], "retailer string, name string")
    done = market.finished(plans, drafts, plans.limit(0), spark.createDataFrame([], "retailer string, name string, term_months int"), coverage, {}, "cur", "2026-07-01")
    assert {r.id for r in done["promoted"].collect()} == {"real"}
    assert {r.id for r in done["plans"].collect()} == {"cur", "real"}
    assert {r.id for r in done["drafts"].collect()} == {"weak"}
    assert [(r.id, r.action, r.by) for r in done["superseded"].collect()] == [("syn", "remove", "real")]
    assert [r.id for r in done["pruned"].collect()] == ["old_syn"]
    assert str(done["plans"].where("id = 'real'").first().retrieved) == "2026-07-01"


def test_reconcile_action_decides_every_part(spark, monkeypatch):
    from meterflow.queries import identity as q

    parts = spark.range(1, 901).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "cast(id % 50 + 1 AS int) AS p_size")
    monkeypatch.setattr(q.a, "table", lambda *_: parts)
    rows = q.reconcile_action(spark, "").collect()
    assert len(rows) == len({r.id for r in rows}) == 900 and all(r.action for r in rows)
