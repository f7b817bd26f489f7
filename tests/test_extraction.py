"""Fact sheets and pages."""

import pytest
from pyspark.sql import functions as F

from meterflow.functions import facts, html
from meterflow.queries.documents import SHEETS


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("text", "hours"), [("9 p.m. to 6 a.m.", [21, 22, 23, 0, 1, 2, 3, 4, 5]), ("12:00 am until 5:59am", [0, 1, 2, 3, 4, 5]), ("12 PM - 3 PM", [12, 13, 14]), ("5 pm", []), ("7pm to 7pm", [19])])
def test_clock_hours(spark, text, hours):
    assert one(spark, text, facts.clock_hours) == hours


@pytest.mark.parametrize(("text", "ckwh"), [("$0.1234 per kWh", 12.34), ("12.5 ¢", 12.5), ("7 cents", 7.0), ("$9.95 per month", None), ("$ .099", 9.9), ("none", None)])
def test_cents(spark, text, ckwh):
    assert one(spark, text, facts.cents) == ckwh


def test_weekdays_by_definition(spark):
    text = "Weekends are defined as 8:00 PM Friday to 12:00 AM Monday. weekend use"
    assert one(spark, text, lambda t: facts.weekdays(F.lit("weekend"), t)) == [4, 5, 6]
    assert one(spark, "", lambda t: facts.weekdays(F.lit("Saturday and Sunday"), t)) == [5, 6]
    assert one(spark, "", lambda t: facts.weekdays(F.lit("Monday through Friday"), t)) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize(
    ("text", "value"),
    [("Base Charge: $4.95 per month", 4.95), ("Base Charge N/A", 0.0), ("no base charge", 0.0), ("Daily Charge: $0.30 per day", 9.13), ("The total price consists of the energy charge and TDU delivery charges.", 0.0), ("a Base Plan Charge each month of $7.50", 7.5), ("nothing", None)],
)
def test_base_charge(spark, text, value):
    got = one(spark, text, facts.base_charge)
    assert (got.value if got else None) == value


def test_credits_are_listed_once(spark):
    text = "A bill credit of $35 when usage is at least 1,000 kWh but less than 2,000 kWh. Usage Credit: $20.00 per month when usage >= 500 kWh. Usage Credit for 800 kWh or more: $5"
    assert [tuple(c) for c in one(spark, text, facts.bill_credits)] == [(1000.0, 2000.0, 35.0), (500.0, None, 20.0), (800.0, None, 5.0)]


@pytest.mark.parametrize(
    ("text", "kind", "rate", "confidence"),
    [
        ("Solar Buyback rate 6.0 ¢ per kWh", "fixed", 6.0, 0.85),
        ("Excess Energy Credit equals the real-time market price", "rtw", None, 0.85),
        ("Energy Sellback Rate? Solar Energy Exports: 3.5 ¢", "fixed", 3.5, 0.9),
        ("Energy Sellback Rate? 90% of Real-Time Market price", "rtw", None, 0.9),
        ("Solar Buyback same as Energy Charge", "fixed", 11.0, 0.8),
        ("Does the retailer purchase excess distributed renewable generation? Yes.", "none", None, 0.3),
        ("nothing", "none", None, 0.95),
    ],
)
def test_buyback(spark, text, kind, rate, confidence):
    got = one(spark, text, lambda t: facts.buyback(t, F.lit(11.0)))
    assert (got.kind, got.rate_ckwh, got.confidence) == (kind, rate, confidence)


def test_delivery_waiver_denial_wins(spark):
    waived = "Free nights: delivery charges will be credited for night usage."
    assert one(spark, waived, facts.waives_delivery) is True
    assert one(spark, waived + " TDU delivery charges apply to all usage.", facts.waives_delivery) is False


def test_sheets_whole(spark):
    docs = spark.createDataFrame(list(enumerate(SHEETS)), "doc_id long, text string")
    rows = {r.doc_id: r for r in facts.drafts(docs).collect()}
    assert (rows[0].retailer, rows[0].name, rows[0].base_charge_usd, rows[0].tdu_ckwh, rows[0].needs_review) == ("Alder Energy LLC", "Alder Flat 12", 4.95, 5.8, False)
    assert (rows[0].etf_usd, rows[0].etf_per_month_remaining, rows[0].renewable_pct) == (20.0, True, 22.0)
    assert [(x.rate_ckwh, x.hours) for x in rows[1].energy_rates] == [(0.0, [21, 22, 23, 0, 1, 2, 3, 4, 5]), (18.9, [])]
    assert rows[1].free_window_waives_delivery and len(rows[1].bill_credits) == 1
    assert [(x.label, x.weekdays) for x in rows[2].energy_rates] == [("on-peak", [0, 1, 2, 3, 4]), ("off-peak", [])]
    assert (rows[2].buyback.kind, rows[2].buyback.offset_scope) == ("fixed", "energy_only")
    assert rows[3].unpriceable_reason.startswith("usage tiers") and rows[3].excludes_solar
    assert (rows[4].term_months, rows[4].signup_fee_usd, rows[4].buyback.cap_ckwh, rows[4].energy_rates[0].rate_ckwh) == (1, 49.99, 25.0, 10.5)
    assert rows[5].name == "Unnamed Plan" and rows[5].needs_review


def test_suggestions_fill_weak_fields_only(spark):
    docs = spark.createDataFrame([(0, "Energy Charge: 10 ¢ per kWh. A fee of 7.5 applies. TDU charge: $4.23 per month"), (1, SHEETS[0])], "doc_id long, text string")
    drafts = facts.drafts(docs).join(docs, "doc_id")
    offered = spark.createDataFrame([(0, "base_charge", 7.5), (1, "base_charge", 20.0), (0, "base_charge", 99.0)], "doc_id long, field string, value double")
    got = {r.doc_id: r for r in facts.suggested(drafts, offered.where("value <> 99")).collect()}
    assert (got[0].base_charge_usd, got[0].needs_review) == (7.5, True)
    assert got[1].base_charge_usd == 4.95


def test_cards(spark):
    page = (
        '<!-- <div class="planbox">x --><script>"<div class=\'planbox\'>"</script>'
        '<div class="planbox"><p class="planname">Sun &amp; Sea™ 12</p><a href="/Home/EFl?productId=5&amp;x=1">e</a> Earn a fixed buyback rate of 3 Cents per kWh for excess energy</div>'
        '<div class="planbox"><p class="planname">again</p><a href="/Home/EFl?productId=5">e</a></div>'
        '<div class="planbox"><p class="planname">Plain</p><a href="/Home/EFl?productId=6">e</a></div><div class="planbox">no link</div>'
    )
    rows = html.cards(spark.createDataFrame([(1, page)], "page_id long, html string"), "planbox", "R", "https://r.example").orderBy("plan_name").collect()
    assert [(r.plan_name, r.efl_url, r.is_buyback, r.buyback_ckwh) for r in rows] == [("Plain", "https://r.example/Home/EFl?productId=6", False, None), ("Sun & Sea 12", "https://r.example/Home/EFl?productId=5&x=1", True, 3.0)]


def test_headed_links(spark):
    page = (
        '<div analyticsproductname="Solar Máx 12" analyticscontractrates="a^BuyBack:7.5"></div><div analyticsproductname="Plain 12" analyticscontractrates="a"></div>'
        "<h3>Solar <b>Máx</b>® 12</h3><a href='x'>no</a><a href=\"/e1\">Electricity Facts Label</a><a href=\"/e2\">Electricity Facts Label</a>"
        '<h3>Plain 12</h3><a href="https://o/e3">Electricity Facts Label</a><h3>Unknown 6</h3><a href="e4"> Electricity Facts Label </a>'
    )
    rows = html.headed_links(spark.createDataFrame([(1, page)], "page_id long, html string"), "G", "https://g.example").orderBy("efl_url").collect()
    assert [(r.plan_name, r.efl_url, r.is_buyback, r.buyback_ckwh) for r in rows] == [
        ("Solar Máx 12", "https://g.example/e1", True, 7.5), ("Unknown 6", "https://g.example/e4", None, None), ("Plain 12", "https://o/e3", False, None),
    ]


def test_document_address(spark):
    viewer = "https://v.example/PDFGenerator?formType=EnergyFactsLabel&comProdId=ABC1&efldate=2026-01-02&tdsp=TNMP"
    made = one(spark, viewer, html.document_url)
    assert made == "https://v.example/api/getdocument?docType=EnergyFactsLabel&productid=ABC1&efldate=2026-01-02T00:00:00&tdsp=TNMP&language=en&classification=Residential"
    assert one(spark, "https://v.example/other", html.document_url) == "https://v.example/other"


def test_platform_rows_and_data_cards(spark):
    page = lambda x: spark.createDataFrame([(1, x)], "page_id long, html string")
    rows = '<div class="row plan-list-padding"><h3>Header only</h3></div><div class="row plan-list-padding"><h3>Sun 12</h3><a href="https://v.example/eflviewer.aspx?a=1&amp;prodcode=P1">e</a>Plan Type: Solar Buyback</div><div class="x Product-tab"><div>Solar Buyback</div></div>'
    got = html.cards(page(rows), "row_list", "G", "https://g.example").collect()
    assert [(r.plan_name, r.efl_url, r.is_buyback) for r in got] == [("Sun 12", "https://v.example/eflviewer.aspx?a=1&prodcode=P1", True)]
    card = '<div class="a show-plan b" data-productid="ABC9" data-planname="Lone Star 12">x</div>'
    got = html.cards(page(card), "data_card", "A", "https://a.example").collect()
    assert [(r.plan_name, r.is_buyback) for r in got] == [("Lone Star 12", False)] and "productid=ABC9&efldate=" in got[0].efl_url


def test_links_that_label_themselves(spark):
    page = spark.createDataFrame([(1, '<h2 data-cy="product-title" x="y">Twelve</h2><a href="https://o.example/efl/1">e</a><a href="https://o.example/efl/1">e</a><h2 data-cy="product-title">O Flex</h2><a href="https://o.example/efl/2">e</a>')], "page_id long, html string")
    got = html.named_links(page, "O", r'(?i)href="(https://o\.example/efl/[^"]+)"', title=r'<h2 data-cy="product-title"', no_buyback="flex").orderBy("efl_url").collect()
    assert [(r.plan_name, r.is_buyback) for r in got] == [("Twelve", True), ("O Flex", False)]
    page = spark.createDataFrame([(1, '<a href="https://t.example/TE_DRIVE_12M_PLAN_x.pdf">e</a><a href="https://t.example/other.pdf">e</a>')], "page_id long, html string")
    got = html.named_links(page, "T", r'(?i)href="(https://t\.example/[^"]+\.pdf)"', name_in_link=r"(?i)/TE_(.+?)_PLAN").collect()
    assert [(r.plan_name, r.is_buyback) for r in got] == [("Drive 12m", True)]


def test_partial_captures_say_why(spark):
    got = spark.range(1).select(html.partial_reason(html.marked_partial(F.lit("<p>x</p>"), F.lit('a "b" & c'))).alias("why"), html.partial_reason(F.lit("<p>")).alias("none")).first()
    assert (got.why, got.none) == ('a "b" & c', None)


def test_rows_of_odd_tables(spark):
    head = "Energy Charge  Base Charge  Delivery Charge per month\n"
    assert one(spark, head + "11.5¢/kWh $4.95 5.5¢ /kWh $4.23", lambda t: F.array(*facts.split_row(t))) == [11.5, 4.95]
    got = one(spark, "Daytime EV Charging delivery charge per month\n12.0¢/kWh 3.0¢/kWh $9.95 5.5¢/kWh $4.23", facts.rates_row)
    assert (got.rates, got.base_usd, got.restricted) == ([12.0, 3.0], 9.95, "EV Charging")
    got = one(spark, "Base Charge Per kWh Charge\nOncor Delivery $4.23 5.5¢\nOur Plan $9.95 12.5¢", facts.base_then_kwh)
    assert (got.base, got.ckwh) == (9.95, 12.5)
    assert one(spark, "Oncor 14.2¢ 14.2¢ 14.2¢", facts.flat_average) == 14.2 and one(spark, "Oncor 14.2¢ 14.1¢ 14.2¢", facts.flat_average) is None
    assert [tuple(r) for r in one(spark, "Sunny Energy Charge: $0.11 per kWh", facts.brand_rows)] == [("Sunny", 11.0)]
    rows = one(spark, "Base Charge: $5 per billing cycle\nOncor Delivery Charge 5.5¢ per kWh\nDaily Charge: $0.10 per day", facts.charge_rows)
    assert [(r.kind, r.value, r.is_delivery) for r in rows] == [("month", 5.0, False), ("kwh", 5.5, True), ("day", 0.1, False)]
    assert one(spark, "x", lambda t: facts.letters_match(F.lit("Bse"), facts.BASE_LETTERS)) is True
    assert one(spark, "x", lambda t: facts.letters_match(F.lit("Delivery"), facts.BASE_LETTERS)) is False
    assert one(spark, "• Energy charge 9 ¢\n• Oncor delivery charges\n• one-time set up fee", facts.base_absent_from_bullets) is True
    assert one(spark, "You get a credit for Energy Charges resulting from energy consumed during the Free Hours. Free Hours are 9 pm to 6 am.", facts.credited_hours) == [21, 22, 23, 0, 1, 2, 3, 4, 5]


def test_known_identity_replaces_failed_readings(spark):
    drafts = spark.createDataFrame([(1, "Unknown Retailer", "Unnamed Plan"), (2, "R", "N 12")], "doc_id long, retailer string, name string")
    known = spark.createDataFrame([(1, "Alder", "Flat 12", "u1"), (2, "Other", "Else", "u2")], "doc_id long, retailer string, name string, enroll_url string")
    assert sorted(tuple(r) for r in facts.with_identity(drafts, known).collect()) == [(1, "Alder", "Flat 12", "u1"), (2, "R", "N 12", "u2")]


def test_labels(spark):
    from meterflow.plans import catalogue

    arr = lambda *h: F.array(*map(F.lit, h)).cast("array<int>")
    got = spark.range(1).select(catalogue.hours_label(arr(21, 22, 23, 0, 1, 2, 3, 4, 5)).alias("a"), catalogue.hours_label(arr(6, 7, 17)).alias("b"), catalogue.hours_label(arr()).alias("c")).first()
    assert tuple(got) == ("21:00-06:00", "06:00-08:00, 17:00-18:00", "all day")


def test_numbers_too_large_are_no_numbers(spark):
    big = "9" * 400
    text = f"Contract Term: {big} Months. Base Charge: ${big} per month. Energy Charge: {big} ¢ per kWh. A credit of ${big} when usage is at least 5 kWh. {big}:00 am to 5 pm"
    got = facts.drafts(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(got) == 1 and got[0].term_months == 12


RATES = "Plan Name: Fir Drive\nDaytime Usage Charge EV Charging Usage Charge Base Charge Delivery Charge per month\n12.0¢/kWh 3.0¢/kWh $9.95 5.5¢/kWh $4.23\n"
BRAND_ROWS = "Sunny Day Energy Charge: 14.0 ¢ per kWh\nSunny Night Energy Charge: 4.0 ¢ per kWh\n"
NO_SHEET_WORDS = (
    ("Type of Product: Variable", lambda r: r.rate_type, "variable"),
    ("not available to customers with rooftop solar panels", lambda r: r.excludes_solar, True),
    ("Not available to homes with a Powerwall", lambda r: r.excludes_battery, True),
    ("Alder Energy LLC (PUC No. 10234)", lambda r: r.retailer, "Alder Energy"),
    ("Retailer: Foo Bar", lambda r: r.retailer, "Foo Bar"),
)
TEXTS = {
    "restricted": RATES + "EV charging hours are from 10:00 PM to 4:00 AM every night.",
    "weekend": RATES.replace("EV Charging", "Weekend"),
    "nights": BRAND_ROWS + "Night hours run from 8:00 PM to 5:00 AM.",
    "nights unsaid": BRAND_ROWS,
    "lost letters": "nerg Charge 11.5¢ per kWh\nae Charge $19.95 per ill\nOncor Delivery Charge 5.5¢ per kWh",
    "header": "Electricity Facts Label\nBy Phone: 800-555-0100 Alder Energy\nResidential Service => Alder Flat 12 DATE 1/2/2026\n",
} | {t: t for t, _, _ in NO_SHEET_WORDS}


@pytest.fixture(scope="module")
def read(spark):
    """Drafts of all TEXTS, made in one job."""
    rows = facts.drafts(spark.createDataFrame(list(TEXTS.items()), "doc_id string, text string")).collect()
    return {r.doc_id: r for r in rows}


def test_rows_with_a_restricted_rate_become_rules(read):
    got = read["restricted"]
    assert [(r.rate_ckwh, r.hours, r.is_default) for r in got.energy_rates] == [(3.0, [22, 23, 0, 1, 2, 3], False), (12.0, [], True)]
    assert got.base_charge_usd == 9.95
    assert [(r.rate_ckwh, r.weekdays) for r in read["weekend"].energy_rates] == [(3.0, [5, 6]), (12.0, [])]


def test_brand_rows_with_nights(read):
    got = read["nights"]
    assert [(r.rate_ckwh, len(r.hours)) for r in got.energy_rates] == [(4.0, 9), (14.0, 0)] and got.confidence["energy_charge"] == 0.85
    assert read["nights unsaid"].confidence["energy_charge"] == 0.5


def test_rows_are_read_by_their_unit_when_letters_are_lost(read):
    got = read["lost letters"]
    assert (got.base_charge_usd, [r.rate_ckwh for r in got.energy_rates]) == (19.95, [11.5])
    assert got.confidence["base_charge"] == got.confidence["energy_charge"] == 0.85


def test_header_junk_is_left_out(read):
    assert (read["header"].retailer, read["header"].name) == ("Alder Energy", "Alder Flat 12")


@pytest.mark.parametrize(("text", "field", "value"), NO_SHEET_WORDS)
def test_single_statements_are_read(read, text, field, value):
    assert field(read[text]) == value


def test_searches_before_readers_change_no_row(spark, monkeypatch):
    """Random pieces of sheets with and without the searches that spare the costly readers."""
    import random

    rng = random.Random(3)
    pieces = [line for s in SHEETS for line in s.split("\n") if line] + [t for t, *_ in NO_SHEET_WORDS]
    pieces += ["Home Charging Fee: $ 25 /month", "What are Eligible Hours for Unlimited Vehicle Charging? 12 am (midnight) - 6 am", "Nights Hours (9 PM - 6 AM) 3.0 ¢ / kWh", "ETF $150", "one-time activation $20", "• Energy Charge\n• TDU delivery", "Oncor 17.9¢ 17.9¢ 17.9¢", "All kWh 9.9¢", "Renewable Buyback 5 cents", "credit for Energy Charges resulting from energy consumed during the Free Hours", "$30 per month remaining"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lambda: sorted(map(repr, facts.drafts(table).select(*COMPARED).collect()))
    with_searches = rows()
    monkeypatch.setattr(facts, "gated", lambda text, need, value, otherwise=None: value if otherwise is None else F.coalesce(value, otherwise))
    assert rows() == with_searches


COMPARED = ("doc_id", "retailer", "name", "term_months", "rate_type", "base_charge_usd", "energy_rates", "buyback", "bill_credits", "tdu_ckwh", "tdu_usd_month", "tdu_passthrough", "etf_usd", "etf_per_month_remaining", "signup_fee_usd", "average_prices", "home_charging", "excludes_solar", "excludes_battery", "unpriceable_reason", "needs_review")


def test_a_sheet_billed_end_to_end(spark):
    """Free nights with delivery waived and a car allowance: a day of 1 kWh a quarter-hour, by hand."""
    import datetime as dt

    from meterflow.functions.clock import day_grid
    from meterflow.operators import billing
    from meterflow.plans import schema

    sheet = SHEETS[1] + "\nHome Charging Fee: $ 25 /month /EV\nWhat are Eligible Hours for Unlimited Vehicle Charging? 10 am - 2 pm"
    docs = spark.createDataFrame([(1, sheet)], "doc_id long, text string")
    draft = facts.drafts(docs, car_kwh_month=10.0, charger_kw=11.0)
    draft = spark.createDataFrame(draft.collect(), draft.schema)  # as a table of drafts would hold it
    plan = facts.plan_rows(draft, "ONCOR").withColumn("ord", F.lit(0))
    plan = spark.createDataFrame(plan.collect(), plan.schema)
    assert schema.violations(plan).count() == 0 and plan.first().base_charge_usd == 25.0
    tariff = spark.createDataFrame([("ONCOR", dt.date(2024, 1, 1), 0.0, 5.0)], schema.TARIFF)
    usage = spark.sql("SELECT DATE'2024-01-08' AS d").select(F.lit("m").alias("meter_id"), F.explode(day_grid(F.col("d"))).alias("ts"), F.lit(1.0).alias("import_kwh"), F.lit(0.0).alias("export_kwh"))
    (m,) = billing.simulated(usage, plan, tariff).collect()
    paid = 15 * 4  # hours outside 21:00 to 06:00
    free = 10.0  # the allowance, less than the 16 kWh of its hours
    assert m.energy_cost == pytest.approx((paid - free) * 0.189)
    assert m.tdu_volumetric == pytest.approx(paid * 0.05)  # the add-on does not cover delivery, the nights do
    assert m.base == pytest.approx(25.0 / 31)
