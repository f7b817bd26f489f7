"""Queries over texts and pages: terms, links, headings, fact sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import facts, html
from ..sources.market import offers
from . import adapters as a


def _docs(spark, sf):
    return a.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _pages(spark, sf):
    return a.table(spark, sf, "pages")


def text_money(spark, sf):
    """The first number with two decimals, and how many numbers there are."""
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", facts.amount(facts.group(t, r"(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d{2})")).alias("amount"), F.size(F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0))).cast("long").alias("numbers"))


def text_rate(spark, sf):
    """Conversation turns with a rate put behind each: dollars, cents, or a figure that is none."""
    c = a.table(spark, sf, "conversations").select("conv_id", "turn")
    said = F.element_at(F.array(*map(F.lit, ("Energy Charge: 12.5 ¢ per kWh", "$0.1234 per kWh", "$ .099", "$9.95 per month", "7 cents", "none"))), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    return c.select("conv_id", "turn", facts.cents(said).alias("ckwh"))


def text_clock_range(spark, sf):
    """Spans of the clock made from order numbers, as lists of hours."""
    o = a.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 12 + 1).cast("string").alias("h1"), (F.col("o_custkey") % 12 + 1).cast("string").alias("h2"), F.when(F.col("o_orderkey") % 2 == 0, "a.m.").otherwise("PM").alias("p1"), F.when(F.col("o_custkey") % 2 == 0, "am").otherwise("p.m.").alias("p2"))
    span = F.concat(F.lit("free from "), "h1", F.lit(" "), "p1", F.lit(" until "), "h2", F.when(F.col("o_orderkey") % 3 == 0, ":59").otherwise(""), "p2")
    return o.select("o_orderkey", F.array_join(facts.clock_hours(span), ",").alias("hours"))


def text_term(spark, sf):
    """Contract terms read by the ordered patterns, with their confidence."""
    said = F.element_at(F.array(*map(F.lit, ("Contract Term: {} Months", "Month-to-Month", "Term: {} mo", "a {} month agreement", "no term"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = a.table(spark, sf, "part").select("p_partkey", facts.term_months(F.replace(said, F.lit("{}"), F.col("p_size").cast("string"))).alias("t"))
    return rows.select("p_partkey", F.col("t.value").alias("term"), F.col("t.confidence").alias("confidence"))


def html_links(spark, sf):
    """Links of pages, made absolute, with their text."""
    links = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*\bhref="([^"]*)"[^>]*>[^<]*</a>'), F.lit(0))
    rows = _pages(spark, sf).select("page_id", F.posexplode(links).alias("n", "link"))
    return rows.select("page_id", "n", html.absolute("https://example.com/plans", F.regexp_extract("link", r'(?i)\bhref="([^"]*)"', 1)).alias("href"), html.stripped(F.col("link")).alias("label"))


def html_headings(spark, sf):
    return _pages(spark, sf).select("page_id", html.plan_name(html.stripped(F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))).alias("heading"))


def strip_tags(spark, sf):
    rows = _pages(spark, sf).select("page_id", html.stripped(html.without_scripts(html.without_comments(F.col("html")))).alias("text"))
    return rows.select("page_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


def name_keys(spark, sf):
    return _pages(spark, sf).select("page_id", html.slug(F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title>", 1)).alias("slug"))


def url_parts(spark, sf):
    u = F.col("url")
    return _pages(spark, sf).select("page_id", F.lower(F.parse_url(u, F.lit("HOST"))).alias("host"), F.parse_url(u, F.lit("PATH")).alias("path"), F.parse_url(u, F.lit("QUERY"), F.lit("page")).alias("page"))


def nearest_heading(spark, sf):
    """For each paragraph of a page's article, the list item that stands nearest before it."""
    from ..sources.files import with_neighbours

    parts = F.regexp_extract_all("html", F.lit(r"(?i)<(?:li|p)\b[^>]*>(?:<a [^>]*>)?[^<]*"), F.lit(0))
    rows = _pages(spark, sf).select("page_id", F.posexplode(parts).alias("at", "part"))
    item = F.when(F.lower(F.left("part", F.lit(3))) == "<li", html.stripped(F.col("part")))
    rows = with_neighbours(rows, item, "item", ["page_id"], ["at"])
    return rows.where(F.lower(F.left("part", F.lit(2))) == "<p").groupBy("page_id", "item").agg(F.count(F.lit(1)).alias("paragraphs"))


#: Fact sheets of our own wording, for the whole reader.
SHEETS = (
    "Electricity Facts Label (EFL)\nAlder Energy LLC\nAlder Flat 12\nOncor Electric Delivery service area\nContract Term: 12 Months\nType of Product: Fixed\nBase Charge: $4.95 per month\nEnergy Charge: 11.2 ¢ per kWh\nTDU Delivery Charges: 5.8¢ per kWh and $4.23 per month\nEarly termination fee: $20 per month remaining. The fee is $20 for each of the months remaining.\nRenewable Content: 22%",
    "Plan Name: Birch Free Nights 24\nRetailer Name: BIRCH ENERGY LLC\nContract Term: 24 Months\nno base charge\nEnergy Charge: $0.189 per kWh\nFree nights: electricity is free from 9 p.m. to 6 a.m. every day\nNights delivery charges: 0.0¢\nA $35 credit will be applied when usage is at least 1,000 kWh",
    "Plan Name: Cedar Clock 12\nContract Term 12\nBase Charge $9.95\nOn-Peak Energy Charge: 24.5¢ (4:00 PM to 9:00 PM weekdays)\nOff-Peak Energy Charge: 9.1¢ (all other hours)\nSolar Buyback rate: 6.0 ¢ per kWh, energy charges only",
    "Plan Name: Dogwood Tiers 12\nBase Charge N/A\nEnergy Charge:\n0 - 1000 kWh: 8.9¢\n1001 - 2000 kWh: 10.9¢\nNot available to customers with rooftop solar panels.",
    "Product Name: Elm Real Time\nMonth-to-Month\nDaily Charge: $0.30 per day\nEnergy Charge 10 .5 ¢ per kWh\nExcess Energy Credit: paid at the real-time market price of the settlement point, capped at 25 cents\nOne-time set up purchase of $49.99 is required to enroll",
    "",
)


def _sheets(spark):
    return spark.createDataFrame(list(enumerate(SHEETS)), "doc_id long, text string")


def _read(spark, sf):
    """Drafts of the sheets, and of the documents, which go through the same readers beside them."""
    return facts.drafts(_sheets(spark).unionByName(_docs(spark, sf).select((F.col("doc_id") + 1000).alias("doc_id"), "text")))


def fact_sheets(spark, sf):
    """Fact sheets read whole."""
    read = _read(spark, sf)
    return read.select("doc_id", "retailer", "name", "term_months", "base_charge_usd", F.to_json("energy_rates").alias("energy_rates"), F.col("buyback.kind").alias("buyback"), F.size("bill_credits").alias("credits"), "etf_usd", "signup_fee_usd", "unpriceable_reason", "needs_review")


def text_confidence(spark, sf):
    """How sure each field of each sheet and document is."""
    return _read(spark, sf).select("doc_id", F.explode("confidence").alias("field", "confidence"))


def silent_wrong(spark, sf):
    """Readings of a labelled sample against the truth: right, wrong though sure, unsure."""
    rows = a.table(spark, sf, "labels")
    read = rows.select("doc_id", F.lit("quality").alias("field"), (F.col("quality") - F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0)).cast("double").alias("value"), F.when(F.col("doc_id") % 4 == 0, 0.7).otherwise(0.9).alias("confidence"))
    truth = rows.select("doc_id", F.lit("quality").alias("field"), F.when(F.col("doc_id") % 7 != 0, F.col("quality").cast("double")).alias("value"))
    return facts.evaluated(read, truth)


def jsonld_offers(spark, sf):
    """Offers in JSON-LD blocks of pages: each page's own script is taken for one."""
    block = F.concat(F.lit('<script type="application/ld+json">{"itemListElement":[{"@id":"#o'), "page_id", F.lit('","name":"Plan '), "page_id", F.lit('","areaServed":[{"@type":"AdministrativeArea","name":"'), F.when(F.col("page_id") % 2 == 0, "Oncor").otherwise("TNMP"), F.lit('"}],"additionalProperty":[{"name":"Electricity Facts Label","value":"'), "url", F.lit('"}]}]}</script>'))
    return offers(_pages(spark, sf).select("page_id", F.concat("html", block).alias("html"))).select("page_id", "offer_id", "name", "efl_url")


def html_cards(spark, sf):
    """Plan cards of one platform, built around the pages' own headings."""
    name = F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)
    card = lambda n: F.concat(F.lit('<div class="planbox"><p class="planname">'), name, F.lit(f' {n}</p><a href="/Home/EFl?productId='), (F.col("page_id") * 2 + n % 2).cast("string"), F.lit('">facts</a><p>Earn a fixed buyback rate of '), (F.col("page_id") % 9).cast("string"), F.lit(" cents for excess energy</p></div>"))
    return html.cards(_pages(spark, sf).select("page_id", F.concat(card(1), card(2), card(3)).alias("html")), "planbox", "Box Energy", "https://example.com").select("page_id", "plan_name", "efl_url", "is_buyback", "buyback_ckwh")


QUERIES = {
    f.__name__: f
    for f in (text_money, text_rate, text_clock_range, text_term, html_links, html_headings, strip_tags, name_keys, url_parts, nearest_heading, fact_sheets, text_confidence, silent_wrong, jsonld_offers, html_cards)
}

_Q = lambda s: "'" + s.replace("'", "''") + "'"


def _unescape(x: str) -> str:
    for reference, character in html.REFERENCES:
        x = f"replace({x}, {_Q(reference)}, {_Q(character)})"
    return x


_STRIP = lambda x: f"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '[\\s]+', ' ', 'g'))"
_CLEAN = "regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\\b[^>]*>.*?</script>', '', 'g'), '(?is)<svg\\b[^>]*>.*?</svg>', ' ', 'g')"
_H1 = r"regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1)"
_RULE = '{{"label":"{0}","rate_ckwh":{1},"hours":[{2}],"weekdays":[{3}],"is_default":{4},"tdu_exempt":{5}}}'
_FLAT = lambda rate: "[" + _RULE.format("default", rate, "", "", "true", "false") + "]"
#: What the sheets say, read by hand: a row each of fact_sheets, and the confidence of retailer, name, term, base charge, energy charge, buyback, termination fee and free window.
_SAID = (
    (0, "Alder Energy LLC", "Alder Flat 12", 12, 4.95, _FLAT(11.2), "none", 0, 20.0, 0.0, None, False),
    (1, "Birch Energy LLC", "Birch Free Nights 24", 24, 0.0, "[" + _RULE.format("free", 0.0, "21,22,23,0,1,2,3,4,5", "", "false", "true") + "," + _RULE.format("default", 18.9, "", "", "true", "false") + "]", "none", 1, 0.0, 0.0, None, True),
    (2, "Unknown Retailer", "Cedar Clock 12", 12, 9.95, "[" + _RULE.format("on-peak", 24.5, "16,17,18,19,20", "0,1,2,3,4", "false", "false") + "," + _RULE.format("off-peak", 9.1, "", "", "true", "false") + "]", "fixed", 0, 0.0, 0.0, None, True),
    (3, "Unknown Retailer", "Dogwood Tiers 12", 12, 0.0, _FLAT(8.9), "none", 0, 0.0, 0.0, "usage tiers: 0 - 1000 kWh: 8.9¢; 1001 - 2000 kWh: 10.9¢", True),
    (4, "Unknown Retailer", "Elm Real Time", 1, 9.13, _FLAT(10.5), "rtw", 0, 0.0, 49.99, None, True),
    (5, "Unknown Retailer", "Unnamed Plan", 12, 0.0, "[]", "none", 0, 0.0, 0.0, None, True),
)
_SURE = ((0.75, 0.7, 0.95, 0.95, 0.95, 0.95, 0.9, 0.95), (0.8, 0.9, 0.95, 0.7, 0.95, 0.95, 0.0, 0.85), (0.0, 0.9, 0.85, 0.75, 0.85, 0.85, 0.0, 0.95), (0.0, 0.9, 0.0, 0.85, 0.95, 0.95, 0.0, 0.95), (0.0, 0.85, 0.9, 0.65, 0.95, 0.85, 0.0, 0.95), (0.0, 0.0, 0.0, 0.0, 0.0, 0.95, 0.0, 0.95))
_SHEET_TYPES = {"doc_id": "BIGINT", "retailer": "VARCHAR", "name": "VARCHAR", "term_months": "INTEGER", "base_charge_usd": "DOUBLE", "energy_rates": "VARCHAR", "buyback": "VARCHAR", "credits": "INTEGER", "etf_usd": "DOUBLE", "signup_fee_usd": "DOUBLE", "unpriceable_reason": "VARCHAR", "needs_review": "BOOLEAN"}
_FIELDS = ("retailer", "plan_name", "term_months", "base_charge", "energy_charge", "buyback", "etf", "free_window")
ORACLE_SQL = {
    # Prose says nothing of plans: documents have the defaults.
    "fact_sheets": f"""WITH s AS ({a.values([dict(zip(_SHEET_TYPES, r, strict=True)) for r in _SAID], _SHEET_TYPES)}) SELECT * FROM s
        UNION ALL SELECT d.doc_id + 1000, retailer, name, term_months, base_charge_usd, energy_rates, buyback, credits, etf_usd, signup_fee_usd, unpriceable_reason, needs_review FROM documents d, s WHERE s.doc_id = 5""",
    "text_confidence": f"""WITH s AS ({a.values([{"doc_id": i, "field": f, "confidence": c} for i, row in enumerate(_SURE) for f, c in zip(_FIELDS, row, strict=True)], {"doc_id": "BIGINT", "field": "VARCHAR", "confidence": "DOUBLE"})}) SELECT * FROM s
        UNION ALL SELECT d.doc_id + 1000, field, confidence FROM documents d, s WHERE s.doc_id = 5""",
    "text_money": r"""SELECT doc_id, try_cast(replace(nullif(regexp_extract(coalesce(text, ''), '([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+\.[0-9]{2})', 1), ''), ',', '') AS DOUBLE) AS amount, len(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS numbers FROM documents""",
    "text_rate": "SELECT conv_id, turn, [12.5, 12.34, 9.9, NULL, 7.0, NULL][(conv_id + turn) % 6 + 1]::DOUBLE AS ckwh FROM conversations",
    "text_clock_range": """WITH o AS (SELECT o_orderkey, (o_orderkey % 12 + 1) % 12 + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 12 END AS s, (o_custkey % 12 + 1) % 12 + CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE 12 END AS e, o_orderkey % 3 = 0 AS late FROM orders),
        n AS (SELECT *, (e - s + 24) % 24 AS span FROM o) SELECT o_orderkey, array_to_string(list_transform(range(greatest(span + CASE WHEN late AND span > 0 THEN 1 ELSE 0 END, 1)), lambda i: (s + i) % 24), ',') AS hours FROM n""",
    "text_term": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN 1 WHEN 2 THEN p_size WHEN 3 THEN p_size END::INTEGER AS term, [0.95, 0.9, 0.7, 0.6, NULL][p_partkey % 5 + 1]::DOUBLE AS confidence FROM part",
    "html_links": f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*\\bhref="([^"]*)"[^>]*>[^<]*</a>')) AS link, generate_subscripts(regexp_extract_all(html, '(?i)<a\\s[^>]*\\bhref="([^"]*)"[^>]*>[^<]*</a>'), 1) - 1 AS n FROM pages),
        h AS (SELECT *, regexp_extract(link, '(?i)\\bhref="([^"]*)"', 1) AS href FROM l)
        SELECT page_id, n::INTEGER AS n, CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN starts_with(href, '//') THEN 'https:' || href WHEN starts_with(href, '/') THEN 'https://example.com' || href ELSE 'https://example.com/plans/' || href END AS href, {_STRIP('link')} AS label FROM h""",
    "html_headings": f"SELECT page_id, trim(regexp_replace(regexp_replace({_unescape(_STRIP(_H1))}, '[™®©]', '', 'g'), '[\\s]+', ' ', 'g')) AS heading FROM pages",
    "strip_tags": f"SELECT page_id, length(t) AS chars, md5(t) AS digest FROM (SELECT page_id, {_STRIP(_CLEAN)} AS t FROM pages)",
    "url_parts": r"""SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages""",
    "silent_wrong": """WITH x AS (SELECT quality - CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END = quality AS ok, doc_id % 4 <> 0 AS sure FROM labels WHERE doc_id % 7 <> 0)
        SELECT 'quality' AS field, count(*) AS total, count(*) FILTER (WHERE ok) AS correct, count(*) FILTER (WHERE sure AND NOT ok) AS silent_wrong, count(*) FILTER (WHERE NOT sure) AS unsure FROM x""",
    "jsonld_offers": "SELECT page_id, 'o' || page_id::VARCHAR AS offer_id, 'Plan ' || page_id::VARCHAR AS name, trim(url) AS efl_url FROM pages WHERE page_id % 2 = 0",
}
