"""Queries over labels, links, catalogue edits and reports, with the driver's tables as their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import facts, html
from ..operators import billing, identity, market, reports
from ..plans import catalogue
from . import adapters as a
from .documents import _unescape
from .identity import _BRAND, _IN, _LESS, _NAMES, _TOKENS, _list, _names, _q, _supersedes

_pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def etf_labels(spark, sf):
    """Termination fees in words: none, once, or per month left."""
    o = a.table(spark, sf, "orders")
    return o.select("o_orderkey", catalogue.etf_label(_pick(F.col("o_custkey"), 0.0, 12.5, 150.0), F.col("o_orderkey") % 2 == 0).alias("label"))


def hours_labels(spark, sf):
    """Hours as spans of the clock, over midnight or not."""
    p = a.table(spark, sf, "part")
    hours = F.transform(F.sequence(F.lit(1), F.greatest(F.col("p_size") % 24, F.lit(1))), lambda i: ((F.col("p_partkey") + i) % 24).cast("int"))
    return p.select("p_partkey", catalogue.hours_label(F.when(F.col("p_size") % 24 == 0, F.array().cast("array<int>")).otherwise(hours)).alias("label"))


def _flagged(spark, sf):
    p = a.table(spark, sf, "part")
    return p.select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_size") % 4 == 0).alias("needs_review"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") % 6 == 0).alias("excludes_solar"), _pick(F.col("p_partkey"), "ptc", "efl:x.pdf", "meterplan", "manual", None).alias("source"), "p_size")


def shown_plans(spark, sf):
    """Plans a comparison lists under each choice of the two switches."""
    rows = _flagged(spark, sf)
    out = None
    for review in (False, True):
        for solar in (False, True):
            part = catalogue.shown(rows, review, solar).select("id", F.lit(review).alias("with_review"), F.lit(solar).alias("with_solar_excluding"))
            out = part if out is None else out.unionByName(part)
    return out.groupBy("with_review", "with_solar_excluding").agg(F.count(F.lit(1)).alias("plans"), F.sum(F.col("id").cast("long")).alias("ids"))


def quarantined_plans(spark, sf):
    """Plans a refresh takes out: rows of the market, never the current plan."""
    rows = _flagged(spark, sf)
    return rows.where(catalogue.quarantined(rows, "7")).select("id")


def file_names(spark, sf):
    p = a.table(spark, sf, "part")
    return p.select("p_partkey", html.file_name(F.concat("p_name", F.lit("/"), "p_brand", F.lit(" ("), F.col("p_size").cast("string"), F.lit(").pdf"))).alias("file"))


def text_snippets(spark, sf):
    """Evidence lines: white space collapsed, cut to a length; and the text's digest."""
    d = a.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", F.md5(facts.snippet(F.col("text"))).alias("snippet"), F.sha2("text", 256).alias("sha256"))


def text_weekdays(spark, sf):
    """Days that a phrase speaks of."""
    o = a.table(spark, sf, "orders")
    said = _pick(F.col("o_orderkey"), "every weekend", "weekdays only", "Monday through Friday", "Saturday and Sunday", "on tuesday and friday", "any time")
    return o.select("o_orderkey", F.array_join(facts.weekdays(said, F.lit("")), ",").alias("days"))


def car_allowance(spark, sf):
    """Free kWh a month by the hours of the window."""
    c = a.table(spark, sf, "customer")
    return c.select("c_custkey", facts.charging_allowance(250.0, 1.5, F.sequence(F.lit(0), (F.col("c_nationkey") % 12).cast("int"))).alias("kwh"))


def audit_impact(spark, sf):
    """Disagreements of two readings by their cost a year."""
    o = a.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("plan_id"), _pick(F.col("o_orderkey"), "rate_ckwh", "base_usd_month", "etf_usd").alias("field"), (F.col("o_custkey") % 8 * 0.25).alias("stored"), F.when(F.col("o_custkey") % 11 != 0, F.col("o_orderkey") % 4 * 0.5).alias("read"))
    return reports.audit_impact(o).select("plan_id", "field", "impact_usd")


def _years(spark, sf):
    c = a.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("meter_id"), _pick(F.col("c_custkey"), *(p["id"] for p in a.PLANS), "removed").alias("plan_id"), (F.col("c_nationkey") % 3 == 0).alias("uses_rtw"), F.when(F.col("c_custkey") % 4 == 0, "no price").alias("skipped"), (F.col("c_acctbal") * 2).alias("first_year_net"), (F.col("c_custkey") % 9 + 1).cast("int").alias("rank"))


def _gaps(spark, sf):
    c = a.table(spark, sf, "customer").where("c_custkey % 2 = 0")
    return c.select(F.col("c_custkey").cast("string").alias("meter_id"), (F.col("c_custkey") % 3).alias("filled"), (F.col("c_nationkey") / 100.0).alias("fraction"))


def estimated_share(spark, sf):
    """The share of estimated prices, for plans priced by them."""
    return billing.with_estimated_share(_years(spark, sf), _gaps(spark, sf)).select("meter_id", "plan_id", "prices_estimated_fraction")


def billing_notes(spark, sf):
    """What a reader of the ranking must know, each said once per meter."""
    c = a.table(spark, sf, "customer")
    windows = c.select(F.col("c_custkey").cast("string").alias("meter_id"), (F.col("c_custkey") % 5 == 0).alias("trimmed"), (F.col("c_custkey") % 7 != 0).alias("reliable"), F.concat(F.lit("window "), F.col("c_nationkey").cast("string")).alias("note"))
    return billing.notes(_years(spark, sf), windows.unionByName(windows), _gaps(spark, sf))


def report_summary(spark, sf):
    """Ranked plans beside the catalogue; a plan no longer in it keeps its figures."""
    ranking = _years(spark, sf).withColumns({"avg_import_price_ckwh": F.lit(1.25), "paid_ckwh": F.lit(2.5), "final_balance": F.lit(0.0)})
    out = reports.summary(ranking, a.plans(spark))
    return out.select("meter_id", "rank", "plan_id", "retailer", "name", "term_months", "first_year_net", "early_termination", "needs_review")


def supersede_sweep(spark, sf):
    """Synthetic plans and drafts against real ones: removed, kept or flagged."""
    rows = _names(spark, sf).withColumn("k", F.col("id").cast("int"))
    make = lambda k, source, more="": rows.where(F.col("k") % 4 == k).select("id", "retailer", F.concat("short_name", F.lit(more)).alias("name"), "term_months", F.lit(source).alias("source"), (F.col("k") % 3 == 0).alias("needs_review"))
    plans = make(1, "meterplan").unionByName(make(0, "ptc", " Online"))
    drafts = make(3, "meterplan").unionByName(make(2, "ptc", " Online"))
    return identity.supersede_actions(plans, drafts, rows.where("k % 8 = 0").select("id"), "1")


def headed_pages(spark, sf):
    """Document links named by the heading before them, with the buyback flag of the page's tracking markup."""
    p = a.table(spark, sf, "pages")
    plan = lambda n: F.concat(F.lit("<h3>Plan "), "page_id", F.lit(f"-{n} ™</h3><p>x</p><a class='q' href=\"/e/"), "page_id", F.lit(f'/{n}"> Electricity Facts Label </a><a href="/e/late">Electricity Facts Label</a>'))
    mark = F.concat(F.lit('<div analyticsproductname="Plan '), "page_id", F.lit('-1" analyticscontractrates="Energy:9;'), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("BuyBack:"), (F.col("page_id") % 9).cast("string"), F.lit(".5"))).otherwise(""), F.lit('"></div>'))
    made = p.select("page_id", F.concat(plan(1), mark, F.lit("<!-- <h3>no</h3> -->"), plan(2), plan(1)).alias("html"))
    return html.headed_links(made, "Heading Energy", "https://example.com").select("page_id", "plan_name", "efl_url", "is_buyback", "buyback_ckwh")


def labelled_links(spark, sf):
    """Links that carry their own label, named by the nearest title or by the link."""
    p = a.table(spark, sf, "pages")
    made = p.select("page_id", F.concat(F.lit("<h2>Solar "), "page_id", F.lit('</h2><a href="/efl/Sun_Plan_'), "page_id", F.lit('.pdf">EFL</a><h2>Basic</h2><a href="/efl/Basic.pdf">EFL</a><a href="/efl/Basic.pdf">EFL</a>')).alias("html"))
    link = r'(?i)<a\b[^>]*href="(/efl/[^"]+)"[^>]*>EFL</a>'
    by_title = html.named_links(made, "T", link, title="<h2", no_buyback="basic")
    by_link = html.named_links(made, "L", link, name_in_link=r"/efl/([^.]+)\.pdf")
    return by_title.unionByName(by_link).select("page_id", "retailer", "plan_name", "efl_url", "is_buyback")


def partial_marks(spark, sf):
    """Captures marked as unfinished say why; others claim to be whole."""
    p = a.table(spark, sf, "pages")
    reason = F.concat(F.lit('slow & "late" '), F.col("page_id").cast("string"))
    return p.select("page_id", html.partial_reason(F.when(F.col("page_id") % 2 == 0, html.marked_partial(F.col("html"), reason)).otherwise(F.col("html"))).alias("reason"))


def viewer_addresses(spark, sf):
    """Viewers' addresses turned into their documents'."""
    p = a.table(spark, sf, "pages")
    url = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("https://v.example/PDFGenerator?comProdId="), F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("AB"), F.col("page_id").cast("string"))).otherwise(""), F.when(F.col("page_id") % 2 == 0, "&efldate=2026-03-04&tdsp=TNMP").otherwise("")))
    return p.select("page_id", html.document_url(url).alias("url"))


def platform_cards(spark, sf):
    """Cards of three further platforms."""
    p = a.table(spark, sf, "pages")
    n = F.col("page_id").cast("string")
    show = F.concat(F.lit('<div class="a show-plan b"><p class="font-mProBlack text-txublue">Sun '), n, F.lit('</p>excess solar<a href="/PDFGenerator?formType=EnergyFactsLabel&amp;comProdId=P'), n, F.lit('">EFL</a></div>'))
    rows = F.concat(F.lit('<div class="row plan-list-padding"><h3>Row '), n, F.lit('</h3><a href="/eflviewer.aspx?prodcode=R'), n, F.lit('">EFL</a></div>'))
    data = F.concat(F.lit('<div class="show-plan" data-planname="Data '), n, F.lit('" data-productid="D'), n, F.lit('">get paid for your excess</div>'))
    out = None
    for kind, made in (("show_plan", show), ("row_list", rows), ("data_card", data)):
        part = html.cards(p.select("page_id", F.concat(F.lit("<body>"), made, F.lit("</body>")).alias("html")), kind, kind, "https://example.com").select("page_id", "retailer", "plan_name", "efl_url", "is_buyback")
        out = part if out is None else out.unionByName(part)
    return out


def refused_hosts(spark, sf):
    """Responses that refuse programs, and hosts nothing more is asked of."""
    p = a.table(spark, sf, "pages")
    r = p.select(F.concat(F.lit("h"), (F.col("page_id") % 50).cast("string")).alias("host"), "url", F.when(F.col("page_id") % 50 % 3 == 0, 403).otherwise(200).alias("status"), F.when(F.col("page_id") % 50 < 20, F.concat(F.lit("<b>Access Denied</b>"), "html")).otherwise(F.concat(F.repeat(F.lit("x"), 2048), F.lit("Access denied"))).alias("body"))
    return market.refusing_hosts(r)


def reviewed_links(spark, sf):
    """Discovered plans with outside opinions merged, upwards only."""
    p = a.table(spark, sf, "pages")
    found = p.select("page_id", "url", F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("efl_url"), F.when(F.col("page_id") % 3 != 0, F.col("page_id") % 2 == 0).alias("is_buyback"), F.lit("static").alias("extraction_method"))
    opinions = p.where("page_id % 5 < 2").select(F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("efl_url"), (F.col("page_id") % 5 == 0).alias("is_buyback"), F.lit(0.75).alias("confidence"))
    return html.reviewed(found, opinions).select("page_id", "is_buyback", "extraction_method", "llm_confidence")


def catalogue_edits(spark, sf):
    """Plans saved, renamed, deleted and demoted; the current plan stays."""
    rows = _flagged(spark, sf).select("id", "needs_review", "p_size")
    saved = rows.where("try_cast(id AS int) % 4 = 0").select(F.concat(F.lit("n"), "id").alias("id"), F.lit(True).alias("needs_review"), F.lit(-1).alias("p_size"), F.col("id").alias("was"))
    held = catalogue.upserted(rows, saved.drop("was"), None)
    held = catalogue.upserted(held.join(saved.select(F.col("was").alias("id")), "id", "left_anti"), saved.drop("was").limit(0))
    held = catalogue.deleted(held, rows.where("try_cast(id AS int) % 9 = 1").select("id"), current_id="1")
    held = catalogue.renamed(held, "2", "two", current_id="1")
    held, drafts = catalogue.demoted(held, held.limit(0), rows.where("try_cast(id AS int) % 5 = 3").select("id"), current_id="3")
    return held.withColumn("at", F.lit("plans")).unionByName(drafts.withColumn("at", F.lit("drafts"))).select("at", "id", "needs_review", "p_size")


def promoted_all(spark, sf):
    """Every draft that keeps a plan's rules, past the gate, and why the others stay."""
    drafts = catalogue.with_faults(a.plans(spark)).where("id <> 'flat'").withColumn("needs_review", F.when(F.col("ord") % 2 == 0, F.col("ord") % 3 == 0))
    done = market.promote_all(a.plans(spark).limit(0), drafts, "2026-01-02")
    return done["promoted"].select("id", F.lit("promoted").alias("what"), F.col("needs_review").cast("string").alias("more")).unionByName(done["failed"].select("id", F.lit("failed").alias("what"), F.col("violation").alias("more")))


def suggested_fields(spark, sf):
    """Outside suggestions merged into weak fields only."""
    p = a.table(spark, sf, "part").withColumn("n", F.col("p_size"))
    low, high = F.lit(0.5), F.lit(0.9)
    draft = p.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("charge "), F.when(F.col("n") % 3 == 0, "").otherwise(F.col("n").cast("string"))).alias("text"), F.lit(1.5).alias("base_charge_usd"), F.lit(0.0).alias("etf_usd"), F.lit(12).alias("term_months"), F.when(F.col("n") % 7 == 0, F.col("n").cast("double")).alias("tdu_usd_month"), F.lit(None).cast("double").alias("tdu_ckwh"), F.create_map(F.lit("base_charge"), F.when(F.col("p_partkey") % 2 == 0, low).otherwise(high), F.lit("etf"), high, F.lit("term_months"), low).alias("confidence"), F.lit(False).alias("needs_review"))
    offers = p.select(F.col("p_partkey").alias("doc_id"), F.explode(F.array(F.lit("base_charge"), F.lit("etf"), F.lit("term_months"))).alias("field"), F.col("n").cast("double").alias("value"))
    return facts.suggested(draft, offers).select("doc_id", "base_charge_usd", "etf_usd", "term_months", "needs_review")


def draft_rows(spark, sf):
    """Drafts in a line each: rates, the least confidence, the review mark."""
    l = a.table(spark, sf, "labels")  # noqa: E741
    rule = F.struct(F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 40 * 0.25).alias("rate_ckwh"), F.when(F.col("doc_id") % 6 == 0, F.struct(F.lit(1.0).alias("multiplier"))).alias("rtw"))
    drafts = l.select(F.col("doc_id").cast("string").alias("id"), F.lit("R").alias("retailer"), F.lit("N").alias("name"), F.lit(12).alias("term_months"), F.when(F.col("doc_id") % 5 == 0, F.array(rule, rule)).otherwise(F.array(rule)).alias("energy_rates"), F.create_map(F.lit("a"), F.col("quality") * 0.5, F.lit("b"), F.lit(0.25)).alias("confidence"), F.when(F.col("doc_id") % 2 == 0, F.col("toxic") == 1).alias("needs_review"))
    return catalogue.draft_summary(drafts).select("id", "rates", "least_confidence", "needs_review")


def price_reach(spark, sf):
    """Whether prices end before usage does; unknown ends are no reason to say so."""
    o = a.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.col("o_custkey"))
    return o.select("o_orderkey", market.prices_fall_short(F.when(F.col("o_custkey") % 6 != 0, F.date_add("d", (F.col("o_custkey") % 5 - 2).cast("int"))), F.col("d")).alias("short"))


QUERIES = {
    f.__name__: f
    for f in (
        etf_labels, hours_labels, shown_plans, quarantined_plans, file_names, text_snippets, text_weekdays, car_allowance, audit_impact, estimated_share, billing_notes, report_summary, supersede_sweep,
        headed_pages, labelled_links, partial_marks, viewer_addresses, platform_cards, refused_hosts, reviewed_links, catalogue_edits, promoted_all, suggested_fields, draft_rows, price_reach,
    )
}

_HEADS = a.values(
    [{"id": p["id"], "ord": i, "retailer": p["retailer"], "name": p["name"], "term": p["term_months"], "base": p["base_charge_usd"], "review": p["needs_review"], "kind": p["buyback"]["kind"], "ckwh": p["buyback"]["rate_ckwh"], "scope": p["buyback"]["offset_scope"], "cap": p["buyback"]["monthly_credit_cap"], "rollover": p["buyback"]["rollover"], "cash_out": p["buyback"]["cash_out"], "n_rates": len(p["energy_rates"])} for i, p in enumerate(a.PLANS)],
    {"id": "VARCHAR", "ord": "INTEGER", "retailer": "VARCHAR", "name": "VARCHAR", "term": "INTEGER", "base": "DOUBLE", "review": "BOOLEAN", "kind": "VARCHAR", "ckwh": "DOUBLE", "scope": "VARCHAR", "cap": "VARCHAR", "rollover": "BOOLEAN", "cash_out": "BOOLEAN", "n_rates": "INTEGER"},
)
_num = lambda x: f"regexp_replace(regexp_replace(printf('%.4f', {x}), '0+$', ''), '[.]$', '')"
_FLAGGED = "f AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 5 <> 0 THEN p_size % 4 = 0 END AS needs_review, CASE WHEN p_partkey % 7 <> 0 THEN p_size % 6 = 0 END AS excludes_solar, ['ptc', 'efl:x.pdf', 'meterplan', 'manual', NULL][p_partkey % 5 + 1] AS source, p_size FROM part)"
_PLAN_IDS = _list([*(p["id"] for p in a.PLANS), "removed"])
_YEARS = f"y AS (SELECT c_custkey AS k, c_custkey::VARCHAR AS meter_id, ({_PLAN_IDS})[c_custkey % {len(a.PLANS) + 1} + 1] AS plan_id, c_nationkey % 3 = 0 AS uses_rtw, c_custkey % 4 = 0 AS skipped, c_acctbal * 2 AS net, c_nationkey, (c_custkey % 9 + 1)::INTEGER AS rank FROM customer)"
_GAPS = "g AS (SELECT c_custkey::VARCHAR AS meter_id, c_custkey % 3 AS filled, c_nationkey / 100.0 AS fraction FROM customer WHERE c_custkey % 2 = 0)"
_SLUG = lambda x: f"regexp_replace(regexp_replace({x}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_FAULTS = f"""{a.plan_ctes()}, p0 AS (SELECT plan_id AS id, plan_id AS base_id, kind, scope FROM plans UNION ALL SELECT 'bad_' || plan_id, plan_id, kind, CASE WHEN plan_id = 'sell_windows' THEN 'none_at_all' ELSE scope END FROM plans
      WHERE plan_id IN ('night_free', 'tou', 'sell_fixed', 'sell_windows') UNION ALL SELECT plan_id, plan_id, kind, scope FROM plans WHERE plan_id = 'flat'),
    rr AS (SELECT DISTINCT p0.id, kind, side, n, CASE WHEN id = 'bad_tou' AND side = 'energy' OR id = 'bad_sell_fixed' AND side = 'export' THEN NULL ELSE rate_ckwh END AS rate, is_rtw, len(months) + len(weekdays) + len(hours) > 0 AS windowed
      FROM p0 JOIN rules r ON r.plan_id = p0.base_id WHERE NOT (id = 'bad_night_free' AND side = 'energy' AND n > 0) AND NOT (id = 'bad_sell_windows' AND side = 'export' AND n > 0)),
    ends AS (SELECT id, side, any_value(kind) AS kind, arg_max(windowed, n) AS w, bool_or((rate IS NULL) = NOT is_rtw) AS unclear, bool_or(rate IS NULL) AS blank FROM rr GROUP BY 1, 2),
    broken AS (SELECT id, 'last energy rate is not a catch-all' AS violation FROM ends WHERE side = 'energy' AND w
      UNION ALL SELECT DISTINCT id, 'a rate needs exactly one of rate_ckwh and rtw' FROM ends WHERE unclear AND (side = 'energy' OR kind = 'windows')
      UNION ALL SELECT id, 'fixed buyback needs rate_ckwh' FROM ends WHERE side = 'export' AND kind = 'fixed' AND blank
      UNION ALL SELECT id, 'windows buyback must end in a catch-all' FROM ends WHERE side = 'export' AND kind = 'windows' AND w
      UNION ALL SELECT DISTINCT id, 'unknown offset scope' FROM p0 WHERE scope NOT IN ('energy_only', 'all_charges')
      UNION ALL SELECT id, 'duplicate id' FROM p0 GROUP BY id HAVING count(*) > 1)"""
_INDEX = f"""WITH {_NAMES}, h AS (SELECT DISTINCT lower(trim(retailer)) AS r, lower(trim(short_name)) AS n, term_months AS t FROM names WHERE k % 12 = 0),
    x AS (SELECT names.*, regexp_matches(short_name, {{night}}) AS night, p_size % 9 <> 0 AND p_size % 3 <> 2 AS priced, EXISTS (SELECT 1 FROM h WHERE r = lower(trim(retailer)) AND n = lower(trim(short_name)) AND t = term_months) AS held FROM names),
    o AS (SELECT id AS row, 'mp_' || {_SLUG("lower(retailer || '_' || short_name || '_' || term_months::VARCHAR || 'mo')")} AS id,
      CASE WHEN lower(retailer) = 'the elm company' THEN 'skipped_own' WHEN p_size % 8 = 0 THEN 'skipped_battery' WHEN held THEN 'skipped_existing' WHEN NOT night AND priced THEN 'imported' ELSE 'flagged' END AS outcome,
      CASE WHEN night THEN 0.4 ELSE 0.9 END::DOUBLE AS rate_confidence, NOT (NOT night AND priced) AS needs_review FROM x)""".replace("{night}", _q(market.FREE_HOURS_NAME))

ORACLE_SQL = {
    "etf_labels": "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'none' ELSE ['', '$12.5', '$150'][o_custkey % 3 + 1] || CASE WHEN o_orderkey % 2 = 0 THEN ' per month left' ELSE '' END END AS label FROM orders",
    "hours_labels": "SELECT p_partkey, CASE WHEN p_size % 24 = 0 THEN 'all day' ELSE printf('%02d:00-%02d:00', (p_partkey + 1) % 24, (p_partkey + 1 + p_size % 24) % 24) END AS label FROM part",
    "shown_plans": f"WITH {_FLAGGED} SELECT r AS with_review, s AS with_solar_excluding, count(*) AS plans, sum(k)::BIGINT AS ids FROM f, (VALUES (false), (true)) a(r), (VALUES (false), (true)) b(s) WHERE (r OR NOT coalesce(needs_review, false)) AND (s OR NOT coalesce(excludes_solar, false)) GROUP BY 1, 2",
    "quarantined_plans": f"WITH {_FLAGGED} SELECT id FROM f WHERE source IN ('ptc', 'efl:x.pdf', 'meterplan') AND k <> 7",
    "file_names": "SELECT p_partkey, left(regexp_replace(regexp_replace(p_name || '/' || p_brand || ' (' || p_size::VARCHAR || ').pdf', '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 150) AS file FROM part",
    "text_snippets": r"SELECT doc_id, md5(left(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')), 180)) AS snippet, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "text_weekdays": "SELECT o_orderkey, ['5,6', '0,1,2,3,4', '0,1,2,3,4', '5,6', '1,4', ''][o_orderkey % 6 + 1] AS days FROM orders",
    "car_allowance": "SELECT c_custkey, round(least(250.0, 1.5 * 30.4 * (c_nationkey % 12 + 1)), 1)::DOUBLE AS kwh FROM customer",
    "audit_impact": """WITH o AS (SELECT o_orderkey::VARCHAR AS plan_id, ['rate_ckwh', 'base_usd_month', 'etf_usd'][o_orderkey % 3 + 1] AS field, o_custkey % 8 * 0.25::DOUBLE AS stored, CASE WHEN o_custkey % 11 <> 0 THEN o_orderkey % 4 * 0.5::DOUBLE END AS read FROM orders)
        SELECT plan_id, field, round(abs(stored - read) * CASE field WHEN 'rate_ckwh' THEN 120.0 WHEN 'base_usd_month' THEN 12.0 ELSE 1.0 END, 2)::DOUBLE AS impact_usd FROM o WHERE stored IS DISTINCT FROM read""",
    "estimated_share": f"WITH {_YEARS}, {_GAPS} SELECT meter_id, plan_id, CASE WHEN uses_rtw AND filled > 0 THEN fraction ELSE 0.0 END::DOUBLE AS prices_estimated_fraction FROM y LEFT JOIN g USING (meter_id)",
    "billing_notes": f"""WITH {_YEARS}, {_GAPS} SELECT meter_id, 'window ' || c_nationkey::VARCHAR AS note FROM y WHERE k % 5 = 0 OR k % 7 = 0
        UNION SELECT meter_id, 'prices estimated for ' || printf('%.1f', fraction * 100) || ' % of intervals' FROM g SEMI JOIN (SELECT meter_id FROM y WHERE uses_rtw AND NOT skipped) USING (meter_id) WHERE filled > 0""",
    "report_summary": f"""WITH {_YEARS}, h AS ({_HEADS}) SELECT meter_id, rank, plan_id, coalesce(retailer, '(removed)') AS retailer, coalesce(name, plan_id) AS name, term AS term_months, round(net, 2) AS first_year_net,
        CASE WHEN h.id IS NOT NULL THEN 'none' END AS early_termination, coalesce(review, false) AS needs_review FROM y LEFT JOIN h ON h.id = y.plan_id""",
    "supersede_sweep": f"""WITH {_NAMES}, {_TOKENS}, real AS (SELECT id, k, term_months, r, list_sort(list_distinct(list_concat(w, ['online']))) AS w FROM t WHERE k % 2 = 0),
        hits AS (SELECT s.id, s.k, x.k % 4 AS side, min(x.id) AS "by" FROM t s JOIN real x ON s.k % 2 = 1 AND s.k <> 1 AND {_supersedes('s.r', 'x.r', 's.w', 'x.w', 's.term_months', 'x.term_months')} GROUP BY 1, 2, 3)
        SELECT id, CASE WHEN k % 4 = 1 THEN 'plans' ELSE 'drafts' END AS "where", CASE WHEN "by"::INT % 8 = 0 THEN 'keep' ELSE 'remove' END AS action, "by" FROM hits WHERE side = 0
        UNION ALL SELECT id, 'plans', 'flag', "by" FROM hits WHERE side = 2 AND k % 4 = 1 AND k % 3 <> 0 AND id NOT IN (SELECT id FROM hits WHERE side = 0)""",
    "headed_pages": """SELECT page_id, 'Plan ' || page_id::VARCHAR || '-' || n AS plan_name, 'https://example.com/e/' || page_id::VARCHAR || '/' || n AS efl_url, CASE WHEN n = '1' THEN page_id % 2 = 0 END AS is_buyback,
        CASE WHEN n = '1' AND page_id % 2 = 0 THEN page_id % 9 + 0.5 END::DOUBLE AS buyback_ckwh FROM pages, (VALUES ('1'), ('2')) v(n)""",
    "labelled_links": """SELECT page_id, 'T' AS retailer, 'Solar ' || page_id::VARCHAR AS plan_name, '/efl/Sun_Plan_' || page_id::VARCHAR || '.pdf' AS efl_url, true AS is_buyback FROM pages
        UNION ALL SELECT page_id, 'T', 'Basic', '/efl/Basic.pdf', false FROM pages UNION ALL SELECT page_id, 'L', 'Sun Plan ' || page_id::VARCHAR, '/efl/Sun_Plan_' || page_id::VARCHAR || '.pdf', true FROM pages UNION ALL SELECT page_id, 'L', 'Basic', '/efl/Basic.pdf', true FROM pages""",
    "partial_marks": """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'slow & "late" ' || page_id::VARCHAR END AS reason FROM pages""",
    "viewer_addresses": """SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'https://v.example/api/getdocument?docType=EnergyFactsLabel&productid=AB' || page_id::VARCHAR || CASE WHEN page_id % 2 = 0 THEN '&efldate=2026-03-04T00:00:00&tdsp=TNMP' ELSE '&efldate=1970-01-01T00:00:00&tdsp=ONCOR' END
        || '&language=en&classification=Residential' ELSE 'https://v.example/PDFGenerator?comProdId=' || CASE WHEN page_id % 2 = 0 THEN '&efldate=2026-03-04&tdsp=TNMP' ELSE '' END END AS url FROM pages""",
    "platform_cards": """SELECT page_id, 'show_plan' AS retailer, 'Sun ' || page_id::VARCHAR AS plan_name, 'https://example.com/api/getdocument?docType=EnergyFactsLabel&productid=P' || page_id::VARCHAR || '&efldate=1970-01-01T00:00:00&tdsp=ONCOR&language=en&classification=Residential' AS efl_url, true AS is_buyback FROM pages
        UNION ALL SELECT page_id, 'row_list', 'Row ' || page_id::VARCHAR, 'https://example.com/eflviewer.aspx?prodcode=R' || page_id::VARCHAR, false FROM pages
        UNION ALL SELECT page_id, 'data_card', 'Data ' || page_id::VARCHAR, 'https://example.com/api/getdocument?docType=EnergyFactsLabel&productid=D' || page_id::VARCHAR || '&efldate=1970-01-01T00:00:00&tdsp=ONCOR&language=en&classification=Residential', true FROM pages""",
    "refused_hosts": "SELECT 'h' || (page_id % 50)::VARCHAR AS host FROM pages WHERE page_id % 50 % 3 = 0 AND page_id % 50 < 20 GROUP BY 1 HAVING count(DISTINCT url) >= 3",
    "reviewed_links": """WITH p AS (SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN page_id % 2 = 0 END AS b, page_id % 5 = 0 AS yes FROM pages)
        SELECT page_id, CASE WHEN yes AND NOT coalesce(b, false) THEN true ELSE b END AS is_buyback, CASE WHEN yes AND NOT coalesce(b, false) THEN 'reviewed' ELSE 'static' END AS extraction_method, CASE WHEN yes THEN 0.75 END::DOUBLE AS llm_confidence FROM p""",
    "catalogue_edits": f"""WITH {_FLAGGED}, h AS (SELECT k, CASE WHEN k % 4 = 0 THEN 'n' || id WHEN k = 2 THEN 'two' ELSE id END AS id, CASE WHEN k % 4 = 0 THEN true ELSE needs_review END AS needs_review, CASE WHEN k % 4 = 0 THEN -1 ELSE p_size END AS p_size FROM f WHERE k % 4 = 0 OR k % 9 <> 1 OR k = 1),
        d AS (SELECT *, k % 4 <> 0 AND k % 5 = 3 AND k <> 3 AS down FROM h) SELECT CASE WHEN down THEN 'drafts' ELSE 'plans' END AS at, id, CASE WHEN down THEN true ELSE needs_review END AS needs_review, p_size FROM d""",
    "promoted_all": f"""WITH {_FAULTS}, mine AS (SELECT p0.id, ord FROM p0 JOIN plans ON plans.plan_id = base_id WHERE id <> 'flat')
        SELECT id, 'promoted' AS what, CASE WHEN ord % 2 = 0 THEN (ord % 3 = 0)::VARCHAR ELSE 'true' END AS more FROM mine WHERE id NOT IN (SELECT id FROM broken) UNION ALL SELECT id, 'failed', violation FROM broken WHERE id <> 'flat'""",
    "suggested_fields": """WITH p AS (SELECT *, p_size % 3 <> 0 AND p_size % 7 <> 0 AS fits FROM part)
        SELECT p_partkey AS doc_id, CASE WHEN fits AND p_partkey % 2 = 0 THEN p_size ELSE 1.5 END::DOUBLE AS base_charge_usd, 0.0::DOUBLE AS etf_usd, CASE WHEN fits THEN p_size ELSE 12 END::INTEGER AS term_months, fits AS needs_review FROM p""",
    "draft_rows": f"""WITH l AS (SELECT *, CASE WHEN doc_id % 3 <> 0 THEN {_num('doc_id % 40 * 0.25')} || 'c/kWh' WHEN doc_id % 6 = 0 THEN 'indexed' ELSE '?' END AS r FROM labels)
        SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 5 = 0 THEN r || ' / ' || r || ' (2 rates)' ELSE r || ' (1 rate)' END AS rates, least(quality * 0.5, 0.25)::DOUBLE AS least_confidence, doc_id % 2 = 0 AND toxic = 1 AS needs_review FROM l""",
    "price_reach": "SELECT o_orderkey, o_custkey % 6 <> 0 AND o_custkey % 5 < 2 AS short FROM orders",
    # Queries of other modules.
    "plan_validation": f"WITH {_FAULTS} SELECT * FROM broken",
    "sibling_groups": f"""WITH {a.plan_ctes()}, sig AS (SELECT plan_id, ord, concat_ws('|', term_months, base, passthrough, fee, kind, scope, cap, rollover, cash_out, ev_cap, ev_hours::VARCHAR, ev_covers,
          (SELECT string_agg(concat_ws(',', side, n, rate_ckwh, is_rtw, exempt, multiplier, adder_ckwh, cap_ckwh, floor_ckwh, months::VARCHAR, weekdays::VARCHAR, hours::VARCHAR), ';' ORDER BY side, n) FROM rules r WHERE r.plan_id = plans.plan_id),
          (SELECT string_agg(concat_ws(',', min_kwh, max_kwh, credit_usd), ';' ORDER BY min_kwh) FROM credits c WHERE c.plan_id = plans.plan_id)) AS deal FROM plans)
        SELECT s.plan_id AS id, (SELECT arg_min(plan_id, ord) FROM sig x WHERE x.deal = s.deal) AS leader, coalesce((SELECT string_agg(plan_id, ',' ORDER BY ord) FROM sig x WHERE x.deal = s.deal AND x.plan_id <> s.plan_id), '') AS siblings FROM sig s""",
    "plan_inputs": f"SELECT id, retailer, name, term AS term_months, base AS base_charge_usd, n_rates, kind AS buyback_kind, scope AS buyback_offset_scope, cash_out AS buyback_cash_out FROM ({_HEADS})",
    "plan_summary": f"""WITH {a.plan_ctes()}, h AS ({_HEADS}), r AS (SELECT plan_id, string_agg(CASE WHEN rate_ckwh IS NOT NULL THEN {_num('rate_ckwh')} || 'c/kWh' WHEN is_rtw THEN 'indexed' ELSE '?' END, ' / ' ORDER BY n) AS x FROM rules WHERE side = 'energy' GROUP BY 1),
        e AS (SELECT *, CASE kind WHEN 'fixed' THEN {_num('ckwh')} || 'c/kWh' WHEN 'rtw' THEN 'wholesale' WHEN 'windows' THEN 'by time of day' END AS rate,
          concat_ws(', ', CASE WHEN scope = 'energy_only' THEN 'energy charges only' END, CASE WHEN cap = 'energy_charge' THEN 'capped at the energy charge' END, CASE WHEN cash_out THEN 'paid out' WHEN NOT rollover THEN 'lapses monthly' END) AS limits FROM h)
        SELECT e.id, retailer, name, term::VARCHAR || ' months' AS term, x || ' (' || n_rates::VARCHAR || CASE WHEN n_rates = 1 THEN ' rate)' ELSE ' rates)' END AS rates, CASE WHEN kind = 'none' THEN 'none' WHEN limits = '' THEN rate ELSE rate || ' (' || limits || ')' END AS export,
          'none' AS early_termination, review AS needs_review FROM e JOIN r ON r.plan_id = e.id""",
    "stale_plans_first": f"SELECT id, (DATE '2024-06-01' - (DATE '2024-01-01' + ord * 7)) > 90 AS stale FROM ({_HEADS})",
    "index_drafts": f"{_INDEX} SELECT * FROM o",
    "outcome_counts": f"{_INDEX} SELECT outcome, count(*) AS n FROM o GROUP BY 1",
    "tidy_names": """SELECT p_partkey, array_to_string(list_transform(list_filter(string_split_regex(trim(upper(p_name || ' llc')), '\\s+'), lambda w: w <> ''), lambda w: CASE WHEN w IN ('LLC', 'LP', 'LLP', 'INC', 'TX', 'US', 'PUCT', 'PTC', 'AC', 'DBA') THEN w ELSE upper(w[1]) || lower(w[2:]) END), ' ') AS retailer,
        [true, true, false, true, false][p_partkey % 5 + 1] AS no_name FROM part""",
    "name_keys": f"""SELECT page_id, coalesce(nullif(lower(regexp_replace(regexp_replace(translate(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1), '{html.ACCENTED}', '{html.FOLDED}'), '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), ''), 'plan') AS slug FROM pages""",
    "nearest_heading": """WITH l AS (SELECT page_id, regexp_extract_all(html, '(?i)<(?:li|p)\\b[^>]*>(?:<a [^>]*>)?[^<]*') AS parts FROM pages), r AS (SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM l),
        n AS (SELECT *, CASE WHEN lower(left(part, 3)) = '<li' THEN trim(regexp_replace(regexp_replace(part, '<[^>]+>', '', 'g'), '[\\s]+', ' ', 'g')) END AS own FROM r),
        w AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS item FROM n) SELECT page_id, item, count(*) AS paragraphs FROM w WHERE lower(left(part, 2)) = '<p' GROUP BY 1, 2""",
    "html_cards": f"""WITH h AS (SELECT page_id, {_unescape("trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '[ ]+', ' ', 'g'))")} AS name FROM pages)
        SELECT page_id, name || ' ' || n::VARCHAR AS plan_name, 'https://example.com/Home/EFl?productId=' || (page_id * 2 + n % 2)::VARCHAR AS efl_url, true AS is_buyback, (page_id % 9)::DOUBLE AS buyback_ckwh FROM h, (VALUES (1), (2)) v(n)""",
    "reconcile_action": f"""WITH {_NAMES}, {_TOKENS}, q AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'meterplan' ELSE 'ptc' END AS source, k % 3 = 0 AS review FROM t), l AS (SELECT DISTINCT term_months, r, w FROM t WHERE k % 10 IN (2, 3)),
        listed AS (SELECT DISTINCT q.id FROM q JOIN l ON {_supersedes('q.r', 'l.r', 'q.w', 'l.w', 'q.term_months', 'l.term_months')} OR (len({_LESS('q.w', "list_concat(q.r, ['plan'])")}) = 0 AND {_BRAND('q.r', 'l.r')} AND q.term_months = l.term_months))
        SELECT id, CASE WHEN k % 10 IN (0, 4) THEN 'dropped' WHEN k % 10 = 1 AND review THEN 'dropped' WHEN k % 10 = 1 AND source = 'ptc' AND k % 4 <> 1 THEN 'already_reviewed' WHEN k % 10 = 1 THEN 'kept_pending_review'
          WHEN id IN (SELECT id FROM listed) OR NOT (source = 'meterplan' OR {_IN('r', "['alder']")} OR {_IN("['alder']", 'r')}) THEN 'restored' ELSE 'delisted' END AS action FROM q""",
}
