"""Queries over plan identities, market lists and the refresh round."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity, market
from ..plans.catalogue import stale_first
from . import adapters as a

NAMES = ("Solar BB FlexSM {}", "Smart 1000 Select {}", "Free Nights 9 to 6 {}mo", "e-Plus {} Choice", "Green {} month Saver", "30 Day Plan", "All Nighter-{}", "Renewable Rewards Solar Max {}", "Unlimited")
BRANDS = ("Alder Energy LLC", "ALDER POWER TEXAS", "Birch Retail Services", "Cedar Electric Co.", "The Elm Company")


def _names(spark, sf):
    """parts as plan rows: id, retailer, name, term_months."""
    p = a.table(spark, sf, "part")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    term = F.col("p_size").cast("string")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"),
        pick(BRANDS, F.col("p_partkey")).alias("retailer"),
        F.concat_ws(" ", F.replace(pick(NAMES, F.col("p_partkey")), F.lit("{}"), term), "p_name").alias("name"),
        F.replace(pick(NAMES, F.col("p_partkey")), F.lit("{}"), term).alias("short_name"),
        F.element_at(F.array(*map(F.lit, (12, 24, 36))), (F.col("p_size") % 3 + 1).cast("int")).alias("term_months"),
        "p_size",
    )


def token_set(spark, sf):
    rows = _names(spark, sf)
    return rows.select("id", F.array_join(identity.tokens(F.col("name")), " ").alias("words"), F.array_join(identity.tokens(F.col("retailer")), " ").alias("brand"))


def term_from_name(spark, sf):
    return _names(spark, sf).select("id", identity.term_from_name(F.col("short_name")).alias("term"), identity.term_from_listed_name(F.col("short_name")).alias("listed_term"))


def supersede_join(spark, sf):
    """Odd parts as synthetic rows, even ones as real plans that add a word to a name."""
    rows = _names(spark, sf)
    real = rows.where("id % 2 = 0").select("id", "retailer", F.concat("short_name", F.lit(" Online")).alias("name"), "term_months")
    synthetic = rows.where("id % 2 = 1").select("id", "retailer", F.col("short_name").alias("name"), "term_months")
    return identity.superseded(synthetic, real)


def listing_anti(spark, sf):
    rows = _names(spark, sf).select("id", "retailer", F.col("short_name").alias("plan_name"), identity.term_from_name(F.col("short_name")).alias("term_months"))
    left = rows.where("id % 3 <> 0").select("id", "retailer", "plan_name")
    return identity.not_in_market(left, rows.where("id % 3 = 0 AND id % 5 < 3")).select("id", "plan_name")


def held_anti(spark, sf):
    rows = _names(spark, sf).select("id", "retailer", F.col("short_name").alias("name"), "term_months")
    return identity.not_held(rows.where("id % 2 = 1"), rows.where("id % 4 = 0").withColumn("retailer", F.upper("retailer"))).select("id")


def coverage_prune(spark, sf):
    rows = _names(spark, sf)
    synthetic = rows.where("id % 2 = 1").select("id", "retailer", F.col("short_name").alias("name"), "term_months")
    coverage = rows.where("id % 6 = 0").select("retailer", F.col("short_name").alias("name")).distinct()
    return identity.pruned(synthetic, coverage)


def market_coverage(spark, sf):
    """Retailers surveyed in full: whole live captures, all documents in hand."""
    s = a.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("R"), (F.col("s_suppkey") % 25).cast("string")).alias("retailer"))
    captures = s.select("retailer", (F.col("k") % 2 == 0).alias("live"), (F.col("k") % 5 == 0).alias("partial"))
    discovered = s.select("retailer", F.col("k").cast("string").alias("efl_url"))
    return market.covered_retailers(captures, discovered, discovered.where("efl_url % 11 <> 0").select("efl_url"))


def reconcile_action(spark, sf):
    """What becomes of quarantined plans: rebuilt, drafted, listed or gone."""
    rows = _names(spark, sf)
    quarantine = rows.select("id", "retailer", F.col("short_name").alias("name"), "term_months", F.when(F.col("id") % 7 == 0, "meterplan").otherwise("ptc").alias("source"), (F.col("id") % 3 == 0).alias("needs_review"), F.concat(F.lit("h"), "id").alias("source_sha256"))
    plans = rows.where("id % 10 = 0").select("id")
    drafts = rows.where("id % 10 = 1").select("id", F.lit("ptc").alias("source"), F.concat(F.lit("h"), (F.col("id").cast("int") + F.when(F.col("id") % 4 == 1, 1).otherwise(0)).cast("string")).alias("source_sha256"))
    listings = rows.where("id % 10 IN (2, 3)").select("retailer", F.col("short_name").alias("name"), "term_months")
    done = market.reconciled(quarantine, plans, drafts, listings, rows.where("id % 10 = 4").select("id"), {"ptc_ok": False, "meterplan_ok": True, "coverage_retailers": ["Alder Energy"]})
    return done


def promote_gate(spark, sf):
    """Labels as drafts: quality as confidence of one field, toxicity as the review mark."""
    rows = a.table(spark, sf, "labels")
    confidence = F.create_map(F.lit("energy_charge"), F.lit(0.7) + F.col("quality") * 0.2, F.lit("base_charge"), F.lit(0.85), F.lit("other"), F.lit(0.1))
    return rows.select("doc_id", market.passes_gate(confidence, F.col("toxic") == 1).alias("promoted"))


def rerun_verdicts(spark, sf):
    rows = a.table(spark, sf, "orders").select("o_orderkey", F.nullif(F.concat(F.lit("h"), (F.col("o_custkey") % 3).cast("string")), F.lit("h0")).alias("d"), F.nullif(F.concat(F.lit("h"), (F.col("o_orderkey") % 3).cast("string")), F.lit("h0")).alias("p"), F.col("o_orderstatus").alias("s"))
    return rows.select("o_orderkey", market.rerun_verdict(F.col("d"), F.col("s"), F.col("p"), F.lit("F")).alias("verdict"))


def type_coerce(spark, sf):
    """Customers as a raw market list under other headers."""
    c = a.table(spark, sf, "customer")
    raw = c.select(F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("Rep Company"), F.when(F.col("c_custkey") % 5 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("KWH500"), F.element_at(F.array(*map(F.lit, ("Y", "no", "TRUE", "0", "?"))), (F.col("c_custkey") % 5 + 1).cast("int")).alias("Time-Of-Use"), F.element_at(F.array(*map(F.lit, ("1", "N", ""))), (F.col("c_custkey") % 3 + 1).cast("int")).alias("Fixed"), F.col("c_nationkey").cast("string").alias("TermValue"), F.col("c_mktsegment").alias("Extra Column"), F.col("c_custkey"))
    return market.tidy(raw).select("c_custkey", "retailer", "kwh500", "tou", "rate_type", "term_months", F.col("Extra Column").alias("extra"))


def listing_filter(spark, sf):
    c = a.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("tdu"), F.when(F.col("c_custkey") % 2 == 0, "English").otherwise("Spanish").alias("language"), (F.col("c_custkey") % 3 == 0).alias("tou"), F.col("c_nationkey").cast("long").alias("term_months"))
    return market.filtered(c, tdu="build", tou=False, min_term=3, max_term=20, retailer="absent column")


def index_drafts(spark, sf):
    """Parts as rows of a plan index: what is imported, flagged or skipped."""
    rows = _names(spark, sf).select(F.col("retailer"), F.col("short_name").alias("plan_name"), "term_months", F.when(F.col("p_size") % 9 != 0, F.col("p_size") * 0.5).alias("import_ckwh"), F.element_at(F.array(*map(F.lit, ("fixed", "none", "rtw"))), (F.col("p_size") % 3 + 1).cast("int")).alias("export_kind"), (F.col("p_size") % 8 == 0).alias("battery_required"), F.col("id").alias("row"))
    held = _names(spark, sf).where("id % 12 = 0").select(F.upper("retailer").alias("retailer"), F.col("short_name").alias("name"), "term_months")
    out = market.index_outcomes(rows, held, ("The Elm Company",))
    return out.select("row", "id", "outcome", "rate_confidence", "needs_review")


def outcome_counts(spark, sf):
    return index_drafts(spark, sf).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def newest_snapshot(spark, sf):
    """The latest order of each customer, as a folder's newest file."""
    o = a.table(spark, sf, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


def staleness_flags(spark, sf):
    o = a.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.when(F.col("o_orderkey") % 4 == 0, "report-2026").otherwise("ptc").alias("source"))
    today = F.lit("2001-07-15").cast("date")
    return o.select("o_orderkey", market.usage_is_stale(F.col("d"), today).alias("usage_stale"), market.tariff_is_stale(F.col("d"), today).alias("tariff_stale"), market.plan_is_stale(F.when(F.col("o_orderkey") % 3 != 0, F.col("d")), F.col("source"), today).alias("plan_stale"))


def stale_plans_first(spark, sf):
    plans = a.plans(spark).withColumn("retrieved", F.expr("date_add(DATE'2024-01-01', ord * 7)"))
    return stale_first(plans, "2024-06-01").select("id", "stale")


def tidy_names(spark, sf):
    """Retailer names made readable, and names that are none."""
    p = a.table(spark, sf, "part")
    shouted = F.upper(F.concat("p_name", F.lit(" llc")))
    other = F.element_at(F.array(*map(F.lit, ("PUCT Certificate Number: 10296", "For Service Area: Oncor", "Free Nights 12", "", "Certificate 12"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select("p_partkey", identity.tidy_retailer(shouted).alias("retailer"), identity.is_not_a_name(other).alias("no_name"))


QUERIES = {
    f.__name__: f
    for f in (
        token_set, term_from_name, supersede_join, listing_anti, held_anti, coverage_prune, market_coverage, reconcile_action, promote_gate, rerun_verdicts, type_coerce, listing_filter, index_drafts,
        outcome_counts, newest_snapshot, staleness_flags, stale_plans_first, tidy_names,
    )
}

_q = lambda s: "'" + s.replace("'", "''") + "'"
_list = lambda xs: "[" + ", ".join(map(_q, xs)) + "]"
_NAMES = f"""names AS (SELECT p_partkey::VARCHAR AS id, p_partkey AS k, ({_list(BRANDS)})[p_partkey % {len(BRANDS)} + 1] AS retailer,
  replace(({_list(NAMES)})[p_partkey % {len(NAMES)} + 1], '{{}}', p_size::VARCHAR) AS short_name,
  replace(({_list(NAMES)})[p_partkey % {len(NAMES)} + 1], '{{}}', p_size::VARCHAR) || ' ' || p_name AS name, [12, 24, 36][p_size % 3 + 1] AS term_months, p_size FROM part)"""


def _tokens(x: str, drop: str = "[]::VARCHAR[]") -> str:
    words = f"list_filter(string_split_regex(trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9 ]', ' ', 'g')), ' +'), lambda w: w <> '')"
    bare = f"list_transform({words}, lambda w: CASE WHEN regexp_full_match(w, '([0-9]+|[a-z]{{4,}})(sm|tm)') THEN left(w, length(w) - 2) ELSE w END)"
    bare = f"list_transform({bare}, lambda w: CASE WHEN w = 'bb' THEN 'buyback' ELSE w END)"
    kept = f"list_filter({bare}, lambda w: NOT list_contains({_list(identity.RETAILER_NOISE)}, w) AND NOT regexp_full_match(w, '0*([0-5]?[0-9]|60)') AND NOT regexp_full_match(w, '[0-9]+mo') AND NOT list_contains({drop}, w))"
    return f"list_sort(list_distinct({kept}))"


_TOKENS = f"t AS (SELECT *, {_tokens('retailer')} AS r, {_tokens('short_name')} AS w FROM names)"
_IN = lambda a, b: f"len(list_filter({a}, lambda x: NOT list_contains({b}, x))) = 0"
_LESS = lambda a, b: f"list_filter({a}, lambda x: NOT list_contains({b}, x))"
_BRAND = lambda a, b: f"(len({a}) > 0 AND len({b}) > 0 AND ({_IN(a, b)} OR {_IN(b, a)}))"


def _supersedes(s: str, r: str, sw: str, rw: str, st: str, rt: str) -> str:
    ns, nr = _LESS(sw, f"list_concat({s}, ['plan'])"), _LESS(rw, f"list_concat(list_concat({r}, {s}), ['plan'])")
    return f"({st} = {rt} AND {_BRAND(s, r)} AND len({ns}) > 0 AND {_IN(ns, nr)} AND NOT list_has_any({_LESS(nr, ns)}, {_list(identity.VARIANT_MARKERS)}))"


_TERM = """CASE WHEN try_cast(regexp_extract({x}, '(?i)\\b([0-9]{{1,2}})\\s*-?\\s*(?:months?|mos?)\\b', 1) AS INT) BETWEEN 1 AND 60 THEN try_cast(regexp_extract({x}, '(?i)\\b([0-9]{{1,2}})\\s*-?\\s*(?:months?|mos?)\\b', 1) AS INT)
  ELSE list_filter(list_transform(list_concat(regexp_extract_all(trim({m}), '\\b([0-9]{{1,2}})\\s*$', 1), regexp_extract_all({m}, '\\b([0-9]{{1,2}})\\b', 1)), lambda v: v::INT), lambda v: v BETWEEN 1 AND 60)[1] END"""


def _term(x: str) -> str:
    masked = f"regexp_replace(regexp_replace({x}, {_q(identity.CLOCK_RANGE)}, ' ', 'g'), {_q(identity.COUNTED_UNIT)}, ' ', 'g')"
    return _TERM.format(x=x, m=masked)


_FILLER = _list(identity.NAME_FILLER)
_TERMS = ", ".join(map(str, identity.PLAUSIBLE_TERMS))
ORACLE_SQL = {
    "token_set": f"WITH {_NAMES} SELECT id, array_to_string({_tokens('name')}, ' ') AS words, array_to_string({_tokens('retailer')}, ' ') AS brand FROM names",
    "term_from_name": f"""WITH {_NAMES}, l AS (SELECT *, try_cast(regexp_extract(short_name, '([0-9]{{1,2}})\\s*$', 1) AS INT) AS tail FROM names)
        SELECT id, {_term('short_name')} AS term, CASE WHEN tail IN ({_TERMS}) THEN tail END AS listed_term FROM l""",
    "supersede_join": f"""WITH {_NAMES}, {_TOKENS}, s AS (SELECT * FROM t WHERE k % 2 = 1), r AS (SELECT id, term_months, r, list_sort(list_distinct(list_concat(w, ['online']))) AS w FROM t WHERE k % 2 = 0)
        SELECT s.id, min(r.id) AS "by" FROM s JOIN r ON {_supersedes('s.r', 'r.r', 's.w', 'r.w', 's.term_months', 'r.term_months')} GROUP BY 1""",
    "listing_anti": f"""WITH {_NAMES}, n AS (SELECT *, {_tokens('retailer')} AS r, {_term('short_name')} AS term FROM names), m AS (SELECT *, {_LESS(_tokens('short_name'), f"list_concat(r, {_FILLER})")} AS w FROM n)
        SELECT id, short_name AS plan_name FROM m d WHERE k % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM m k WHERE k.k % 3 = 0 AND k.k % 5 < 3 AND k.term = d.term AND k.w = d.w AND len(d.w) > 0 AND {_BRAND('d.r', 'k.r')})""",
    "held_anti": f"""WITH {_NAMES} SELECT id FROM names a WHERE k % 2 = 1 AND NOT EXISTS (SELECT 1 FROM names b WHERE b.k % 4 = 0 AND lower(a.retailer) = lower(b.retailer) AND lower(a.short_name) = lower(b.short_name) AND a.term_months IS NOT DISTINCT FROM b.term_months)""",
    "coverage_prune": f"""WITH {_NAMES}, {_TOKENS}, c AS (SELECT DISTINCT retailer, short_name FROM names WHERE k % 6 = 0), shops AS (SELECT DISTINCT retailer AS shop, {_tokens('retailer')} AS sr FROM c),
        chosen AS (SELECT t.id, min(shop) AS shop FROM t JOIN shops ON {_BRAND('t.r', 'sr')} WHERE t.k % 2 = 1 GROUP BY 1),
        tested AS (SELECT t.id, x.shop, bool_or({_supersedes('t.r', 's.sr', 't.w', 'l.lw', 't.term_months', 'coalesce(l.lt, t.term_months)')}) AS offered FROM chosen x JOIN t USING (id) JOIN shops s ON s.shop = x.shop
          JOIN (SELECT retailer, {_tokens('short_name')} AS lw, CASE WHEN try_cast(regexp_extract(short_name, '([0-9]{{1,2}})\\s*$', 1) AS INT) IN ({_TERMS}) THEN try_cast(regexp_extract(short_name, '([0-9]{{1,2}})\\s*$', 1) AS INT) END AS lt FROM c) l ON l.retailer = x.shop GROUP BY 1, 2)
        SELECT id, shop AS retailer FROM tested WHERE NOT coalesce(offered, false)""",
    "market_coverage": """WITH s AS (SELECT s_suppkey AS k, 'R' || (s_suppkey % 25)::VARCHAR AS retailer FROM supplier)
        SELECT DISTINCT retailer FROM s WHERE k % 2 = 0 AND k % 5 <> 0 AND retailer NOT IN (SELECT retailer FROM s WHERE k % 11 = 0)""",
    "promote_gate": "SELECT doc_id, toxic <> 1 AND 0.7 + quality * 0.2 >= 0.8 AS promoted FROM labels",
    "rerun_verdicts": """SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'new' WHEN o_orderkey % 3 = 0 THEN 'unknown' WHEN o_orderstatus <> 'F' THEN 'new' WHEN o_custkey % 3 = o_orderkey % 3 THEN 'rerun' ELSE 'new' END AS verdict FROM orders""",
    "type_coerce": """SELECT c_custkey, c_name AS retailer, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS kwh500, [true, false, true, false, NULL][c_custkey % 5 + 1] AS tou, ['fixed', 'variable', NULL][c_custkey % 3 + 1] AS rate_type,
        c_nationkey::BIGINT AS term_months, c_mktsegment AS extra FROM customer""",
    "listing_filter": """SELECT * FROM (SELECT c_custkey, c_mktsegment AS tdu, CASE WHEN c_custkey % 2 = 0 THEN 'English' ELSE 'Spanish' END AS language, c_custkey % 3 = 0 AS tou, c_nationkey::BIGINT AS term_months FROM customer)
        WHERE tdu ILIKE '%build%' AND language = 'English' AND NOT tou AND term_months BETWEEN 3 AND 20""",
    "newest_snapshot": "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1",
    "staleness_flags": """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, DATE '2001-07-15' AS t FROM orders)
        SELECT o_orderkey, t - d > 35 AS usage_stale, t - d > 210 OR EXISTS (SELECT 1 FROM (SELECT unnest(generate_series(DATE '1990-03-01', DATE '2005-09-01', INTERVAL 6 MONTH))::DATE AS b) WHERE b > d AND b <= t) AS tariff_stale,
        CASE WHEN o_orderkey % 3 <> 0 THEN t - d > 90 ELSE o_orderkey % 4 = 0 END AS plan_stale FROM o""",
}
