"""Plan identity across sources: significant tokens, terms in names, and the joins built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words without identity in retailer names.
RETAILER_NOISE = (
    "llc", "lp", "inc", "co", "company", "corp", "corporation", "retail",
    "services", "service", "energy", "utilities", "utility", "power",
    "electric", "electricity", "texas", "tx", "rep", "cert", "certificate",
    "number", "no", "dba", "the", "of", "and",
)
# Abbreviations one source spells out.
SYNONYMS = {"bb": "buyback"}
# Words that tell products of one family apart.
VARIANT_MARKERS = (
    "plus", "saver", "max", "match", "pro", "premier", "premium", "select",
    "advantage", "basic", "lite", "light", "prime", "ultra", "elite",
    "choice", "preferred", "value", "edge", "flex", "secure", "complete",
)
# Filler in plan names.
NAME_FILLER = ("plan", "sm", "tm", "new", "customer", "special", "product", "residential", "meters", "meter")
# Contract lengths in months that are sold.
PLAUSIBLE_TERMS = (1, 3, 5, 6, 9, 10, 11, 12, 13, 14, 18, 24, 36, 48, 60)
LONGEST_TERM = 60
#: Columns of an identity row.
IDENTITY = ("id", "retailer", "name", "term_months")


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def tokens(text: Column, drop: Column | None = None) -> Column:
    """Distinct significant words, sorted.

    Words of a-z and 0-9 without noise, terms (numbers up to 60) and `<n>mo`; a service mark fused to
    a number or to a word of four letters or more comes off; `drop` removes further words.
    """
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9 ]", " ")), " +")
    marked = lambda w: F.regexp_like(w, F.lit(r"^(?:\d+|[a-z]{4,})(?:sm|tm)$"))
    bare = F.transform(words, lambda w: F.when(marked(w), F.left(w, F.length(w) - 2)).otherwise(w))
    spelled = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    bare = F.transform(bare, lambda w: F.coalesce(F.try_element_at(spelled, w), w))
    term = lambda w: F.regexp_like(w, F.lit(r"^0*(?:[0-5]?\d|60)$")) | F.regexp_like(w, F.lit(r"^\d+mo$"))
    kept = F.filter(bare, lambda w: (w != "") & ~w.isin(*RETAILER_NOISE) & ~term(w))
    if drop is not None:
        kept = F.array_except(kept, drop)
    return F.array_sort(F.array_distinct(kept))


def within(a: Column, b: Column) -> Column:
    """Whether every element of a is in b."""
    return F.size(F.array_except(a, b)) == 0


def same_brand(a: Column, b: Column) -> Column:
    """Whether one retailer's words are all among the other's; never for a name without words."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (within(a, b) | within(b, a))


def with_tokens(rows: DataFrame) -> DataFrame:
    """Adds r_tokens (retailer) and name_words (all significant words of the name)."""
    return rows.withColumns({"r_tokens": tokens(F.col("retailer")), "name_words": tokens(F.col("name"))})


def supersedes(synthetic: str, real: str) -> Column:
    """Whether the aliased `real` row covers the `synthetic` one: same term and brand, all of the synthetic
    name's words in the real name, and no variant marker among what the real name adds."""
    s, r = F.col(f"{synthetic}.r_tokens"), F.col(f"{real}.r_tokens")
    plan_word = _strings(["plan"])
    n_s = F.array_except(F.col(f"{synthetic}.name_words"), F.array_union(s, plan_word))
    n_r = F.array_except(F.col(f"{real}.name_words"), F.array_union(F.array_union(r, s), plan_word))
    added = F.array_except(n_r, n_s)
    return (
        (F.col(f"{synthetic}.term_months") == F.col(f"{real}.term_months"))
        & same_brand(s, r)
        & (F.size(n_s) > 0)
        & within(n_s, n_r)
        & ~F.arrays_overlap(added, _strings(VARIANT_MARKERS))
    )


def _by_rarest_word(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(l, r) structs of rows equal in keys, where r's name has the rarest word of l's `need`.

    A name that holds all the needed words holds that one too, so no such pair is lost, and words that
    every name has are no reason to meet. Both sides should be distinct identities.
    """
    words = right.select(*keys, F.explode("name_words").alias("word"), F.struct(*right.columns).alias("r"))
    often = words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    asked = left.select(*keys, F.struct(*left.columns).alias("l"), F.explode("need").alias("word")).join(often, [*keys, "word"])
    chosen = asked.groupBy(*keys, "l").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    return chosen.join(words, [*keys, "word"]).select("l", "r")


def superseded(synthetic: DataFrame, real: DataFrame) -> DataFrame:
    """(id, by): synthetic rows covered by a real one; of several the first by id.

    Distinct identities (term, words of brand and name) are compared, ids come back by an equi-join.
    """
    own = ["term_months", "r_tokens", "name_words"]
    s = with_tokens(synthetic.select(*IDENTITY))
    r = with_tokens(real.select(*IDENTITY)).groupBy(*own).agg(F.min("id").alias("by"))
    need = s.select(*own).distinct().withColumn("need", F.array_except("name_words", F.array_union("r_tokens", _strings(["plan"]))))
    hits = _by_rarest_word(need, r, ["term_months"]).where(supersedes("l", "r"))
    covered = hits.groupBy(*(F.col(f"l.{c}").alias(c) for c in own)).agg(F.min("r.by").alias("by"))
    return s.join(covered, own).select("id", "by")


def supersede_actions(plans: DataFrame, drafts: DataFrame, delisted: DataFrame, current_id: str) -> DataFrame:
    """(id, where, action, by) for synthetic plans and drafts.

    remove: a promoted real plan covers it; keep: that real plan was delisted in this run; flag: only
    a real draft covers a plan. Rows of the current plan and drafts without promoted cover get none.
    """
    synthetic = lambda df: df.where((F.col("source") == "meterplan") & (F.col("id") != current_id))
    real = lambda df: df.where(F.coalesce("source", F.lit("")) != "meterplan")
    gone = delisted.select(F.col("id").alias("by"), F.lit(True).alias("is_delisted")).distinct()

    def covered(df: DataFrame, where: str) -> DataFrame:
        hits = superseded(synthetic(df), real(plans)).join(gone, "by", "left")
        return hits.select("id", F.lit(where).alias("where"), F.when(F.col("is_delisted"), "keep").otherwise("remove").alias("action"), "by")

    by_plan = covered(plans, "plans")
    flags = superseded(synthetic(plans).where("NOT coalesce(needs_review, false)"), real(drafts)).join(by_plan, "id", "left_anti")
    return by_plan.unionByName(covered(drafts, "drafts")).unionByName(flags.select("id", F.lit("plans").alias("where"), F.lit("flag").alias("action"), "by"))


# How names state a term, and numbers that are not one.
EXPLICIT_TERM = r"(?i)\b(\d{1,2})\s*-?\s*(?:months?|mos?)\b"
CLOCK_RANGE = r"(?i)\b\d{1,2}\s*(?:a\.?m\.?|p\.?m\.?)?\s*(?:to|through|until|-|–|—)\s*\d{1,2}\s*(?:a\.?m\.?|p\.?m\.?)?"
COUNTED_UNIT = r"(?i)\b\d{1,2}\s*(?:a\.?m\.?|p\.?m\.?|days?|hours?|hrs?|weeks?|%|kwh|cents?)\b"


def term_from_name(name: Column) -> Column:
    """Months: an explicit count, else a trailing number, else the first one, after clock ranges and counted units are blanked; 1 to 60."""
    text = F.coalesce(name, F.lit(""))
    plausible = lambda x: F.filter(F.transform(x, lambda v: v.try_cast("int")), lambda v: v.between(1, LONGEST_TERM))
    explicit = F.try_element_at(plausible(F.slice(F.regexp_extract_all(text, F.lit(EXPLICIT_TERM), F.lit(1)), 1, 1)), F.lit(1))
    masked = F.regexp_replace(F.regexp_replace(text, CLOCK_RANGE, " "), COUNTED_UNIT, " ")
    trailing = F.regexp_extract_all(F.trim(masked), F.lit(r"\b(\d{1,2})\s*$"), F.lit(1))
    numbers = F.regexp_extract_all(masked, F.lit(r"\b(\d{1,2})\b"), F.lit(1))
    return F.coalesce(explicit, F.try_element_at(plausible(F.concat(trailing, numbers)), F.lit(1)))


def term_from_listed_name(name: Column) -> Column:
    """A trailing number that is a contract length in use."""
    n = F.nullif(F.regexp_extract(F.coalesce(name, F.lit("")), r"(\d{1,2})\s*$", 1), F.lit("")).try_cast("int")
    return F.when(n.isin(*PLAUSIBLE_TERMS), n)


def market_index(listing: DataFrame) -> DataFrame:
    """Identity rows of a market list: term_months, r_tokens, n_tokens (name words without brand and filler)."""
    rows = listing.withColumn("r_tokens", tokens(F.col("retailer")))
    return rows.withColumn("n_tokens", tokens(F.col("plan_name"), F.array_union("r_tokens", _strings(NAME_FILLER))))


def not_in_market(discovered: DataFrame, listing: DataFrame) -> DataFrame:
    """Discovered (retailer, plan_name) rows the market list does not have already.

    A row is a duplicate if brand and term agree and the distinctive words are the same; rows whose
    name has no term, no distinctive word or no brand stay. Joined on (term, words).
    """
    found = discovered.withColumn("term_months", term_from_name(F.col("plan_name")))
    found = market_index(found).alias("d")
    known = market_index(listing).alias("k")
    same = (
        (F.col("d.term_months") == F.col("k.term_months"))
        & (F.col("d.n_tokens") == F.col("k.n_tokens"))
        & (F.size("d.n_tokens") > 0)
        & same_brand(F.col("d.r_tokens"), F.col("k.r_tokens"))
    )
    return found.join(known, same, "left_anti").select(*discovered.columns)


def not_held(rows: DataFrame, held: DataFrame) -> DataFrame:
    """Rows whose (retailer, name, term) is not held, compared in lower case, null terms equal to each other."""
    key = lambda df: df.withColumns({"_r": F.lower(F.trim("retailer")), "_n": F.lower(F.trim("name")), "_t": F.col("term_months")})
    a, b = key(rows).alias("a"), key(held).alias("b")
    same = (F.col("a._r") == F.col("b._r")) & (F.col("a._n") == F.col("b._n")) & F.col("a._t").eqNullSafe(F.col("b._t"))
    return a.join(b, same, "left_anti").select(*rows.columns)


def pruned(synthetic: DataFrame, coverage: DataFrame) -> DataFrame:
    """(id, retailer): synthetic rows of a fully surveyed retailer that it does not sell.

    coverage: (retailer, name), names null for a retailer with none. The first retailer by name that
    is of the row's brand decides. A listed name's own term is compared; without one the row's.
    """
    own = ["term_months", "r_tokens", "name_words"]
    rows = with_tokens(synthetic.select(*IDENTITY))
    shops = coverage.select("retailer").distinct().withColumn("shop_tokens", tokens(F.col("retailer")))
    brands = rows.select("r_tokens").distinct()
    words = brands.withColumn("word", F.explode("r_tokens")).join(shops.withColumn("word", F.explode("shop_tokens")), "word")
    chosen = words.where(same_brand(F.col("r_tokens"), F.col("shop_tokens"))).groupBy("r_tokens").agg(F.min("retailer").alias("shop"))
    sold = coverage.where("name IS NOT NULL").select(F.col("retailer").alias("shop"), "name").distinct()
    sold = sold.select("shop", tokens(F.col("shop")).alias("r_tokens"), tokens(F.col("name")).alias("name_words"), term_from_listed_name(F.col("name")).alias("listed_term")).distinct()
    mine = rows.select(*own).distinct().join(chosen, "r_tokens")
    asked = mine.withColumn("need", F.array_except("name_words", F.array_union("r_tokens", _strings(["plan"]))))
    pairs = _by_rarest_word(asked, sold, ["shop"])
    # Without a term of its own a listed name has the row's.
    listed = F.col("r").withField("term_months", F.coalesce("r.listed_term", "l.term_months"))
    offered = pairs.select("l", listed.alias("r")).where(supersedes("l", "r")).select(*(F.col(f"l.{c}").alias(c) for c in own)).distinct()
    match = [rows[c].eqNullSafe(offered[c]) for c in own]
    return rows.join(offered, match, "left_anti").join(chosen, "r_tokens").select("id", F.col("shop").alias("retailer"))


def still_listed(plans: DataFrame, listings: DataFrame) -> DataFrame:
    """(id) of plans that some listing (retailer, name, term, null: unknown) still offers; names without a
    distinctive word fall back to brand and term."""
    p = with_tokens(plans.select(*IDENTITY))
    k = listings.select("retailer", "name", F.col("term_months").alias("listed_term")).withColumns({"r_tokens": tokens(F.col("retailer")), "name_words": tokens(F.col("name"))})
    # Listings that read alike decide alike: one of them meets the plans.
    k = k.select("listed_term", "r_tokens", "name_words").distinct()
    words = p.withColumn("word", F.explode("r_tokens")).alias("p").join(k.withColumn("word", F.explode("r_tokens")).alias("k"), "word")
    l = F.struct(F.col("p.term_months").alias("term_months"), F.col("p.r_tokens").alias("r_tokens"), F.col("p.name_words").alias("name_words"))  # noqa: E741
    r = F.struct(F.coalesce("listed_term", "p.term_months").alias("term_months"), F.col("k.r_tokens").alias("r_tokens"), F.col("k.name_words").alias("name_words"))
    pairs = words.select("id", l.alias("l"), r.alias("r"))
    plain = F.size(F.array_except("l.name_words", F.array_union("l.r_tokens", _strings(["plan"])))) == 0
    generic = plain & same_brand(F.col("l.r_tokens"), F.col("r.r_tokens")) & (F.col("l.term_months") == F.col("r.term_months"))
    return pairs.where(supersedes("l", "r") | generic).select("id").distinct()


# Boilerplate that a search for a plan's name can hit.
NOT_A_NAME = (
    r"(?i)^\s*(?:(?:puct|rep)\s*certificat(?:e|ion)(?:\s*(?:no\.?|number|#))?[\s:#.]*\d*"
    r"|certificat(?:e|ion)\s*(?:no\.?|number|#)[\s:#.]*\d*"
    r"|(?:for\s+)?[\w .,'-]*?service\s+area\b.*)\s*$"
)
# Words of retailer names that stay in capitals.
KEPT_CAPITALS = ("LLC", "LP", "LLP", "INC", "TX", "US", "PUCT", "PTC", "AC", "DBA")


def is_not_a_name(name: Column) -> Column:
    text = F.trim(F.coalesce(name, F.lit("")))
    return (text == "") | (text == "Unnamed Plan") | F.regexp_like(text, F.lit(NOT_A_NAME))


def tidy_retailer(name: Column) -> Column:
    """Shouted names in title case, legal forms kept; mixed case stays."""
    text = F.trim(F.coalesce(name, F.lit("")))
    bare = lambda w: F.upper(F.regexp_replace(w, r"^[.,]+|[.,]+$", ""))
    titled = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.when(bare(w).isin(*KEPT_CAPITALS), w).otherwise(F.initcap(w)))
    return F.when((text == "") | (text != F.upper(text)), text).otherwise(F.array_join(titled, " "))
