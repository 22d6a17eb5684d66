"""Facts from prospectus text: shares, lots, objects, promoters.

``docs`` frames have doc_id, text and the columns named per job. Values are found with array
functions inside the row of a document; nothing is shuffled until facts are aggregated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean_object_name, distinct_names, let, letters_key, name_groups, parse_num, parse_shares, round2, split_person_names, squeeze
from ..rows import once
from ..rules import facts as R
from .tables import with_tables

SHARES = "array<bigint>"


# --- share structure ----------------------------------------------------------------------


def _row_shares(cells: Column, label_idx: Column) -> Column:
    """Share count of a labelled row: '<n> equity shares', else the first plain count >= 1000."""
    others = F.transform(cells, lambda c, i: F.when(i == label_idx, "").otherwise(c))
    worded = parse_shares(F.regexp_extract(F.array_join(others, " "), R.SHARES_IN_ROW, 1))
    plain = F.filter(F.transform(others, parse_shares), lambda v: v >= R.LEAST_SHARES)
    return F.coalesce(worded, F.get(plain, F.lit(0)))


#: Any label of any field; a cell without a match is looked at no further.
_ANY_LABEL = "|".join(f"(?:{p})" for patterns in R.SHARE_LABELS.values() for p in patterns)
_TAGGED = "array<struct<label:string,shares:bigint>>"


def _tagged(rows: Column, label_chars: int | None) -> Column:
    """Label cells of all rows with the share count of their row, in order: one pass over the cells."""
    def in_row(row: Column) -> Column:
        def is_label(c: Column) -> Column:
            short = F.lit(True) if label_chars is None else F.length(c) <= label_chars
            return (c != "") & short & c.rlike(_ANY_LABEL)

        found = F.transform(row, lambda c, i: F.when(is_label(c), F.struct(c.alias("label"), _row_shares(row, i).alias("shares"))))
        return F.filter(found, lambda t: t["shares"].isNotNull())

    return F.flatten(F.transform(rows, in_row)).cast(_TAGGED)


def _labelled(tagged: Column, patterns: list[str]) -> Column:
    own = F.filter(tagged, lambda t: reduce(lambda a, b: a | b, [t["label"].rlike(p) for p in patterns]))
    return F.transform(own, lambda t: t["shares"]).cast(SHARES)


def _in_prose(text: Column, lowered: Column, pattern: str, word: str) -> Column:
    """Counts that a pattern finds in running text; only texts with the word can match."""
    hits = F.when(F.contains(lowered, F.lit(word)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(hits, parse_shares), lambda v: v.isNotNull()).cast(SHARES)


def share_candidates(docs: DataFrame, label_chars: int | None = None) -> DataFrame:
    """docs + flat text + one array of candidate counts per field, tables before prose.

    Cells are matched once against all labels together, and only label cells by field. With ``label_chars``
    (surveyed: R.LABEL_CHARS) longer cells are no labels.
    """
    rows = once(with_tables(docs), {"_rows": F.transform(F.flatten("tables"), lambda r: F.transform(r, squeeze)), "_flat": squeeze(F.col("text"))})
    tagged = once(rows, {"_tags": _tagged(F.col("_rows"), label_chars), "_low": F.lower("_flat")})
    fields = {}
    for field, labels in R.SHARE_LABELS.items():
        parts = [_labelled(F.col("_tags"), labels)]
        if field in R.SHARE_PROSE:
            parts.append(_in_prose(F.col("_flat"), F.col("_low"), R.SHARE_PROSE[field], R.PROSE_WORD[field]))
        fields[f"c_{field}"] = F.array_distinct(F.concat(*parts))
    return once(tagged, fields).drop("_rows", "_tags", "_low", "tables")


RESERVED = "struct<score:int,ord:int,fresh:bigint,mm:bigint,emp:bigint,net:bigint>"


def reservation_match(fresh: Column, mm: Column, emp: Column, net: Column) -> Column:
    """struct(fresh, mm, emp, net) with fresh = mm + emp + net; most parts found wins, then the
    earliest candidates; without any such combination the first candidates.

    The net is looked up by equality instead of being enumerated.
    """
    none = F.array(F.lit(None).cast("bigint"))
    parts = F.flatten(
        F.transform(
            F.concat(mm, none),
            lambda m: F.transform(F.concat(emp, none), lambda e: F.struct(m.alias("mm"), e.alias("emp"))),
        )
    )

    def fit(f: Column) -> Column:
        return F.transform(
            parts,
            lambda p: F.struct(
                (-(p["mm"].isNotNull().cast("int") + p["emp"].isNotNull().cast("int"))).alias("score"),
                f.alias("fresh"), p["mm"].alias("mm"), p["emp"].alias("emp"),
                (f - F.coalesce(p["mm"], F.lit(0)) - F.coalesce(p["emp"], F.lit(0))).alias("net"),
            ),
        )

    fits = F.filter(F.flatten(F.transform(fresh, fit)), lambda s: F.array_contains(net, s["net"]))
    ranked = F.transform(
        fits,
        lambda s, i: F.struct(s["score"].alias("score"), i.alias("ord"), s["fresh"].alias("fresh"), s["mm"].alias("mm"), s["emp"].alias("emp"), s["net"].alias("net")),
    )
    def told(best: Column) -> Column:
        def pick(name: str, fallback: Column) -> Column:
            return F.when(best.isNotNull(), best[name]).otherwise(F.get(fallback, F.lit(0))).alias(name)

        return F.struct(pick("fresh", fresh), pick("mm", mm), pick("emp", emp), pick("net", net))

    return let(F.array_min(ranked), told)


def pre_post_match(pre: Column, post: Column, fresh: Column) -> Column:
    """struct(pre, post) with post = pre + fresh, else the first candidates."""
    fit = F.get(F.filter(pre, lambda p: F.array_contains(post, p + fresh)), F.lit(0))
    ok = fit.isNotNull()
    return F.struct(
        F.when(ok, fit).otherwise(F.get(pre, F.lit(0))).alias("pre"),
        F.when(ok, fit + fresh).otherwise(F.get(post, F.lit(0))).alias("post"),
    )


def sale_type(fresh: Column, ofs: Column) -> Column:
    has_fresh, has_ofs = F.coalesce(fresh, F.lit(0)) != 0, F.coalesce(ofs, F.lit(0)) != 0
    return (
        F.when(has_fresh & has_ofs, "Fresh + OFS").when(has_ofs, "Offer for Sale only").otherwise("Fresh capital only")
    )


def issue_details(docs: DataFrame, label_chars: int | None = None) -> DataFrame:
    """docs(doc_id, text, is_sme) → share structure, its invariants and a confidence."""
    sme = F.coalesce(F.col("is_sme"), F.lit(True))
    zero = lambda c: F.coalesce(c, F.lit(0))
    first = lambda f: F.get(f"c_{f}", F.lit(0))
    flat = F.col("_flat")
    found = [F.col(f"c_{f}") for f in ("freshIssueShares", "marketMakerShares", "employeeReservationShares", "netOfferShares")]
    r = once(share_candidates(docs, label_chars), {"_res": reservation_match(*found)})
    ofs_found = first("ofsShares")
    ofs_only = ofs_found.isNotNull() & (F.size("c_freshIssueShares") == 0) & flat.rlike(R.OFS_ONLY)
    r = once(r, {
        "fresh_issue_shares": F.when(sme, F.col("_res.fresh")).otherwise(F.when(ofs_only, F.lit(0).cast("bigint")).otherwise(first("freshIssueShares"))),
        "market_maker_shares": F.when(sme, F.col("_res.mm")),
        "employee_reservation_shares": F.when(sme, F.col("_res.emp")).otherwise(first("employeeReservationShares")),
        "net_offer_shares": F.when(sme, F.col("_res.net")).otherwise(first("netOfferShares")),
        "ofs_shares": F.coalesce(ofs_found, F.when(flat.rlike(R.OFS_NIL), F.lit(0).cast("bigint"))),
    })
    fresh, ofs = F.col("fresh_issue_shares"), F.col("ofs_shares")
    computed = F.when(F.coalesce(fresh, ofs).isNotNull(), zero(fresh) + zero(ofs))
    total = F.when(F.array_contains("c_totalIssueShares", computed), computed).otherwise(
        F.coalesce(first("totalIssueShares"), computed)
    )
    venue = F.lit(None).cast("string")
    for pattern, name in reversed(R.VENUES):
        venue = F.when(flat.rlike(pattern), name).otherwise(venue)
    lowered = F.lower(flat)
    named = F.contains(lowered, F.lit("limited")) & F.contains(lowered, F.lit("maker"))
    names = F.when(named, reduce(F.concat, [F.regexp_extract_all(flat, F.lit(p), F.lit(1)) for p in R.MARKET_MAKER_NAMES])).otherwise(F.array().cast("array<string>"))
    r = once(r, {
        "total_issue_shares": F.when(F.size("c_totalIssueShares") > 0, total).otherwise(computed),
        "_pp": pre_post_match(F.col("c_preIssueShares"), F.col("c_postIssueShares"), fresh),
        "issue_type": F.when(flat.rlike(R.FIXED_PRICE), "Fixed Price").when(flat.rlike(R.BOOK_BUILT), "Bookbuilding"),
        "listing_at": venue,
        "sale_type": sale_type(fresh, ofs),
        "_names": F.filter(F.transform(names, squeeze), lambda n: F.length(n) >= 6),
    })
    r = r.withColumns({"pre_issue_shares": F.col("_pp.pre"), "post_issue_shares": F.col("_pp.post")})
    pre, post, tot, net = (F.col(f"{c}_shares") for c in ("pre_issue", "post_issue", "total_issue", "net_offer"))
    mm, emp = F.col("market_maker_shares"), F.col("employee_reservation_shares")
    r = r.withColumns({
        "post_equals_pre_plus_fresh": F.when(post.isNotNull() & pre.isNotNull() & fresh.isNotNull(), post == pre + fresh),
        "total_equals_fresh_plus_ofs": F.when(tot.isNotNull() & F.coalesce(fresh, ofs).isNotNull(), tot == zero(fresh) + zero(ofs)),
        "fresh_equals_reservations_plus_net": F.when(sme & fresh.isNotNull() & net.isNotNull(), fresh == zero(mm) + zero(emp) + net),
        "net_equals_offer_minus_reservations": F.when(~sme & net.isNotNull() & tot.isNotNull(), net == tot - zero(emp)),
    })
    checks = F.array_compact(F.array(*[F.col(c) for c in ISSUE_CHECKS]))
    sized = (zero(tot) > 0) | (zero(fresh) > 0) | (zero(ofs) > 0)
    confidence = (
        F.when((F.size(checks) == 0) | ~sized, "low").when(F.forall(checks, lambda c: c), "high").otherwise("needs_review")
    )
    kept = [c for c in docs.columns if c != "text"]
    return r.withColumn("confidence", confidence).select(
        *kept, *ISSUE_FIELDS, "issue_type", "listing_at", "sale_type", *ISSUE_CHECKS, "confidence", F.col("_names").alias("market_maker_mentions")
    )


ISSUE_FIELDS = [
    "total_issue_shares", "fresh_issue_shares", "ofs_shares", "market_maker_shares", "employee_reservation_shares",
    "net_offer_shares", "pre_issue_shares", "post_issue_shares",
]
ISSUE_CHECKS = [
    "post_equals_pre_plus_fresh", "total_equals_fresh_plus_ofs", "fresh_equals_reservations_plus_net",
    "net_equals_offer_minus_reservations",
]


def canonical_mentions(df: DataFrame, mentions: str, out: str, threshold: float = 0.9) -> DataFrame:
    """df + ``out``: the group heads of an array of names, most mentioned first (first seen on ties)."""
    staged = df.withColumn("_heads", name_groups(F.col(mentions), threshold))
    ranked = F.array_sort(
        F.transform(
            F.array_distinct("_heads"),
            lambda h, i: F.struct((-F.size(F.filter("_heads", lambda x: x == h))).alias("n"), i.alias("i"), h.alias("h")),
        )
    )
    return staged.withColumn(out, F.transform(ranked, lambda s: s["h"])).drop("_heads")


def with_market_maker(details: DataFrame) -> DataFrame:
    """issue_details + market_maker_name and its variants."""
    staged = canonical_mentions(details, "market_maker_mentions", "market_maker_variants")
    return staged.withColumn("market_maker_name", F.get("market_maker_variants", F.lit(0))).drop("market_maker_mentions")


# Amounts derived from share counts.
AMOUNTS = {
    "totalIssue": "total_issue_shares", "freshIssue": "fresh_issue_shares", "marketMaker": "market_maker_shares",
    "employeeReservation": "employee_reservation_shares", "netOffer": "net_offer_shares",
}


def issue_amounts(details: DataFrame, cap: str = "cap_price", key: str = "doc_id") -> DataFrame:
    """key, field, shares, rupees, amount, unit: share counts at the cap price, in Lakhs or Crore."""
    entries = [F.struct(F.lit(n).alias("field"), F.col(c).alias("shares")) for n, c in AMOUNTS.items() if c in details.columns]
    sme = F.coalesce(F.col("is_sme"), F.lit(True))
    long = details.select(key, cap, sme.alias("_sme"), F.explode(F.array(*entries)).alias("e"))
    rupees = F.col("e.shares") * F.col(cap)
    return long.select(
        key, "e.field", "e.shares", rupees.alias("rupees"),
        round2(rupees / F.when(F.col("_sme"), 1e5).otherwise(1e7)).alias("amount"),
        F.when(F.col("_sme"), "Lakhs").otherwise("Crore").alias("unit"),
    )


# --- lots ---------------------------------------------------------------------------------


def lot_tiers(df: DataFrame, lot: str = "lot_size", price: str = "price", market: str = "market_type") -> DataFrame:
    """Application tiers per row with a lot and a price: category, type, lots, shares, amount."""
    per_lot = F.col(lot) * F.col(price)
    retail = F.floor(F.lit(R.RETAIL_CAP) / per_lot)
    small_max = F.floor(F.lit(R.SMALL_HNI_CAP) / per_lot)
    sme = F.lower(F.col(market)) == "sme"
    small_min = F.when(sme, F.lit(R.SME_LOTS + 1)).otherwise(retail + 1)
    band = small_max >= small_min

    def tier(category: str, kind: str, lots: Column, test: Column, ord_: int) -> Column:
        return F.when(test, F.struct(F.lit(ord_).alias("ord"), F.lit(category).alias("category"), F.lit(kind).alias("type"), lots.cast("bigint").alias("lots")))

    tiers = F.array_compact(F.array(
        tier("Individual", "Fixed", F.lit(R.SME_LOTS), sme, 0),
        tier("Retail", "Min", F.lit(1), ~sme & (retail >= 1), 1),
        tier("Retail", "Max", retail, ~sme & (retail > 1), 2),
        tier("S-HNI", "Min", small_min, band, 3),
        tier("S-HNI", "Max", small_max, band & (small_max > small_min), 4),
        tier("B-HNI", "Min", F.when(band, small_max + 1).otherwise(small_min), F.lit(True), 5),
    ))
    usable = df.filter((F.col(lot) > 0) & (F.col(price) > 0))
    rows = usable.select("*", per_lot.alias("per_lot"), F.explode(tiers).alias("t"))
    shares = F.col("t.lots") * F.col(lot)
    return rows.select(
        *df.columns, "per_lot", "t.category", "t.type", "t.lots", shares.cast("bigint").alias("shares"),
        F.floor(shares * F.col(price) + 0.5).cast("bigint").alias("amount"), F.col("t.ord").alias("tier_ord"),
    )


def lot_warnings(df: DataFrame, lot: str = "lot_size", price: str = "price", market: str = "market_type") -> DataFrame:
    """df + warnings: array of codes for lots that do not fit the application bands."""
    per_lot = F.col(lot) * F.col(price)
    sme = F.lower(F.col(market)) == "sme"
    small_min = F.when(sme, F.lit(R.SME_LOTS + 1)).otherwise(F.floor(F.lit(R.RETAIL_CAP) / per_lot) + 1)
    empty = F.floor(F.lit(R.SMALL_HNI_CAP) / per_lot) < small_min
    return df.withColumn("warnings", F.array_compact(F.array(
        F.when(~sme & (per_lot > R.RETAIL_CAP), "one_lot_exceeds_retail_cap"),
        F.when(sme & (per_lot * R.SME_LOTS <= R.RETAIL_CAP), "sme_minimum_within_retail_cap"),
        F.when(empty, "small_hni_band_empty"),
    )))


def lot_price(issue_price: Column, cap: Column) -> Column:
    """Issue price, else the upper end of the band; zero is missing."""
    zero = F.lit(0).cast("double")
    return F.coalesce(F.nullif(issue_price.cast("double"), zero), F.nullif(cap.cast("double"), zero))


def printed_lot_table(docs: DataFrame) -> DataFrame:
    """doc_id, lot_size, category, type, lots, shares, amount read from running text."""
    number = lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("bigint")
    entries = []
    for category in R.LOT_CATEGORIES:
        for kind in R.LOT_TYPES:
            p = (
                rf"(?i){category}\s*\(?{kind}\)?[^\d]*(\d+)[^\d]*(\d{{1,3}}(?:,\d{{3}})*)[^\d]*(?:₹|Rs\.?\s*)?"
                rf"(\d{{1,3}}(?:,\d{{3}})*)"
            )
            entries.append(F.when(F.col("text").rlike(p), F.struct(
                F.lit(category).alias("category"), F.lit(kind).alias("type"),
                *[number(F.regexp_extract("text", p, g)).alias(n) for g, n in ((1, "lots"), (2, "shares"), (3, "amount"))],
            )))
    lot = F.regexp_extract("text", R.LOT_SIZE, 1).try_cast("int")
    found = docs.select("doc_id", lot.alias("lot_size"), F.array_compact(F.array(*entries)).alias("rows"))
    return found.select("doc_id", "lot_size", F.explode_outer("rows").alias("r")).select("doc_id", "lot_size", "r.*").filter(
        F.col("lot_size").isNotNull() | F.col("category").isNotNull()
    )


# --- objects of the issue -----------------------------------------------------------------


def detect_unit(text: Column) -> Column:
    return F.when(text.rlike(R.UNIT_LAKH), "Lakhs").when(text.rlike(R.UNIT_CRORE), "Crore").otherwise("Lakhs")


def _letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^A-Za-z]+", ""))


def _printed_rows(table: Column) -> Column:
    """Rows with squeezed cells, their text (cells hold no bar) and their first filled cell."""
    def row(r: Column) -> Column:
        cells = F.transform(r, squeeze)
        return F.struct(
            cells.alias("cells"), F.array_join(r, "|").alias("text"),
            F.coalesce(F.get(F.filter(cells, lambda c: c != ""), F.lit(0)), F.lit("")).alias("first"),
        )

    return F.transform(table, row)


def _object_row(row: Column) -> Column:
    """struct(kind, name, amount) of a printed row; kind is header, total, skip or object."""
    cells = row["cells"]
    header = row["text"].rlike("(?i)particulars") & row["text"].rlike("(?i)amount|%")
    total = row["first"].rlike(R.OBJECT_TOTAL)
    widest = F.array_max(F.transform(cells, lambda c, i: F.struct(_letters(c).alias("n"), (-i).alias("o"))))

    def amount_after(pos: Column) -> Column:
        values = F.transform(F.slice(cells, pos.cast("int") + 2, F.size(cells)), parse_num)
        return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))

    def named(at: Column) -> Column:
        def judged(name: Column) -> Column:
            usable = (F.length(name) >= 6) & ~name.rlike(R.OBJECT_META)
            return F.struct(F.when(usable, "object").otherwise("skip").alias("kind"), name.alias("name"), amount_after(at).alias("amount"))

        return let(clean_object_name(F.get(cells, at)), judged)

    none = F.lit(None)
    total_at = F.array_position(F.transform(cells, lambda c: c.rlike(R.OBJECT_TOTAL)), F.lit(True)) - 1
    plain = lambda kind, amount: F.struct(F.lit(kind).alias("kind"), none.cast("string").alias("name"), amount.alias("amount"))
    return (
        F.when(header, plain("header", none.cast("double")))
        .when(total, plain("total", amount_after(total_at)))
        .otherwise(let(widest, lambda w: F.when(w["n"] >= 6, named(-w["o"])).otherwise(plain("skip", none.cast("double")))))
    )


def objects_of_issue(docs: DataFrame, few: int = 2, list_chars: int | None = None) -> DataFrame:
    """doc_id, ord, name, amount, amount_cr, total, total_cr, unit, origin.

    The table with a general-purpose row and most object rows is read; with fewer than ``few``
    objects the numbered list in the text is used when it names more. The list is read to the end of the
    text; with ``list_chars`` (surveyed: R.OBJECT_LIST_SPAN) for so many characters.
    """
    staged = once(with_tables(docs), {"_tables": F.transform("tables", _printed_rows)})

    def score(table: Column) -> Column:
        general = F.exists(table, lambda r: r["text"].rlike(R.GENERAL_PURPOSE))
        hinted = F.size(F.filter(table, lambda r: r["text"].rlike(R.OBJECT_HINT)))
        total = F.exists(table, lambda r: r["first"].rlike(R.OBJECT_TOTAL))
        return F.when(general, hinted + F.when(total, 2).otherwise(0)).otherwise(0)

    ranked = F.transform("_tables", lambda t, i: F.struct(score(t).alias("score"), (-i).alias("o"), i.alias("at")))
    staged = once(staged, {"_best": F.array_max(ranked)})
    rows = F.when(F.col("_best.score") >= 2, F.get("_tables", F.col("_best.at")))
    staged = once(staged, {"_read": F.coalesce(F.transform(rows, _object_row), F.array().cast("array<struct<kind:string,name:string,amount:double>>"))})
    staged = once(staged, {"_flat": squeeze(F.col("text"))})
    staged = once(staged, {"_at": F.regexp_instr("_flat", F.lit(R.OBJECT_LIST_HEAD))})
    at = F.col("_at")
    span = F.when(at > 0, F.substr("_flat", at) if list_chars is None else F.substr("_flat", at, F.lit(list_chars)))
    named = F.filter(
        F.transform(F.regexp_extract_all(span, F.lit(R.OBJECT_LIST_ITEM), F.lit(1)), clean_object_name), lambda n: F.length(n) >= 8
    )
    staged = once(staged, {
        "_objects": F.filter("_read", lambda r: r["kind"] == "object"),
        "_total": F.try_element_at(F.filter("_read", lambda r: r["kind"] == "total"), F.lit(-1))["amount"],
        "_named": F.coalesce(named, F.array().cast("array<string>")),
        "unit": detect_unit(F.col("text")),
    })
    staged = once(staged, {"_lowered": F.transform("_named", F.lower)})
    listed = F.filter("_named", lambda n, i: F.array_position("_lowered", F.get("_lowered", i)) == i + 1)
    staged = once(staged, {"_listed": F.transform(listed, lambda n: F.struct(F.lit("object").alias("kind"), n.alias("name"), F.lit(None).cast("double").alias("amount")))})
    use_list = (F.size("_objects") < few) & (F.size("_listed") > F.size("_objects"))
    staged = once(staged, {
        "_final": F.when(use_list, F.col("_listed")).otherwise(F.col("_objects")),
        "origin": F.when(use_list, "list").otherwise("table"),
    })
    known = F.filter(F.transform("_final", lambda o: o["amount"]), lambda v: v.isNotNull())
    summed = F.when(F.size(known) > 0, round2(F.aggregate(known, F.lit(0.0), lambda a, v: a + v)))
    total = F.coalesce(F.when(F.col("origin") == "table", F.col("_total")), summed)

    def crore(v: Column) -> Column:
        return F.when(F.col("unit") == "Crore", round2(v)).otherwise(round2(v / 100))

    rows = once(staged, {"total": total}).select("doc_id", "unit", "origin", "total", F.posexplode("_final").alias("ord", "o"))
    return rows.select(
        "doc_id", "ord", F.col("o.name").alias("name"), F.col("o.amount").alias("amount"), crore(F.col("o.amount")).alias("amount_cr"),
        "total", crore(F.col("total")).alias("total_cr"), "unit", "origin",
    )


# --- promoters ----------------------------------------------------------------------------


def _named_at(names: Column, place: str) -> Column:
    return let(names, lambda n: F.when(F.size(n) > 0, F.struct(F.lit(place).alias("place"), n.alias("names"))))


def promoter_names(docs: DataFrame) -> DataFrame:
    """doc_id, promoters, confidence, origin, evidence (map name key → kind of place)."""
    flat = once(docs, {"_flat": squeeze(F.col("text"))})
    hits = []
    for pattern, place in R.PROMOTER_PATTERNS:
        names = let(F.regexp_extract("_flat", pattern, 1), lambda raw: F.when(F.length(F.trim(raw)) >= 5, distinct_names(split_person_names(raw))))
        hits.append(_named_at(names, place))
    found = once(flat, {"_hits": F.array_compact(F.array(*hits))}).filter(F.size("_hits") > 0)
    strong = F.exists("_hits", lambda h: h["place"] == "cover") | (F.size("_hits") >= 2)
    tagged = F.flatten(F.transform("_hits", lambda h: F.transform(h["names"], lambda n: F.struct(letters_key(n).alias("k"), h["place"].alias("p")))))
    def places(held: Column) -> Column:
        keys = F.array_distinct(F.transform(held, lambda t: t["k"]))
        return F.map_from_entries(
            F.transform(keys, lambda k: F.struct(k, F.get(F.filter(held, lambda t: t["k"] == k), F.lit(0))["p"]))
        )

    evidence = let(tagged, places)
    return found.select(
        "doc_id",
        distinct_names(F.flatten(F.transform("_hits", lambda h: h["names"]))).alias("promoters"),
        F.when(strong, "high").otherwise("medium").alias("confidence"),
        F.when(strong, "multi").otherwise(F.get("_hits", F.lit(0))["place"]).alias("origin"),
        evidence.alias("evidence"),
    )
