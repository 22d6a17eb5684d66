"""Feed payloads → standard records.

A standard record is one row per source and listing. The payload fields that later
steps read stay as one typed struct column per source, so Catalyst prunes the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (
    blank_to_null,
    epoch_ms_date,
    first_text,
    infer_status,
    parse_date,
    parse_day_range,
    parse_price_band,
    parse_price_range,
    squeeze,
)
from ..functions.doctype import classify_with_hint
from ..rows import once, pick_row

# Source labels in merge order.
FEED_A, FEED_B, FEED_C, FEED_D = "upstox", "nse", "groww", "zerodha"
SOURCES = (FEED_A, FEED_B, FEED_C, FEED_D)

# Payload fields read by the mappers.
FEED_A_SCHEMA = """
    id string, symbol string, name string, status string, isin string, issue_type string,
    issue_size double, minimum_price double, maximum_price double, bidding_start_date string,
    bidding_end_date string, rhp_url string, drhp_url string, lot_size bigint, face_value double,
    industry string, cut_off_price double,
    timeline struct<application_start_date:string,application_end_date:string,
        allotment_date:string,allotment_start_date:string,listing_date:string>
"""
FEED_B_SCHEMA = """
    symbol string, companyName string, company string, ipoStartDate string, issueStartDate string,
    ipoEndDate string, issueEndDate string, listingDate string, priceRange string, issuePrice string,
    status string, isin string, rhpUrl string, drhpUrl string,
    metaInfo struct<isin:string,rhpUrl:string,drhpUrl:string,listingDate:string>
"""
FEED_C_LIST_SCHEMA = """
    searchId string, symbol string, isin string, companyName string, bidStartTimestamp bigint,
    categories array<struct<minPrice:double,maxPrice:double>>
"""
FEED_C_DETAIL_SCHEMA = """
    searchId string, isin string, symbol string, companyName string, status string, minPrice double,
    maxPrice double, startDate string, endDate string, listingDate string, allotmentDate string,
    lastBidPlaceTime string, companyShortName string, documentUrl string, isSme boolean,
    issueType string, issuePrice double, faceValue double, sector string, lotSize bigint,
    issueSize double, registrar string,
    listing struct<listingPrice:double,listedOn:array<string>>,
    subscriptionRates array<struct<category:string,subscriptionRate:double>>
"""
FEED_D_SCHEMA = """
    symbol string, type string, isSme boolean, companyName string, detailPath string,
    biddingRange string, listingDateText string, priceText string, prospectusUrl string
"""

STANDARD = [
    "source", "seq", "isin", "symbol", "company_name", "status", "bidding_start", "price_min",
    "price_max", "rhp", "drhp", "listing_date", *SOURCES,
]


def read_payloads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed JSON lines of one feed; unknown fields are never parsed."""
    return spark.read.schema(schema).json(path)


def _record(df: DataFrame, source: str, payload: list[str] | None = None, **cols: Column) -> DataFrame:
    keep_cols = payload or [c for c in df.columns if not c.startswith("_")]
    if "seq" not in df.columns:
        raise ValueError("payload rows need a seq column: their position in the feed")
    seq = F.col("seq")
    values = {
        "source": F.lit(source),
        "seq": seq,
        "listing_date": F.lit(None).cast("date"),
        **cols,
        source: F.struct(*[F.col(c) for c in keep_cols if c not in ("seq",)]),
    }
    order = [c for c in STANDARD if c in values] + [c for c in values if c not in STANDARD]
    return df.select(*[values[c].alias(c) for c in order])


def map_feed_a(df: DataFrame) -> DataFrame:
    return _record(
        df,
        FEED_A,
        isin=blank_to_null(F.col("isin")),
        symbol=blank_to_null(F.col("symbol")),
        company_name=F.trim(F.regexp_replace(blank_to_null(F.col("name")), r"\s+IPO$", "")),
        status=blank_to_null(F.col("status")),
        bidding_start=parse_date(first_text(F.col("bidding_start_date"), F.col("timeline.application_start_date"))),
        price_min=F.col("minimum_price"),
        price_max=F.col("maximum_price"),
        rhp=blank_to_null(F.col("rhp_url")),
        drhp=blank_to_null(F.col("drhp_url")),
    )


def map_feed_b(df: DataFrame) -> DataFrame:
    status = F.lower(blank_to_null(F.col("status")))
    band = parse_price_range(first_text(F.col("priceRange"), F.col("issuePrice")))
    mapped = _record(
        df,
        FEED_B,
        payload=[c for c in df.columns if c not in ("seq", "bucket")],
        isin=first_text(F.col("isin"), F.col("metaInfo.isin")),
        symbol=blank_to_null(F.col("symbol")),
        company_name=first_text(F.col("companyName"), F.col("company")),
        status=F.when(status == "active", "open").when(status == "past", "closed").otherwise(status),
        bidding_start=parse_date(first_text(F.col("ipoStartDate"), F.col("issueStartDate"))),
        price_min=band["minimum"],
        price_max=band["maximum"],
        rhp=first_text(F.col("rhpUrl"), F.col("metaInfo.rhpUrl")),
        drhp=first_text(F.col("drhpUrl"), F.col("metaInfo.drhpUrl")),
        **({"bucket": F.col("bucket")} if "bucket" in df.columns else {}),
    )
    return mapped


def dedupe_feed_b(mapped: DataFrame) -> DataFrame:
    """One row per symbol; a later bucket (current, upcoming, past) replaces an earlier one.

    Past rows may lack a symbol and are then keyed by name; others are dropped.
    """
    rank = F.when(F.col("bucket") == "current", 0).when(F.col("bucket") == "upcoming", 1).otherwise(2)
    default = F.when(F.col("bucket") == "upcoming", "upcoming").when(F.col("bucket") == "past", "closed")
    key = F.when(F.col("symbol").isNotNull(), F.concat(F.lit("SYM:"), "symbol")).when(
        F.col("bucket") == "past", F.concat(F.lit("NAME:"), F.coalesce(F.col("company_name"), F.lit("null")))
    )
    keyed = (
        mapped.withColumn("status", F.coalesce("status", default))
        .withColumn("_key", key)
        .withColumn("_rank", rank)
        .filter(F.col("_key").isNotNull())
    )
    return pick_row(keyed, ["_key"], [F.col("_rank"), F.col("seq")], last=True).drop("_key", "_rank")


def enrich_past(mapped: DataFrame, details: DataFrame) -> DataFrame:
    """Fill isin and listing date of past rows without an isin from detail rows.

    ``details``: symbol, isin, listing_date text. Rows that already know their isin keep all values.
    """
    one = details.filter(blank_to_null(F.col("symbol")).isNotNull()).groupBy("symbol").agg(
        F.first(blank_to_null(F.col("isin")), ignorenulls=True).alias("_isin"),
        F.first(blank_to_null(F.col("listing_date")), ignorenulls=True).alias("_listing"),
    )
    wanted = (F.col("bucket") == "past") & F.col("isin").isNull()
    return (
        mapped.join(one, "symbol", "left")
        .withColumn("listing_date", F.when(wanted, F.coalesce(parse_date(F.col("_listing")), "listing_date")).otherwise(F.col("listing_date")))
        .withColumn("isin", F.when(wanted, F.col("_isin")).otherwise(F.col("isin")))
        .select(*mapped.columns)
    )


def status_from_detail(bucket: Column, status: Column, listing_price: Column, listed_on: Column) -> Column:
    """Listing facts first, then the detail status, then the list it came from."""
    s = F.upper(F.coalesce(status, F.lit("")))
    return (
        F.when(listing_price.isNotNull(), "listed")
        .when((F.size(listed_on) > 0) & (status == "LISTED"), "listed")
        .when(s == "LISTED", "listed")
        .when(s.isin("ACTIVE", "OPEN"), "open")
        .when(s.isin("UPCOMING", "PRE_APPLY"), "upcoming")
        .when(s == "CLOSED", "closed")
        .otherwise(bucket)
    )


def dedupe_list(lists: DataFrame) -> DataFrame:
    """One list row per listing; the first bucket (open, upcoming, closed) wins."""
    key = first_text(F.col("searchId"), F.col("isin"), F.col("symbol"))
    rank = F.when(F.col("bucket") == "open", 0).when(F.col("bucket") == "upcoming", 1).otherwise(2)
    keyed = lists.withColumn("_key", key).withColumn("_rank", rank).filter(F.col("_key").isNotNull())
    return pick_row(keyed, ["_key"], [F.col("_rank"), F.col("seq")]).drop("_key", "_rank")


def map_feed_c(lists: DataFrame, details: DataFrame, include_listed: bool = True, docs_only: bool = False) -> DataFrame:
    """List rows with their detail row; an upcoming or regulator link is a draft."""
    detail_cols = [c for c in details.columns if c != "searchId"]
    d = details.select("searchId", F.struct(*detail_cols).alias("d"))
    joined = lists.join(d, "searchId", "left")
    status = status_from_detail(
        F.col("bucket"), F.col("d.status"), F.col("d.listing.listingPrice"), F.col("d.listing.listedOn")
    )
    category = F.get(F.col("categories"), F.lit(0))
    from_detail = F.col("d.minPrice").isNotNull()
    doc = blank_to_null(F.col("d.documentUrl"))
    joined = joined.withColumn("_status", status)
    draft = (F.col("_status") == "upcoming") | doc.rlike(r"(?i)sebi\.gov\.in/filings")
    payload = joined.select(
        "*",
        F.col("searchId").alias("search_id"),
        doc.alias("documentUrl"),
        F.when(draft, "drhp").otherwise("rhp").alias("docType"),
    )
    kept = ["search_id", "documentUrl", "docType"] if docs_only else ["search_id", "d", "documentUrl", "docType"]
    out = _record(
        payload,
        FEED_C,
        payload=kept,
        isin=first_text(F.col("isin"), F.col("d.isin")),
        symbol=first_text(F.col("symbol"), F.col("d.symbol")),
        company_name=first_text(F.col("d.companyShortName"), F.col("companyName"), F.col("d.companyName")),
        status=F.col("_status"),
        bidding_start=F.coalesce(parse_date(blank_to_null(F.col("d.startDate"))), epoch_ms_date(F.col("bidStartTimestamp"))),
        price_min=F.when(from_detail, F.col("d.minPrice")).otherwise(category["minPrice"]),
        price_max=F.when(from_detail, F.col("d.maxPrice")).otherwise(
            F.when(category["minPrice"].isNotNull(), category["maxPrice"])
        ),
        rhp=F.when(~F.coalesce(draft, F.lit(False)), doc),
        drhp=F.when(draft, doc),
        listing_date=parse_date(blank_to_null(F.col("d.listingDate"))),
    )
    return out if include_listed else drop_listed(out)


def _inner_text(html: Column) -> Column:
    """Text of an HTML fragment: tags dropped, the common entities decoded."""
    t = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for entity, char in (("&ndash;", "–"), ("&#8377;", "₹"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return squeeze(t)


def _classed(tag: str, name: str, close: bool = True) -> str:
    body = rf"(?is)<{tag}\b[^>]*class=[\"'][^\"']*(?<![\w-]){name}(?![\w-])[^\"']*[\"'][^>]*>"
    return body + (rf"((?:(?!</{tag}>).)*)" if close else "")


def parse_listing_rows(pages: DataFrame, page_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Rows of an HTML listing table, one per detail path and page."""
    rows = pages.select(
        page_col,
        F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("pos", "tr"),
    )
    tr = F.col("tr")
    cell = F.concat(
        F.regexp_extract(tr, _classed("td", "name"), 1), F.regexp_extract(tr, _classed("td", "ipo-logo"), 1)
    )
    logo_first = F.regexp_extract(tr, r"(?is)<td\b[^>]*class=[\"'](?:name|ipo-logo)[\"'][^>]*>((?:(?!</td>).)*)", 1)
    href = F.regexp_extract(F.when(logo_first != "", logo_first).otherwise(cell), r"(?is)<a\b[^>]*href=[\"']([^\"']*)[\"']", 1)
    type_text = _inner_text(F.regexp_extract(tr, _classed("span", "ipo-type"), 1))
    no_type = F.regexp_replace(tr, r"(?is)<span\b[^>]*class=[\"'][^\"']*ipo-type[^\"']*[\"'][^>]*>(?:(?!</span>).)*</span>", "")
    dates = F.regexp_extract_all(tr, F.lit(_classed("td", "date")), F.lit(1))
    bidding = F.regexp_replace(F.get(dates, F.lit(0)), r"(?is)<span\b[^>]*class=[\"'][^\"']*hidden[^\"']*[\"'][^>]*>(?:(?!</span>).)*</span>", "")
    parsed = rows.select(
        page_col,
        "pos",
        _inner_text(F.regexp_extract(no_type, _classed("span", "ipo-symbol"), 1)).alias("symbol"),
        type_text.alias("type"),
        type_text.rlike("(?i)sme").alias("isSme"),
        _inner_text(F.regexp_extract(tr, _classed("span", "ipo-name"), 1)).alias("companyName"),
        F.concat(F.regexp_replace(href, "/$", ""), F.lit("/")).alias("detailPath"),
        F.coalesce(_inner_text(bidding), F.lit("")).alias("biddingRange"),
        F.coalesce(_inner_text(F.get(dates, F.lit(1))), F.lit("")).alias("listingDateText"),
        _inner_text(F.regexp_extract(tr, _classed("td", "text-right"), 1)).alias("priceText"),
    ).filter(F.col("detailPath").rlike(r"^/ipo/\d+/"))
    return pick_row(parsed, [page_col, "detailPath"], [F.col("pos")])


ANCHOR = r"(?is)<a\b[^>]*href=[\"'][^\"']*[\"'][^>]*>(?:(?!</a>).)*</a>"


def page_anchors(html: Column) -> Column:
    """All anchors of a page as array<struct<href, text>> in page order."""
    return F.transform(
        F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0)),
        lambda a: F.struct(
            F.regexp_extract(a, r"(?is)href=[\"']([^\"']*)[\"']", 1).alias("href"),
            _inner_text(a).alias("text"),
        ),
    )


def first_matching_link(pages: DataFrame, word: str = "prospectus", href_part: str = ".pdf", page_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per page the first link whose text has the word and whose address has the part."""
    fits = F.filter(
        page_anchors(F.col(html_col)),
        lambda a: F.lower(a["text"]).contains(word) & F.lower(a["href"]).contains(href_part),
    )
    return pages.select(page_col, F.get(fits, F.lit(0))["href"].alias("href")).filter("href is not null")


def map_feed_d(rows: DataFrame, today: Column) -> DataFrame:
    """Listing rows (with the found prospectus link) to records; 'final' fills the rhp slot."""
    span = parse_day_range(F.col("biddingRange"))
    listing = parse_date(blank_to_null(F.col("listingDateText")))
    band = parse_price_band(F.col("priceText"))
    url = blank_to_null(F.col("prospectusUrl"))
    kind = F.when(url.isNotNull(), classify_with_hint(F.lit(None).cast("string"), url))
    rows = once(rows, {"docType": kind, "_span": span, "_listing": listing})
    return _record(
        rows,
        FEED_D,
        isin=F.lit(None).cast("string"),
        symbol=blank_to_null(F.col("symbol")),
        company_name=blank_to_null(F.col("companyName")),
        status=infer_status(F.col("_span.start"), F.col("_span.end"), F.col("_listing"), today),
        bidding_start=F.col("_span.start"),
        price_min=band["minimum"],
        price_max=band["maximum"],
        rhp=F.when(F.col("docType").isin("rhp", "final"), url),
        drhp=F.when(F.col("docType") == "drhp", url),
        listing_date=F.col("_listing"),
    )


def drop_listed(df: DataFrame) -> DataFrame:
    """Listed rows no longer change; rows without a status stay."""
    return df.filter(~F.col("status").eqNullSafe("listed"))


def combine_feeds(*feeds: DataFrame | None) -> DataFrame:
    """All feeds that arrived, in merge order; ``seq`` becomes a global ordinal.

    The source rank sits above each feed's own position, so no global sort is needed.
    """
    present = [f for f in feeds if f is not None]
    if not present:
        raise ValueError("no feed arrived")
    rank = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(SOURCES) for x in (s, i)]), F.col("source"))
    ranked = [f.withColumn("seq", (rank.cast("bigint") * F.lit(1 << 60)) + F.col("seq")) for f in present]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def unknown_sources(requested: DataFrame, known: tuple[str, ...] = SOURCES) -> DataFrame:
    """Requested source names nobody serves."""
    names = requested.sparkSession.createDataFrame([(k,) for k in known], "source string")
    return requested.join(F.broadcast(names), "source", "left_anti")


def scrape_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
