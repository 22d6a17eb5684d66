"""Queries: the two detail feeds, stored records, dates and statuses, and what documents hold on several pages.

Payloads, pages and sheets are assembled from the shared tables, one per row, with values that differ by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..functions import doctype
from ..operators import facts, items, listing, pages, parties, quality, stored
from ..rows import once
from ..session import shared_folder
from ..sources import feeds, files
from .registry import query, spread, table
from .sheets import LINES, STATEMENT_KEYS, STATEMENT_LABELS, _key_sql, _money, _pick, order_lines

NOW = "2026-06-07 10:00:00"


def _text(c: Column) -> Column:
    return c.cast("string")


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


# --- dates and statuses -------------------------------------------------------------------


@query("date_rules", """
WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS s FROM orders),
r AS (SELECT *, make_date(year(d), month(d), CAST(1 + k % 20 AS INTEGER)) AS start, make_date(year(d), month(d), CAST(1 + k % 20 + k % 6 AS INTEGER)) AS stop, CASE WHEN s = 'F' THEN d + 30 END AS listing FROM o)
SELECT k AS o_orderkey, strftime(d, '%Y-%m-%d') AS iso, k % 71 <= 30 AS near, start, stop,
  CASE WHEN listing < DATE '1995-06-17' THEN 'listed' WHEN stop < DATE '1995-06-17' THEN 'closed' WHEN start > DATE '1995-06-17' THEN 'upcoming' ELSE 'open' END AS status,
  CASE WHEN k % 7 <> 0 THEN d END AS from_millis
FROM r
""")
def date_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges such as '05th – 09th Jun 1995', day distances, statuses by date and epoch milliseconds."""
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    o = table(spark, folder, "orders").select(
        k, d.alias("d"), F.when(F.col("o_orderstatus") == "F", F.date_add(d, 30)).alias("listing"),
        F.concat(
            F.lpad(_text(1 + k % 20), 2, "0"), F.lit("th – "), F.lpad(_text(1 + k % 20 + k % 6), 2, "0"), F.lit("th "), F.date_format(d, "MMM yyyy")
        ).alias("range"),
        F.when(k % 7 == 0, F.lit(0)).otherwise(F.unix_date(d).cast("bigint") * 86_400_000).alias("millis"),
    )
    o = once(o, {"r": fn.parse_day_range(F.col("range"))})
    return o.select(
        "o_orderkey", fn.format_iso(F.col("d")).alias("iso"), fn.within_days(F.col("d"), F.date_add("d", (k % 71).cast("int"))).alias("near"),
        F.col("r.start").alias("start"), F.col("r.end").alias("stop"),
        fn.infer_status(F.col("r.start"), F.col("r.end"), F.col("listing"), F.lit("1995-06-17").cast("date")).alias("status"), fn.epoch_ms_date(F.col("millis")).alias("from_millis"),
    )


# --- feeds C and D ------------------------------------------------------------------------

FEED_C = """
lists AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'upcoming' ELSE 'closed' END AS bucket, DATE '2026-01-01' + CAST(p_partkey % 300 AS INTEGER) AS d FROM part),
det AS (SELECT *, k % 2 = 0 AS has,
    CASE WHEN k % 10 = 0 THEN 'listed' WHEN k % 10 = 2 THEN 'open' WHEN k % 10 = 4 THEN 'upcoming' WHEN k % 10 = 6 THEN 'listed' ELSE bucket END AS status,
    CASE WHEN k % 2 = 0 THEN 'https://' || CASE WHEN k % 4 = 0 THEN 'www.sebi.gov.in/filings/' ELSE 'docs/' END || k END AS url FROM lists),
c AS (
  SELECT k, 'I' || k AS isin, CASE WHEN k % 5 <> 0 THEN 'SY' || k WHEN has THEN 'DS' || k END AS symbol, CASE WHEN has THEN 'Short ' || k ELSE 'Long name ' || k END AS company_name,
    CASE WHEN has THEN status ELSE bucket END AS status, CASE WHEN has AND k % 6 = 0 THEN d + 7 ELSE d END AS bidding_start,
    CASE WHEN k % 4 = 2 THEN k + 1 ELSE k END AS price_min, CASE WHEN k % 4 = 2 THEN k + 2 ELSE k + 10 END AS price_max, url,
    has AND (status = 'upcoming' OR k % 4 = 0) AS draft, CASE WHEN has AND k % 10 = 6 THEN d + 20 END AS listing_date FROM det)
"""


def _feed_c(spark: SparkSession, folder: str, **options: bool) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, folder, "part")
    day = F.date_add(F.lit("2026-01-01").cast("date"), (k % 300).cast("int"))
    price = k.cast("double")
    key = F.concat(F.lit("s"), _text(k))
    bucket = F.when(k % 3 == 0, "open").when(k % 3 == 1, "upcoming").otherwise("closed")
    lists = p.select(
        k.alias("seq"), key.alias("searchId"), F.when(k % 5 != 0, F.concat(F.lit("SY"), _text(k))).otherwise("").alias("symbol"), F.concat(F.lit("I"), _text(k)).alias("isin"),
        F.concat(F.lit("Long name "), _text(k)).alias("companyName"), (F.unix_date(day).cast("bigint") * 86_400_000).alias("bidStartTimestamp"),
        F.array(F.struct(price.alias("minPrice"), (price + 10).alias("maxPrice"))).alias("categories"), bucket.alias("bucket"),
    )
    last = k % 10
    status = F.when(last == 0, "LISTED").when(last == 2, "Active").when(last == 4, "PRE_APPLY").when(last == 6, "CLOSED").otherwise("")
    own = F.when(k % 4 == 2, price + 1)
    details = p.filter(k % 2 == 0).select(
        key.alias("searchId"), _none().alias("isin"), F.concat(F.lit("DS"), _text(k)).alias("symbol"), F.concat(F.lit("Detail "), _text(k)).alias("companyName"), status.alias("status"),
        own.alias("minPrice"), (own + 1).alias("maxPrice"), F.when(k % 6 == 0, F.date_format(F.date_add(day, 7), "yyyy-MM-dd")).otherwise("").alias("startDate"),
        F.when(last == 6, F.date_format(F.date_add(day, 20), "dd-MMM-yyyy")).alias("listingDate"), F.concat(F.lit("Short "), _text(k)).alias("companyShortName"),
        F.concat(F.when(k % 4 == 0, "https://www.sebi.gov.in/filings/").otherwise("https://docs/"), _text(k)).alias("documentUrl"),
        F.struct(F.when(last == 6, price).alias("listingPrice"), F.array().cast("array<string>").alias("listedOn")).alias("listing"),
    )
    return feeds.map_feed_c(feeds.dedupe_list(lists), details, **options)


@query("map_feed_c", f"""
WITH {FEED_C}
SELECT k AS seq, isin, symbol, company_name, status, bidding_start, CAST(price_min AS DOUBLE) AS price_min, CAST(price_max AS DOUBLE) AS price_max,
  CASE WHEN url IS NOT NULL AND NOT draft THEN url END AS rhp, CASE WHEN draft THEN url END AS drhp, listing_date FROM c
""")
def map_feed_c(spark: SparkSession, folder: str) -> DataFrame:
    """List rows, half of them with a detail row that decides status, prices and the kind of document."""
    return _feed_c(spark, folder).select("seq", "isin", "symbol", "company_name", "status", "bidding_start", "price_min", "price_max", "rhp", "drhp", "listing_date")


@query("feed_c_documents", f"""
WITH {FEED_C} SELECT k AS seq, 's' || k AS search_id, url AS document_url, CASE WHEN draft OR status = 'upcoming' THEN 'drhp' ELSE 'rhp' END AS doc_type, 3 AS fields FROM c WHERE status <> 'listed'
""")
def feed_c_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Listed rows dropped at the scan, payloads trimmed to their documents."""
    df = _feed_c(spark, folder, include_listed=False, docs_only=True)
    fields = len(df.schema[feeds.FEED_C].dataType.fields)
    c = F.col(feeds.FEED_C)
    return df.select("seq", c["search_id"].alias("search_id"), c["documentUrl"].alias("document_url"), c["docType"].alias("doc_type"), F.lit(fields).alias("fields"))


def _listing_pages(spark: SparkSession, folder: str) -> DataFrame:
    """An HTML listing per supplier nation with a row per supplier; every fifth row leads elsewhere."""
    k = F.col("s_suppkey")
    month = F.lpad(_text(1 + k % 12), 2, "0")
    start = F.make_date(F.lit(2026), 1 + k % 12, 1 + k % 20)
    path = F.concat(F.when(k % 5 == 0, "/other/").otherwise("/ipo/"), _text(k), F.lit("/supplier-"), _text(k), F.when(k % 2 == 0, "/").otherwise(""))
    row = F.concat(
        F.lit('<tr><td class="ipo-logo"><a href="'), path, F.lit('"><img/></a></td><td class="name"><a href="'), path, F.lit('"><span class="ipo-symbol">SYM'), _text(k),
        F.lit('<span class="ipo-type">'), F.when(k % 3 == 0, "SME").otherwise("Mainboard"), F.lit('</span></span><span class="ipo-name text-12">Supplier &amp; Sons '), _text(k),
        F.lit('</span></a></td><td class="date"><span class="hidden">2026-'), month, F.lit("</span>"), F.lpad(_text(1 + k % 20), 2, "0"), F.lit("th – "), F.lpad(_text(4 + k % 20), 2, "0"), F.lit("th "),
        F.date_format(start, "MMM yyyy"), F.lit('</td><td class="date">'), F.when(k % 4 == 0, "-").otherwise(F.date_format(F.date_add(start, 9), "dd MMM yyyy")),
        F.lit('</td><td class="text-right">₹'), F.format_string("%,d", k * 10), F.lit(" &ndash; ₹"), F.format_string("%,d", k * 10 + 5), F.lit("</td></tr>"),
    )
    s = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("page_id"), k.alias("k"), row.alias("row"))
    return s.groupBy("page_id").agg(F.concat(F.lit("<table>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda x: x["row"]), "\n"), F.lit("</table>")).alias("html"))


LISTED_ROWS = """
k AS (SELECT s_suppkey AS k, s_nationkey AS page_id, make_date(2026, CAST(1 + s_suppkey % 12 AS INTEGER), CAST(1 + s_suppkey % 20 AS INTEGER)) AS start FROM supplier WHERE s_suppkey % 5 <> 0)
"""


@query("listing_rows", f"""
WITH {LISTED_ROWS}
SELECT page_id, 'SYM' || k AS symbol, CASE WHEN k % 3 = 0 THEN 'SME' ELSE 'Mainboard' END AS type, k % 3 = 0 AS is_sme, 'Supplier & Sons ' || k AS company_name, '/ipo/' || k || '/supplier-' || k || '/' AS path FROM k
""")
def listing_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = feeds.parse_listing_rows(_listing_pages(spark, folder))
    return rows.select("page_id", "symbol", "type", F.col("isSme").alias("is_sme"), F.col("companyName").alias("company_name"), F.col("detailPath").alias("path"))


@query("map_feed_d", f"""
WITH {LISTED_ROWS},
r AS (SELECT *, start + 3 AS stop, CASE WHEN k % 4 <> 0 THEN start + 9 END AS listing FROM k)
SELECT 'SYM' || k AS symbol, 'Supplier & Sons ' || k AS company_name,
  CASE WHEN listing < DATE '2026-06-07' THEN 'listed' WHEN stop < DATE '2026-06-07' THEN 'closed' WHEN start > DATE '2026-06-07' THEN 'upcoming' ELSE 'open' END AS status,
  start AS bidding_start, CAST(k * 10 AS DOUBLE) AS price_min, CAST(k * 10 + 5 AS DOUBLE) AS price_max,
  CASE WHEN k % 3 = 1 THEN 'https://x/' || k || '-rhp.pdf' WHEN k % 3 = 2 THEN 'https://x/' || k || '-final.pdf' END AS rhp, CASE WHEN k % 3 = 0 THEN 'https://x/' || k || '-drhp.pdf' END AS drhp, listing AS listing_date
FROM r
""")
def map_feed_d(spark: SparkSession, folder: str) -> DataFrame:
    """Listing rows with the link that their detail page shows as prospectus."""
    rows = feeds.parse_listing_rows(_listing_pages(spark, folder)).withColumn("k", F.regexp_extract("detailPath", r"/ipo/(\d+)/", 1).cast("bigint"))
    name = F.when(F.col("k") % 3 == 1, "-rhp").when(F.col("k") % 3 == 2, "-final").otherwise("-drhp")
    page = F.concat(F.lit('<a href="https://x/notice.pdf">Grievances</a> <a href="https://x/form.html">Prospectus</a> <a class="b" href="https://x/'), _text(F.col("k")), name, F.lit('.pdf">Download <b>Prospectus</b> (PDF)</a>'))
    links = feeds.first_matching_link(rows.select("k", page.alias("html")), page_col="k").withColumnRenamed("href", "prospectusUrl")
    full = rows.join(links, "k").withColumn("seq", F.col("k"))
    mapped = feeds.map_feed_d(full.drop("k", "page_id", "pos"), F.lit("2026-06-07").cast("date"))
    return mapped.select("symbol", "company_name", "status", "bidding_start", "price_min", "price_max", "rhp", "drhp", "listing_date")


@query("enrich_past", """
SELECT 'C' || c_custkey AS symbol, CASE c_custkey % 3 WHEN 0 THEN 'past' WHEN 1 THEN 'current' ELSE 'upcoming' END AS bucket,
  CASE WHEN c_custkey % 4 = 0 THEN 'OWN' || c_custkey WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 1 THEN 'IN' || c_custkey END AS isin,
  CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 <> 0 AND c_custkey % 2 = 1 THEN DATE '2026-02-01' + CAST(c_custkey % 90 AS INTEGER) END AS listing_date
FROM customer
""")
def enrich_past(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, folder, "customer")
    symbol = F.concat(F.lit("C"), _text(k))
    mapped = c.select(
        symbol.alias("symbol"), F.when(k % 3 == 0, "past").when(k % 3 == 1, "current").otherwise("upcoming").alias("bucket"),
        F.when(k % 4 == 0, F.concat(F.lit("OWN"), _text(k))).alias("isin"), _none("date").alias("listing_date"),
    )
    details = c.filter(k % 2 == 1).select(symbol.alias("symbol"), F.concat(F.lit("IN"), _text(k)).alias("isin"), F.date_format(F.date_add(F.lit("2026-02-01").cast("date"), (k % 90).cast("int")), "dd-MMM-yyyy").alias("listing_date"))
    return feeds.enrich_past(mapped, details)


@query("prospectus_links", """
SELECT s_suppkey AS page_id, CASE WHEN s_suppkey % 3 = 0 THEN 'https://x/p' || s_suppkey || '.pdf' ELSE 'https://x/q' || s_suppkey || '.PDF' END AS href FROM supplier WHERE s_suppkey % 4 <> 0
""")
def prospectus_links(spark: SparkSession, folder: str) -> DataFrame:
    """Both the text and the address of a link decide; a quarter of the pages has no fitting one."""
    k = F.col("s_suppkey")
    link = lambda href, text: F.concat(F.lit("<A HREF='"), href, F.lit("'><i>"), F.lit(text), F.lit("</i></A>"))
    first = F.when(k % 3 == 0, link(F.concat(F.lit("https://x/p"), _text(k), F.lit(".pdf")), "The Prospectus")).otherwise(link(F.lit("https://x/annual.pdf"), "Annual report"))
    html = F.concat(link(F.lit("/prospectus.html"), "Prospectus"), first, link(F.concat(F.lit("https://x/q"), _text(k), F.lit(".PDF")), "red herring PROSPECTUS"))
    none = F.concat(link(F.lit("/prospectus.html"), "Prospectus"), link(F.lit("https://x/annual.pdf"), "Annual report"))
    return feeds.first_matching_link(table(spark, folder, "supplier").select(k.alias("page_id"), F.when(k % 4 == 0, none).otherwise(html).alias("html")))


# --- stored records -----------------------------------------------------------------------


def _masters(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    key, bal = _text(k), F.col("c_acctbal")
    day = F.date_add(F.lit("2026-01-01").cast("date"), (k % 300).cast("int"))
    a = F.struct(
        F.when(k % 5 == 0, "SME IPO").when(k % 5 == 1, "Regular").otherwise("").alias("issue_type"), F.when(k % 2 == 0, k % 90).alias("lot_size"), F.lit("Foods").alias("industry"),
        F.lit(10.0).alias("face_value"), bal.alias("cut_off_price"), F.lit(5.0).alias("issue_size"), F.concat(F.lit("http://X/A"), key).alias("rhp_url"), F.lit("").alias("drhp_url"),
        F.struct(F.date_format(F.date_add(day, 3), "yyyy-MM-dd").alias("application_end_date"), F.lit("soon").alias("listing_date")).alias("timeline"),
    )
    rates = F.array(*[F.struct(F.lit(c).alias("category"), (k % 7 + i).cast("double").alias("subscriptionRate")) for i, c in enumerate(("retail", "QIB", "RETAIL"))])
    detail = F.struct(
        (k % 2 == 1).alias("isSme"), F.when(k % 4 == 1, "Chemicals").alias("sector"), (k % 50 + 1).cast("bigint").alias("lotSize"), F.when(k % 3 == 0, bal + 1).alias("issuePrice"),
        F.date_format(F.date_add(day, 4), "dd-MMM-yyyy").alias("endDate"), F.lit("Kfin").alias("registrar"), F.when(k % 3 != 0, rates).alias("subscriptionRates"),
    )
    c = F.struct(detail.alias("d"), F.lit("drhp").alias("docType"), F.when(k % 2 == 0, F.concat(F.lit("http://x/c"), key)).alias("documentUrl"), F.concat(F.lit("http://g/"), key).alias("detailUrl"))
    return spread(table(spark, folder, "customer"), "c_custkey").select(
        k.alias("entity_id"), F.when(k % 2 == 0, F.concat(F.lit("I"), key)).otherwise("").alias("isin"), F.concat(F.lit("S"), key).alias("symbol"), F.concat(F.lit("Master "), key, F.lit(" Limited")).alias("company_name"),
        F.when(k % 6 == 0, "").otherwise("open").alias("status"), bal.alias("price_min"), (bal + 10).alias("price_max"), F.when(k % 3 != 0, day).alias("bidding_start"), _none("date").alias("listing_date"),
        F.when(k % 4 == 0, F.concat(F.lit("http://x/a"), key)).alias("rhp"), _none().alias("drhp"), F.when(k % 3 != 2, a).alias(feeds.FEED_A), F.when(k % 4 != 3, c).alias(feeds.FEED_C),
    )


MASTERS = """
m AS (SELECT c_custkey AS k, c_acctbal AS bal, DATE '2026-01-01' + CAST(c_custkey % 300 AS INTEGER) AS day, c_custkey % 3 <> 2 AS a, c_custkey % 4 <> 3 AS c FROM customer),
docs AS (
  SELECT k, 1 AS ord, 'rhp' AS doc_type, 'http://x/a' || k AS url, 'merged' AS source FROM m WHERE k % 4 = 0
  UNION ALL SELECT k, 2, 'rhp', 'http://X/A' || k, 'upstox' FROM m WHERE a
  UNION ALL SELECT k, 3, 'drhp', 'http://x/c' || k, 'groww' FROM m WHERE c AND k % 2 = 0)
"""


@query("to_stored", f"""
WITH {MASTERS}
SELECT k AS entity_id, 'master-' || k || '-ipo' AS slug, CASE WHEN k % 2 = 0 THEN 'I' || k END AS isin, 'Master ' || k || ' Limited IPO' AS display_name, CASE WHEN k % 6 <> 0 THEN 'open' END AS status,
  CASE WHEN a AND k % 5 = 0 THEN 'SME' WHEN a AND k % 5 = 1 THEN 'MAINBOARD' WHEN c THEN CASE WHEN k % 2 = 1 THEN 'SME' ELSE 'MAINBOARD' END END AS issue_type,
  coalesce(CASE WHEN c AND k % 4 = 1 THEN 'Chemicals' END, CASE WHEN a THEN 'Foods' END) AS sector, coalesce(CASE WHEN c AND k % 3 = 0 THEN bal + 1 END, CASE WHEN a THEN bal END) AS issue_price,
  coalesce(CASE WHEN a AND k % 2 = 0 THEN k % 90 END, CASE WHEN c THEN k % 50 + 1 END) AS lot_size, CASE WHEN k % 3 <> 0 THEN day END AS bidding_start,
  coalesce(CASE WHEN c THEN day + 4 END, CASE WHEN a THEN day + 3 END) AS bidding_end, CASE WHEN c AND k % 3 <> 0 THEN CAST(k % 7 + 2 AS DOUBLE) END AS retail, CASE WHEN c AND k % 3 <> 0 THEN CAST(k % 7 + 1 AS DOUBLE) END AS qualified,
  concat_ws(',', CASE WHEN a THEN 'upstox' END, CASE WHEN c THEN 'groww' END) AS sources, CASE WHEN c THEN 'http://g/' || k END AS detail_url
FROM m
""")
def to_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Merged records to stored ones: the fields of two payloads by precedence."""
    s = stored.to_stored(_masters(spark, folder), F.lit(NOW).cast("timestamp"))
    return s.select(
        "entity_id", "slug", "isin", "display_name", "status", "issue_type", "sector", "issue_price", "lot_size", "bidding_start", "bidding_end",
        F.col("subscription.retail").alias("retail"), F.col("subscription.qualified").alias("qualified"),
        F.concat_ws(",", *[F.when(F.array_contains(F.map_keys("sources"), x), x) for x in (feeds.FEED_A, feeds.FEED_C)]).alias("sources"),
        F.try_element_at("sources", F.lit(feeds.FEED_C))["url"].alias("detail_url"),
    )


@query("documents_map", f"""
WITH {MASTERS}, d AS (SELECT *, lower(regexp_replace(url, '/+$', '')) AS u FROM docs),
one AS (SELECT k, u, min(ord) AS ord, arg_min(doc_type, ord) AS doc_type, arg_min(source, ord) AS source, arg_min(url, ord) AS url FROM (SELECT k, ord, doc_type, source, url, url AS u FROM d) GROUP BY 1, 2)
SELECT k AS entity_id, doc_type, arg_min(url, ord) AS url, arg_min(source, ord) AS source FROM one GROUP BY 1, 2
""")
def documents_map(spark: SparkSession, folder: str) -> DataFrame:
    """The first document of each type of a record, as rows of its map."""
    s = stored.to_stored(_masters(spark, folder), F.lit(NOW).cast("timestamp"))
    return s.select("entity_id", F.explode("documents").alias("doc_type", "d")).select("entity_id", "doc_type", "d.url", "d.source")


@query("records_with_documents", f"WITH {MASTERS} SELECT k AS entity_id, CAST(count(DISTINCT url) AS INTEGER) AS documents, CAST(count(DISTINCT (url, source)) AS INTEGER) AS mentions FROM docs GROUP BY 1")
def records_with_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Only records that have a document stay."""
    got = stored.collect_documents(_masters(spark, folder))
    return got.select("entity_id", F.size("documents").alias("documents"), F.size(F.flatten(F.transform("documents", lambda d: d["sources"]))).alias("mentions"))


@query("merged_and_raw_views", f"""
WITH {MASTERS} SELECT 'master-' || k || '-ipo' AS slug, a AS raw_first, c AS raw_second, 0 AS payloads_in_merged FROM m
""")
def merged_and_raw_views(spark: SparkSession, folder: str) -> DataFrame:
    """The raw view has the payloads, the merged view everything else."""
    s = stored.to_stored(_masters(spark, folder), F.lit(NOW).cast("timestamp"))
    merged = stored.merged_view(s)
    left = sum(c in merged.columns for c in feeds.SOURCES)
    raw = stored.raw_view(s).select("slug", F.col(feeds.FEED_A).isNotNull().alias("raw_first"), F.col(feeds.FEED_C).isNotNull().alias("raw_second"))
    return merged.select("slug").join(raw, "slug").withColumn("payloads_in_merged", F.lit(left))


@query("retry_selection", "SELECT o_orderkey AS doc_id, 'error' AS status FROM orders WHERE o_orderstatus = 'P'")
def retry_selection(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "error").when(F.col("o_orderstatus") == "F", "extracted")
    return listing.retry_selection(table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), status.alias("status")))


# --- files --------------------------------------------------------------------------------


@query("master_files", """
SELECT c_custkey AS key, c_name AS company_name, c_acctbal AS price, 'ipos/' || upper(regexp_replace('s ' || c_custkey, '[^a-zA-Z0-9]+', '_', 'g')) || '/rhp.md' AS artifact_key FROM customer
""")
def master_files(spark: SparkSession, folder: str) -> DataFrame:
    """Master records written as files of JSON arrays, one per nation, read back, written as a table and read again."""
    c = table(spark, folder, "customer")
    one = F.to_json(F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("company_name"), F.col("c_acctbal").alias("price")))
    arrays = c.groupBy(F.col("c_nationkey").alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("value"))
    root = shared_folder(spark, "master")
    arrays.write.partitionBy("part").text(f"{root}/json")
    read = files.read_master(spark, f"{root}/json/*/*.txt", "key long, company_name string, price double")
    files.write_reconciled(read, read.limit(0), f"{root}/out")
    back = spark.read.parquet(f"{root}/out/master").withColumns({"symbol": F.concat(F.lit("s "), _text(F.col("key"))), "slug": F.lit("x"), "doc_type": F.lit("rhp")})
    return files.with_artifact_key(back).select("key", "company_name", "price", "artifact_key")


@query("gold_files", """
SELECT 'S' || n_nationkey AS symbol, n_nationkey % 2 = 0 AS verified, 'ebitda' AS key, CAST(i AS INTEGER) AS period_idx, 'FY' || (25 - i) AS period, CAST(n_nationkey * 10 + i AS DOUBLE) AS value FROM nation, range(2) t(i)
""")
def gold_files(spark: SparkSession, folder: str) -> DataFrame:
    """Hand-checked truth, one JSON file per nation."""
    k = F.col("n_nationkey")
    body = F.to_json(F.struct(
        F.concat(F.lit("S"), _text(k)).alias("symbol"), (k % 2 == 0).alias("_verified"), F.array(F.lit("FY25"), F.lit("FY24")).alias("periods"),
        F.create_map(F.lit("ebitda"), F.array((k * 10).cast("double"), (k * 10 + 1).cast("double"))).alias("metrics"),
    ))
    root = shared_folder(spark, "gold")
    table(spark, folder, "nation").select(k.alias("part"), body.alias("value")).write.partitionBy("part").text(root)
    return files.gold_cells(files.read_gold(spark, f"{root}/*/*.txt"))


# --- documents ----------------------------------------------------------------------------


@query("document_covers", """
SELECT p_partkey AS doc_id, CASE p_partkey % 5 WHEN 0 THEN 'drhp' WHEN 1 THEN 'rhp' WHEN 2 THEN 'final' ELSE 'drhp' END AS doc_type,
  CASE p_partkey % 5 WHEN 0 THEN 'cover' WHEN 1 THEN 'cover' WHEN 2 THEN 'cover' WHEN 3 THEN 'filename' ELSE 'default' END AS method,
  CASE p_partkey % 5 WHEN 0 THEN 'drhp' WHEN 1 THEN 'rhp' WHEN 2 THEN 'final' END AS by_cover, CASE p_partkey % 2 WHEN 0 THEN 'riskFactors' ELSE 'basisForOfferPrice' END AS section, CASE p_partkey % 2 WHEN 0 THEN 'risk-factors' ELSE 'kpis' END AS short
FROM part
""")
def document_covers(spark: SparkSession, folder: str) -> DataFrame:
    """Covers that name a type, wherever on the page, ahead of file names, and section names both ways."""
    k = F.col("p_partkey")
    filler = F.repeat(F.concat("p_comment" if "p_comment" in table(spark, folder, "part").columns else "p_name", F.lit(" words ")), 40)
    cover = F.concat(filler, F.when(k % 5 == 0, "Draft Red  Herring\nProspectus").when(k % 5 == 1, "RED HERRING PROSPECTUS").when(k % 5 == 2, "this prospectus, dated").otherwise("Annual report"))
    url = F.concat(F.lit("https://x/"), _text(k), F.when(k % 5 == 3, "-drhp.pdf").otherwise("-a.pdf"))
    short = F.when(k % 2 == 0, "risk-factors").otherwise("kpis")
    v = doctype.classify_document(url, cover)
    return table(spark, folder, "part").select(
        k.alias("doc_id"), v["doc_type"].alias("doc_type"), v["method"].alias("method"), doctype.classify_by_cover(cover)["doc_type"].alias("by_cover"),
        doctype.canonical_section(short).alias("section"), doctype.short_section(doctype.canonical_section(short)).alias("short"),
    )


@query("contents_pages", "SELECT o_orderkey AS doc_id, o_orderkey % 3 = 0 OR o_orderkey % 7 >= 5 AS contents, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 7 >= 5 THEN 0 ELSE 6 END AS score FROM orders")
def contents_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A heading or five dotted lines make a contents page, which scores nothing as a page of ratios."""
    k = F.col("o_orderkey")
    dotted = F.array_join(F.transform(F.sequence(F.lit(1), (k % 7 + 1).cast("int")), lambda i: F.concat(F.lit("Chapter "), _text(i), F.lit(" ........ "), _text(i * 3))), "\n")
    lines = F.array_join(F.slice(F.split(dotted, "\n"), F.lit(1), (k % 7).cast("int")), "\n")
    text = F.concat(F.when(k % 3 == 0, "Table of Contents\n").otherwise(""), F.lit("Return on net worth 12%\nKey performance indicators\n"), lines)
    p = table(spark, folder, "orders").select(k.alias("doc_id"), text.alias("text"))
    return p.select("doc_id", pages.is_contents_page(F.col("text")).alias("contents"), pages.ratio_score(F.col("text")).alias("score"))


def _paged(spark: SparkSession, folder: str, labels: list[str], page: Column, skip: Column) -> DataFrame:
    """A sheet per order and page: a header and the lines of that page."""
    def cell(x: float, y: Column, text: Column) -> Column:
        return F.struct(F.lit(x).alias("x"), y.cast("double").alias("y"), text.alias("str"))

    head = F.array(cell(50.0, F.lit(700), F.lit("Particulars")), cell(300.0, F.lit(700), F.concat(F.lit("March 20"), _text(24 + page))), cell(400.0, F.lit(700), F.concat(F.lit("March 20"), _text(23 + page))))
    some = F.filter("l", lambda x: ~skip & (x["no"] >= page))
    body = F.flatten(F.transform(some, lambda x, i: F.array(
        cell(50.0, 680 - 20 * i, _pick(labels, x["no"])), cell(301.0, 680 - 20 * i, _money(x["price"] * page)), cell(399.0, 680 - 20 * i, F.concat(F.lit("("), _money(x["qty"]), F.lit(")"))),
    )))
    return order_lines(spark, folder).select("doc_id", page.cast("int").alias("page"), F.posexplode(F.concat(head, body)).alias("seq", "c")).select("doc_id", "page", "seq", "c.*")


PAGED = """
q AS (SELECT l_orderkey AS doc_id, CAST(p AS INTEGER) AS page, key, arg_min({'a': l_extendedprice * p, 'b': -l_quantity}, rn) AS v FROM keyed, range(1, 3) t(p)
      WHERE key IS NOT NULL AND l_linenumber >= p AND NOT (p = 1 AND l_orderkey % 3 = 0) GROUP BY 1, 2, 3),
first AS (SELECT doc_id, key, min(page) AS page FROM q GROUP BY 1, 2),
opening AS (SELECT doc_id, min(page) AS page FROM q GROUP BY 1)
SELECT q.doc_id, q.key, q.page, CAST(i AS INTEGER) AS period_idx, 'March 20' || (24 + o.page - i) AS period, CASE i WHEN 0 THEN v.a ELSE v.b END AS value
FROM q JOIN first USING (doc_id, key, page) JOIN opening o ON o.doc_id = q.doc_id, range(2) t(i)
"""


def _two_pages(spark: SparkSession, folder: str, labels: list[str]) -> DataFrame:
    first = _paged(spark, folder, labels, F.lit(1), F.col("doc_id") % 3 == 0)
    return first.unionByName(_paged(spark, folder, labels, F.lit(2), F.lit(False)))


@query("metrics_over_pages", f"WITH {LINES}, keyed AS (SELECT *, {_key_sql(STATEMENT_KEYS)} AS key FROM lines), " + PAGED)
def metrics_over_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Statements on two pages: each metric from its first page, labels from the first page with any."""
    return items.first_page_wins(items.item_statements(_two_pages(spark, folder, STATEMENT_LABELS)))


@query("item_ratios", f"WITH {LINES}, keyed AS (SELECT *, CASE l_linenumber WHEN 1 THEN 'roce' WHEN 2 THEN 'ronw' WHEN 3 THEN 'debtEquity' WHEN 5 THEN 'patMargin' END AS key FROM lines), " + PAGED)
def item_ratios(spark: SparkSession, folder: str) -> DataFrame:
    labels = ["RoCE", "Return on net worth", "Debt equity", "Sundry one", "PAT margin", "Sundry two", "Sundry three"]
    return items.first_page_wins(items.item_ratios(_two_pages(spark, folder, labels)))


@query("promoter_holding", """
SELECT o_orderkey AS doc_id, CAST(o_orderkey % 60 + 20.25 AS DOUBLE) AS pre_issue, CAST(o_orderkey % 40 + 10.5 AS DOUBLE) AS post_issue FROM orders WHERE o_orderkey % 5 <> 0
""")
def promoter_holding(spark: SparkSession, folder: str) -> DataFrame:
    """The first total row with two percentages; a later page has another one, and some rows have one only."""
    k = F.col("o_orderkey")
    cell = lambda page, y, x, text: F.struct(F.lit(page).alias("page"), F.lit(y).alias("y"), F.lit(x).alias("x"), text.alias("str"))
    cells = F.array(
        cell(2, 500.0, 50.0, F.lit("Total promoters")), cell(2, 500.0, 200.0, F.format_string("%d.00%%", k % 60)),
        cell(3, 400.0, 50.0, F.lit("Total - Promoter group")), cell(3, 400.0, 200.0, F.format_string("%.2f%%", k % 60 + 20.25)), cell(3, 400.0, 300.0, F.lit("shares")),
        F.when(k % 5 != 0, cell(3, 400.0, 400.0, F.format_string("%.2f%%", k % 40 + 10.5))), F.when(k % 5 != 0, cell(4, 600.0, 50.0, F.lit("Promoters total 1.00% 2.00%"))),
    )
    it = table(spark, folder, "orders").select(k.alias("doc_id"), F.posexplode(F.array_compact(cells)).alias("seq", "c")).select("doc_id", "seq", "c.*")
    return items.promoter_holding(it)


@query("best_pages", f"""
WITH {LINES}, s AS (SELECT l_orderkey AS doc_id, p AS page, count(DISTINCT CASE WHEN l_linenumber BETWEEN 1 AND 6 AND l_linenumber >= p AND NOT (p = 1 AND l_orderkey % 3 = 0) THEN l_linenumber END) AS n FROM lines, range(1, 3) t(p) GROUP BY 1, 2)
SELECT doc_id, CAST(arg_max(page, {{'n': n, 'p': -page}}) AS INTEGER) AS page FROM s WHERE n > 0 GROUP BY 1
""")
def best_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The page with most fields, the first on ties; brackets are no numbers, so no page has year columns."""
    found = items.page_fields(_two_pages(spark, folder, STATEMENT_LABELS))
    return items.best_page(found).select("doc_id", F.col("page").cast("int").alias("page"))


@query("registrars", """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Bigshare Services Limited' ELSE 'Kfin Technologies Limited' END AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'ipo@bigshareonline.com' END AS email FROM orders
""")
def registrars(spark: SparkSession, folder: str) -> DataFrame:
    """Two registrars are named; the one with an address goes first, else the first named."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Registrar to the Issue: Kfin Technologies Limited. Registrar to the Offer, Bigshare Services Limited; "), F.when(k % 3 == 0, "write to ipo@bigshareonline.com").otherwise("write to us"))
    d = table(spark, folder, "orders").select(k.alias("doc_id"), text.alias("text"))
    return parties.pick_registrar(parties.parties_of(d)).select("doc_id", "name", "email")


@query("market_makers", """
SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'Rikhav Securities Limited' ELSE 'Spread X Broking Private Limited' END AS name, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS variants FROM part
""")
def market_makers(spark: SparkSession, folder: str) -> DataFrame:
    """The name mentioned most often; spellings of one name are one mention group."""
    k = F.col("p_partkey")
    other = " Rikhav Securities Limited will act as the market maker."
    text = F.concat(
        F.when(k % 2 == 0, "Rikhav Securities Limited will act as the market maker. RIKHAV SECURITIES LIMITED will act as the market maker.").otherwise(
            "Spread X Broking Private Limited will act as the market maker. Spread X Broking Private Limited will act as the market maker." + other),
    )
    d = table(spark, folder, "part").select(k.alias("doc_id"), text.alias("text"), F.lit(True).alias("is_sme"))
    out = facts.with_market_maker(facts.issue_details(d))
    return out.select("doc_id", F.col("market_maker_name").alias("name"), F.size("market_maker_variants").alias("variants"))


@query("ronw_checks", """
WITH r AS (SELECT o_orderkey AS doc_id, o_totalprice AS nw, o_totalprice * 0.12 AS pat, 12.0 + o_orderkey % 10 * 0.5 AS ronw FROM orders)
SELECT doc_id, 'ronw_consistency:FY25' AS name, CASE WHEN abs(pat / nw * 100 - ronw) <= 1.0 OR abs(pat / nw * 100 - ronw) / greatest(abs(pat / nw * 100), abs(ronw), 1e-9) <= 0.20 THEN 'pass' ELSE 'fail' END AS status FROM r
""")
def ronw_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Printed return on net worth against profit and net worth, from equal to a third apart."""
    o = table(spark, folder, "orders")
    values = [("netWorth", F.col("o_totalprice")), ("profitAfterTax", F.col("o_totalprice") * 0.12), ("ronw", 12.0 + F.col("o_orderkey") % 10 * 0.5)]
    entries = F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in values])
    m = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("period_idx"), F.explode(entries).alias("e")).select("doc_id", "period_idx", "e.*")
    p = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("period_idx"), F.lit("FY25").alias("label"))
    return quality.soft_checks(m, p).filter(F.col("name").startswith("ronw"))


@query("fact_summary", """
SELECT l_orderkey AS doc_id, count(*) FILTER (WHERE l_returnflag = 'A') > 0 AS has_financials, count(*) FILTER (WHERE l_returnflag = 'R') > 0 AS has_ratios,
  CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS BIGINT) AS metrics, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS ratios FROM lineitem GROUP BY 1
""")
def fact_summary(spark: SparkSession, folder: str) -> DataFrame:
    flag = F.col("l_returnflag")
    counts = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count_if(flag == "A").alias("metrics"), F.count_if(flag == "R").alias("ratios"))
    return quality.fact_summary(counts)


@query("lot_warnings", """
SELECT p_partkey AS doc_id, concat_ws(',', CASE WHEN p_partkey % 2 = 1 AND p_size * p_retailprice * 10 > 200000 THEN 'one_lot_exceeds_retail_cap' END,
  CASE WHEN p_partkey % 2 = 0 AND p_size * p_retailprice * 10 * 2 <= 200000 THEN 'sme_minimum_within_retail_cap' END,
  CASE WHEN floor(1000000 / (p_size * p_retailprice * 10)) < CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE floor(200000 / (p_size * p_retailprice * 10)) + 1 END THEN 'small_hni_band_empty' END) AS warnings
FROM part
""")
def lot_warnings(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select(
        F.col("p_partkey").alias("doc_id"), (F.col("p_size") * 10).alias("lot_size"), F.col("p_retailprice").alias("price"), F.when(F.col("p_partkey") % 2 == 0, "sme").otherwise("main").alias("market_type"),
    )
    return facts.lot_warnings(p).select("doc_id", F.array_join("warnings", ",").alias("warnings"))


@query("first_values", """
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 END, -1.0) AS value, CASE WHEN o_orderkey % 4 = 0 THEN 'a' ELSE o_orderstatus END AS word,
  CAST(o_orderkey % 1000 + 1000 AS DOUBLE) AS low, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 1000 + 1005 ELSE o_orderkey % 1000 + 1000 END AS DOUBLE) AS high
FROM orders
""")
def first_values(spark: SparkSession, folder: str) -> DataFrame:
    """The first given of several values, and price bands of one or two numbers."""
    k = F.col("o_orderkey")
    low = F.format_string("%,d", k % 1000 + 1000)
    band = fn.parse_price_band(F.concat(F.lit("₹"), low, F.when(k % 2 == 0, F.concat(F.lit(" – ₹"), F.format_string("%,d", k % 1000 + 1005))).otherwise(" per share")))
    return table(spark, folder, "orders").select(
        k, fn.first_defined(F.when(k % 2 == 0, F.col("o_totalprice")), F.when(k % 3 == 0, F.lit(0.0)), F.lit(-1.0)).alias("value"),
        fn.first_text(F.when(k % 4 == 0, "a").otherwise(""), F.col("o_orderstatus")).alias("word"), band["minimum"].alias("low"), band["maximum"].alias("high"),
    )
