"""Queries: stored snapshot, upsert, timeline and what is served from them.

Customers stand for stored listings, orders for arriving records, order and ship dates for
events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.doctype import admission, classify_document
from ..operators import listing, stored, timeline, upsert
from ..operators import facts as facts_ops
from ..sources import feeds, files
from .registry import query, table

NOW = "2026-06-07 00:00:00"
BEFORE = "2026-01-01 00:00:00"


def _ts(text: str):
    return F.lit(text).cast("timestamp")


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return table(spark, folder, "customer").select(
        F.concat(F.lit("listing-"), key, F.lit("-ipo")).alias("slug"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("I"), key)).alias("isin"),
        F.concat(F.lit("S"), key).alias("symbol"),
        F.concat(F.lit("Listing "), key).alias("company_name"),
        F.when(F.col("c_nationkey") % 3 == 0, "listed").when(F.col("c_nationkey") % 3 == 1, "open").alias("status"),
        F.col("c_acctbal").alias("price_min"),
        (F.col("c_acctbal") + 100).alias("price_max"),
        F.col("c_nationkey").cast("bigint").alias("lot_size"),
        F.when(F.col("c_custkey") % 7 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 700).cast("int"))).alias("bidding_start"),
        F.create_map(F.lit("rhp"), F.struct(F.concat(F.lit("http://x/"), key, F.lit(".pdf")).alias("url"), F.lit("nse").alias("source"), F.lit("extracted").alias("status"))).alias("documents"),
        F.create_map(F.lit("nse"), F.struct(_ts(BEFORE).alias("last_fetched"), F.lit(None).cast("string").alias("url"))).alias("sources"),
        _ts(BEFORE).alias("created_at"),
        _ts(BEFORE).alias("updated_at"),
    )


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """One record per order: some match by isin, some by symbol or name, some are new."""
    o = table(spark, folder, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    fresh = k % 10 == 0
    key = F.when(fresh, k + 1_000_000).otherwise(c).cast("string")
    return o.select(
        k.alias("seq"),
        F.when((k % 2 == 0) & (F.when(fresh, k).otherwise(c) % 2 == 0), F.concat(F.lit("I"), key)).alias("isin"),
        F.when(k % 3 == 0, F.concat(F.lit("S"), key)).otherwise("").alias("symbol"),
        F.concat(F.lit("Listing "), key, F.lit(" Ltd")).alias("company_name"),
        F.when(k % 5 == 0, "closed").otherwise("").alias("status"),
        F.when(k % 4 == 0, F.col("o_totalprice")).alias("price_min"),
        F.lit(None).cast("double").alias("price_max"),
        F.lit(None).cast("bigint").alias("lot_size"),
        F.lit(None).cast("date").alias("bidding_start"),
        F.create_map(F.when(k % 6 == 0, "drhp").otherwise("rhp"), F.struct(
            F.concat(F.lit("http://x/"), key, F.when(k % 6 == 0, "-d.pdf").otherwise(".pdf")).alias("url"), F.lit("").alias("source"), F.lit(None).cast("string").alias("status"))).alias("documents"),
        F.create_map(F.lit("upstox"), F.struct(_ts(NOW).alias("last_fetched"), F.lit(None).cast("string").alias("url"))).alias("sources"),
    )


# Every arrival has a company name whose slug is its key, so the slug decides the row.
UPSERTED = f"""
cur AS (
  SELECT 'listing-' || c_custkey || '-ipo' AS slug, c_custkey AS k, 'Listing ' || c_custkey AS company_name,
         CASE c_nationkey % 3 WHEN 0 THEN 'listed' WHEN 1 THEN 'open' END AS status, c_acctbal AS price_min, c_acctbal + 100 AS price_max
  FROM customer),
arr AS (
  SELECT o_orderkey AS seq, 'listing-' || CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey + 1000000 ELSE o_custkey END || '-ipo' AS slug,
         CASE WHEN o_orderkey % 5 = 0 THEN 'closed' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END AS price_min,
         'Listing ' || CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey + 1000000 ELSE o_custkey END || ' Ltd' AS company_name, o_orderkey % 6 = 0 AS draft
  FROM orders),
inc AS (
  SELECT slug, arg_max(status, seq) FILTER (WHERE status IS NOT NULL) AS status, arg_max(price_min, seq) FILTER (WHERE price_min IS NOT NULL) AS price_min,
         arg_max(company_name, seq) AS company_name, arg_max(draft, seq) AS draft
  FROM arr GROUP BY slug),
merged AS (
  SELECT coalesce(c.slug, i.slug) AS slug, c.slug IS NULL AS is_new, i.slug IS NULL AS is_kept, coalesce(i.status, c.status) AS status,
         coalesce(i.price_min, c.price_min) AS price_min, c.price_max, c.company_name AS c_name, i.company_name AS i_name,
         c.status IS DISTINCT FROM coalesce(i.status, c.status) AS ch_status,
         c.price_min IS DISTINCT FROM coalesce(i.price_min, c.price_min) AS ch_price, coalesce(i.draft, FALSE) AS ch_docs
  FROM cur c FULL JOIN inc i ON c.slug = i.slug),
acted AS (
  SELECT *, CASE WHEN is_new THEN 'new' WHEN is_kept THEN 'untouched' WHEN ch_status OR ch_price OR ch_docs THEN 'updated' ELSE 'unchanged' END AS action
  FROM merged)
"""


def upserted(spark: SparkSession, folder: str) -> DataFrame:
    return upsert.upsert_snapshot(snapshot(spark, folder), arrivals(spark, folder), _ts(NOW))


@query("upsert_snapshot", f"""
WITH {UPSERTED}
SELECT slug, status, price_min, price_max, action,
       CASE WHEN action IN ('new', 'updated') THEN i_name ELSE c_name END AS company_name,
       CASE WHEN is_new THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '{BEFORE}' END AS created_at,
       CASE WHEN action IN ('new', 'updated') THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '{BEFORE}' END AS updated_at,
       CASE WHEN is_new THEN 'upstox' WHEN is_kept THEN 'nse' ELSE 'nse,upstox' END AS sources
FROM acted
""")
def upsert_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return upserted(spark, folder).select(
        "slug", "status", "price_min", "price_max", "action", "company_name", "created_at", "updated_at",
        F.array_join(F.array_sort(F.map_keys("sources")), ",").alias("sources"),
    )


@query("diff_fields", f"""
WITH {UPSERTED}
SELECT slug, concat_ws(',', CASE WHEN ch_status THEN 'status' END, CASE WHEN ch_price THEN 'priceBand' END, CASE WHEN ch_docs THEN 'documents' END) AS changes
FROM acted WHERE action = 'updated'
""")
def diff_fields(spark: SparkSession, folder: str) -> DataFrame:
    return upserted(spark, folder).filter("action = 'updated'").select("slug", F.array_join("changes", ",").alias("changes"))


@query("upsert_tally", f"""
WITH {UPSERTED}, a AS (SELECT action, count(*) AS n FROM acted GROUP BY action)
SELECT k.action, CAST(coalesce(n, 0) AS BIGINT) AS rows FROM (VALUES ('new'), ('updated'), ('unchanged')) k(action) LEFT JOIN a USING (action)
UNION ALL SELECT 'errors', count(*) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
""")
def upsert_tally(spark: SparkSession, folder: str) -> DataFrame:
    known = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
    failed = table(spark, folder, "orders").filter(~F.col("o_orderpriority").isin(known))
    return upsert.upsert_tally(upserted(spark, folder), failed)


# A third of the orders make three new records that only meet through each other: the second shares the
# isin of the first, the third its symbol. The other orders are known by their customer's isin or symbol.
@query("upsert_within_batch", """
SELECT 'trio-' || o_orderkey || '-ipo' AS slug, 'Trio ' || o_orderkey || ' Agro' AS company_name, 'IN' || o_orderkey AS isin, 'SY' || o_orderkey AS symbol, 'new' AS action
FROM orders WHERE o_orderkey % 3 = 0
UNION ALL
SELECT 'listing-' || c_custkey || '-ipo', 'Listing ' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'I' || c_custkey END, 'S' || c_custkey, CASE WHEN n.c IS NULL THEN 'untouched' ELSE 'unchanged' END
FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderkey % 3 <> 0) n ON n.c = c_custkey
""")
def upsert_within_batch(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    key = k.cast("string")
    none = F.lit(None).cast("string")
    by_isin = (k % 3 == 1) & (F.col("o_custkey") % 2 == 0)

    def row(i: int, isin, symbol, name):
        return F.struct((k * 4 + i).alias("seq"), isin.alias("isin"), symbol.alias("symbol"), name.alias("company_name"))

    trio = F.array(
        row(0, F.concat(F.lit("IN"), key), F.concat(F.lit("SY"), key), F.concat(F.lit("Trio "), key)),
        row(1, F.concat(F.lit("IN"), key), F.lit(""), F.concat(F.lit("Trio "), key, F.lit(" India"))),
        row(2, none, F.concat(F.lit("SY"), key), F.concat(F.lit("Trio "), key, F.lit(" Agro"))),
    )
    known = F.array(row(3, F.when(by_isin, F.concat(F.lit("I"), c)), F.when(by_isin, "").otherwise(F.concat(F.lit("S"), c)), F.concat(F.lit("Renamed "), c)))
    incoming = o.select(F.explode(F.when(k % 3 == 0, trio).otherwise(known)).alias("r")).select("r.*")
    out = upsert.upsert_snapshot(snapshot(spark, folder), incoming, _ts(NOW))
    return out.select("slug", "company_name", "isin", "symbol", "action")


@query("unique_slugs", """
SELECT p_partkey AS seq, CASE WHEN rn > 1 OR n.n_nationkey IS NOT NULL THEN base || '-s' || p_partkey ELSE base END AS slug FROM (
  SELECT p_partkey, CASE WHEN p_partkey % 40 = 0 THEN 'nation-' || (p_partkey // 40) || '-ipo' ELSE replace(p_name, ' ', '-') || '-ipo' END AS base,
         row_number() OVER (PARTITION BY CASE WHEN p_partkey % 40 = 0 THEN 'nation-' || (p_partkey // 40) || '-ipo' ELSE replace(p_name, ' ', '-') || '-ipo' END ORDER BY p_partkey) AS rn
  FROM part) LEFT JOIN nation n ON base = 'nation-' || n.n_nationkey || '-ipo'
""")
def unique_slugs(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    df = table(spark, folder, "part").select(
        k.alias("seq"), F.when(k % 40 == 0, F.concat(F.lit("Nation "), F.floor(k / 40).cast("string"))).otherwise(F.concat("p_name", F.lit(" Limited"))).alias("company_name"),
        F.concat(F.lit("S"), k.cast("string")).alias("symbol"), F.lit(None).cast("string").alias("isin"),
    )
    taken = table(spark, folder, "nation").select(F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string"), F.lit("-ipo")).alias("slug"))
    return upsert.unique_slugs(df, taken).select("seq", "slug")


@query("merge_documents", """
WITH cur AS (SELECT o_custkey AS slug, o_orderpriority AS doc_type, max(o_orderkey) AS m FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2),
inc AS (SELECT o_custkey AS slug, o_orderpriority AS doc_type, max(o_orderkey) AS m FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2)
SELECT coalesce(c.slug, i.slug) AS slug, coalesce(c.doc_type, i.doc_type) AS doc_type,
       coalesce('new/' || i.m, 'old/' || c.m) AS url, coalesce(CASE WHEN i.m % 2 = 0 THEN 'nse' END, CASE WHEN c.m IS NOT NULL THEN 'upstox' END) AS source,
       CASE WHEN c.m IS NOT NULL THEN 'extracted' END AS status
FROM cur c FULL JOIN inc i ON c.slug = i.slug AND c.doc_type = i.doc_type
""")
def merge_documents(spark: SparkSession, folder: str) -> DataFrame:
    def docs(skip: str) -> DataFrame:
        o = table(spark, folder, "orders").filter(F.col("o_orderstatus") != skip)
        return o.groupBy(F.col("o_custkey").alias("slug"), F.col("o_orderpriority").alias("doc_type")).agg(F.max("o_orderkey").alias("m"))

    m = F.col("m").cast("string")
    cur = docs("P").select("slug", "doc_type", F.concat(F.lit("old/"), m).alias("url"), F.lit("upstox").alias("source"), F.lit("extracted").alias("status"))
    inc = docs("F").select("slug", "doc_type", F.concat(F.lit("new/"), m).alias("url"), F.when(F.col("m") % 2 == 0, "nse").otherwise("").alias("source"))
    return upsert.merge_documents(cur, inc)


EVENTS_SQL = """
timeline AS (
  SELECT o_orderkey AS entity_id, CAST(o_orderdate AS DATE) AS open, CAST(o_orderdate AS DATE) + 4 AS close,
         CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 10 END AS listing FROM orders),
events_of AS (
  SELECT entity_id, 'open' AS status, open AS date, 'upstox' AS source FROM timeline
  UNION ALL SELECT entity_id, 'close', close, 'nse' FROM timeline
  UNION ALL SELECT entity_id, 'listing', listing, 'inferred' FROM timeline WHERE listing IS NOT NULL
  UNION ALL SELECT entity_id, 'rhp_available', open, 'inferred' FROM timeline WHERE entity_id % 2 = 0)
"""


def _timeline(spark: SparkSession, folder: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    k = F.col("o_orderkey")
    master = table(spark, folder, "orders").select(
        k.alias("entity_id"), d.alias("bidding_start"), F.when(F.col("o_orderstatus") == "F", F.date_add(d, 10)).alias("listing_date"),
        F.when(k % 2 == 0, F.concat(F.lit("http://x/"), k.cast("string"))).alias("rhp"), F.lit("").alias("drhp"),
        F.struct(F.date_format(d, "d-MMM-yyyy").alias("bidding_start_date")).alias(feeds.FEED_A),
        F.struct(F.date_format(F.date_add(d, 4), "yyyy-MM-dd").alias("issueEndDate")).alias(feeds.FEED_B),
    )
    return timeline.build_timeline(master)


@query("status_events", f"WITH {EVENTS_SQL} SELECT * FROM events_of")
def status_events(spark: SparkSession, folder: str) -> DataFrame:
    return timeline.status_events(_timeline(spark, folder)).select("entity_id", "status", "date", "source")


@query("append_status_history", f"""
WITH {EVENTS_SQL},
history AS (SELECT DISTINCT l_orderkey AS entity_id, 'open' AS status, CAST(l_shipdate AS DATE) AS date, 'nse' AS source, TIMESTAMP '{BEFORE}' AS detected_at FROM lineitem
            UNION SELECT o_orderkey, 'open', CAST(o_orderdate AS DATE), 'nse', TIMESTAMP '{BEFORE}' FROM orders WHERE o_orderkey % 3 = 0)
SELECT * FROM history
UNION ALL
SELECT e.entity_id, e.status, e.date, e.source, TIMESTAMP '{NOW}' FROM events_of e
WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.entity_id = e.entity_id AND h.status = e.status AND h.date = e.date)
""")
def append_status_history(spark: SparkSession, folder: str) -> DataFrame:
    ships = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("entity_id"), F.to_date("l_shipdate").alias("date"))
    known = table(spark, folder, "orders").filter(F.col("o_orderkey") % 3 == 0).select(F.col("o_orderkey").alias("entity_id"), F.to_date("o_orderdate").alias("date"))
    history = ships.unionByName(known).distinct().select(
        "entity_id", F.lit("open").alias("status"), "date", F.lit("nse").alias("source"), _ts(BEFORE).alias("detected_at")
    )
    return timeline.append_status_history(history, timeline.status_events(_timeline(spark, folder)), _ts(NOW))


@query("cascade_delete", """
SELECT 'orders' AS part, CAST(count(*) AS BIGINT) AS rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
UNION ALL SELECT 'customers', CAST(count(*) AS BIGINT) FROM customer WHERE c_mktsegment <> 'BUILDING'
""")
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    gone = c.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("slug"))
    left = files.cascade_delete(
        {"orders": table(spark, folder, "orders").withColumnRenamed("o_custkey", "slug"), "customers": c.withColumnRenamed("c_custkey", "slug")}, gone
    )
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("part"), "rows") for n, df in left.items()]
    return counts[0].unionByName(counts[1])


@query("date_range_filter", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1997-03-01' AND o_orderdate <= DATE '1998-02-28'")
def date_range_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").filter(listing.within_date_range(F.col("o_orderdate"), "1997-03-01", "1998-02-28")).select("o_orderkey")


@query("filtered_page", """
SELECT slug, company_name, bidding_start FROM (
  SELECT 'listing-' || c_custkey || '-ipo' AS slug, 'Listing ' || c_custkey AS company_name,
         CASE WHEN c_custkey % 7 <> 0 THEN DATE '2024-01-01' + CAST(c_custkey % 700 AS INTEGER) END AS bidding_start, c_nationkey FROM customer)
WHERE c_nationkey % 3 = 1 AND (regexp_matches(company_name, '(?i)listing \\d*5$'))
ORDER BY bidding_start DESC NULLS LAST, slug LIMIT 20 OFFSET 20
""")
def filtered_page(spark: SparkSession, folder: str) -> DataFrame:
    """Second page of twenty open listings found by a search, latest first."""
    hits = listing.filter_listings(snapshot(spark, folder), status="open", source="nse", document="rhp", search=r"LISTING \d*5$")
    return listing.page_of(hits, page=2, limit=20).select("slug", "company_name", "bidding_start")


@query("page_info", """
SELECT 2 AS page, 20 AS "limit", CAST(count(*) AS BIGINT) AS total, 40 < count(*) AS has_more FROM customer WHERE c_nationkey % 3 = 1
""")
def page_info(spark: SparkSession, folder: str) -> DataFrame:
    return listing.page_info(listing.filter_listings(snapshot(spark, folder), status="open"), 2, 20)


@query("index_cards", """
SELECT 'listing-' || c_custkey || '-ipo' AS slug, CASE c_nationkey % 3 WHEN 0 THEN 'listed' WHEN 1 THEN 'open' END AS status, c_acctbal AS price_min, 'nse' AS sources FROM customer
""")
def index_cards(spark: SparkSession, folder: str) -> DataFrame:
    return stored.to_card(snapshot(spark, folder)).select("slug", "status", "price_min", F.array_join("sources", ",").alias("sources"))


@query("source_freshness", """
WITH known(source) AS (VALUES ('nse'), ('bse'), ('upstox'), ('groww'), ('zerodha'), ('investorgain')),
seen AS (SELECT CASE event_type WHEN 'click' THEN 'nse' WHEN 'view' THEN 'upstox' WHEN 'error' THEN 'groww' WHEN 'signup' THEN 'zerodha' ELSE event_type END AS source,
                count(DISTINCT user_id) AS entities, max(ts) AS last_fetched FROM events GROUP BY 1)
SELECT known.source, CAST(coalesce(entities, 0) AS BIGINT) AS entities, coalesce(entities, 0) > 0 AS healthy, last_fetched FROM known LEFT JOIN seen ON known.source = seen.source
""")
def source_freshness(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    source = F.when(kind == "click", "nse").when(kind == "view", "upstox").when(kind == "error", "groww").when(kind == "signup", "zerodha").otherwise(kind)
    per = table(spark, folder, "events").groupBy("user_id", source.alias("source")).agg(F.max("ts").alias("last_fetched"))
    maps = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("source", F.struct("last_fetched")))).alias("sources"))
    return listing.source_freshness(maps)


@query("scrape_counts", "SELECT event_type AS source, CAST(count(*) AS BIGINT) AS rows FROM events GROUP BY 1")
def scrape_counts(spark: SparkSession, folder: str) -> DataFrame:
    return feeds.scrape_counts(table(spark, folder, "events").withColumnRenamed("event_type", "source"))


@query("unknown_sources", "SELECT DISTINCT event_type AS source FROM events WHERE event_type NOT IN ('click', 'view')")
def unknown_sources(spark: SparkSession, folder: str) -> DataFrame:
    return feeds.unknown_sources(table(spark, folder, "events").select(F.col("event_type").alias("source")).distinct(), ("click", "view"))


@query("coverage_report", """
WITH d AS (SELECT o_orderstatus = 'P' AS failed, o_orderkey % 2 = 0 AS fin, o_orderkey % 3 AS kpi, o_orderkey % 5 AS obj,
                  CASE o_orderkey % 7 WHEN 0 THEN 'high' WHEN 1 THEN 'needs_review' END AS conf, o_orderkey % 4 AS lm FROM orders),
e AS (SELECT *, NOT failed AND (fin OR obj > 0 OR conf IS NOT NULL) AS ok FROM d)
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS ok, CAST(count(*) FILTER (WHERE failed) AS BIGINT) AS download_failed,
  CAST(count(*) FILTER (WHERE NOT failed AND NOT ok) AS BIGINT) AS nothing_found, CAST(count(*) FILTER (WHERE ok AND fin) AS BIGINT) AS financials,
  CAST(count(*) FILTER (WHERE ok AND kpi > 0) AS BIGINT) AS kpis, CAST(count(*) FILTER (WHERE ok AND obj > 0) AS BIGINT) AS objects,
  CAST(count(*) FILTER (WHERE ok AND lm > 0) AS BIGINT) AS lead_managers, CAST(count(*) FILTER (WHERE ok AND conf = 'high') AS BIGINT) AS issue_high,
  CAST(count(*) FILTER (WHERE ok AND conf = 'needs_review') AS BIGINT) AS issue_review
FROM e
""")
def coverage_report(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    return listing.coverage_report(table(spark, folder, "orders").select(
        F.when(F.col("o_orderstatus") == "P", "error").alias("doc_status"), (k % 2 == 0).alias("has_financials"), (k % 3).alias("kpi_count"), (k % 5).alias("object_count"),
        F.when(k % 7 == 0, "high").when(k % 7 == 1, "needs_review").alias("issue_confidence"), (k % 4).alias("lead_managers"),
    ))


@query("latest_per_type", "SELECT event_type, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM events GROUP BY event_type")
def latest_per_type(spark: SparkSession, folder: str) -> DataFrame:
    return listing.latest_by_type(table(spark, folder, "events").select("event_type", "event_id", "ts"), "event_type", "ts")


@query("last_five_errors", """
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type = 'error') WHERE rn <= 5
""")
def last_five_errors(spark: SparkSession, folder: str) -> DataFrame:
    errors = table(spark, folder, "events").filter("event_type = 'error'").select("user_id", "event_id", "ts")
    return listing.last_errors(errors, "user_id", "ts", "event_id", 5).select("user_id", "event_id")


@query("error_history", """
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS position FROM events WHERE event_type = 'error'
""")
def error_history(spark: SparkSession, folder: str) -> DataFrame:
    errors = table(spark, folder, "events").filter("event_type = 'error'").select("user_id", "event_id", "ts")
    return listing.last_errors(errors, "user_id", "ts", "event_id").select("user_id", "event_id", "position")


@query("subscription_pivot", """
WITH r AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'RETAIL' WHEN 'N' THEN 'QIB' ELSE 'NII' END AS category, l_quantity * (1 - l_discount) AS rate, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
last AS (SELECT l_orderkey, category, arg_max(rate, {'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey, 'd': l_extendedprice}) AS rate FROM r GROUP BY 1, 2)
SELECT l_orderkey, max(CASE WHEN category = 'RETAIL' THEN floor(rate * 100 + 0.5) / 100 END) AS retail, max(CASE WHEN category = 'QIB' THEN floor(rate * 100 + 0.5) / 100 END) AS qualified,
  max(CASE WHEN category = 'NII' THEN floor(rate * 100 + 0.5) / 100 END) AS nii FROM last GROUP BY l_orderkey
""")
def subscription_pivot(spark: SparkSession, folder: str) -> DataFrame:
    flag = F.col("l_returnflag")
    category = F.when(flag == "A", "retail").when(flag == "N", "qib").otherwise("NII")
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", category.alias("category"), (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("subscriptionRate"))
    # An order has a handful of lines; they stand for the rate list inside one payload.
    per = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("rates"))
    s = stored.subscription(F.col("rates"))
    return per.select("l_orderkey", s.alias("s")).select("l_orderkey", "s.retail", "s.qualified", "s.nii")


@query("collect_documents", """
WITH c AS (SELECT l_orderkey AS entity, 'http://x/' || (l_partkey % 3) AS url, CASE l_returnflag WHEN 'A' THEN 'drhp' ELSE 'rhp' END AS doc_type, l_linestatus || (l_suppkey % 3) AS source,
             (l_linenumber * 1000000 + l_partkey) * 1000 + l_suppkey AS ord FROM lineitem),
s AS (SELECT entity, url, source, min(ord) AS ord FROM c GROUP BY 1, 2, 3)
SELECT entity, url, (SELECT arg_min(doc_type, ord) FROM c WHERE c.entity = s.entity AND c.url = s.url) AS doc_type, string_agg(source, ',' ORDER BY ord, source) AS sources FROM s GROUP BY entity, url
""")
def collect_documents(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("entity"), F.concat(F.lit("http://x/"), (F.col("l_partkey") % 3).cast("string"), F.lit("/")).alias("url"),
        F.when(F.col("l_returnflag") == "A", "drhp").otherwise("rhp").alias("doc_type"), F.concat("l_linestatus", (F.col("l_suppkey") % 3).cast("string")).alias("source"),
        ((F.col("l_linenumber") * F.lit(1_000_000).cast("bigint") + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).alias("ord"),
    )
    return stored.documents_by_link(c).withColumn("sources", F.array_join("sources", ","))


@query("pick_document", """
SELECT slug, CASE best WHEN 1 THEN 'rhp' WHEN 2 THEN 'final' ELSE 'drhp' END AS doc_type FROM (
  SELECT o_custkey AS slug, min(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END) AS best
  FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0 GROUP BY 1) WHERE best IS NOT NULL
""")
def pick_document(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("o_orderpriority")
    docs = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("slug"), F.when(p == "1-URGENT", "rhp").when(p == "2-HIGH", "final").when(p == "3-MEDIUM", "drhp").otherwise("other").alias("doc_type"),
        F.when(F.col("o_orderstatus") == "F", "extracted").otherwise("error").alias("status"), F.when(F.col("o_orderkey") % 3 != 0, "md").otherwise("").alias("markdown_url"),
    )
    return stored.pick_document(docs)


@query("restore_documents", """
SELECT o_orderkey AS slug, CASE WHEN have AND NOT ready THEN 'extracted' ELSE status END AS status, have AND NOT ready AS restored,
       CASE WHEN have AND NOT ready THEN 'md/' || o_orderkey ELSE md END AS markdown_url
FROM (SELECT o_orderkey, o_orderkey % 2 = 0 AS have, CASE o_orderstatus WHEN 'F' THEN 'extracted' ELSE 'error' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'old' END AS md,
             o_orderstatus = 'F' AND o_orderkey % 3 = 0 AS ready FROM orders)
""")
def restore_documents(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, folder, "orders")
    docs = o.select(
        k.alias("slug"), F.lit("rhp").alias("doc_type"), F.when(F.col("o_orderstatus") == "F", "extracted").otherwise("error").alias("status"),
        F.when(k % 3 == 0, "old").alias("markdown_url"), F.lit("u").alias("url"),
    )
    have = o.filter(k % 2 == 0).select(k.alias("slug"), F.lit("rhp").alias("doc_type"), F.concat(F.lit("md/"), k.cast("string")).alias("markdown_url"), F.lit("p").alias("pdf_url"))
    return stored.restore_documents(docs, have).select("slug", "status", "restored", "markdown_url")


@query("classify_documents", """
SELECT page_id, CASE WHEN contains(s, 'drhp') OR regexp_matches(s, 'draft\\s+red\\s*herring') THEN 'drhp' WHEN contains(s, 'rhp') OR regexp_matches(s, 'red\\s*herring') THEN 'rhp'
       WHEN regexp_matches(s, '\\bfinal\\b') THEN 'final' ELSE 'drhp' END AS doc_type,
       CASE WHEN contains(s, 'drhp') OR regexp_matches(s, 'draft\\s+red\\s*herring') THEN 0.9 WHEN contains(s, 'rhp') OR regexp_matches(s, 'red\\s*herring') THEN 0.88
       WHEN regexp_matches(s, '\\bfinal\\b') THEN 0.8 ELSE 0.3 END::DOUBLE AS confidence
FROM (SELECT page_id, regexp_replace(lower(url || CASE page_id % 5 WHEN 0 THEN '/x-drhp.pdf' WHEN 1 THEN '/Red-Herring_Prospectus.pdf' WHEN 2 THEN '/final.pdf' ELSE '' END), '[._\\-/+%]+', ' ', 'g') AS s FROM pages)
""")
def classify_documents(spark: SparkSession, folder: str) -> DataFrame:
    m = F.col("page_id") % 5
    tail = F.when(m == 0, "/x-drhp.pdf").when(m == 1, "/Red-Herring_Prospectus.pdf").when(m == 2, "/final.pdf").otherwise("")
    verdict = classify_document(F.concat("url", tail))
    return table(spark, folder, "pages").select("page_id", verdict.alias("v")).select("page_id", "v.doc_type", "v.confidence")


@query("document_admission", """
SELECT doc_id, CASE WHEN regexp_matches(name, 'corrigendum|addendum|notice|erratum|clarification') THEN 'not_a_prospectus' WHEN contains(name, 'abridged') THEN 'abridged_detected'
  WHEN pages > 0 AND pages < 3 THEN CASE WHEN ab THEN 'abridged_detected' ELSE 'not_a_prospectus' END WHEN pages < 20 AND ab THEN 'abridged_detected' ELSE 'success' END AS admission
FROM (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'corrigendum.pdf' WHEN 1 THEN 'x_abridged.pdf' ELSE 'rhp.pdf' END AS name, len(string_split(text, chr(10))) AS pages,
             contains(lower(text), 'the') AS ab FROM documents)
""")
def document_admission(spark: SparkSession, folder: str) -> DataFrame:
    m = F.col("doc_id") % 9
    name = F.when(m == 0, "Corrigendum.pdf").when(m == 1, "x_abridged.pdf").otherwise("rhp.pdf")
    head = F.replace(F.lower("text"), F.lit("the"), F.lit("abridged"))
    return table(spark, folder, "documents").select("doc_id", admission(name, F.size(F.split("text", "\n")), head).alias("admission"))


@query("confidence_distribution", "SELECT o_orderpriority AS confidence, CAST(count(*) AS BIGINT) AS documents FROM orders GROUP BY 1")
def confidence_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return listing.confidence_distribution(table(spark, folder, "orders").withColumnRenamed("o_orderpriority", "confidence"))


@query("pending_documents", "SELECT 'listing-' || c_custkey || '-ipo' AS slug FROM customer WHERE c_nationkey % 3 <> 0 AND c_custkey % 2 = 0")
def pending_documents(spark: SparkSession, folder: str) -> DataFrame:
    none = F.lit(None).cast("string")
    df = snapshot(spark, folder).withColumn("objects", F.when(F.regexp_extract("company_name", r"(\d+)", 1).cast("bigint") % 2 == 1, "x")).withColumn("financials", none)
    return listing.pending_documents(df).select("slug")


@query("issue_amounts", """
SELECT p_partkey AS doc_id, f.field AS field, f.shares AS shares, f.shares * p_retailprice AS rupees,
       floor(f.shares * p_retailprice / CASE WHEN p_size % 2 = 0 THEN 100000.0 ELSE 10000000.0 END * 100 + 0.5) / 100 AS amount, CASE WHEN p_size % 2 = 0 THEN 'Lakhs' ELSE 'Crore' END AS unit
FROM part, (SELECT unnest([{'field': 'totalIssue', 'm': 3}, {'field': 'freshIssue', 'm': 2}, {'field': 'netOffer', 'm': 1}]) AS g) u, LATERAL (SELECT g.field AS field, p_size * 1000 * g.m AS shares) f
""")
def issue_amounts(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("p_size") * 1000
    d = table(spark, folder, "part").select(
        F.col("p_partkey").alias("doc_id"), (n * 3).alias("total_issue_shares"), (n * 2).alias("fresh_issue_shares"), n.alias("net_offer_shares"),
        F.col("p_retailprice").alias("cap_price"), (F.col("p_size") % 2 == 0).alias("is_sme"),
    )
    return facts_ops.issue_amounts(d)


@query("lot_tiers", """
WITH p AS (SELECT p_partkey, p_size AS lot, p_retailprice AS price, p_partkey % 2 = 0 AS sme, p_size * p_retailprice AS per_lot FROM part),
b AS (SELECT *, CAST(floor(200000 / per_lot) AS BIGINT) AS rmax, CAST(floor(1000000 / per_lot) AS BIGINT) AS smax FROM p),
c AS (SELECT *, CASE WHEN sme THEN 3 ELSE rmax + 1 END AS smin FROM b),
t AS (
  SELECT *, 'Individual' AS category, 'Fixed' AS type, CAST(2 AS BIGINT) AS lots FROM c WHERE sme
  UNION ALL SELECT *, 'Retail', 'Min', 1 FROM c WHERE NOT sme AND rmax >= 1
  UNION ALL SELECT *, 'Retail', 'Max', rmax FROM c WHERE NOT sme AND rmax > 1
  UNION ALL SELECT *, 'S-HNI', 'Min', smin FROM c WHERE smax >= smin
  UNION ALL SELECT *, 'S-HNI', 'Max', smax FROM c WHERE smax > smin
  UNION ALL SELECT *, 'B-HNI', 'Min', CASE WHEN smax >= smin THEN smax + 1 ELSE smin END FROM c)
SELECT p_partkey, category, type, lots, CAST(lots * lot AS BIGINT) AS shares, CAST(floor(lots * lot * price + 0.5) AS BIGINT) AS amount FROM t
""")
def lot_tiers(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select(
        "p_partkey", F.col("p_size").alias("lot_size"), F.col("p_retailprice").alias("price"), F.when(F.col("p_partkey") % 2 == 0, "sme").otherwise("mainboard").alias("market_type")
    )
    return facts_ops.lot_tiers(p).select("p_partkey", "category", "type", "lots", "shares", "amount")
