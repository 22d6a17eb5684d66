"""Queries: feeds, entity resolution, merging and name matching.

Parts stand for listings: every part is a record of one of two feeds with a name of few
distinct values, some with an isin or a symbol that other records share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import matching, merge, names, resolve
from ..session import cut_lineage
from ..sources import feeds
from .registry import query, table


def offers(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    none = F.lit(None).cast("string")
    return p.select(
        key.alias("seq"),
        F.when(size % 2 == 0, feeds.FEED_B).otherwise(feeds.FEED_A).alias("source"),
        F.when(size % 5 == 0, F.concat(F.lit("IN"), F.floor(key / 2).cast("string"))).otherwise(F.when(size % 5 == 1, "")).alias("isin"),
        F.when(size % 7 == 0, F.concat(F.lit("s"), F.floor(key / 3).cast("string"), F.lit("-EQ"))).alias("symbol"),
        F.concat("p_name", F.lit(" Limited")).alias("company_name"),
        F.when(size % 3 == 0, "open").when(size % 3 == 1, "closed").alias("status"),
        F.when(size % 11 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (key * 37 % 3650).cast("int"))).alias("bidding_start"),
        F.when(size % 13 != 0, F.col("p_retailprice")).alias("price_min"),
        (F.col("p_retailprice") + 10).alias("price_max"),
        F.when(size % 4 == 0, F.concat(F.lit("http://x/rhp/"), key.cast("string"))).alias("rhp"),
        none.alias("drhp"),
        F.lit(None).cast("date").alias("listing_date"),
    )


OFFERS = """
offers AS (
  SELECT p_partkey AS seq,
         CASE WHEN p_size % 2 = 0 THEN 'nse' ELSE 'upstox' END AS source,
         CASE WHEN p_size % 5 = 0 THEN 'IN' || (p_partkey // 2) END AS isin,
         CASE WHEN p_size % 7 = 0 THEN 'S' || (p_partkey // 3) END AS symbol,
         p_name AS name,
         p_name || ' Limited' AS company_name,
         CASE WHEN p_size % 3 = 0 THEN 'open' WHEN p_size % 3 = 1 THEN 'closed' END AS status,
         CASE WHEN p_size % 11 <> 0 THEN DATE '2024-01-01' + CAST(p_partkey * 37 % 3650 AS INTEGER) END AS day,
         CASE WHEN p_size % 13 <> 0 THEN p_retailprice END AS price_min,
         p_retailprice + 10 AS price_max,
         CASE WHEN p_size % 4 = 0 THEN 'http://x/rhp/' || p_partkey END AS rhp
  FROM part)
"""


# Names as distinct pairs with their score; ``pairs(a, b)`` must exist.
SCORED = """
matched AS (
  SELECT a, b, list_reduce(
    list_prepend(repeat('0', length(b)) || '|', list_transform(range(1, length(a) + 1), lambda i: CAST(i AS VARCHAR))),
    lambda s, x: CASE
      WHEN list_position(list_transform(
             range(greatest(1, CAST(x AS INTEGER) - (greatest(length(a), length(b)) // 2 - 1)),
                   least(length(b), CAST(x AS INTEGER) + (greatest(length(a), length(b)) // 2 - 1)) + 1),
             lambda j: b[j] = a[CAST(x AS INTEGER)] AND s[j] = '0'), true) IS NULL THEN s
      ELSE
        s[1 : greatest(1, CAST(x AS INTEGER) - (greatest(length(a), length(b)) // 2 - 1)) - 2 + list_position(list_transform(
             range(greatest(1, CAST(x AS INTEGER) - (greatest(length(a), length(b)) // 2 - 1)),
                   least(length(b), CAST(x AS INTEGER) + (greatest(length(a), length(b)) // 2 - 1)) + 1),
             lambda j: b[j] = a[CAST(x AS INTEGER)] AND s[j] = '0'), true)]
        || '1' ||
        s[greatest(1, CAST(x AS INTEGER) - (greatest(length(a), length(b)) // 2 - 1)) + list_position(list_transform(
             range(greatest(1, CAST(x AS INTEGER) - (greatest(length(a), length(b)) // 2 - 1)),
                   least(length(b), CAST(x AS INTEGER) + (greatest(length(a), length(b)) // 2 - 1)) + 1),
             lambda j: b[j] = a[CAST(x AS INTEGER)] AND s[j] = '0'), true) :]
        || a[CAST(x AS INTEGER)] END) AS st
  FROM pairs),
parts_of AS (
  SELECT a, b, st[length(b) + 2 :] AS seq_a,
         array_to_string(list_transform(list_filter(range(1, length(b) + 1), lambda j: st[j] = '1'), lambda j: b[j]), '') AS seq_b
  FROM matched),
jaro_of AS (
  SELECT a, b,
         CASE WHEN length(seq_a) = 0 THEN 0 ELSE
           (length(seq_a) / length(a) + length(seq_a) / length(b)
            + (length(seq_a) - len(list_filter(range(1, length(seq_a) + 1), lambda k: seq_a[k] <> seq_b[k])) / 2) / length(seq_a)) / 3 END AS jaro,
         CASE WHEN length(seq_a) = 0 THEN 0
              WHEN a[1:4] = b[1:4] AND length(a) >= 4 AND length(b) >= 4 THEN 4
              WHEN a[1:3] = b[1:3] AND length(a) >= 3 AND length(b) >= 3 THEN 3
              WHEN a[1:2] = b[1:2] AND length(a) >= 2 AND length(b) >= 2 THEN 2
              WHEN a[1] = b[1] THEN 1 ELSE 0 END AS prefix
  FROM parts_of),
scored AS (
  SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE jaro + prefix * 0.1 * (1 - jaro) END AS score FROM jaro_of)
"""

RUNS = """
days AS (SELECT name, day, min(seq) AS first_seq, count(*) AS n FROM offers GROUP BY name, day),
numbered AS (
  SELECT *, CASE WHEN day IS NULL THEN -1 ELSE
    sum(CASE WHEN jump > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY name, day IS NULL ORDER BY day) END AS run_no
  FROM (SELECT *, day - lag(day) OVER (PARTITION BY name, day IS NULL ORDER BY day) AS jump FROM days)),
runs AS (SELECT name, run_no, min(first_seq) AS run, min(day) AS d0, max(day) AS d1, CAST(sum(n) AS BIGINT) AS records
         FROM numbered GROUP BY name, run_no),
seen AS (SELECT name, min(run) AS first_seq FROM runs GROUP BY name),
pairs AS (SELECT l.name AS a, r.name AS b FROM seen l JOIN seen r ON l.first_seq > r.first_seq)
"""


@query("normalize_names", """
SELECT c_custkey,
       trim(regexp_replace(regexp_replace(regexp_replace(lower('The ' || c_name || ' Corp. & Company Ltd'),
         '\\b(limited|ltd\\.?|corporation|corp\\.?|company|co\\.?|ipo|details)\\b', '', 'g'), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS company_key,
       'CUST' || c_custkey AS symbol_key,
       'the-customer-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '-corp-and-company-ipo-cust' || c_custkey AS slug,
       'the customer' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || ' corp company' AS premium_key
FROM customer
""")
def normalize_names(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat(F.lit("The "), F.col("c_name"), F.lit(" Corp. & Company Ltd"))
    symbol = F.concat(F.lit("cust"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, "-EQ").otherwise(".NS"))
    return table(spark, folder, "customer").select(
        "c_custkey",
        fn.normalize_company(name).alias("company_key"),
        fn.normalize_symbol(symbol).alias("symbol_key"),
        fn.slugify(name, fn.normalize_symbol(symbol)).alias("slug"),
        fn.normalize_premium_name(name).alias("premium_key"),
    )


@query("parse_dates", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS dashed, CAST(o_orderdate AS DATE) AS spaced,
       CAST(o_orderdate AS DATE) AS strict, CAST(NULL AS DATE) AS strict_spaced, CAST(o_orderdate AS DATE) AS day_first
FROM orders
""")
def parse_dates(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        fn.parse_date(F.date_format(d, "yyyy-MM-dd")).alias("iso"),
        fn.parse_date(F.upper(F.date_format(d, "dd-MMM-yyyy"))).alias("dashed"),
        fn.parse_date(F.date_format(d, "d MMMM yyyy")).alias("spaced"),
        fn.strict_date(F.date_format(d, "d-MMM-yyyy")).alias("strict"),
        fn.strict_date(F.date_format(d, "d MMM yyyy")).alias("strict_spaced"),
        fn.day_first_date(F.date_format(d, "dd-MM-yyyy")).alias("day_first"),
    )


@query("parse_numbers", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS amount,
       CAST(floor(o_totalprice) AS DOUBLE) AS band_low, CAST(floor(o_totalprice) + 5 AS DOUBLE) AS band_high,
       o_orderkey + 1000 AS shares
FROM orders
""")
def parse_numbers(spark: SparkSession, folder: str) -> DataFrame:
    price = F.format_string("%,.2f", F.col("o_totalprice"))
    amount = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("(₹ "), price, F.lit(")"))).otherwise(F.concat(F.lit("₹ "), price))
    whole = F.floor("o_totalprice")
    band = fn.parse_price_range(F.concat(F.lit("Rs."), F.format_string("%,d", whole), F.lit(" to Rs."), F.format_string("%,d", whole + 5)))
    return table(spark, folder, "orders").select(
        "o_orderkey", fn.parse_num(amount).alias("amount"), band["minimum"].alias("band_low"), band["maximum"].alias("band_high"),
        fn.parse_shares(F.concat(F.format_string("%,d", F.col("o_orderkey") + 1000), F.lit("*"))).alias("shares"),
    )


@query("map_feeds", """
SELECT source, CAST(count(*) AS BIGINT) AS rows, CAST(count(isin) AS BIGINT) AS with_isin, min(bidding_start) AS first_start,
       max(price_max) AS highest, CAST(count(status) AS BIGINT) AS with_status
FROM (
  SELECT 'upstox' AS source, 'IN' || c_custkey AS isin, DATE '2024-01-01' + CAST(c_custkey % 300 AS INTEGER) AS bidding_start,
         CAST(c_nationkey + 10 AS DOUBLE) AS price_max, 'open' AS status FROM customer
  UNION ALL
  SELECT 'nse', NULL, DATE '2024-01-02' + CAST(s_suppkey % 300 AS INTEGER), CAST(s_nationkey + 120 AS DOUBLE),
         CASE WHEN s_suppkey % 2 = 0 THEN 'open' END FROM supplier)
GROUP BY source
""")
def map_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads of two feeds from customers and suppliers through their mappers."""
    day = lambda key, base: F.date_add(F.lit(base).cast("date"), (F.col(key) % 300).cast("int"))
    none = lambda kind: F.lit(None).cast(kind)
    a = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("seq"), F.concat(F.lit("IN"), F.col("c_custkey").cast("string")).alias("isin"), F.lit("").alias("symbol"),
        F.concat("c_name", F.lit(" IPO")).alias("name"), F.lit("open").alias("status"), F.col("c_nationkey").cast("double").alias("minimum_price"),
        (F.col("c_nationkey") + 10).cast("double").alias("maximum_price"), none("string").alias("bidding_start_date"),
        F.struct(F.date_format(day("c_custkey", "2024-01-01"), "yyyy-MM-dd").alias("application_start_date")).alias("timeline"),
        none("string").alias("rhp_url"), none("string").alias("drhp_url"),
    )
    b = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("seq"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), F.col("s_name").alias("company"),
        none("string").alias("companyName"), F.upper(F.date_format(day("s_suppkey", "2024-01-02"), "dd-MMM-yyyy")).alias("ipoStartDate"),
        none("string").alias("issueStartDate"), F.concat(F.lit("Rs."), (F.col("s_nationkey") + 100).cast("string"), F.lit(" to Rs."), (F.col("s_nationkey") + 120).cast("string")).alias("priceRange"),
        none("string").alias("issuePrice"), F.when(F.col("s_suppkey") % 2 == 0, "Active").alias("status"), none("string").alias("isin"),
        none("string").alias("rhpUrl"), none("string").alias("drhpUrl"), F.struct(none("string").alias("isin"), none("string").alias("rhpUrl"), none("string").alias("drhpUrl")).alias("metaInfo"),
    )
    records = feeds.combine_feeds(feeds.map_feed_a(a), feeds.map_feed_b(b))
    return records.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.count("isin").alias("with_isin"), F.min("bidding_start").alias("first_start"),
        F.max("price_max").alias("highest"), F.count("status").alias("with_status"),
    )


@query("feed_buckets", """
SELECT key, bucket, CAST(o_orderkey AS BIGINT) AS seq FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE bucket WHEN 'current' THEN 0 WHEN 'upcoming' THEN 1 ELSE 2 END DESC, o_orderkey DESC) AS rn
  FROM (SELECT o_orderkey, 'C' || o_custkey AS key, CASE o_orderstatus WHEN 'O' THEN 'current' WHEN 'P' THEN 'upcoming' ELSE 'past' END AS bucket FROM orders))
WHERE rn = 1
""")
def feed_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """The last bucket of each symbol replaces the earlier ones."""
    status = F.col("o_orderstatus")
    mapped = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"), F.lit(None).cast("string").alias("company_name"),
        F.lit(None).cast("string").alias("status"), F.when(status == "O", "current").when(status == "P", "upcoming").otherwise("past").alias("bucket"),
    )
    return feeds.dedupe_feed_b(mapped).select(F.col("symbol").alias("key"), "bucket", "seq")


@query("list_buckets", """
SELECT key, bucket, CAST(o_orderkey AS BIGINT) AS seq FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE bucket WHEN 'open' THEN 0 WHEN 'upcoming' THEN 1 ELSE 2 END, o_orderkey) AS rn
  FROM (SELECT o_orderkey, 'C' || o_custkey AS key, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'upcoming' ELSE 'closed' END AS bucket FROM orders))
WHERE rn = 1
""")
def list_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """The first bucket of each listing stays."""
    status = F.col("o_orderstatus")
    lists = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("searchId"), F.lit(None).cast("string").alias("isin"),
        F.lit("").alias("symbol"), F.when(status == "O", "open").when(status == "P", "upcoming").otherwise("closed").alias("bucket"),
    )
    return feeds.dedupe_list(lists).select(F.col("searchId").alias("key"), "bucket", "seq")


@query("listing_links", """
SELECT page_id, href FROM (
  SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<a\\b[^>]*href="[^"]*"[^>]*>[^<]*</a>'),
           lambda x: regexp_extract(x, '(?is)href="([^"]*)"', 1)), lambda h: contains(lower(h), 't'))[1] AS href
  FROM pages) WHERE href IS NOT NULL
""")
def listing_links(spark: SparkSession, folder: str) -> DataFrame:
    """The first link of each page whose address has a 't', whatever its text."""
    return feeds.first_matching_link(table(spark, folder, "pages"), word="", href_part="t")


@query("resolve_isin", f"WITH {OFFERS} SELECT seq AS u, first AS v FROM (SELECT seq, min(seq) OVER (PARTITION BY isin) AS first FROM offers WHERE isin IS NOT NULL) WHERE seq <> first")
def resolve_isin(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.equal_key_edges(resolve.match_keys(offers(spark, folder)), "isin")


@query("resolve_symbol", f"WITH {OFFERS} SELECT seq AS u, first AS v FROM (SELECT seq, min(seq) OVER (PARTITION BY symbol) AS first FROM offers WHERE symbol IS NOT NULL) WHERE seq <> first")
def resolve_symbol(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.equal_key_edges(resolve.match_keys(offers(spark, folder)), "symbol")


@query("similar_names", f"""
WITH {OFFERS}, {RUNS}, {SCORED}
SELECT a AS left_name, b AS right_name, round(score, 6) AS score FROM scored WHERE score >= 0.85
""")
def similar_names(spark: SparkSession, folder: str) -> DataFrame:
    runs = resolve.name_runs(resolve.run_days(resolve.match_keys(offers(spark, folder))))
    return resolve.name_pairs(runs, resolve.NEAR_SCORE).withColumn("score", F.round("score", 6))


FUZZY_EDGES = """
fuzzy AS (
  SELECT l.run AS u, r.run AS v FROM scored JOIN runs l ON l.name = a JOIN runs r ON r.name = b
  WHERE score >= 0.9 AND l.d0 - r.d1 <= 30 AND r.d0 - l.d1 <= 30)
"""


@query("resolve_fuzzy_dates", f"WITH {OFFERS}, {RUNS}, {SCORED}, {FUZZY_EDGES} SELECT u, v FROM fuzzy")
def resolve_fuzzy_dates(spark: SparkSession, folder: str) -> DataFrame:
    runs = cut_lineage(resolve.name_runs(resolve.run_days(resolve.match_keys(offers(spark, folder)))))
    return resolve.fuzzy_edges(resolve.swept_pairs(runs, resolve.dated_name_pairs(runs)))


@query("borderline_pairs", f"""
WITH {OFFERS}, {RUNS}, {SCORED},
sides AS (
  SELECT score, l.run AS lr, r.run AS rr, l.name AS ln, r.name AS rn, coalesce(l.d0 - r.d1 <= 30 AND r.d0 - l.d1 <= 30, FALSE) AS near
  FROM scored JOIN runs r ON r.name = a JOIN runs l ON l.name = b WHERE score >= 0.85
  UNION ALL
  SELECT 1.0, l.run, r.run, l.name, r.name, FALSE FROM runs l JOIN runs r ON l.name = r.name AND l.run < r.run),
lists AS (SELECT name, string_agg(CAST(run AS VARCHAR), ',' ORDER BY run) AS ids, string_agg(CAST(records AS VARCHAR), ',' ORDER BY run) AS counts, CAST(sum(records) AS BIGINT) AS records FROM runs GROUP BY name),
classes AS (
  SELECT ln, rn, score, CAST(count(*) FILTER (WHERE score < 0.9 OR NOT near) AS BIGINT) AS pairs,
    min({{'l': rr, 'r': lr}}) FILTER (WHERE NOT near) AS first_apart, min(lr) AS l0, min(rr) AS r0,
    coalesce(string_agg(lr || ':' || rr, ',' ORDER BY r_start, l_start) FILTER (WHERE score >= 0.9 AND near), '') AS near_ids
  FROM (SELECT s.*, a.d0 AS l_start, b.d0 AS r_start FROM sides s JOIN runs a ON a.run = lr JOIN runs b ON b.run = rr)
  GROUP BY ln, rn, score)
SELECT CASE WHEN score >= 0.9 THEN 'fuzzy_name_match_date_guard_failed' ELSE 'near_miss_below_threshold' END AS reason, round(score, 6) AS score,
  CASE WHEN ln = rn OR score < 0.9 THEN l0 ELSE first_apart.r END AS left_id, CASE WHEN ln = rn OR score < 0.9 THEN r0 ELSE first_apart.l END AS right_id,
  ln AS left_name, rn AS right_name, l.ids AS left_ids, r.ids AS right_ids, l.counts AS left_counts, r.counts AS right_counts, near_ids, pairs, l.records AS left_records, r.records AS right_records
FROM classes JOIN lists l ON l.name = ln JOIN lists r ON r.name = rn WHERE pairs > 0
""")
def borderline_pairs(spark: SparkSession, folder: str) -> DataFrame:
    runs = cut_lineage(resolve.name_runs(resolve.run_days(resolve.match_keys(offers(spark, folder)))))
    swept = resolve.swept_pairs(runs, resolve.name_pairs(runs, resolve.NEAR_SCORE))
    return resolve.borderline_pairs(runs, swept).withColumn("score", F.round("score", 6))


ENTITIES = f"""
{OFFERS}, {RUNS}, {SCORED}, {FUZZY_EDGES},
links AS (
  SELECT seq AS u, min(seq) OVER (PARTITION BY isin) AS v FROM offers WHERE isin IS NOT NULL
  UNION ALL SELECT seq, min(seq) OVER (PARTITION BY symbol) FROM offers WHERE symbol IS NOT NULL
  UNION ALL SELECT o.seq, r.run FROM offers o JOIN runs r ON o.name = r.name AND o.day BETWEEN r.d0 AND r.d1
  UNION ALL SELECT u, v FROM fuzzy),
edges AS (SELECT u, v FROM links WHERE u <> v UNION SELECT v, u FROM links WHERE u <> v),
labels_of(id, label) USING KEY (id) AS (
  SELECT seq, seq FROM offers
  UNION
  SELECT e.v, min(l.label) FROM labels_of l JOIN edges e ON e.u = l.id JOIN recurring.labels_of k ON k.id = e.v
  WHERE l.label < k.label GROUP BY e.v)
"""


@query("resolve_entities", f"WITH RECURSIVE {ENTITIES} SELECT id AS seq, label AS entity_id FROM labels_of")
def resolve_entities(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.link_entities(offers(spark, folder)).select("seq", "entity_id")


@query("merge_precedence", """
WITH """ + OFFERS.strip() + """,
grouped AS (SELECT *, seq % 500 AS entity_id FROM offers),
agg AS (
  SELECT entity_id, arg_min(isin, seq) FILTER (WHERE isin IS NOT NULL) AS isin,
    arg_min(status, seq) FILTER (WHERE status IS NOT NULL) AS status,
    arg_min(company_name, seq) AS company_name,
    arg_max(day, seq) FILTER (WHERE source = 'nse' AND day IS NOT NULL) AS n_day,
    arg_min(day, seq) FILTER (WHERE source = 'upstox' AND day IS NOT NULL) AS u_day,
    arg_max(rhp, seq) FILTER (WHERE source = 'nse' AND rhp IS NOT NULL) AS n_rhp,
    arg_min(rhp, seq) FILTER (WHERE rhp IS NOT NULL) AS any_rhp,
    arg_min({'lo': price_min, 'hi': price_max}, seq) FILTER (WHERE source = 'upstox') AS u_band,
    arg_max({'lo': price_min, 'hi': price_max}, seq) FILTER (WHERE source = 'nse') AS n_band,
    CAST(count(*) AS BIGINT) AS record_count
  FROM grouped GROUP BY entity_id)
SELECT CAST(entity_id AS BIGINT) AS entity_id, isin, status, company_name, coalesce(n_day, u_day) AS bidding_start, coalesce(n_rhp, any_rhp) AS rhp,
  CASE WHEN u_band.lo IS NOT NULL THEN u_band.lo WHEN n_band IS NOT NULL THEN n_band.lo ELSE u_band.lo END AS price_min,
  CASE WHEN u_band.lo IS NOT NULL THEN u_band.hi WHEN n_band IS NOT NULL THEN n_band.hi ELSE u_band.hi END AS price_max,
  record_count
FROM agg
""")
def merge_precedence(spark: SparkSession, folder: str) -> DataFrame:
    """Records of 500 known groups merged by source precedence."""
    grouped = offers(spark, folder).withColumn("isin", fn.blank_to_null(F.col("isin"))).withColumn("entity_id", F.col("seq") % 500)
    return merge.merge_records(grouped).select(
        "entity_id", "isin", "status", "company_name", "bidding_start", "rhp", "price_min", "price_max", "record_count"
    )


@query("reconciled_listings", "WITH RECURSIVE " + ENTITIES + """,
joined AS (SELECT o.*, l.label AS entity_id FROM offers o JOIN labels_of l ON l.id = o.seq),
agg AS (
  SELECT entity_id, arg_min(status, seq) FILTER (WHERE status IS NOT NULL) AS status, arg_min(company_name, seq) AS company_name,
    coalesce(arg_max(day, seq) FILTER (WHERE source = 'nse' AND day IS NOT NULL), arg_min(day, seq) FILTER (WHERE day IS NOT NULL)) AS bidding_start,
    CAST(count(*) AS BIGINT) AS record_count
  FROM joined GROUP BY entity_id)
SELECT entity_id, status, company_name, bidding_start, record_count FROM agg
WHERE bidding_start >= DATE '2026-01-01' AND bidding_start <= DATE '2026-12-31' AND (status IS NULL OR status <> 'listed')
""")
def reconciled_listings(spark: SparkSession, folder: str) -> DataFrame:
    """End to end: records → entities → merged listings → those of one year that are not listed."""
    from ..operators.listing import within_date_range

    merged = feeds.drop_listed(merge.merge_records(resolve.link_entities(offers(spark, folder))))
    return merged.filter(within_date_range(F.col("bidding_start"), year=2026)).select(
        "entity_id", "status", "company_name", "bidding_start", "record_count"
    )


@query("find_existing", """
SELECT o.o_orderkey, CASE
    WHEN o.o_orderkey % 3 = 0 AND i.c_custkey IS NOT NULL THEN 'slug-' || i.c_custkey
    WHEN s.c_custkey IS NOT NULL THEN 'slug-' || s.c_custkey
    WHEN n.n_nationkey IS NOT NULL THEN 'nation-' || n.n_nationkey || '-ipo' END AS existing_slug
FROM orders o
LEFT JOIN customer i ON o.o_orderkey % 3 = 0 AND i.c_custkey = o.o_orderkey
LEFT JOIN customer s ON o.o_orderkey % 3 <= 1 AND s.c_custkey = o.o_custkey AND s.c_custkey % 2 = 0
LEFT JOIN nation n ON n.n_nationkey = o.o_orderkey % 50
""")
def find_existing(spark: SparkSession, folder: str) -> DataFrame:
    """Orders looked up by isin, symbol, then the slug of a name."""
    c = table(spark, folder, "customer")
    key = F.col("c_custkey").cast("string")
    nations = table(spark, folder, "nation").select(
        F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string"), F.lit("-ipo")).alias("slug"), F.lit(None).cast("string").alias("isin"), F.lit("").alias("symbol")
    )
    existing = c.select(
        F.concat(F.lit("slug-"), key).alias("slug"), F.concat(F.lit("I"), key).alias("isin"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("S"), key)).alias("symbol"),
    ).unionByName(nations)
    o = F.col("o_orderkey")
    incoming = table(spark, folder, "orders").select(
        "o_orderkey", F.when(o % 3 == 0, F.concat(F.lit("I"), o.cast("string"))).alias("isin"),
        F.when(o % 3 <= 1, F.concat(F.lit("S"), F.col("o_custkey").cast("string"))).otherwise("").alias("symbol"),
        F.concat(F.lit("Nation "), (o % 50).cast("string"), F.lit(" Ltd")).alias("company_name"),
    )
    return matching.find_existing(incoming, existing).select("o_orderkey", "existing_slug")


@query("best_name_match", """
WITH targets AS (SELECT p_partkey AS slug, replace(p_name, 'g', '') AS name FROM part),
entries AS (SELECT p_name AS name, min(p_partkey) AS list_pos FROM part GROUP BY p_name),
pairs AS (SELECT e.name AS a, t.name AS b FROM entries e, (SELECT DISTINCT name FROM targets) t),
""" + SCORED + """,
best AS (SELECT b, arg_max({'p': list_pos, 's': score}, {'s': score, 'p': -list_pos}) AS r
         FROM scored JOIN entries ON entries.name = a WHERE score >= 0.92 GROUP BY b)
SELECT slug, r.p AS list_pos, round(r.s, 6) AS score FROM targets JOIN best ON b = name
""")
def best_name_match(spark: SparkSession, folder: str) -> DataFrame:
    """Names with letters missing matched to the list of full names."""
    p = table(spark, folder, "part")
    targets = p.select(F.col("p_partkey").alias("slug"), F.replace("p_name", F.lit("g"), F.lit("")).alias("company_name"))
    entries = p.select(F.concat("p_name", F.lit(" IPO")).alias("company_name"), F.col("p_partkey").alias("list_pos"))
    return matching.best_name_match(targets, entries).withColumn("score", F.round("score", 6))


@query("contains_match", """
WITH e AS (SELECT p_partkey AS entry_id, CASE WHEN p_partkey % 3 = 0 THEN 'apex ' || p_name ELSE p_name END AS name FROM part),
l AS (SELECT name, min(pos) AS pos FROM (
        SELECT CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 2) ELSE 'big apex ' || p_name || ' works' END AS name, p_partkey AS pos FROM part) GROUP BY name)
SELECT entry_id, min(l.pos) AS slug FROM e JOIN l
  ON e.name = l.name OR (length(e.name) >= 4 AND contains(l.name, e.name)) OR (length(l.name) >= 4 AND contains(e.name, l.name))
GROUP BY entry_id
""")
def contains_match(spark: SparkSession, folder: str) -> DataFrame:
    """Short names found inside longer ones, both ways; a third of the names starts with one word."""
    p = table(spark, folder, "part")
    key = F.col("p_partkey")
    e = p.select(key.alias("entry_id"), F.when(key % 3 == 0, F.concat(F.lit("Apex "), "p_name")).otherwise(F.col("p_name")).alias("company_name"))
    name = F.when(key % 2 == 0, F.element_at(F.split("p_name", " "), 2)).otherwise(F.concat(F.lit("Big Apex "), F.col("p_name"), F.lit(" Works Ltd.")))
    listings = p.select(key.alias("slug"), key.alias("list_pos"), name.alias("company_name"))
    return matching.contains_match(e, listings)


@query("name_pairs_of_suppliers", None)
def name_pairs_of_suppliers(spark: SparkSession, folder: str) -> DataFrame:
    """Similar pairs among distinct part descriptions (name and brand): a wider set of names."""
    distinct = table(spark, folder, "part").select(
        fn.normalize_company(F.concat_ws(" ", "p_name", "p_type", F.regexp_extract("p_brand", r"\d+", 0))).alias("name")
    ).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    ranked = cut_lineage(distinct.select("name", F.xxhash64("name").alias("rank")))
    return names.similar_names_within(ranked, 0.97).groupBy("right_name").agg(F.count(F.lit(1)).alias("similar"))
