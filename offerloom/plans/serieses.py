"""Queries: candles and premium series from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import listing, series
from ..sources.series import map_candles, map_premium_history, map_premium_list, prefer_first
from .registry import query, table

# Day candles per user from event values; ties are impossible, timestamps are distinct.
CANDLES = """
candles AS (
  SELECT user_id, CAST(ts AS DATE) AS date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume
  FROM events GROUP BY 1, 2)
"""


def _candles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


@query("candle_rows", f"WITH {CANDLES} SELECT user_id, date, open, high, CASE WHEN volume > 2 THEN low END AS low, close, volume FROM candles")
def candle_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Positional text arrays, as a feed sends them, back to typed rows."""
    c = _candles(spark, folder)
    low = F.when(F.col("volume") > 2, F.col("low").cast("string"))
    arr = F.array(F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("T00:00:00+05:30")), *[F.col(x).cast("string") for x in ("open", "high")], low, F.col("close").cast("string"), F.col("volume").cast("string"))
    # A calendar bounds the days of one key.
    packed = c.select("user_id", arr.alias("a")).groupBy("user_id").agg(F.collect_list("a").alias("candles"))
    return map_candles(packed, "user_id").select("user_id", "date", "open", "high", "low", "close", "volume")


@query("listing_metrics", f"""
WITH {CANDLES},
f AS (SELECT user_id, arg_min(open, date) AS listing_price, arg_min(high, date) AS day_high, arg_min(low, date) AS day_low, arg_max(close, date) AS current_price, max(date) AS as_of FROM candles GROUP BY 1)
SELECT user_id, listing_price, day_high, day_low, current_price,
       floor((listing_price - p) / p * 100 * 100 + 0.5) / 100 AS opening_gain, as_of
FROM (SELECT *, nullif(CAST(user_id % 40 AS DOUBLE), 0) AS p FROM f)
""")
def listing_metrics(spark: SparkSession, folder: str) -> DataFrame:
    c = _candles(spark, folder)
    prices = table(spark, folder, "events").select("user_id").distinct().withColumn("issue_price", (F.col("user_id") % 40).cast("double"))
    return series.listing_metrics(c, prices, "user_id")


@query("merge_price_history", """
WITH old AS (SELECT user_id, CAST(ts AS DATE) AS date, max(value) AS close FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2),
new AS (SELECT user_id, CAST(ts AS DATE) AS date, min(value) AS close FROM events WHERE event_type IN ('error', 'view') GROUP BY 1, 2)
SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.date, o.date) AS date, CASE WHEN n.user_id IS NULL THEN o.close ELSE n.close END AS close
FROM old o FULL JOIN new n ON o.user_id = n.user_id AND o.date = n.date
""")
def merge_price_history(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    day = [F.col("user_id"), F.to_date("ts").alias("date")]
    old = e.filter(F.col("event_type").isin("click", "view")).groupBy(*day).agg(F.max("value").alias("close"))
    new = e.filter(F.col("event_type").isin("error", "view")).groupBy(*day).agg(F.min("value").alias("close"))
    return series.merge_price_history(old, new, "user_id")


@query("prefer_first_exchange", """
WITH p AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'purchase' AND value > 40 GROUP BY 1),
f AS (SELECT user_id, min(value) AS v FROM events GROUP BY 1)
SELECT user_id, v, 'first' AS venue FROM p UNION ALL SELECT user_id, v, 'second' FROM f WHERE user_id NOT IN (SELECT user_id FROM p)
""")
def prefer_first_exchange(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    first = e.filter((F.col("event_type") == "purchase") & (F.col("value") > 40)).groupBy("user_id").agg(F.max("value").alias("v")).withColumn("venue", F.lit("first"))
    second = e.groupBy("user_id").agg(F.min("value").alias("v")).withColumn("venue", F.lit("second"))
    return prefer_first(first, second, "user_id")


@query("premium_list", """
SELECT event_id AS seq, user_id AS id, CASE WHEN event_type = 'error' THEN 0 ELSE value END AS premium, CASE WHEN user_id % 3 > 0 THEN CAST(user_id % 3 AS DOUBLE) END AS price FROM events
""")
def premium_list(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.concat(F.col("value").cast("string"), F.lit(" (est.)")))
    raw = table(spark, folder, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("company_short_name"),
        F.concat(F.lit("/gmp/user/"), F.col("user_id").cast("string"), F.lit("/")).alias("gmp_href"), F.lit(None).cast("string").alias("href"), text.alias("gmp"),
        (F.col("user_id") % 3).cast("string").alias("ipo_price"), F.lit("").alias("gmp_perc"), F.lit("SME").alias("ipo_category"), F.lit("O").alias("ipo_status"),
    )
    return map_premium_list(raw).select("seq", "id", "premium", "price")


@query("upsert_premium_history", """
WITH old AS (SELECT user_id, CAST(ts AS DATE) AS date, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2),
new AS (SELECT user_id, CAST(ts AS DATE) AS date, arg_max(value, event_id) AS value FROM events WHERE event_type <> 'click' GROUP BY 1, 2)
SELECT 'user-' || coalesce(n.user_id, o.user_id) AS slug, coalesce(n.date, o.date) AS date, CASE WHEN n.user_id IS NULL THEN o.value ELSE n.value END AS value, o.user_id IS NULL AS is_new
FROM old o FULL JOIN new n ON o.user_id = n.user_id AND o.date = n.date
""")
def upsert_premium_history(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    slug = F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("slug")
    old = e.filter("event_type = 'click'").groupBy(slug, F.to_date("ts").alias("date")).agg(F.max("value").alias("value"))
    raw = e.filter("event_type <> 'click'").select("user_id", F.date_format("ts", "dd-MM-yyyy").alias("gmp_date"), F.col("value").cast("string").alias("gmp"), "event_id")
    history = map_premium_history(raw.withColumn("id", F.struct("user_id", "event_id")))
    points = history.select(F.concat(F.lit("user-"), F.col("id.user_id").cast("string")).alias("slug"), "date", F.col("premium").alias("value"), F.col("id.event_id").alias("o"))
    return series.upsert_premium_history(old, points, F.col("o"))


@query("premium_points", """
WITH h AS (SELECT user_id, CAST(ts AS DATE) AS date, arg_max(value, ts) AS value FROM events WHERE event_type = 'click' AND user_id % 4 <> 0 GROUP BY 1, 2),
m AS (SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 0.0 ELSE max(value) END AS premium FROM events GROUP BY 1)
SELECT 'user-' || h.user_id AS slug, date, value FROM h JOIN m ON h.user_id = m.user_id WHERE premium <> 0
UNION ALL SELECT 'user-' || user_id, DATE '2024-02-01', premium FROM m WHERE premium <> 0 AND user_id NOT IN (SELECT user_id FROM h)
""")
def premium_points(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    h = e.filter("event_type = 'click' AND user_id % 4 <> 0").groupBy(F.col("user_id").alias("id"), F.to_date("ts").alias("date")).agg(F.max_by("value", "ts").alias("premium"))
    m = e.groupBy("user_id").agg(F.max("value").alias("v")).select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("slug"), F.col("user_id").alias("id"), F.when(F.col("user_id") % 5 == 0, 0.0).otherwise(F.col("v")).alias("premium")
    )
    return series.premium_points(m, h, F.lit("2024-02-01").cast("date"))


@query("premium_targets", """
SELECT o_orderkey, o_orderstatus = 'O' AS live, CASE WHEN o_orderstatus <> 'O' THEN 'status closed — no live GMP' END AS skip_reason
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')
""")
def premium_targets(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "orders").select(F.col("o_orderkey").alias("slug"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"))
    slugs = table(spark, folder, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("slug"))
    return series.premium_targets(li, slugs=slugs).select(F.col("slug").alias("o_orderkey"), (F.col("status") == "open").alias("live"), "skip_reason")


@query("premium_history", """
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn <= 500
""")
def premium_history(spark: SparkSession, folder: str) -> DataFrame:
    pts = table(spark, folder, "events").select("user_id", "event_id", F.col("ts").alias("date"))
    return listing.premium_history(pts, "user_id").select("user_id", "event_id")


@query("candle_targets", """
SELECT slug, listing_date FROM (SELECT 'o' || o_orderkey AS slug, CAST(o_orderdate AS DATE) AS listing_date FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0)
WHERE listing_date >= DATE '1999-01-01'
""")
def candle_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Listed offerings since a day, oldest first."""
    li = table(spark, folder, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("slug"), F.when(F.col("o_custkey") % 2 == 0, F.lit("I")).alias("isin"),
        F.when(F.col("o_orderstatus") == "F", "listed").otherwise("open").alias("status"), F.to_date("o_orderdate").alias("listing_date"),
    )
    return series.eligible_for_candles(li, F.lit("1999-01-01").cast("date")).select("slug", "listing_date")
