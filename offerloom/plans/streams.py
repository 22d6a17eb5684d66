"""Queries that replay tables as streams and read back what the streams left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import timeline
from ..session import shared_folder
from ..streaming import jobs
from ..streaming.store import BucketedSnapshot, cascade_delete_stored
from .registry import query, table
from .snapshots import EVENTS_SQL, NOW, UPSERTED, _timeline, _ts, arrivals, snapshot


@query("stream_status_events", f"WITH {EVENTS_SQL} SELECT DISTINCT entity_id, status, date FROM events_of")
def stream_status_events(spark: SparkSession, folder: str) -> DataFrame:
    """Status events of all orders, each seen by several snapshots of the feeds: every event is kept once."""
    events = timeline.status_events(_timeline(spark, folder)).select("entity_id", "status", "date")
    # Three polls; each sees two thirds of the entities, so every event comes twice.
    polled = events.withColumn("poll", F.explode(F.array(F.col("entity_id") % 3, (F.col("entity_id") + 1) % 3)))
    out = shared_folder(spark, "status-events")
    jobs.replay(polled, [F.col("poll") == i for i in range(3)], lambda s: jobs.event_stream(s.drop("poll"), out), "replayed-events")
    return spark.read.schema("entity_id long, status string, date date").parquet(out)


@query("stream_premiums", """
SELECT slug, date, arg_max(value, ts) AS value FROM (
  SELECT 'user-' || user_id AS slug, CAST(ts AS DATE) AS date, value, CAST(epoch_us(ts) AS HUGEINT) * 1000000 + event_id AS ts FROM events)
GROUP BY slug, date
""")
def stream_premiums(spark: SparkSession, folder: str) -> DataFrame:
    """Every event is a poll of its user's premium, in four batches by time; the last poll of a day stays."""
    e = table(spark, folder, "events")
    points = e.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("slug"), F.to_date("ts").alias("date"), "value", F.col("ts").cast("timestamp").alias("ts"), "event_id",
    )
    day = F.dayofmonth("date") % 4
    start = spark.createDataFrame([], "slug string, date date, value double")
    store = BucketedSnapshot(shared_folder(spark, "premiums"), start)
    # Events are numbered in time order.
    jobs.replay(points, [day == i for i in range(4)], lambda s: jobs.premium_stream(s, store, "event_id"), "replayed-premiums")
    return store.latest()


@query("stream_snapshot", f"WITH {UPSERTED} SELECT slug, status, price_min, price_max FROM acted")
def stream_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The arrivals of upsert_snapshot in three batches; the listings are those of one batch."""
    records = arrivals(spark, folder)
    bounds = records.agg(F.max("seq").alias("m")).first()["m"] or 0
    parts = [F.col("seq") <= bounds // 3, (F.col("seq") > bounds // 3) & (F.col("seq") <= bounds * 2 // 3), F.col("seq") > bounds * 2 // 3]
    store = BucketedSnapshot(shared_folder(spark, "listings"), snapshot(spark, folder))
    jobs.replay(records, parts, lambda s: jobs.snapshot_stream(s, store, lambda: _ts(NOW)), "replayed-arrivals")
    return store.latest().select("slug", "status", "price_min", "price_max")


@query("stored_cascade_delete", """
SELECT 'orders' AS part, CAST(count(*) AS BIGINT) AS rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)
UNION ALL SELECT 'customers', CAST(count(*) AS BIGINT) FROM customer WHERE c_nationkey <> 7
""")
def stored_cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of one nation and their orders removed from stored tables."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("slug"), "c_name", "c_nationkey")
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("slug"), "o_orderkey", "o_totalprice")
    stores = {n: BucketedSnapshot(shared_folder(spark, n), df) for n, df in (("orders", o), ("customers", c))}
    cascade_delete_stored(stores.values(), 0, c.filter("c_nationkey = 7"))
    counts = [s.latest().agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("part"), "rows") for n, s in stores.items()]
    return counts[0].unionByName(counts[1])
