"""Streaming forms of the three batch updates: events, premiums and the snapshot.

The batch steps never forget a key. Events are told apart by a key-value state store; premiums and the
snapshot have their state on disk, in parts of which a micro-batch reads and writes those that its keys are in.
A batch that is retried reads the same rows and writes them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.series import upsert_premium_history
from ..operators.upsert import target_slugs, upsert_snapshot
from ..session import cut_lineage, shared_folder
from .store import BucketedSnapshot

EVENT_KEY = ["entity_id", "status", "date"]
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """State that grows with the history belongs into RocksDB, not into the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def first_seen_events(events: DataFrame) -> DataFrame:
    """Each (entity, status, date) once, however often snapshots repeat it.

    State grows with the number of distinct events, as the history itself does.
    """
    return events.dropDuplicates(EVENT_KEY)


def event_stream(events: DataFrame, path: str) -> DataStreamWriter:
    """Events that no earlier batch had, appended to a table; its sink commits each batch once."""
    keep_state_on_disk(events.sparkSession)
    return first_seen_events(events).writeStream.format("parquet").outputMode("append").option("path", path)


def premium_step(store: BucketedSnapshot, batch: DataFrame, batch_id: int, order: str = "ts") -> None:
    """One batch of polls (slug, date, value, order) into the stored points; a later poll of a day wins."""
    touched = store.touched(batch)
    held = store.rows(store.before(batch_id), touched)
    rank = F.unix_micros(order) if dict(batch.dtypes)[order].startswith("timestamp") else F.col(order)
    store.replace(batch_id, upsert_premium_history(held, batch, rank).select("slug", "date", "value"), touched)


def premium_stream(points: DataFrame, store: BucketedSnapshot, order: str = "ts") -> DataStreamWriter:
    """Polls → one row per slug and day, last write wins."""
    def step(batch: DataFrame, batch_id: int) -> None:
        premium_step(store, cut_lineage(batch), batch_id, order)

    return points.writeStream.foreachBatch(step)


def snapshot_step(store: BucketedSnapshot, batch: DataFrame, batch_id: int, now: Column, order: str = "seq") -> None:
    """One batch of arriving records into the stored listings.

    Which row a record is written to may depend on every stored isin, symbol and slug: those columns are read
    whole. Rows are read and written for the buckets of the target slugs alone.
    """
    before = store.before(batch_id)
    targets = cut_lineage(target_slugs(batch, store.rows(before).select("slug", "isin", "symbol"), order))
    touched = store.touched(targets)
    out = upsert_snapshot(store.rows(before, touched), batch, now, order, targets)
    store.replace(batch_id, out.select(*store.start.columns), touched)


def snapshot_stream(records: DataFrame, store: BucketedSnapshot, now: Callable[[], Column], order: str = "seq") -> DataStreamWriter:
    """Arriving stored records → upserted snapshot, batch by batch."""
    def step(batch: DataFrame, batch_id: int) -> None:
        snapshot_step(store, cut_lineage(batch), batch_id, now(), order)

    return records.writeStream.foreachBatch(step)


def replay(rows: DataFrame, parts: list[Column], start: Callable[[DataFrame], DataStreamWriter], name: str) -> None:
    """Let a stream read the rows part by part: each part arrives as files, and the stream is started
    anew from its checkpoint until it has read them."""
    spark = rows.sparkSession
    root = shared_folder(spark, name)
    for i, part in enumerate(parts):
        rows.filter(part).write.parquet(f"{root}/in/{i}")
        source = spark.readStream.schema(rows.schema).parquet(f"{root}/in/*")
        query = start(source).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        if query.exception():
            raise query.exception()
