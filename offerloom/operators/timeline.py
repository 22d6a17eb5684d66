"""Event dates of a listing and their append-only history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blank_to_null, strict_date
from ..sources.feeds import FEED_A, FEED_B
from .stored import Payload

# Events in display order.
EVENTS = ("drhp_available", "rhp_available", "open", "close", "allotment", "listing")

# Payload fields per event, most trusted first.
_A, _B, _T = FEED_A, FEED_B, f"{FEED_A}.timeline"
DATE_FIELDS = {
    "open": [f"{_T}.application_start_date", f"{_A}.bidding_start_date", f"{_B}.issueStartDate", f"{_B}.ipoStartDate"],
    "close": [f"{_T}.application_end_date", f"{_A}.bidding_end_date", f"{_B}.issueEndDate", f"{_B}.ipoEndDate"],
    "allotment": [f"{_T}.allotment_date", f"{_T}.allotment_start_date"],
    "listing": [f"{_T}.listing_date", f"{_B}.listingDate"],
}
RECORD_FIELDS = {"open": "bidding_start", "close": "bidding_end", "listing": "listing_date"}
# The second allotment field does not make the broker the named source.
NAMED_SOURCE_FIELDS = {**DATE_FIELDS, "allotment": [f"{_T}.allotment_date"]}


def _event_date(p: Payload, event: str) -> Column:
    dates = [strict_date(blank_to_null(p.get(f))) for f in DATE_FIELDS[event]]
    if event in RECORD_FIELDS:
        dates.append(p.get(RECORD_FIELDS[event], "date"))
    return F.coalesce(*dates)


def _event_source(p: Payload, event: str) -> Column:
    def any_of(source: str) -> Column:
        fields = [blank_to_null(p.get(f)) for f in NAMED_SOURCE_FIELDS.get(event, []) if f.startswith(source + ".")]
        return F.coalesce(*fields, F.lit(None).cast("string")).isNotNull()

    return F.when(any_of(FEED_A), FEED_A).when(any_of(FEED_B), FEED_B).otherwise("inferred")


def build_timeline(master: DataFrame) -> DataFrame:
    """master + the six event dates; filings are dated by the bidding start once a link exists."""
    p = Payload(master)
    dates = {e: _event_date(p, e) for e in DATE_FIELDS}

    def filed(kind: str, field: str) -> Column:
        links = [p.get(kind), p.get(f"{_A}.{kind}_url"), p.get(f"{_B}.metaInfo.{field}"), p.get(f"{_B}.{field}")]
        link = F.coalesce(*[blank_to_null(x) for x in links])
        return F.when(link.isNotNull(), F.coalesce(p.get("bidding_start", "date"), dates["open"]))

    return master.select(
        "*",
        filed("drhp", "drhpUrl").alias("drhp_available"),
        filed("rhp", "rhpUrl").alias("rhp_available"),
        *[dates[e].alias(e) for e in ("open", "close", "allotment", "listing")],
    )


def status_events(timeline: DataFrame, key: str = "entity_id") -> DataFrame:
    """Timeline columns → rows (key, status, date, source, event_ord)."""
    p = Payload(timeline)
    entries = [
        F.struct(F.lit(i).alias("event_ord"), F.lit(e).alias("status"), F.col(e).alias("date"), _event_source(p, e).alias("source"))
        for i, e in enumerate(EVENTS)
    ]
    return timeline.select(key, F.explode(F.array(*entries)).alias("e")).select(
        key, "e.status", "e.date", "e.source", "e.event_ord"
    ).filter(F.col("date").isNotNull())


def append_status_history(history: DataFrame, events: DataFrame, now: Column, key: str = "entity_id") -> DataFrame:
    """history plus the events whose (status, date) it does not hold yet."""
    fresh = events.join(history, [key, "status", "date"], "left_anti")
    one = fresh.groupBy(key, "status", "date").agg(F.min_by("source", "event_ord").alias("source"))
    return history.unionByName(one.withColumn("detected_at", now).select(*history.columns))


def history_in_order(history: DataFrame, key: str = "entity_id") -> DataFrame:
    """One row per listing: its history in order of detection, then of events."""
    order = F.array_position(F.array(*[F.lit(e) for e in EVENTS]), F.col("status"))
    entry = F.struct(F.col("detected_at"), order.alias("event_ord"), F.col("date"), F.col("status"), F.col("source"))
    return history.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("history"))
