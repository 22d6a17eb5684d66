"""Merging the records of one listing by source precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rows import first_by, last_by
from ..sources.feeds import FEED_A, FEED_B, SOURCES


def merge_records(resolved: DataFrame, exchange: str = FEED_B, broker: str = FEED_A) -> DataFrame:
    """One row per entity_id. First non-null value in seq order, except:

    * bidding start and documents: the exchange first (its later record wins), then the broker;
    * price band: the broker's band if it has a minimum (its earlier record wins), then the
      exchange's band even if empty, then the first band.
    """
    seq = F.col("seq")
    of_exchange = F.col("source") == exchange
    of_broker = F.col("source") == broker

    def first(name: str) -> Column:
        return first_by(F.col(name), seq)

    def exchange_last(name: str) -> Column:
        return last_by(F.when(of_exchange, F.col(name)), seq)

    def broker_first(name: str) -> Column:
        return first_by(F.when(of_broker, F.col(name)), seq)

    band = F.struct(F.col("price_min").alias("lo"), F.col("price_max").alias("hi"))
    payloads = [s for s in SOURCES if s in resolved.columns]
    grouped = resolved.groupBy("entity_id").agg(
        *[first(c).alias(c) for c in ("isin", "symbol", "company_name", "status", "listing_date")],
        F.coalesce(exchange_last("bidding_start"), broker_first("bidding_start"), first("bidding_start")).alias("bidding_start"),
        F.min_by(F.when(of_broker, band), F.when(of_broker, seq)).alias("_broker"),
        F.max_by(F.when(of_exchange, band), F.when(of_exchange, seq)).alias("_exchange"),
        F.min_by(band, seq).alias("_first"),
        F.coalesce(exchange_last("rhp"), first("rhp")).alias("rhp"),
        F.coalesce(exchange_last("drhp"), first("drhp")).alias("drhp"),
        *[last_by(F.col(s), seq).alias(s) for s in payloads],
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.count(F.lit(1)).alias("record_count"),
    )
    chosen = F.coalesce(F.when(F.col("_broker.lo").isNotNull(), F.col("_broker")), F.col("_exchange"), F.col("_first"))
    return grouped.withColumn("_band", chosen).select(
        "entity_id", "isin", "symbol", "company_name", "status", "bidding_start",
        F.col("_band.lo").alias("price_min"), F.col("_band.hi").alias("price_max"),
        "rhp", "drhp", "listing_date", *payloads, "sources", "record_count",
    )
