"""Price and premium series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import round2
from ..rows import pick_row


def listing_metrics(candles: DataFrame, listings: DataFrame, key: str = "isin") -> DataFrame:
    """First-day prices, last close and gain against the issue price, per listing with candles.

    ``listings``: key and issue_price. One aggregation with map-side combine.
    """
    day = F.col("date")
    per_key = candles.groupBy(key).agg(
        F.min_by(F.struct("open", "high", "low", "close"), day).alias("f"),
        F.max_by("close", day).alias("current_price"),
        F.max(day).alias("as_of"),
    )
    opened = F.coalesce("f.open", "f.close")
    price = F.nullif(F.col("issue_price"), F.lit(0).cast("double"))
    return per_key.join(listings.select(key, "issue_price"), key).select(
        key,
        opened.alias("listing_price"),
        F.col("f.high").alias("day_high"),
        F.col("f.low").alias("day_low"),
        "current_price",
        round2((opened - price) / price * 100).alias("opening_gain"),
        "as_of",
    )


def merge_price_history(existing: DataFrame, arrived: DataFrame, key: str = "isin") -> DataFrame:
    """One row per key and day; arrived candles replace existing ones of the same day."""
    both = existing.withColumn("_v", F.lit(0)).unionByName(arrived.withColumn("_v", F.lit(1)))
    order = [F.col("_v")] + ([F.col("seq")] if "seq" in both.columns else [])
    return pick_row(both.filter(F.col("date").isNotNull()), [key, "date"], order, last=True).drop("_v")


def premium_percentage(percent: Column, premium: Column, price: Column) -> Column:
    return F.coalesce(percent, round2(premium / F.nullif(price, F.lit(0).cast("double")) * 100))


def premium_targets(listings: DataFrame, status: str | None = None, slugs: DataFrame | None = None) -> DataFrame:
    """Listings to look up with ``skip_reason`` for those that are not open or upcoming."""
    if slugs is not None:
        chosen = listings.join(slugs.select("slug").distinct(), "slug", "left_semi")
    elif status in (None, "all"):
        chosen = listings.filter(F.col("status").isin("open", "upcoming"))
    else:
        chosen = listings.filter(F.col("status") == status)
    live = F.coalesce(F.col("status").isin("open", "upcoming"), F.lit(False))
    reason = F.concat(F.lit("status "), F.coalesce("status", F.lit("null")), F.lit(" — no live GMP"))
    return chosen.withColumn("skip_reason", F.when(~live, reason))


def premium_points(matches: DataFrame, history: DataFrame, today: Column) -> DataFrame:
    """(slug, date, value) of matched listings: their history, else the snapshot dated today.

    ``matches``: slug, id, premium. A zero premium counts as none.
    """
    live = matches.filter(F.coalesce(F.col("premium"), F.lit(0.0)) != 0)
    past = live.select("slug", "id").join(history.select("id", "date", F.col("premium").alias("value")), "id")
    alone = live.join(history.select("id").distinct(), "id", "left_anti").select(
        "slug", today.alias("date"), F.col("premium").alias("value")
    )
    return past.select("slug", "date", "value").unionByName(alone)


def upsert_premium_history(existing: DataFrame, points: DataFrame, order: Column | None = None) -> DataFrame:
    """One row per (slug, date), last write wins; ``is_new`` marks days not stored before."""
    rank = order if order is not None else F.lit(0)
    old = existing.select("slug", "date", "value", F.lit(0).alias("_v"), F.lit(0).cast("bigint").alias("_o"))
    new = points.select("slug", "date", "value", F.lit(1).alias("_v"), rank.cast("bigint").alias("_o"))
    both = old.unionByName(new)
    return both.groupBy("slug", "date").agg(
        F.max_by("value", F.struct("_v", "_o")).alias("value"), (F.min("_v") == 1).alias("is_new")
    )


def eligible_for_candles(listings: DataFrame, since: Column | None = None, limit: int | None = None, status: str = "listed") -> DataFrame:
    """Listed rows with an isin, oldest listing first; with a limit, the first so many."""
    rows = listings.filter((F.col("status") == status) & F.col("isin").isNotNull())
    if since is not None:
        rows = rows.filter(F.col("listing_date") >= since)
    rows = rows.orderBy(F.asc_nulls_first("listing_date"), "slug")
    return rows if limit is None else rows.limit(limit)
