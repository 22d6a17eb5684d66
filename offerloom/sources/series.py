"""Candles and premium observations as typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import day_first_date, leading_float, trailing_path_id


def map_candles(df: DataFrame, key: str = "isin", candles: str = "candles") -> DataFrame:
    """array<array<string>> [ts, open, high, low, close, volume, oi] → one row per day."""
    c = F.col("c")

    def at(i: int, kind: str) -> Column:
        return F.get(c, F.lit(i)).try_cast(kind)

    rows = df.select(key, F.explode(candles).alias("c"))
    return rows.select(
        key,
        F.try_to_date(F.get(F.split(F.get(c, F.lit(0)), "T"), F.lit(0)), "yyyy-MM-dd").alias("date"),
        at(1, "double").alias("open"),
        at(2, "double").alias("high"),
        at(3, "double").alias("low"),
        at(4, "double").alias("close"),
        at(5, "bigint").alias("volume"),
        at(6, "bigint").alias("oi"),
    )


def prefer_first(primary: DataFrame, fallback: DataFrame, key: str = "isin") -> DataFrame:
    """Rows of the fallback exchange only for keys the primary does not have."""
    missing = fallback.join(primary.select(key).distinct(), key, "left_anti")
    return primary.unionByName(missing)


def map_premium_list(df: DataFrame) -> DataFrame:
    """Snapshot payload rows; an unreadable premium is 0, unreadable price or percent null."""
    zero_is_missing = lambda name: F.nullif(leading_float(F.col(name)), F.lit(0.0))
    link = F.coalesce(F.nullif(F.col("gmp_href"), F.lit("")), F.col("href"))
    return df.select(
        *(["seq"] if "seq" in df.columns else []),
        F.nullif(F.col("company_short_name"), F.lit("")).alias("company_name"),
        trailing_path_id(link).alias("id"),
        F.coalesce(leading_float(F.col("gmp")), F.lit(0.0)).alias("premium"),
        zero_is_missing("ipo_price").alias("price"),
        zero_is_missing("gmp_perc").alias("percent"),
        F.nullif(F.col("ipo_category"), F.lit("")).alias("category"),
        F.nullif(F.col("ipo_status"), F.lit("")).alias("status"),
    )


def map_premium_history(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Per-id history rows; rows without a readable DD-MM-YYYY date are dropped."""
    return df.select(
        id_col,
        day_first_date(F.col("gmp_date")).alias("date"),
        F.coalesce(leading_float(F.col("gmp")), F.lit(0.0)).alias("premium"),
    ).filter(F.col("date").isNotNull())
