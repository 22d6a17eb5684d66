"""Scoring extractions against hand-checked truth, cell by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values_match
from .listing import newest_per_entity


def compare_cells(gold: DataFrame, extraction: DataFrame) -> DataFrame:
    """gold(symbol, key, period_idx, period, value[, verified]) ⟕ extraction → cells with a type.

    Only cells with a true value are measured; type is correct, wrong or missed.
    """
    truth = gold.filter(F.col("value").isNotNull()).withColumnRenamed("value", "expected")
    got = extraction.select("symbol", "key", "period_idx", F.col("value").alias("got"))
    joined = truth.join(got, ["symbol", "key", "period_idx"], "left")
    kind = F.when(F.col("got").isNull(), "missed").when(values_match(F.col("got"), F.col("expected")), "correct").otherwise("wrong")
    return joined.withColumn("type", kind)


def _rates(df: DataFrame) -> DataFrame:
    attempted = F.col("correct") + F.col("wrong")

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, F.round(part / whole, 3)).otherwise(0.0)

    return df.select(
        "*", share(attempted, F.col("cells")).alias("coverage"), share(F.col("correct"), F.col("cells")).alias("accuracy"),
        share(F.col("correct"), attempted).alias("precision"),
    )


def _counts() -> list[Column]:
    return [F.count("type").alias("cells"), *[F.count_if(F.col("type") == t).alias(t) for t in ("correct", "wrong", "missed")]]


def score_files(files: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per truth file: cells, correct, wrong, missed and the three rates."""
    per_file = cells.groupBy("symbol").agg(*_counts())
    joined = files.select("symbol", "verified").join(per_file, "symbol", "left")
    filled = joined.select("symbol", "verified", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("cells", "correct", "wrong", "missed")])
    return _rates(filled)


def score_corpus(scores: DataFrame) -> DataFrame:
    """Totals over verified files only, weighted by cells."""
    v = F.col("verified")
    totals = scores.agg(
        F.count(F.lit(1)).alias("files_total"), F.count_if(v).alias("files_verified"),
        *[F.coalesce(F.sum(F.when(v, F.col(c))), F.lit(0)).alias(c) for c in ("cells", "correct", "wrong", "missed")],
    )
    return _rates(totals)


def cell_errors(cells: DataFrame, shown: int | None = None) -> DataFrame:
    """Missed and wrong cells with what was expected and got; with ``shown``, the first so many per file."""
    errors = cells.filter(F.col("type") != "correct").select("symbol", "key", "period_idx", "period", "expected", "got", "type")
    if shown is None:
        return errors
    return newest_per_entity(errors, "symbol", [F.asc("key"), F.asc("period_idx")], shown)
