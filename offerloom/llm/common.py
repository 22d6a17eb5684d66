"""Shared steps: folders that all executors see, stored tables, prefix sums, whole-text slices."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Characters that Python code works on at a time; bounds its memory.
SLICE_CHARS = 1 << 20
#: Words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to a shared folder and read them back: later steps never rerun what made them."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_count(rows: int, per_bucket: int = 256) -> int:
    return max(1, math.ceil(rows / per_bucket))


def with_prefix(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, rows: int) -> DataFrame:
    """Add the sum of `value` over the rows before each row, within `keys`, in an order drawn by hash.

    No task gets a whole key: rows lie in hash buckets of about 256, buckets in groups of 1,024, and
    only the sums of buckets and of groups are put in order. Keys must not be null. Rows that agree in
    `order` are placed next to each other; rerunning gives the same sums.
    """
    n = bucket_count(rows)
    keys = list(keys)
    cells = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n))).withColumn("_value", value)
    sums = cells.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_sum")).withColumn("_group", F.floor(F.col("_bucket") / 1024))
    groups = sums.groupBy(*keys, "_group").agg(F.sum("_sum").alias("_sum"))
    far = W.partitionBy(*keys).orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    groups = groups.select(*keys, "_group", F.coalesce(F.sum("_sum").over(far), zero).alias("_far"))
    inside = W.partitionBy(*keys, "_group").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    base = (
        sums.join(groups, [*keys, "_group"])
        .select(*keys, "_bucket", (F.col("_far") + F.coalesce(F.sum("_sum").over(inside), zero)).alias("_base"))
    )
    own = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        cells.withColumn("_own", F.coalesce(F.sum("_value").over(own), zero))
        .join(base, [*keys, "_bucket"])
        .withColumn(out, F.col("_base") + F.col("_own"))
        .drop("_bucket", "_value", "_own", "_base")
    )


def slices(texts: Sequence[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `limit` characters; a longer text is a range of its own."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)
