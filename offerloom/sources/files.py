"""Readers and writers of whole datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import artifact_key
from ..session import cut_lineage

# Layout of a hand-checked truth file.
GOLD_SCHEMA = """
    symbol string, sourceFile string, _verified boolean, currencyUnit string, periods array<string>,
    metrics map<string,array<double>>, _hints map<string,struct<_page:int,_quote:string>>
"""


def read_master(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array of master records."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """One row per markdown file: path, doc_type and text."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return df.withColumn("doc_type", F.regexp_extract("path", r"([^/]+)\.md$", 1)).withColumn(
        "symbol", F.regexp_extract("path", r"([^/]+)/[^/]+\.md$", 1)
    )


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(GOLD_SCHEMA).json(path)


def gold_cells(gold: DataFrame) -> DataFrame:
    """Truth files as long rows: symbol, verified, key, period_idx, period, value."""
    metrics = gold.select("symbol", F.coalesce("_verified", F.lit(False)).alias("verified"), "periods", F.explode("metrics").alias("key", "values"))
    return metrics.select(
        "symbol", "verified", "key", "periods", F.posexplode("values").alias("period_idx", "value")
    ).select(
        "symbol", "verified", "key", "period_idx",
        F.coalesce(F.get("periods", F.col("period_idx")), F.col("period_idx").cast("string")).alias("period"),
        "value",
    )


def gold_files(gold: DataFrame) -> DataFrame:
    """One row per truth file, so files without cells still count."""
    return gold.select("symbol", F.coalesce("_verified", F.lit(False)).alias("verified"))


def write_reconciled(master: DataFrame, borderline: DataFrame, path: str) -> None:
    """Master table, and the review table only when it has rows; its plan runs once."""
    master.write.mode("overwrite").parquet(f"{path}/master")
    held = cut_lineage(borderline)
    if not held.isEmpty():
        held.write.mode("overwrite").parquet(f"{path}/borderline")


def write_sections(slices: DataFrame, path: str) -> None:
    """Section page texts laid out by section."""
    slices.write.mode("overwrite").partitionBy("section").parquet(path)


def section_manifest(ranges: DataFrame) -> DataFrame:
    """Per document a map section → status and page range."""
    status = F.when(F.col("end") < F.col("start"), "skipped").otherwise("extracted")
    entry = F.struct(
        "section",
        F.struct(status.alias("status"), F.concat_ws("-", "start", "end").alias("pages")).alias("v"),
    )
    return ranges.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("sections"))


def with_artifact_key(df: DataFrame, ext: str = "md") -> DataFrame:
    return df.withColumn("artifact_key", artifact_key(F.coalesce("symbol", "slug"), F.col("doc_type"), ext))


def cascade_delete(tables: dict[str, DataFrame], keys: DataFrame, key: str = "slug") -> dict[str, DataFrame]:
    """Each table without the deleted entities; the caller writes the new snapshots."""
    gone = keys.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}
