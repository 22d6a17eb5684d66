"""Looking up an existing listing, and matching premium entries to listings by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blank_to_null, normalize_premium_name, slugify
from ..rows import pick_row
from ..session import cut_lineage
from .names import similar_names

PREMIUM_SCORE = 0.92  # Fixed value: least name score of a premium match.
LEAST_CONTAINED = 4  # Fixed value: shorter names are not searched inside others.
GRAM = 8  # Longest piece of a name by which it is looked up.


def find_existing(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """incoming + existing_slug: by isin, else symbol, else the slug of the company name."""
    def lookup(column: str) -> DataFrame:
        held = existing.filter(blank_to_null(F.col(column)).isNotNull())
        return held.groupBy(F.col(column).alias(f"_{column}")).agg(F.min("slug").alias(f"_by_{column}"))

    named = blank_to_null(F.col("company_name"))
    keyed = (
        incoming.withColumn("_isin", blank_to_null(F.col("isin")))
        .withColumn("_symbol", blank_to_null(F.col("symbol")))
        .withColumn("_slug", F.when(named.isNotNull(), slugify(named)))
    )
    # Rows without a key would gather in one partition of the joins: each gets a key of its own that nothing has.
    for column in ("_isin", "_symbol", "_slug"):
        keyed = keyed.withColumn(column, F.coalesce(column, F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))))
    slugs = existing.select(F.col("slug").alias("_slug")).distinct().withColumn("_by_slug", F.col("_slug"))
    return (
        keyed.join(lookup("isin"), "_isin", "left")
        .join(lookup("symbol"), "_symbol", "left")
        .join(slugs, "_slug", "left")
        .select(*incoming.columns, F.coalesce("_by_isin", "_by_symbol", "_by_slug").alias("existing_slug"))
    )


def best_name_match(
    targets: DataFrame, entries: DataFrame, key: str = "slug", name: str = "company_name", pos: str = "list_pos",
    threshold: float = PREMIUM_SCORE,
) -> DataFrame:
    """key, list_pos, score of the best entry per target: an equal name, else the highest score.

    Ties keep list order. Both sides are reduced to distinct names before they are compared.
    """
    norm = normalize_premium_name(F.col(name))
    t = targets.select(key, norm.alias("name")).filter("name <> ''")
    e = entries.select(norm.alias("name"), pos).filter("name <> ''").groupBy("name").agg(F.min(pos).alias(pos))
    pairs = similar_names(e.select("name"), t.select("name").distinct(), threshold)
    best = (
        pairs.join(e.withColumnRenamed("name", "left_name"), "left_name")
        .groupBy(F.col("right_name").alias("name"))
        .agg(F.max_by(F.struct(pos, "score"), F.struct("score", (-F.col(pos)).alias("p"))).alias("b"))
    )
    return t.join(best, "name").select(key, F.col(f"b.{pos}").alias(pos), F.col("b.score").alias("score"))


def _pieces(name: Column, size: Column) -> Column:
    """All substrings of so many characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - size + 1), lambda i: F.substring(name, i, size)))


def looked_up(short: DataFrame, long: DataFrame) -> DataFrame:
    """(short name, long name) that share the short one's rarest piece.

    An inverted index holds the pieces of the long names. A short name is looked up by that of its pieces
    which the fewest long names have, so a word that many names share decides for no name that has another
    piece; a short name with a piece that no long name has is in none.
    """
    size = F.least(F.length("name"), F.lit(GRAM))
    s = short.filter(F.length("name") >= LEAST_CONTAINED).withColumn("size", size)
    asked = cut_lineage(s.select("name", "size", F.explode(_pieces(F.col("name"), F.col("size"))).alias("piece")))
    sizes = F.transform(F.sequence(F.lit(LEAST_CONTAINED), F.least(F.length("name"), F.lit(GRAM))), lambda n: _pieces(F.col("name"), n))
    index = long.filter(F.length("name") >= LEAST_CONTAINED).select(F.col("name").alias("long_name"), F.explode(F.flatten(sizes)).alias("piece"))
    index = cut_lineage(index)
    often = index.groupBy("piece").agg(F.count(F.lit(1)).alias("names"))
    rarest = asked.join(often, "piece", "left").groupBy(F.col("name").alias("short_name")).agg(
        F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "piece")).alias("r")
    )
    chosen = rarest.filter("r.names > 0").select("short_name", F.col("r.piece").alias("piece"))
    return chosen.join(index, "piece").select("short_name", "long_name")


def _inside(short: DataFrame, long: DataFrame) -> DataFrame:
    """(short name, long name) where the short one occurs in the long one, if it is not the same."""
    held = F.contains(F.col("long_name"), F.col("short_name")) & (F.col("long_name") != F.col("short_name"))
    return looked_up(short, long).filter(held)


def contains_match(
    entries: DataFrame, listings: DataFrame, entry_key: str = "entry_id", listing_key: str = "slug",
    name: str = "company_name", pos: str = "list_pos",
) -> DataFrame:
    """entry key, listing key: the first listing whose name equals, contains or lies in the entry's.

    A name is found inside another through the rarest of its pieces.
    """
    norm = normalize_premium_name(F.col(name))
    e = entries.select(entry_key, norm.alias("entry_name")).filter("entry_name <> ''")
    li = pick_row(
        listings.select(norm.alias("listing_name"), listing_key, pos).filter("listing_name <> ''"),
        ["listing_name"], [F.col(pos)],
    )
    en = e.select(F.col("entry_name").alias("name")).distinct()
    ln = li.select(F.col("listing_name").alias("name"))
    pairs = (
        en.join(ln, "name").select(F.col("name").alias("entry_name"), F.col("name").alias("listing_name"))
        .unionByName(_inside(en, ln).select(F.col("short_name").alias("entry_name"), F.col("long_name").alias("listing_name")))
        .unionByName(_inside(ln, en).select(F.col("long_name").alias("entry_name"), F.col("short_name").alias("listing_name")))
    )
    best = pairs.join(li, "listing_name").groupBy("entry_name").agg(
        F.min_by(F.struct(listing_key, pos), pos).alias("b")
    )
    return e.join(best, "entry_name").select(entry_key, F.col(f"b.{listing_key}").alias(listing_key))
