"""Similar-name join: all pairs of distinct names with Jaro-Winkler >= threshold.

No pair is missed. The filter is weak for long names at low thresholds: at 0.85 two names need only two
thirds of their characters in common, so among thousands of wide names the pairs that meet in a key
grow about as the square. Three facts about the score bound the overlap of the two bags of characters:

* score >= T with p equal leading characters needs jaro >= (T - p/10) / (1 - p/10);
* jaro <= (m/len_a + m/len_b + 1) / 3, so m/len_a + m/len_b >= S(p) = 3*jaro_min - 1;
* the matched characters m are at most the common characters of both bags.

Characters (with their repeat number) are put in one fixed order, rare ones first. If two
bags share at least m characters, then their heads of length ``len - m + k`` share at least
k of them (prefix filtering of set-similarity joins). The join key is therefore
(equal first characters or not, length of the shorter name, k head characters):
names with four equal leading characters use k = 1 on top of those four, all others k = 2.
The bag overlap itself is checked inside the join, before a pair leaves it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jaro_winkler

# Fixed order of characters, rare ones first. Any total order is correct; this one keeps
# the leading characters selective for company names.
RARE_FIRST = "zqxjkvbywfpgm9876543210uhdlcstnroiae "


def _bounds(threshold: float) -> tuple[float, float]:
    """Smallest m/len_a + m/len_b for pairs with four, and with fewer, equal leading characters."""
    four = 3 * (threshold - 0.4) / 0.6 - 1
    fewer = 3 * (threshold - 0.3) / 0.7 - 1
    return four, fewer


def bag_tokens(name: Column) -> Column:
    """Characters of a normalised name with their repeat number, rare ones first."""
    def repeats(ch: Column) -> Column:
        count = F.length(name) - F.length(F.replace(name, ch, F.lit("")))
        # Higher repeat numbers are rarer, so they come first.
        return F.when(count > 0, F.transform(F.sequence(count, F.lit(1)), lambda i: F.concat(ch, i.cast("string")))).otherwise(
            F.array().cast("array<string>")
        )

    return F.flatten(F.transform(F.split(F.lit(RARE_FIRST), ""), repeats))


def _need(bound: float, own: Column, other: Column) -> Column:
    """Least number of common characters of two names of these lengths."""
    return F.ceil(F.lit(bound) * own * other / (own + other) - F.lit(1e-9)).cast("int")


def _head(tokens: Column, length: Column, need: Column, k: Column | int) -> Column:
    return F.slice(tokens, 1, F.least(length, length - need + k))


def _pairs_of(head: Column) -> Column:
    """All two-element combinations of a head, in order, as text."""
    n = F.size(head)
    return F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
            lambda i: F.transform(
                F.slice(head, i + 1, F.greatest(n - i, F.lit(0))),
                lambda t: F.concat(F.element_at(head, i), t),
            ),
        )
    )


def _keys(df: DataFrame, threshold: float, shorter: bool) -> DataFrame:
    """Join keys of each name in its role as the shorter or the longer of a pair."""
    four, fewer = _bounds(threshold)
    length = F.length("name")
    rank = ["rank"] if "rank" in df.columns else []
    places = ("short_at" if shorter else "long_at") if "short_at" in df.columns else None
    base = df.select("name", *rank, *([places] if places else []), length.alias("len"), bag_tokens(F.col("name")).alias("tokens"))
    parts = []
    for cls, bound in (("4", four), ("x", fewer)):
        if shorter:
            sized = base.withColumn("short_len", F.col("len"))
        else:
            # Shorter partners have m <= their own length, so short_len/len >= bound - 1.
            low = F.greatest(F.lit(1), F.ceil(F.col("len") * F.lit(bound - 1) - F.lit(1e-9)).cast("int"))
            sized = base.withColumn("short_len", F.explode(F.sequence(low, F.col("len"))))
        # A shorter name shares least with a partner of its own length.
        need = _need(bound, F.col("len"), F.col("short_len"))
        floor = F.ceil(F.lit(bound) * F.col("short_len") / 2 - F.lit(1e-9)).cast("int")
        if cls == "4":
            sized = sized.filter(F.col("len") >= 4)
            signature = F.transform(
                _head(F.col("tokens"), F.col("len"), need, 1), lambda t: F.concat(F.substring("name", 1, 4), F.lit("|"), t)
            )
        else:
            # Names too short to share two characters are keyed by one.
            signature = F.when(floor >= 2, _pairs_of(_head(F.col("tokens"), F.col("len"), need, 2))).otherwise(
                _head(F.col("tokens"), F.col("len"), need, 1)
            )
        if places:
            # The time of a name is part of its keys.
            signature = F.flatten(F.transform(signature, lambda t: F.transform(F.col(places), lambda p: F.concat(t, F.lit("@"), p))))
        parts.append(
            sized.select("name", *rank, "len", "tokens", "short_len", F.explode(signature).alias("sig")).withColumn(
                "cls", F.lit(cls)
            )
        )
    return parts[0].unionByName(parts[1])


def _candidates(short: DataFrame, long: DataFrame, threshold: float, ties: bool) -> DataFrame:
    """Pairs within both bounds. ``ties`` says that the shorter side is the left one, which then also
    takes equal lengths."""
    four, fewer = _bounds(threshold)
    s, g = short.alias("s"), long.alias("g")
    prefix4 = (F.col("s.len") >= 4) & (F.substring("s.name", 1, 4) == F.substring("g.name", 1, 4))
    bound = F.when(F.col("s.cls") == "4", F.lit(four)).otherwise(F.lit(fewer))
    ratio = F.lit(1.0) / F.col("s.len") + F.lit(1.0) / F.col("g.len")
    common = F.size(F.array_intersect("s.tokens", "g.tokens"))
    longer = F.col("s.len") <= F.col("g.len") if ties else F.col("s.len") < F.col("g.len")
    return s.join(
        g,
        (F.col("s.cls") == F.col("g.cls"))
        & (F.col("s.short_len") == F.col("g.short_len"))
        & (F.col("s.sig") == F.col("g.sig"))
        & longer
        & ((F.col("s.cls") == "4") == prefix4)
        & (common * ratio >= bound - F.lit(1e-9)),
    )


def similar_names_within(ranked: DataFrame, threshold: float) -> DataFrame:
    """left_name, right_name, score for all pairs of names of one frame (name, rank) scoring >= threshold.

    The left name ranks after the right one. Each name meets the longer ones, and those of its length that
    rank before it, so no pair is tested in two roles. With columns at and reach (buckets of time of a name,
    and those around them), short_at and long_at (its keys in either role), names whose times do not meet
    are no pair.
    """
    four, fewer = _bounds(threshold)
    s, g = _keys(ranked, threshold, True).alias("s"), _keys(ranked, threshold, False).alias("g")
    prefix4 = (F.col("s.len") >= 4) & (F.substring("s.name", 1, 4) == F.substring("g.name", 1, 4))
    bound = F.when(F.col("s.cls") == "4", F.lit(four)).otherwise(F.lit(fewer))
    common = F.size(F.array_intersect("s.tokens", "g.tokens")) * (F.lit(1.0) / F.col("s.len") + F.lit(1.0) / F.col("g.len"))
    met = s.join(
        g,
        (F.col("s.cls") == F.col("g.cls")) & (F.col("s.short_len") == F.col("g.short_len")) & (F.col("s.sig") == F.col("g.sig"))
        & ((F.col("s.len") < F.col("g.len")) | ((F.col("s.len") == F.col("g.len")) & (F.col("s.rank") > F.col("g.rank"))))
        & ((F.col("s.cls") == "4") == prefix4) & (common >= bound - F.lit(1e-9)),
    )
    later = F.col("s.rank") > F.col("g.rank")
    pairs = met.select(
        F.when(later, F.col("s.name")).otherwise(F.col("g.name")).alias("left_name"),
        F.when(later, F.col("g.name")).otherwise(F.col("s.name")).alias("right_name"),
    ).dropDuplicates(["left_name", "right_name"])
    if "at" in ranked.columns:
        # Names that met by a common key: their lists of buckets decide, before any score is taken.
        held = ranked.select(F.col("name").alias("left_name"), "reach"), ranked.select(F.col("name").alias("right_name"), "at")
        pairs = pairs.join(held[0], "left_name").join(held[1], "right_name").filter(F.arrays_overlap("reach", "at")).drop("reach", "at")
    return pairs.withColumn("score", jaro_winkler(F.col("left_name"), F.col("right_name"))).filter(F.col("score") >= threshold)


def similar_names(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """left_name, right_name, score for all pairs of distinct names scoring >= threshold.

    Both frames have a column ``name`` of distinct, non-empty names over [a-z0-9 ]. The score is taken
    with the left name first. Equal names are included with score 1.
    """
    short_left = _candidates(_keys(left, threshold, True), _keys(right, threshold, False), threshold, ties=True).select(
        F.col("s.name").alias("left_name"), F.col("g.name").alias("right_name")
    )
    short_right = _candidates(_keys(right, threshold, True), _keys(left, threshold, False), threshold, ties=False).select(
        F.col("g.name").alias("left_name"), F.col("s.name").alias("right_name")
    )
    pairs = short_left.unionByName(short_right).dropDuplicates(["left_name", "right_name"])
    return pairs.withColumn("score", jaro_winkler(F.col("left_name"), F.col("right_name"))).filter(
        F.col("score") >= threshold
    )
