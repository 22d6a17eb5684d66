"""Entity resolution over standard records.

Two records are the same listing when they share an isin, share a normalised symbol, or
have similar names (Jaro-Winkler >= 0.90) with bidding starts at most 30 days apart;
matches are followed transitively.

Names are handled as *runs*, not as records: all records of one name whose dates follow
each other within 30 days are one run. A name held by a third of all rows is thus a few
runs, and two runs have records within 30 days of each other exactly when their date
spans come within 30 days.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import blank_to_null, normalize_company, normalize_symbol
from ..session import cut_lineage
from .components import connected_components
from .names import similar_names_within

# Score limits and the date guard.
MATCH_SCORE = 0.90
NEAR_SCORE = 0.85
DATE_GUARD_DAYS = 30
#: A name active in more buckets of time is compared with the others by its list of buckets.
FEW_BUCKETS = 6


def match_keys(records: DataFrame) -> DataFrame:
    """seq, isin, symbol key, name key and date; blanks are null and never match."""
    return records.select(
        "seq",
        blank_to_null(F.col("isin")).alias("isin"),
        blank_to_null(normalize_symbol(F.col("symbol"))).alias("symbol"),
        blank_to_null(normalize_company(F.col("company_name"))).alias("name"),
        F.col("bidding_start").alias("day"),
    )


def equal_key_edges(keys: DataFrame, column: str) -> DataFrame:
    """Each record to the first record with the same key."""
    held = keys.select("seq", column).filter(F.col(column).isNotNull())
    first = held.groupBy(column).agg(F.min("seq").alias("v"))
    return held.join(first, column).select(F.col("seq").alias("u"), "v").filter("u <> v")


def run_days(keys: DataFrame, days: int = DATE_GUARD_DAYS) -> DataFrame:
    """name, day, run (the first record of the run that the day is in) and records; undated records are one run per name.

    Days are aggregated before the window, so a window partition holds at most one row per
    calendar day.
    """
    per_day = keys.filter(F.col("name").isNotNull()).groupBy("name", "day").agg(
        F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("records")
    )
    by_day = W.partitionBy("name").orderBy("day")
    gap = F.datediff("day", F.lag("day").over(by_day)) > days
    numbered = per_day.withColumn(
        "run_no", F.when(F.col("day").isNull(), -1).otherwise(F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(by_day))
    )
    first = F.min("first_seq").over(W.partitionBy("name", "run_no"))
    return numbered.select("name", "day", first.alias("run"), "records")


def name_runs(days: DataFrame) -> DataFrame:
    """name, run (its first record), span and size of the runs of run_days."""
    return days.groupBy("name", "run").agg(
        F.min("day").alias("run_start"), F.max("day").alias("run_end"), F.sum("records").alias("records")
    )


def run_edges(keys: DataFrame, days: DataFrame) -> DataFrame:
    """Each dated record to the first record of its run."""
    dated = keys.select("seq", "name", "day").filter(F.col("name").isNotNull() & F.col("day").isNotNull())
    return dated.join(days.select("name", "day", "run"), ["name", "day"]).select(F.col("seq").alias("u"), F.col("run").alias("v")).filter("u <> v")


def name_pairs(runs: DataFrame, threshold: float) -> DataFrame:
    """left_name (appearing later), right_name (appearing earlier), score >= threshold."""
    ranked = cut_lineage(runs.groupBy("name").agg(F.min("run").alias("rank")))
    return similar_names_within(ranked, threshold)


def dated_name_pairs(runs: DataFrame, threshold: float = MATCH_SCORE, days: int = DATE_GUARD_DAYS, few: int = FEW_BUCKETS) -> DataFrame:
    """Like name_pairs, for names with runs at most about `days` apart only: the time is part of the join key.

    Runs are spread over buckets of `days` days; a name in the role of the shorter one asks in the buckets beside its own too, so
    runs within `days` of each other meet. A name active in more than `few` buckets would be copied too
    often: such names meet the others by a common key, and their lists of buckets are compared in the join.
    """
    dated = runs.filter(F.col("run_start").isNotNull())
    bucket = lambda c: F.floor(F.unix_date(c) / days).cast("int")
    spread = dated.select("name", "run", F.explode(F.sequence(bucket("run_start"), bucket("run_end"))).alias("b"))
    held = F.array_sort(F.collect_set("b"))
    ranked = spread.groupBy("name").agg(F.min("run").alias("rank"), held.alias("at"))
    # A name's rank counts its undated records too.
    first = runs.groupBy("name").agg(F.min("run").alias("rank"))
    reach = F.array_distinct(F.flatten(F.transform("at", lambda b: F.array(b - 1, b, b + 1))))
    to_long, to_short = F.array(F.lit("long")), F.array(F.lit("short"))
    brief = F.size("at") <= few
    text = lambda c: c.cast("array<string>")
    placed = ranked.drop("rank").join(first, "name").select(
        "name", "rank", "at", reach.alias("reach"),
        F.when(brief, F.concat(text(reach), to_long)).otherwise(F.concat(to_short, to_long)).alias("short_at"),
        F.when(brief, F.concat(text(F.col("at")), to_short)).otherwise(to_long).alias("long_at"),
    )
    return similar_names_within(cut_lineage(placed), threshold)


def _run_lists(runs: DataFrame, side: str) -> DataFrame:
    """Per name its runs in one list; days are counted from 1970, null for undated records.

    A name has at most one run per `DATE_GUARD_DAYS` days of the calendar, however many records it has.
    """
    one = F.struct("run", F.unix_date("run_start").alias("start"), F.unix_date("run_end").alias("end"), "records")
    return runs.groupBy(F.col("name").alias(f"{side}_name")).agg(F.sort_array(F.collect_list(one)).alias(f"{side}_list"))


_SWEPT = "near_left array<long>, near_right array<long>, apart long, left_id long, right_id long"


def _swept(left: pd.Series, right: pd.Series, days: int) -> pd.DataFrame:
    rows = []
    for a, b in zip(left, right, strict=True):
        # Runs of one name do not overlap: in order of their starts, those near a run follow each other.
        dated = [sorted((r["start"], r["end"], r["run"]) for r in side if r["start"] is not None and r["start"] == r["start"]) for side in (a, b)]
        near: list[tuple[int, int]] = []
        lo = 0
        for start, end, run in dated[0]:
            while lo < len(dated[1]) and dated[1][lo][1] < start - days:
                lo += 1
            at = lo
            while at < len(dated[1]) and dated[1][at][0] <= end + days:
                near.append((int(run), int(dated[1][at][2])))
                at += 1
        count: dict[int, set[int]] = {}
        for u, v in near:
            count.setdefault(u, set()).add(v)
        # The first pair of runs too far apart, by the runs of the left name.
        first = next((int(r["run"]) for r in a if len(count.get(r["run"], ())) < len(b)), None)
        other = None if first is None else next(int(r["run"]) for r in b if r["run"] not in count.get(first, ()))
        rows.append(([u for u, _ in near], [v for _, v in near], len(a) * len(b) - len(near), first, other))
    out = pd.DataFrame(rows, columns=["near_left", "near_right", "apart", "left_id", "right_id"])
    return out.astype({"left_id": "Int64", "right_id": "Int64"})


def swept_pairs(runs: DataFrame, pairs: DataFrame, days: int = DATE_GUARD_DAYS) -> DataFrame:
    """Name pairs with the lists of their runs, the run pairs within `days` (near_left, near_right) and the number of the others.

    The two lists are merged in one sweep: a run lies near few runs of the other name, so the result grows
    with the number of runs, not with their product. left_id and right_id are the first run pair too far apart.
    """
    @F.pandas_udf(_SWEPT)
    def sweep(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        return _swept(left, right, days)

    met = pairs.join(_run_lists(runs, "left"), "left_name").join(_run_lists(runs, "right"), "right_name")
    return met.withColumn("s", sweep("left_list", "right_list")).select("left_name", "right_name", "score", "left_list", "right_list", "s.*")


def fuzzy_edges(swept: DataFrame) -> DataFrame:
    """Run pairs of similar names within the date guard, as edges of their first records."""
    near = swept.filter(F.col("score") >= MATCH_SCORE).select(F.explode(F.arrays_zip("near_left", "near_right")).alias("e"))
    return near.select(F.col("e.near_left").alias("u"), F.col("e.near_right").alias("v"))


def _listed(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["run"].cast("string")), ",")


def _counted(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["records"].cast("string")), ",")


def _records(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["records"])


def borderline_pairs(runs: DataFrame, swept: DataFrame) -> DataFrame:
    """One row per pair of names for review: near misses, and similar names with runs too far apart.

    The left name is the one that appeared first; left_id and right_id are the first pair of runs to look at. All pairs
    under review are those of left_ids and right_ids, without near_ids, which are matched already; `pairs` is
    their number, left_counts and right_counts the records of each run. Runs of one and the same name are similar with score 1: its row has the name on both sides,
    and each two of its runs are a pair.
    """
    missed = F.col("score") < MATCH_SCORE
    near = F.array_join(F.zip_with("near_right", "near_left", lambda x, y: F.concat_ws(":", x, y)), ",")
    first = lambda c: F.get(c, F.lit(0))["run"]
    # `swept` has the later name on the left.
    similar = swept.filter(missed | (F.col("apart") > 0)).select(
        F.when(missed, "near_miss_below_threshold").otherwise("fuzzy_name_match_date_guard_failed").alias("reason"), "score",
        F.when(missed, first(F.col("right_list"))).otherwise(F.col("right_id")).alias("left_id"),
        F.when(missed, first(F.col("left_list"))).otherwise(F.col("left_id")).alias("right_id"),
        F.col("right_name").alias("left_name"), F.col("left_name").alias("right_name"),
        _listed(F.col("right_list")).alias("left_ids"), _listed(F.col("left_list")).alias("right_ids"),
        _counted(F.col("right_list")).alias("left_counts"), _counted(F.col("left_list")).alias("right_counts"),
        F.when(missed, "").otherwise(near).alias("near_ids"),
        F.when(missed, F.size("left_list").cast("long") * F.size("right_list")).otherwise(F.col("apart")).alias("pairs"),
        _records(F.col("right_list")).alias("left_records"), _records(F.col("left_list")).alias("right_records"),
    )
    n = F.size("left_list").cast("long")
    same = _run_lists(runs, "left").filter(n > 1).select(
        F.lit("fuzzy_name_match_date_guard_failed").alias("reason"), F.lit(1.0).alias("score"),
        first(F.col("left_list")).alias("left_id"), F.get("left_list", F.lit(1))["run"].alias("right_id"), "left_name", F.col("left_name").alias("right_name"),
        _listed(F.col("left_list")).alias("left_ids"), _listed(F.col("left_list")).alias("right_ids"),
        _counted(F.col("left_list")).alias("left_counts"), _counted(F.col("left_list")).alias("right_counts"), F.lit("").alias("near_ids"),
        F.floor(n * (n - 1) / 2).alias("pairs"), _records(F.col("left_list")).alias("left_records"), _records(F.col("left_list")).alias("right_records"),
    )
    return similar.unionByName(same)


def _entities(records: DataFrame, keys: DataFrame, days: DataFrame, fuzzy: DataFrame) -> DataFrame:
    edges = equal_key_edges(keys, "isin").unionByName(equal_key_edges(keys, "symbol")).unionByName(run_edges(keys, days)).unionByName(fuzzy)
    groups = connected_components(edges).withColumnRenamed("id", "seq")
    return records.join(groups, "seq", "left").withColumn("entity_id", F.coalesce("component", "seq")).drop("component")


def link_entities(records: DataFrame) -> DataFrame:
    """Records with entity_id, the first seq of their listing; names are only compared if their dates allow a match."""
    keys = match_keys(records)
    days = cut_lineage(run_days(keys))
    runs = name_runs(days)
    return _entities(records, keys, days, fuzzy_edges(swept_pairs(runs, dated_name_pairs(runs))))


def resolve_entities(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with entity_id, borderline pairs); without use for the pairs, link_entities does less."""
    keys = match_keys(records)
    days = cut_lineage(run_days(keys))
    runs = name_runs(days)
    swept = cut_lineage(swept_pairs(runs, name_pairs(runs, NEAR_SCORE)))
    return _entities(records, keys, days, fuzzy_edges(swept)), borderline_pairs(runs, swept)
