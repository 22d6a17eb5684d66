"""Page-level jobs: versions, sections, page scores and page windows.

``pages`` frames have doc_id, page (1-based) and text.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import page_hash, squeeze
from ..rows import may_meet, once
from ..rules import pages as R
from ..session import cut_lineage

OVERLAP_SKIP = 0.9  # Fixed value: share of known pages from which a later version is skipped.


def pages_of(docs: DataFrame, text: str = "text", separator: str = "\f") -> DataFrame:
    """Whole texts → one row per page."""
    return docs.select("doc_id", F.posexplode(F.split(text, separator)).alias("pos", "text")).select(
        "doc_id", (F.col("pos") + 1).alias("page"), "text"
    )


def hash_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("page_hash", page_hash(F.col("text")))


def page_overlap(new: DataFrame, old: DataFrame, entity: str = "entity", by: str = "page_hash") -> DataFrame:
    """Per entity: pages of the new version, how many occur in the old one, and the rest.

    Repeated new pages count each time; the old side is reduced to distinct hashes.
    """
    known = old.select(entity, by).distinct().withColumn("_known", F.lit(1))
    # Equal pages of one entity are counted before the join, so copies do not travel.
    counted = new.groupBy(entity, by).agg(F.count(F.lit(1)).alias("_n"))
    return counted.join(known, [entity, by], "left").groupBy(entity).agg(
        F.sum("_n").alias("pages"),
        F.sum(F.when(F.col("_known") == 1, F.col("_n")).otherwise(0)).alias("overlap"),
        F.sum(F.when(F.col("_known").isNull(), F.col("_n")).otherwise(0)).alias("unique_pages"),
    )


def version_skip(overlap: DataFrame, limit: float = OVERLAP_SKIP) -> DataFrame:
    """Adds ratio, skipped and the number of pages to read."""
    ratio = F.when(F.col("pages") > 0, F.col("overlap") / F.col("pages")).otherwise(0.0)
    skipped = (ratio >= limit) & (F.col("pages") > 0)
    return overlap.select(
        "*", ratio.alias("ratio"), skipped.alias("skipped"),
        F.when(skipped, 0).otherwise(F.col("unique_pages")).alias("new_pages"),
    )


def detect_sections(pages: DataFrame, rules: dict[str, str] | None = None, front: int = 0) -> DataFrame:
    """doc_id, section, start, end: first page that matches each rule, after ``front`` pages of cover and contents.

    A section ends before the next larger start, or at the last page. One aggregation.
    """
    rules = rules or R.SECTION_SIGNALS
    body = F.col("page") > front
    starts = pages.groupBy("doc_id").agg(
        F.max("page").alias("last_page"),
        *[F.min(F.when(body & F.col("text").rlike(rule), F.col("page"))).alias(f"_{i}") for i, rule in enumerate(rules.values())],
    )
    found = F.filter(
        F.array(*[F.struct(F.lit(name).alias("section"), F.col(f"_{i}").alias("start")) for i, name in enumerate(rules)]),
        lambda s: s["start"].isNotNull(),
    )
    listed = starts.select("doc_id", "last_page", found.alias("found"))
    rows = listed.select("doc_id", "last_page", "found", F.explode("found").alias("s"))
    later = F.array_min(F.filter(F.transform("found", lambda f: f["start"]), lambda p: p > F.col("s.start")))
    return rows.select(
        "doc_id", "s.section", "s.start", F.coalesce(later - 1, F.col("last_page")).alias("end")
    )


def sliced_pages(numbers: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, section, page: the page numbers in each range, clamped to the document's pages; no texts.

    A range becomes its numbers, as many rows as it will have pages, which an equal key can meet: no
    page is compared with ranges that it is not in.
    """
    last = numbers.groupBy("doc_id").agg(F.max("page").alias("_last"))
    clamped = ranges.join(last, "doc_id").select(
        "doc_id", "section", F.greatest("start", F.lit(1)).cast("long").alias("_start"), F.least("end", "_last").cast("long").alias("_end")
    )
    return clamped.filter("_start <= _end").select("doc_id", "section", F.explode(F.sequence("_start", "_end")).alias("page"))


def slice_sections(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pages of each section. Ranges are clamped to the document; an empty range gives no pages.

    Only pages that some range has enter the join with their texts.
    """
    wanted = sliced_pages(pages.select("doc_id", "page"), ranges)
    kind = pages.schema["page"].dataType
    wanted = cut_lineage(wanted.withColumn("page", F.col("page").cast(kind)))
    return may_meet(pages, wanted, ["doc_id", "page"]).join(wanted, ["doc_id", "page"]).select("doc_id", "section", "page", "text")


def _hits(text: Column, patterns: list[str]) -> Column:
    return reduce(add, [F.when(text.rlike(p), 1).otherwise(0) for p in patterns])


def statement_score(text: Column) -> Column:
    """How much a page looks like a financial summary; 0 without a number."""
    years = F.regexp_count(text, F.lit(R.YEAR_HEADER))
    score = _hits(text, R.STATEMENT_SIGNALS) + F.when(years >= 3, 3).when(years >= 2, 2).otherwise(0)
    return F.when(text.rlike(R.HAS_NUMBER), score).otherwise(0)


def is_contents_page(text: Column) -> Column:
    return text.rlike(r"(?i)table\s+of\s+contents") | (F.regexp_count(text, F.lit(R.DOT_LEADER)) >= 5)


def percent_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(R.PERCENT))


def ratio_rows(text: Column) -> Column:
    return _hits(text, R.RATIO_SIGNALS)


def ratio_score(text: Column) -> Column:
    """How much a page looks like a table of ratios."""
    rows = ratio_rows(text)
    heading = F.when(text.rlike(R.RATIO_HEADING), 3).otherwise(0) + F.when(text.rlike(R.PRICE_HEADING), 1).otherwise(0)
    cover = F.when(text.rlike(R.COVER_WORDS) & (rows < 3), 5).otherwise(0)
    score = F.greatest(F.lit(0), rows * 2 + F.least(F.lit(8), percent_count(text)) + heading - cover)
    return F.when(is_contents_page(text) | ((rows == 0) & (heading == 0)), 0).otherwise(score)


def statement_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("text").rlike(R.STATEMENT_PAGE[0]) & F.col("text").rlike(R.STATEMENT_PAGE[1]))


def ratio_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("text").rlike(R.RATIO_PAGE[0]) & F.contains("text", F.lit(R.RATIO_PAGE[1])))


# A page costs its text plus the marker line put before it.
_MARKER = 20


def _around_best(pages: DataFrame, score: Column, least: int, picked: int | None, reach: int | None) -> DataFrame:
    """The best page (first on ties) and the nearest good pages around it, with ``nearness``.

    Only page numbers, scores and sizes travel, never the texts. The per-document limit is
    applied before the shuffle as well.
    """
    scored = pages.select(
        "doc_id", "page", score.alias("score"),
        (F.length("text") + _MARKER + F.length(F.col("page").cast("string"))).alias("size"),
    )
    best = scored.groupBy("doc_id").agg(F.max_by("page", F.struct("score", -F.col("page"))).alias("best_page"))
    distance = F.abs(F.col("page") - F.col("best_page"))
    near = scored.join(best, "doc_id").withColumn("distance", distance)
    good = (F.col("score") >= least) if reach is None else (F.col("score") >= least) & (F.col("distance") <= reach)
    order = W.partitionBy("doc_id").orderBy("distance", "page")
    ranked = near.filter((F.col("distance") == 0) | good).withColumn("nearness", F.row_number().over(order))
    return ranked if picked is None else ranked.filter(F.col("nearness") <= picked)


def statement_window(pages: DataFrame, window: int | None = None, max_chars: int | None = None) -> DataFrame:
    """doc_id, page, score: the best statement page and all good ones; with ``window``, the so many nearest,
    and with ``max_chars``, in reading order as long as they fit that budget."""
    near = _around_best(pages, statement_score(F.col("text")), 2, window, None)
    if max_chars is None:
        return near.select("doc_id", "page", "score")
    running = F.sum("size").over(W.partitionBy("doc_id").orderBy("page"))
    return near.withColumn("_used", running).filter(F.col("_used") <= max_chars).select("doc_id", "page", "score")


def ratio_window(
    pages: DataFrame, window: int | None = None, max_chars: int | None = None, least_best: int = 4, reach: int | None = None,
) -> DataFrame:
    """doc_id, page, score: the best ratio page and all good ones; with ``window``, the so many nearest, and
    with ``reach``, at most so far away. With ``max_chars`` the best scores are fitted into that budget
    first and a page that does not fit is passed over."""
    near = _around_best(pages, ratio_score(F.col("text")), 3, window, reach)
    if max_chars is None:
        top = near.groupBy("doc_id").agg(F.max("score").alias("top")).filter(F.col("top") >= least_best)
        return near.join(top, "doc_id").select("doc_id", "page", "score")
    entry = F.struct((-F.col("score")).alias("o"), "nearness", "page", "score", "size")
    per_doc = near.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("c"))
    page_type = "array<struct<page:int,score:int>>"
    start = F.struct(F.lit(max_chars).cast("int").alias("left"), F.array().cast(page_type).alias("used"))

    def fit(acc: Column, p: Column) -> Column:
        ok = p["size"] <= acc["left"]
        one = F.array(F.struct(p["page"].cast("int").alias("page"), p["score"].cast("int").alias("score")))
        return F.struct(
            F.when(ok, acc["left"] - p["size"]).otherwise(acc["left"]).cast("int").alias("left"),
            F.when(ok, F.concat(acc["used"], one.cast(page_type))).otherwise(acc["used"]).alias("used"),
        )

    fitted = per_doc.select("doc_id", F.aggregate("c", start, fit)["used"].alias("used"))
    rich = fitted.filter(F.array_max(F.transform("used", lambda u: u["score"])) >= least_best)
    return rich.select("doc_id", F.explode("used").alias("u")).select("doc_id", "u.page", "u.score")


def plain_text(c: Column) -> Column:
    return F.lower(squeeze(c))


def is_grounded(quote: Column, page: Column, lead: int | None = None) -> Column:
    """A quote occurs on its page: wholly, by 70 % of its words, or, with ``lead``, by so many first characters.

    Both sides are plain texts; they are read once per word, so they should be plain columns.
    """
    words = F.filter(F.split(quote, " "), lambda t: F.length(t) > 1)
    hits = F.size(F.filter(words, lambda t: F.contains(page, t)))
    enough = (F.size(words) > 0) & (hits >= F.size(words) * 0.7)
    found = F.contains(page, quote) | enough
    if lead is not None:
        found = found | F.contains(page, F.substring(quote, 1, lead))
    return F.coalesce((F.length(quote) >= 4) & (F.length(page) > 0) & found, F.lit(False))


def ground_facts(facts: DataFrame, pages: DataFrame, lead: int | None = None) -> DataFrame:
    """facts(doc_id, page, quote, …) + grounded. Texts of pages that nothing cites stay where they are."""
    cited = may_meet(pages.select("doc_id", "page", F.col("text").alias("_text")), facts.select("doc_id", "page"), ["doc_id", "page"])
    joined = facts.join(cited, ["doc_id", "page"], "left")
    plain = once(joined, {"_quote": plain_text(F.col("quote")), "_page": plain_text(F.col("_text"))})
    return plain.withColumn("grounded", is_grounded(F.col("_quote"), F.col("_page"), lead)).drop("_text", "_quote", "_page")
