"""Queries served from the stored snapshot: filters, pages, health and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What the caller may sort by, and the sources shown in the health list.
SORT_FIELDS = {
    "listingDate": "listing_date", "name": "company_name", "createdAt": "created_at",
    "biddingStart": "bidding_start", "date": "bidding_start", "latest": "bidding_start",
}
KNOWN_SOURCES = ("nse", "bse", "upstox", "groww", "zerodha", "investorgain")


def within_date_range(day: Column, start: str | None = None, end: str | None = None, year: int | None = None) -> Column:
    """Both bounds, else one bound, else the year, else any date; a null date is outside.

    Years become bounds too, so that the filter reaches the scan.
    """
    if not (start or end) and year:
        start, end = f"{year:04d}-01-01", f"{year:04d}-12-31"
    test = day.isNotNull()
    if start:
        test = test & (day >= F.lit(start).cast("date"))
    if end:
        test = test & (day <= F.lit(end).cast("date"))
    return test


def filter_listings(stored: DataFrame, status: str | None = None, source: str | None = None, document: str | None = None, search: str | None = None) -> DataFrame:
    out = stored
    if status:
        out = out.filter(F.col("status") == status)
    if source:
        out = out.filter(F.map_contains_key("sources", source))
    if document:
        out = out.filter(F.map_contains_key("documents", document))
    if search:
        hit = [F.coalesce(F.col(c).rlike(f"(?i){search}"), F.lit(False)) for c in ("company_name", "symbol", "isin") if c in stored.columns]
        test = hit[0]
        for h in hit[1:]:
            test = test | h
        out = out.filter(test)
    return out


def sort_order(sort: str | None = None, order: str | None = None) -> list[Column]:
    """Missing values sort lowest, as in the stored collection."""
    field = SORT_FIELDS.get(sort or "", "bidding_start")
    main = F.asc_nulls_first(field) if order == "asc" else F.desc_nulls_last(field)
    if field == "company_name":
        return [main, F.asc("slug")]
    return [main, F.desc_nulls_last("updated_at"), F.desc_nulls_last("created_at"), F.asc("slug")]


def page_of(filtered: DataFrame, sort: str | None = None, order: str | None = None, page: int = 1, limit: int = 50) -> DataFrame:
    """One page; Spark runs it as a top-k per task and one small merge."""
    page, limit = max(1, page or 1), max(1, limit or 50)
    return filtered.orderBy(*sort_order(sort, order)).offset((page - 1) * limit).limit(limit)


def page_info(filtered: DataFrame, page: int = 1, limit: int = 50) -> DataFrame:
    page, limit = max(1, page or 1), max(1, limit or 50)
    return filtered.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(page).alias("page"), F.lit(limit).alias("limit"), "total", (F.lit(page * limit) < F.col("total")).alias("has_more")
    )


def source_freshness(stored: DataFrame, known: tuple[str, ...] = KNOWN_SOURCES) -> DataFrame:
    """Entities and last fetch per known source; sources nobody has count 0."""
    seen = stored.select(F.explode("sources").alias("source", "meta")).groupBy("source").agg(
        F.count(F.lit(1)).alias("entities"), F.max("meta.last_fetched").alias("last_fetched")
    )
    names = stored.sparkSession.createDataFrame([(k,) for k in known], "source string")
    return F.broadcast(names).join(seen, "source", "left").select(
        "source", F.coalesce("entities", F.lit(0)).alias("entities"),
        (F.coalesce("entities", F.lit(0)) > 0).alias("healthy"), "last_fetched",
    )


def latest_by_type(rows: DataFrame, type_col: str, at: str) -> DataFrame:
    return rows.groupBy(type_col).agg(F.max_by(F.struct(*[c for c in rows.columns if c != type_col]), at).alias("r")).select(type_col, "r.*")


def newest_per_entity(rows: DataFrame, key: str, order: list[Column], n: int | None = None) -> DataFrame:
    """Rows per entity with their position, newest first; with n, the first n, which Spark limits before the shuffle."""
    ranked = rows.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return (ranked if n is None else ranked.filter(F.col("_rn") <= n)).withColumnRenamed("_rn", "position")


def last_errors(errors: DataFrame, key: str = "slug", at: str = "at", tie: str | None = None, n: int | None = None) -> DataFrame:
    """Errors per entity, newest first; with n, the last n."""
    return newest_per_entity(errors, key, [F.desc(at), *([F.desc(tie)] if tie else [])], n)


def premium_history(points: DataFrame, key: str = "slug", n: int | None = None) -> DataFrame:
    """Premium points per listing, newest first; with n, the last n."""
    return newest_per_entity(points, key, [F.desc("date")], n)


def pending_documents(stored: DataFrame) -> DataFrame:
    """Not listed, first document link is a PDF, and neither objects nor financials are known."""
    urls = [F.nullif(F.try_element_at("documents", F.lit(t))["url"], F.lit("")) for t in ("rhp", "drhp", "final")]
    link = F.coalesce(*urls)
    return stored.filter(
        ~F.col("status").eqNullSafe("listed")
        & F.coalesce(link.rlike(r"(?i)\.pdf($|\?)"), F.lit(False))
        & F.col("objects").isNull()
        & F.col("financials").isNull()
    )


def coverage_report(stored: DataFrame) -> DataFrame:
    """How many documents were processed and what was found in them.

    Columns: doc_status, has_financials, kpi_count, object_count, issue_confidence, lead_managers.
    """
    failed = F.col("doc_status").eqNullSafe("error")
    something = F.col("has_financials") | (F.col("object_count") > 0) | F.col("issue_confidence").isNotNull()
    ok = ~failed & F.coalesce(something, F.lit(False))

    def count(test: Column) -> Column:
        return F.count_if(ok & F.coalesce(test, F.lit(False)))

    return stored.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("ok"),
        F.count_if(failed).alias("download_failed"),
        F.count_if(~failed & ~F.coalesce(something, F.lit(False))).alias("nothing_found"),
        count(F.col("has_financials")).alias("financials"),
        count(F.col("kpi_count") > 0).alias("kpis"),
        count(F.col("object_count") > 0).alias("objects"),
        count(F.col("lead_managers") > 0).alias("lead_managers"),
        count(F.col("issue_confidence") == "high").alias("issue_high"),
        count(F.col("issue_confidence") == "needs_review").alias("issue_review"),
    )


def confidence_distribution(facts: DataFrame, column: str = "confidence") -> DataFrame:
    return facts.groupBy(column).agg(F.count(F.lit(1)).alias("documents"))


def health(stored: DataFrame) -> DataFrame:
    return stored.agg(F.count(F.lit(1)).alias("listings"))


def retry_selection(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("status") == "error")
