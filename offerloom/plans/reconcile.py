"""End-to-end jobs: feeds to snapshot, and documents to checked facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import facts, parties, quality, tables, timeline
from ..operators.listing import within_date_range
from ..operators.merge import merge_records
from ..operators.resolve import link_entities, resolve_entities
from ..operators.stored import to_stored
from ..operators.upsert import upsert_snapshot
from ..session import cut_lineage
from ..sources.feeds import combine_feeds, drop_listed


def reconcile(feeds: list[DataFrame | None], start: str | None = None, end: str | None = None, year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(merged listings with their timeline, pairs for review) of all feeds that arrived."""
    records = cut_lineage(combine_feeds(*feeds))
    resolved, borderline = resolve_entities(records)
    master = timeline.build_timeline(merge_records(resolved))
    return master.filter(within_date_range(F.col("bidding_start"), start, end, year)), borderline


def scrape_into(snapshot: DataFrame, feeds: list[DataFrame | None], now: Column) -> DataFrame:
    """The next snapshot, with the action taken per row, after one round of feeds."""
    resolved = link_entities(cut_lineage(combine_feeds(*feeds)))
    live = drop_listed(merge_records(resolved))
    return upsert_snapshot(snapshot, to_stored(live, now).withColumnRenamed("entity_id", "seq"), now)


# Issue fields as the checks name them.
ISSUE_FACTS = {
    "totalIssueShares": "total_issue_shares", "freshIssueShares": "fresh_issue_shares", "ofsShares": "ofs_shares",
    "marketMakerShares": "market_maker_shares", "employeeReservationShares": "employee_reservation_shares",
    "netOfferShares": "net_offer_shares", "preIssueShares": "pre_issue_shares", "postIssueShares": "post_issue_shares",
}


def extract_facts(docs: DataFrame) -> dict[str, DataFrame]:
    """docs(doc_id, text, is_sme, company_name, price_min, price_max, face_value, issue_price) → fact tables
    and the validation of each document."""
    metrics = tables.table_metrics(docs)
    ratios = tables.table_ratios(docs)
    issue = facts.with_market_maker(facts.issue_details(docs.select("doc_id", "text", "is_sme", "price_min", "price_max", "face_value", "issue_price")))
    objects = facts.objects_of_issue(docs)
    promoters = facts.promoter_names(docs)
    people = parties.parties_of(docs)
    prices = {"priceMin": "price_min", "priceMax": "price_max", "faceValue": "face_value", "issuePrice": "issue_price"}
    flat = (
        quality.flatten_metrics(metrics, metric="key")
        .unionByName(quality.flatten_metrics(ratios, metric="key"))
        .unionByName(quality.long_facts(issue, {**ISSUE_FACTS, **prices}))
        .unionByName(objects.groupBy("doc_id").agg(F.first("total").alias("value")).select("doc_id", F.lit("objectsTotal").alias("field"), "value").filter("value IS NOT NULL"))
    )
    counts = (
        promoters.select("doc_id", F.size("promoters").alias("promoterCount"))
        .join(people.filter("role = 'lead_manager'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("leadManagerCount")), "doc_id", "full")
        .join(objects.groupBy("doc_id").agg(F.count(F.lit(1)).alias("objectCount")), "doc_id", "full")
    )
    wide = issue.select("doc_id", *[F.col(c).alias(n) for n, c in {**ISSUE_FACTS, **prices}.items()]).join(counts, "doc_id", "left")
    checks = quality.consistency_checks(wide)
    flags = quality.bounds_flags(flat)
    return {
        "metrics": metrics, "ratios": ratios, "issue": issue, "objects": objects, "promoters": promoters, "parties": people,
        "company": parties.company_contacts(docs), "facts": flat, "flags": flags, "checks": checks,
        "validation": quality.validation_score(docs, flags, checks),
    }
