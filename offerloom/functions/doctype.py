"""Which prospectus is this: draft, red herring or final? Names and cover text decide."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import rx

# Document types in the order in which they are preferred for reading.
READ_ORDER = ("rhp", "final", "drhp")


def _verdict(doc_type: str | None, confidence: float, method: str) -> Column:
    return F.struct(
        F.lit(doc_type).cast("string").alias("doc_type"),
        F.lit(confidence).alias("confidence"),
        F.lit(method).alias("method"),
    )


def classify_by_name(url: Column) -> Column:
    raw = F.coalesce(url, F.lit(""))
    # A plus sign is a plus sign in a path; only %xx is decoded.
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(raw, r"\+", "%2B")), raw)
    s = F.regexp_replace(F.lower(decoded), r"[._\-/+%]+", " ")
    draft = s.contains("drhp") | s.rlike(r"draft\s+red\s*herring")
    filing = s.rlike(r"sebi\s+gov\s+in\s+filings") | F.lower(raw).contains("sebi.gov.in/filings")
    return (
        F.when(draft, _verdict("drhp", 0.9, "filename"))
        .when(filing, _verdict("drhp", 0.8, "filename"))
        .when(s.contains("rhp") | s.rlike(r"red\s*herring"), _verdict("rhp", 0.88, "filename"))
        .when(s.rlike(rx(r"\bfinal\b")), _verdict("final", 0.8, "filename"))
        .otherwise(_verdict(None, 0.0, "filename"))
    )


def classify_by_cover(text: Column, top: int | None = None) -> Column:
    """Null when the first page (with ``top``, its first so many characters) names no type."""
    head = F.regexp_replace(F.upper(text), r"\s+", " ")
    head = head if top is None else F.substring(head, 1, top)
    return (
        F.when(head.rlike("DRAFT RED HERRING PROSPECTUS"), _verdict("drhp", 0.99, "cover"))
        .when(head.rlike("RED HERRING PROSPECTUS"), _verdict("rhp", 0.98, "cover"))
        .when(head.rlike(rx(r"\bPROSPECTUS\b")), _verdict("final", 0.8, "cover"))
    )


def classify_document(url: Column, cover: Column | None = None) -> Column:
    """Cover text first, then the name, then a draft by default."""
    by_name = classify_by_name(url)
    named = F.when(by_name["doc_type"].isNotNull(), by_name)
    parts = [named, _verdict("drhp", 0.3, "default")]
    return F.coalesce(*([classify_by_cover(cover)] if cover is not None else []), *parts)


def classify_with_hint(hint: Column, url: Column) -> Column:
    """A source's own type when it is a known one, else the name, else draft."""
    known = F.when(hint.isin(*READ_ORDER), hint)
    return F.coalesce(known, classify_by_name(url)["doc_type"], F.lit("drhp"))


def admission(filename: Column, pages: Column, head: Column, least_pages: int = 3, whole_pages: int = 20) -> Column:
    """Why a file is (not) taken as a prospectus; 0 pages means the count is unknown.

    A prospectus has ``least_pages`` at least, and below ``whole_pages`` it must not call itself abridged.
    """
    name = F.lower(F.coalesce(filename, F.lit("")))
    abridged = F.lower(F.coalesce(head, F.lit(""))).contains("abridged")
    # Words of files that accompany a prospectus.
    side_papers = "corrigendum|addendum|notice|erratum|clarification"
    return (
        F.when(name.rlike(side_papers), "not_a_prospectus")
        .when(name.contains("abridged"), "abridged_detected")
        .when((pages > 0) & (pages < least_pages), F.when(abridged, "abridged_detected").otherwise("not_a_prospectus"))
        .when((pages < whole_pages) & abridged, "abridged_detected")
        .otherwise("success")
    )


# Short section names and their canonical forms.
SECTION_NAMES = {
    "financials": "financials",
    "risk-factors": "riskFactors",
    "objects-of-issue": "objectsOfIssue",
    "capital-structure": "capitalStructure",
    "management": "management",
    "kpis": "basisForOfferPrice",
}


def canonical_section(short: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SECTION_NAMES.items() for x in kv])[short], short)


def short_section(canonical: Column) -> Column:
    pairs = [F.lit(x) for k, v in SECTION_NAMES.items() for x in (v, k)]
    return F.coalesce(F.create_map(*pairs)[canonical], canonical)
