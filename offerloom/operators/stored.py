"""Merged master records → stored documents, and the projections served from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import blank_to_null, first_text, norm_url, parse_date, round2, slugify
from ..functions.doctype import READ_ORDER, classify_with_hint
from ..sources.feeds import FEED_A, FEED_B, FEED_C, FEED_D, SOURCES


class Payload:
    """Field access into the typed payload structs; a field a feed did not send is null."""

    def __init__(self, df: DataFrame):
        self.schema = df.schema

    def get(self, path: str, kind: str = "string") -> Column:
        node = self.schema
        for part in path.split("."):
            if not isinstance(node, StructType) or part not in node.fieldNames():
                return F.lit(None).cast(kind)
            node = node[part].dataType
        return F.col(path)


def issue_type(p: Payload) -> Column:
    def kind(sme: Column) -> Column:
        return F.when(sme, "SME").otherwise("MAINBOARD")

    a = blank_to_null(p.get(f"{FEED_A}.issue_type"))
    c, d = p.get(f"{FEED_C}.d.isSme", "boolean"), p.get(f"{FEED_D}.isSme", "boolean")
    c_text = blank_to_null(p.get(f"{FEED_C}.d.issueType"))
    return (
        F.when(a.isNotNull(), kind(a.rlike("(?i)sme")))
        .when(c.isNotNull(), kind(c))
        .when(d.isNotNull(), kind(d))
        .when(c_text.isNotNull(), kind(c_text.rlike("(?i)sme")))
    )


# Subscription categories and their output names.
SUBSCRIPTION = {"RETAIL": "retail", "QIB": "qualified", "NII": "nii", "TOTAL": "total"}


def subscription(rates: Column) -> Column:
    """array<struct<category, subscriptionRate>> → struct; the last duplicate wins; null if empty."""
    def rate(category: str) -> Column:
        same = F.filter(rates, lambda r: F.upper(r["category"]) == category)
        return round2(F.try_element_at(same, F.lit(-1))["subscriptionRate"])

    values = {name: rate(cat) for cat, name in SUBSCRIPTION.items()}
    some = F.coalesce(*values.values()).isNotNull()
    return F.when(some, F.struct(*[v.alias(k) for k, v in values.items()]))


def document_candidates(p: Payload) -> Column:
    """Every document link of a record in the order in which sources are trusted."""
    slots = [
        ("rhp", p.get("rhp"), "merged"),
        ("drhp", p.get("drhp"), "merged"),
        ("rhp", p.get(f"{FEED_A}.rhp_url"), FEED_A),
        ("drhp", p.get(f"{FEED_A}.drhp_url"), FEED_A),
        ("rhp", p.get(f"{FEED_B}.rhpUrl"), FEED_B),
        ("drhp", p.get(f"{FEED_B}.drhpUrl"), FEED_B),
        ("rhp", p.get(f"{FEED_B}.metaInfo.rhpUrl"), FEED_B),
        ("drhp", p.get(f"{FEED_B}.metaInfo.drhpUrl"), FEED_B),
        (p.get(f"{FEED_C}.docType"), first_text(p.get(f"{FEED_C}.documentUrl"), p.get(f"{FEED_C}.d.documentUrl")), FEED_C),
        (p.get(f"{FEED_D}.docType"), p.get(f"{FEED_D}.prospectusUrl"), FEED_D),
    ]
    rows = [
        F.struct(
            (F.lit(hint) if isinstance(hint, str) else classify_with_hint(hint, url)).alias("doc_type"),
            norm_url(url).alias("url"),
            F.lit(source).alias("source"),
        )
        for hint, url, source in slots
    ]
    return F.filter(F.array(*rows), lambda r: r["url"] != "")


def group_documents(candidates: Column) -> Column:
    """Candidates of one record grouped by link: first type, distinct sources in order."""
    urls = F.array_distinct(F.transform(candidates, lambda r: r["url"]))

    def entry(u: Column) -> Column:
        same = F.filter(candidates, lambda r: r["url"] == u)
        return F.struct(
            F.get(same, F.lit(0))["doc_type"].alias("doc_type"),
            u.alias("url"),
            F.array_distinct(F.transform(same, lambda r: r["source"])).alias("sources"),
        )

    return F.transform(urls, entry)


def collect_documents(records: DataFrame, only_with_documents: bool = True) -> DataFrame:
    """One row per record with its distinct documents; computed inside the row, no shuffle."""
    out = records.withColumn("documents", group_documents(document_candidates(Payload(records))))
    return out.filter(F.size("documents") > 0) if only_with_documents else out


def documents_by_link(candidates: DataFrame) -> DataFrame:
    """Long form: (entity, doc_type, url, source, ord) → one row per entity and link.

    Repeats of a source are folded first, so a hot link gathers at most one row per source.
    """
    c = candidates.withColumn("url", norm_url(F.col("url"))).filter("url <> ''")
    per_source = c.groupBy("entity", "url", "source").agg(
        F.min("ord").alias("ord"), F.min_by("doc_type", "ord").alias("doc_type")
    )
    return per_source.groupBy("entity", "url").agg(
        F.min_by("doc_type", "ord").alias("doc_type"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "source"))), lambda s: s["source"]).alias("sources"),
    )


def documents_map(documents: Column) -> Column:
    """First document per type as map doc_type → struct(url, source)."""
    types = F.array_distinct(F.transform(documents, lambda d: d["doc_type"]))

    def entry(t: Column) -> Column:
        d = F.get(F.filter(documents, lambda x: x["doc_type"] == t), F.lit(0))
        return F.struct(t, F.struct(d["url"].alias("url"), F.get(d["sources"], F.lit(0)).alias("source")))

    return F.map_from_entries(F.transform(types, entry))


def sources_meta(df: DataFrame, now: Column) -> Column:
    """map source → struct(last_fetched, url) for the sources of a record."""
    p = Payload(df)
    entries = [
        F.when(
            F.col(s).isNotNull(),
            F.struct(
                F.lit(s),
                F.struct(now.alias("last_fetched"), first_text(p.get(f"{s}.detailUrl"), p.get(f"{s}.url")).alias("url")),
            ),
        )
        for s in SOURCES
        if s in df.columns
    ]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def to_stored(master: DataFrame, now: Column) -> DataFrame:
    """Stored document of each master record; raw fields fill gaps by source precedence."""
    p = Payload(master)
    a, c = FEED_A, f"{FEED_C}.d"

    def text(*paths: str) -> Column:
        return first_text(*[p.get(x) for x in paths])

    def number(*paths: str) -> Column:
        return F.coalesce(*[p.get(x, "double").cast("double") for x in paths])

    def day(*paths: str) -> Column:
        return F.coalesce(*[parse_date(blank_to_null(p.get(x))) for x in paths])

    lot = F.coalesce(p.get(f"{a}.lot_size", "bigint"), p.get(f"{c}.lotSize", "bigint"))
    minimum = F.when((lot != 0) & (F.col("price_max") != 0), lot * F.col("price_max"))
    rates = p.get(f"{c}.subscriptionRates", "array<struct<category:string,subscriptionRate:double>>")
    payloads = [s for s in SOURCES if s in master.columns]
    return master.select(
        *(["entity_id"] if "entity_id" in master.columns else []),
        slugify(first_text(F.col("company_name"), F.col("symbol"))).alias("slug"),
        blank_to_null(F.col("isin")).alias("isin"),
        blank_to_null(F.col("symbol")).alias("symbol"),
        blank_to_null(F.col("company_name")).alias("company_name"),
        F.concat(blank_to_null(F.col("company_name")), F.lit(" IPO")).alias("display_name"),
        blank_to_null(F.col("status")).alias("status"),
        issue_type(p).alias("issue_type"),
        text(f"{c}.sector", f"{a}.industry").alias("sector"),
        text(f"{a}.industry", f"{c}.sector").alias("industry"),
        number(f"{a}.face_value", f"{c}.faceValue").alias("face_value"),
        "price_min",
        "price_max",
        number(f"{c}.issuePrice", f"{a}.cut_off_price").alias("issue_price"),
        lot.alias("lot_size"),
        minimum.alias("minimum_amount"),
        number(f"{c}.issueSize", f"{a}.issue_size").alias("issue_size"),
        F.coalesce(F.col("bidding_start"), day(f"{c}.startDate", f"{a}.bidding_start_date")).alias("bidding_start"),
        day(f"{c}.endDate", f"{a}.bidding_end_date", f"{a}.timeline.application_end_date").alias("bidding_end"),
        F.coalesce(F.col("listing_date"), day(f"{c}.listingDate", f"{a}.timeline.listing_date")).alias("listing_date"),
        text(f"{c}.lastBidPlaceTime", f"{a}.timeline.application_end_date").alias("cutoff_time"),
        day(f"{c}.allotmentDate", f"{a}.timeline.allotment_date").alias("allotment_date"),
        text(f"{c}.registrar").alias("registrar"),
        subscription(rates).alias("subscription"),
        documents_map(group_documents(document_candidates(p))).alias("documents"),
        sources_meta(master, now).alias("sources"),
        *payloads,
        now.alias("updated_at"),
    )


# Fields of an index card.
CARD = [
    "slug", "company_name", "display_name", "isin", "symbol", "status", "issue_type", "price_min", "price_max",
    "lot_size", "issue_size", "bidding_start", "bidding_end", "listing_date", "gmp", "sector",
]


def to_card(stored: DataFrame) -> DataFrame:
    extra = [c for c in ("documents", "updated_at", "created_at") if c in stored.columns]
    return stored.select(
        *[c for c in CARD if c in stored.columns], F.map_keys("sources").alias("sources"), *extra
    )


def merged_view(stored: DataFrame) -> DataFrame:
    return stored.drop(*SOURCES)


def raw_view(stored: DataFrame) -> DataFrame:
    return stored.select("slug", *[s for s in SOURCES if s in stored.columns])


def pick_document(documents: DataFrame) -> DataFrame:
    """Per listing the document to read: rhp, else final, else drhp, if extracted with text."""
    rank = F.array_position(F.array(*[F.lit(t) for t in READ_ORDER]), F.col("doc_type"))
    ready = (F.col("status") == "extracted") & blank_to_null(F.col("markdown_url")).isNotNull() & (rank > 0)
    return documents.filter(ready).groupBy("slug").agg(F.min_by("doc_type", rank).alias("doc_type"))


def restore_documents(documents: DataFrame, available: DataFrame) -> DataFrame:
    """Mark documents as extracted again where their text exists but the status was lost.

    ``available``: slug, doc_type, markdown_url, pdf_url. Adds ``restored``.
    """
    have = available.select("slug", "doc_type", F.col("markdown_url").alias("_md"), F.col("pdf_url").alias("_pdf"))
    lost = F.col("_md").isNotNull() & (
        ~F.col("status").eqNullSafe("extracted") | blank_to_null(F.col("markdown_url")).isNull()
    )
    return (
        documents.join(have, ["slug", "doc_type"], "full")
        .withColumn("restored", F.coalesce(lost, F.lit(False)))
        .withColumn("status", F.when(F.col("restored"), "extracted").otherwise(F.col("status")))
        .withColumn("markdown_url", F.when(F.col("restored"), F.col("_md")).otherwise(F.col("markdown_url")))
        .withColumn("url", F.when(F.col("restored"), F.coalesce(blank_to_null(F.col("url")), "_pdf")).otherwise(F.col("url")))
        .drop("_md", "_pdf")
    )
