"""Snapshot upsert with field-level change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructType

from ..functions import blank_to_null, first_text, slugify
from ..rows import first_by, last_by
from ..session import cut_lineage
from .components import connected_components
from .matching import find_existing

# Fields whose change is reported. A price band is two columns here.
WATCHED = {
    "status": ["status"], "priceBand": ["price_min", "price_max"], "lotSize": ["lot_size"],
    "issueSize": ["issue_size"], "listingDate": ["listing_date"], "biddingStart": ["bidding_start"],
    "biddingEnd": ["bidding_end"], "issuePrice": ["issue_price"], "documents": ["documents"],
    "subscription": ["subscription"],
}
CHANGES = ("new", "updated", "unchanged", "untouched")


def _present(df: DataFrame, name: str, prefix: str = "") -> Column:
    """Column value with '' as null."""
    col = F.col(prefix + name)
    return blank_to_null(col) if isinstance(df.schema[name].dataType, StringType) else col


def comparable(df: DataFrame, name: str, col: Column) -> Column:
    """Maps cannot be compared; their sorted entries can."""
    return F.array_sort(F.map_entries(col)) if isinstance(df.schema[name].dataType, MapType) else col


def merge_maps(df: DataFrame, name: str, current: Column, incoming: Column) -> Column:
    """Per key the incoming struct fields where given, else the current ones."""
    kind = df.schema[name].dataType
    assert isinstance(kind, MapType)
    empty = F.create_map().cast(kind)
    value = kind.valueType

    def both(_: Column, a: Column, b: Column) -> Column:
        if not isinstance(value, StructType):
            return F.coalesce(b, a)
        fields = []
        for f in value.fields:
            new = b[f.name]
            new = blank_to_null(new) if isinstance(f.dataType, StringType) else new
            fields.append(F.coalesce(new, a[f.name]).alias(f.name))
        return F.struct(*fields)

    return F.map_zip_with(F.coalesce(current, empty), F.coalesce(incoming, empty), both)


def changed_fields(df: DataFrame, before: str, after: str, watched: dict[str, list[str]] | None = None) -> Column:
    """Names of watched fields that differ between two prefixed copies, null-safe."""
    tests = []
    for name, cols in (watched or WATCHED).items():
        cols = [c for c in cols if c in df.columns]
        if not cols:
            continue
        differ = F.lit(False)
        for c in cols:
            a, b = comparable(df, c, F.col(before + c)), comparable(df, c, F.col(after + c))
            differ = differ | ~a.eqNullSafe(b)
        tests.append(F.when(differ, F.lit(name)))
    return F.array_compact(F.array(*tests))


def unique_slugs(df: DataFrame, taken: DataFrame | None = None, order: str = "seq") -> DataFrame:
    """Adds ``slug``; a later row of the same slug, or a slug in use, gets a symbol or isin suffix."""
    label = first_text(F.col("company_name"), F.col("symbol"))
    based = df.withColumn("_base", slugify(label))
    first = based.groupBy("_base").agg(F.min(order).alias("_first"))
    out = based.join(first, "_base")
    clash = F.col(order) != F.col("_first")
    if taken is not None:
        used = taken.select(F.col("slug").alias("_base")).distinct().withColumn("_used", F.lit(True))
        out = out.join(used, "_base", "left")
        clash = clash | F.coalesce("_used", F.lit(False))
    suffix = first_text(F.col("symbol"), F.right(F.coalesce("isin", F.lit("")), F.lit(4)))
    return out.withColumn("slug", F.when(clash, slugify(label, suffix)).otherwise(F.col("_base"))).select(
        *[c for c in df.columns if c != "slug"], "slug"
    )


def _shared_groups(rows: DataFrame) -> DataFrame:
    """(seq, kind, value) of records and their keys -> (seq, group): records that keys connect, group = least seq.

    A key that one record has connects nothing. Where no record of a key has another shared key, the key's
    records are a group at once; only the rest goes through the component steps. Records without a
    shared key do not appear.
    """
    keys = rows.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first")).filter("n > 1")
    held = cut_lineage(rows.join(keys.drop("n"), ["kind", "value"]))
    several = held.groupBy("seq").agg(F.count(F.lit(1)).alias("keys"), F.max("first").alias("first")).withColumn("loose", F.col("keys") > 1)
    tangled = held.join(several.filter("loose").select("seq"), "seq").select("kind", "value").distinct().withColumn("tangled", F.lit(True))
    marked = cut_lineage(held.join(tangled, ["kind", "value"], "left"))
    plain = marked.filter("tangled IS NULL").select("seq", F.col("first").alias("group"))
    edges = marked.filter("tangled").select(F.col("seq").alias("u"), F.col("first").alias("v"))
    return plain.unionByName(connected_components(edges).select(F.col("id").alias("seq"), F.col("component").alias("group")))


def target_slugs(incoming: DataFrame, current: DataFrame, order: str) -> DataFrame:
    """order + slug: the row that each record is written to.

    A record goes to the stored row that it matches by itself. Others follow the records of the same
    batch that share an isin, a symbol or a name's slug with them, or with another such record, as if these were stored
    before: to the stored row of the first of them that matches one, else all to one new row. Only records
    without a stored match are grouped, and only narrow rows are moved for it.
    """
    narrow = incoming.select(F.col(order).alias("seq"), "isin", "symbol", "company_name")
    named = blank_to_null(F.col("company_name")).isNotNull()
    label = first_text(F.col("company_name"), F.col("symbol"))
    found = cut_lineage(find_existing(narrow, current.select("slug", "isin", "symbol")).select(
        "seq", "existing_slug", blank_to_null(F.col("isin")).alias("isin"), blank_to_null(F.col("symbol")).alias("symbol"),
        named.alias("named"), label.alias("label"), slugify(label).alias("base"),
    ))
    stored = found.filter(F.col("existing_slug").isNotNull())
    fresh = found.filter(F.col("existing_slug").isNull())

    def keys(rows: DataFrame, *more: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("isin", F.col("isin")), ("symbol", F.col("symbol")), ("name", F.when(F.col("named"), F.col("base"))))])
        return rows.select("seq", *more, F.explode(pairs).alias("k")).select("seq", *more, "k.kind", "k.value").filter("value IS NOT NULL")

    own_keys = cut_lineage(keys(fresh))
    # The first stored match among the records with which a fresh one shares a key.
    asked = own_keys.select("kind", "value").distinct()
    led = keys(stored, "existing_slug").groupBy("kind", "value").agg(F.min(F.struct("seq", "existing_slug")).alias("lead")).join(asked, ["kind", "value"], "left_semi")
    led = own_keys.join(led, ["kind", "value"]).groupBy("seq").agg(F.min("lead").alias("lead"))
    # Only rows without a company name can meet a slug that belongs to someone else.
    nameless = fresh.filter(~F.col("named")).select("base").distinct()
    owned = current.select(F.col("slug").alias("base")).unionByName(fresh.filter("named").select("base")).join(nameless, "base", "left_semi").distinct().withColumn("owned", F.lit(True))
    suffix = first_text(F.col("symbol"), F.right(F.coalesce("isin", F.lit("")), F.lit(4)))
    own = F.when(~F.col("named") & F.coalesce("owned", F.lit(False)), slugify(F.col("label"), suffix)).otherwise(F.col("base"))
    marked = fresh.join(owned, "base", "left").withColumn("own", own).join(led, "seq", "left")
    grouped = marked.join(_shared_groups(own_keys), "seq", "left").withColumn("group", F.coalesce("group", "seq")).select("seq", "group", "own", "lead")
    targets = grouped.groupBy("group").agg(F.min("lead").alias("lead"), first_by(F.col("own"), F.col("seq")).alias("new"))
    chosen = grouped.join(targets.select("group", F.coalesce("lead.existing_slug", "new").alias("slug")), "group").select("seq", "slug")
    return stored.select("seq", F.col("existing_slug").alias("slug")).unionByName(chosen).withColumnRenamed("seq", order)


def _folded(df: DataFrame, order: str) -> DataFrame:
    """One row per slug: the last given value of every column."""
    cols = [c for c in df.columns if c not in ("slug", order)]
    return df.groupBy("slug").agg(*[last_by(_present(df, c), F.col(order)).alias(c) for c in cols])


def upsert_snapshot(current: DataFrame, incoming: DataFrame, now: Column, order: str = "seq", targets: DataFrame | None = None) -> DataFrame:
    """The next snapshot with ``action`` and ``changes`` per row.

    ``targets`` are the rows of target_slugs, where they are known; then ``current`` needs no rows but theirs.

    ``current`` has slug, created_at and updated_at; ``incoming`` has an ordinal ``order``.
    Given incoming values win, missing ones keep the current value. created_at and gmp stay;
    sources are always refreshed; updated_at moves only when a watched field changed.
    """
    slugs = target_slugs(incoming, current, order) if targets is None else targets
    rows = _folded(incoming.drop("slug").join(slugs, order), order)
    kept = {"slug", "created_at", "updated_at", "action", "changes"}
    cols = [c for c in current.columns if c not in kept]
    extra = [c for c in rows.columns if c not in kept and c not in cols]
    cur = current.select("slug", *[F.col(c).alias(f"c_{c}") for c in [*cols, "created_at", "updated_at"]])
    inc = rows.select("slug", F.lit(True).alias("_in"), *[F.col(c).alias(f"i_{c}") for c in [*cols, *extra] if c in rows.columns])
    joined = cur.withColumn("_cur", F.lit(True)).join(inc, "slug", "full")

    def next_value(c: str) -> Column:
        if c in extra:
            return F.col(f"i_{c}")
        if c not in rows.columns:
            return F.col(f"c_{c}")
        if c == "gmp":
            return F.coalesce("c_gmp", "i_gmp")
        if isinstance(current.schema[c].dataType, MapType):
            merged = merge_maps(current, c, F.col(f"c_{c}"), F.col(f"i_{c}"))
            return F.when(F.coalesce(f"c_{c}", f"i_{c}").isNotNull(), merged)
        return F.coalesce(F.col(f"i_{c}"), F.col(f"c_{c}"))

    merged = joined.select(
        "slug", "_in", "_cur", "c_created_at", "c_updated_at",
        *[F.col(f"c_{c}") for c in cols],
        *[next_value(c).alias(f"n_{c}") for c in [*cols, *extra]],
    )
    watched = {k: [c for c in v if c in cols] for k, v in WATCHED.items()}
    changes = changed_fields(current, "c_", "n_", watched)
    none = F.array().cast("array<string>")
    action = (
        F.when(F.col("_cur").isNull(), "new")
        .when(F.col("_in").isNull(), "untouched")
        .when(F.size(changes) > 0, "updated")
        .otherwise("unchanged")
    )
    merged = merged.withColumn("action", action).withColumn(
        "changes", F.when(F.col("action") == "updated", changes).otherwise(none)
    )

    def written(c: str) -> Column:
        # An unchanged row keeps its stored values; only its sources move.
        if c in extra or c == "sources":
            return F.col(f"n_{c}").alias(c)
        return F.when(F.col("action") == "unchanged", F.col(f"c_{c}")).otherwise(F.col(f"n_{c}")).alias(c)

    touched = F.col("action").isin("new", "updated")
    return merged.select(
        "slug",
        *[written(c) for c in [*cols, *extra]],
        F.coalesce("c_created_at", now).alias("created_at"),
        F.when(touched, now).otherwise(F.col("c_updated_at")).alias("updated_at"),
        "action",
        "changes",
    )


def upsert_tally(actions: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Rows per action, and the number of records that could not be stored; always one row for each."""
    totals = actions.agg(*[F.count_if(F.col("action") == a).alias(a) for a in CHANGES[:3]])
    counted = totals.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("action"), F.col(a).alias("rows")) for a in CHANGES[:3]
    ])).alias("t")).select("t.*")
    errors = failed.agg(F.count(F.lit(1)).alias("rows")) if failed is not None else actions.sparkSession.range(1).select(F.lit(0).cast("long").alias("rows"))
    return counted.unionByName(errors.select(F.lit("errors").alias("action"), "rows"))


def merge_documents(current: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("slug", "doc_type")) -> DataFrame:
    """Long form of the document merge: given incoming fields win, processing fields survive."""
    cols = [c for c in current.columns if c not in keys]
    inc_cols = [c for c in incoming.columns if c not in keys]
    c = current.select(*keys, *[F.col(x).alias(f"c_{x}") for x in cols])
    i = incoming.select(*keys, *[F.col(x).alias(f"i_{x}") for x in inc_cols])
    out = c.join(i, list(keys), "full")
    merged = []
    for x in cols:
        given = F.lit(None)
        if x in inc_cols:
            given = blank_to_null(F.col(f"i_{x}")) if isinstance(incoming.schema[x].dataType, StringType) else F.col(f"i_{x}")
        merged.append(F.coalesce(given, F.col(f"c_{x}")).alias(x))
    return out.select(*keys, *merged, *[F.col(f"i_{x}").alias(x) for x in inc_cols if x not in cols])
