"""Stored documents, upsert, timeline, series and listing queries."""

import datetime as dt

from pyspark.sql import functions as F

from offerloom.operators import listing, series, stored, timeline, upsert
from offerloom.operators.merge import merge_records
from offerloom.sources import feeds
from offerloom.sources.series import map_candles, map_premium_history, map_premium_list, prefer_first
from tests.test_resolve import payloads

D = dt.date
NOW = lambda: F.lit("2026-06-07 00:00:00").cast("timestamp")


def master(spark):
    a = feeds.map_feed_a(payloads(spark, feeds.FEED_A_SCHEMA, [
        {"name": "Hexagon Nutrition Limited", "symbol": "HEX", "isin": "INE1", "issue_type": "REGULAR", "lot_size": 333, "minimum_price": 42, "maximum_price": 45,
         "rhp_url": "http://x/rhp.pdf/", "industry": "Food", "face_value": 1, "bidding_start_date": "2026-06-05",
         "timeline": {"application_start_date": "2026-06-05", "application_end_date": "2026-06-09", "allotment_date": "2026-06-10", "listing_date": "2026-06-12"}}]))
    lists = payloads(spark, feeds.FEED_C_LIST_SCHEMA, [{"searchId": "h", "symbol": "HEX", "bucket": "open"}], "seq bigint, bucket string")
    det = payloads(spark, feeds.FEED_C_DETAIL_SCHEMA, [
        {"searchId": "h", "sector": "FMCG", "issueSize": 100.5, "registrar": "Kfin", "documentUrl": "http://x/rhp.pdf", "status": "ACTIVE",
         "subscriptionRates": [{"category": "RETAIL", "subscriptionRate": 1.0}, {"category": "RETAIL", "subscriptionRate": 25.012}, {"category": "QIB", "subscriptionRate": 19.77},
                               {"category": "NII", "subscriptionRate": 160.35}, {"category": "TOTAL", "subscriptionRate": 52.52}]}]).drop("seq")
    c = feeds.map_feed_c(lists, det)
    records = feeds.combine_feeds(a, None, c).withColumn("entity_id", F.lit(0).cast("bigint"))
    return merge_records(records)


def test_to_stored(spark):
    doc = stored.to_stored(master(spark), NOW())
    r = doc.first()
    assert (r.slug, r.display_name, r.issue_type, r.lot_size, r.minimum_amount) == ("hexagon-nutrition-ipo", "Hexagon Nutrition Limited IPO", "MAINBOARD", 333, 333 * 45)
    assert (r.sector, r.industry, r.registrar, r.issue_size, r.listing_date, r.bidding_end) == ("FMCG", "Food", "Kfin", 100.5, D(2026, 6, 12), D(2026, 6, 9))
    s = r.subscription
    assert (s.retail, s.qualified, s.nii, s.total) == (25.01, 19.77, 160.35, 52.52)
    assert r.documents["rhp"].url == "http://x/rhp.pdf" and r.documents["rhp"].source == "merged" and set(r.sources) == {"upstox", "groww"}
    card = listing  # noqa: F841
    c = stored.to_card(doc).first()
    assert sorted(c.sources) == ["groww", "upstox"]
    assert "upstox" not in stored.merged_view(doc).columns and stored.raw_view(doc).first().upstox.symbol == "HEX"


def test_collect_documents(spark):
    docs = stored.collect_documents(master(spark)).first().documents
    assert [(d.doc_type, d.url, d.sources) for d in docs] == [("rhp", "http://x/rhp.pdf", ["merged", "upstox", "groww"])]
    cands = spark.createDataFrame([(1, "rhp", "u/", "merged", 0), (1, "drhp", "u", "nse", 1), (1, "drhp", "v", "nse", 2), (1, "drhp", " ", "z", 3)],
                                  "entity bigint, doc_type string, url string, source string, ord int")
    got = {r.url: (r.doc_type, r.sources) for r in stored.documents_by_link(cands).collect()}
    assert got == {"u": ("rhp", ["merged", "nse"]), "v": ("drhp", ["nse"])}


def test_documents_state(spark):
    docs = spark.createDataFrame([("a", "rhp", "error", None, "u1"), ("a", "drhp", "extracted", "m", "u2"), ("b", "rhp", "extracted", "m2", "u3"), ("b", "drhp", "extracted", "m3", "u4")],
                                 "slug string, doc_type string, status string, markdown_url string, url string")
    assert {(r.slug, r.doc_type) for r in stored.pick_document(docs).collect()} == {("a", "drhp"), ("b", "rhp")}
    have = spark.createDataFrame([("a", "rhp", "md", "pdf"), ("b", "rhp", "md", "pdf"), ("c", "final", "md9", "pdf9")], "slug string, doc_type string, markdown_url string, pdf_url string")
    got = {(r.slug, r.doc_type): r for r in stored.restore_documents(docs, have).collect()}
    assert got[("a", "rhp")].restored and got[("a", "rhp")].status == "extracted" and got[("a", "rhp")].url == "u1"
    assert not got[("b", "rhp")].restored and got[("c", "final")].url == "pdf9"
    assert [r.doc_type for r in listing.retry_selection(docs).collect()] == ["rhp"]


SNAP = ("slug string, isin string, symbol string, company_name string, status string, price_min double, price_max double, gmp double, "
        "documents map<string,struct<url:string,source:string,status:string>>, sources map<string,struct<last_fetched:timestamp,url:string>>, created_at timestamp, updated_at timestamp")
T0 = dt.datetime(2026, 1, 1)
T1 = dt.datetime(2026, 6, 7)


def test_upsert(spark):
    cur = spark.createDataFrame([
        ("a-ipo", "I1", "A", "A", "open", 1.0, 2.0, 5.0, {"rhp": ("u", "nse", "extracted")}, {"nse": (T0, None)}, T0, T0),
        ("b-ipo", "I2", "B", "B", "open", 1.0, 2.0, None, None, {"nse": (T0, None)}, T0, T0),
        ("c-ipo", "I3", "C", "C", "open", 1.0, 2.0, None, None, None, T0, T0),
        ("x-ipo", None, None, "X", "open", None, None, None, None, None, T0, T0)], SNAP)
    inc = spark.createDataFrame([
        (1, "I1", "A", "A", "closed", None, None, 9.0, {"rhp": ("u2", "nse", None), "drhp": ("d", "nse", None)}, {"upstox": (T1, None)}),
        (2, None, "B", "Bee", "", 1.0, 2.0, None, None, {"nse": (T1, None)}),
        (3, None, None, "New Co", "open", 3.0, 4.0, None, None, None),
        (4, None, None, "New Co", None, 5.0, None, None, None, None),
        (5, None, "X", None, "open", None, None, None, None, None)],
        "seq bigint, isin string, symbol string, company_name string, status string, price_min double, price_max double, gmp double, "
        "documents map<string,struct<url:string,source:string,status:string>>, sources map<string,struct<last_fetched:timestamp,url:string>>")
    out = upsert.upsert_snapshot(cur, inc, NOW())
    r = {x.slug: x for x in out.collect()}
    assert {k: v.action for k, v in r.items()} == {"a-ipo": "updated", "b-ipo": "unchanged", "c-ipo": "untouched", "x-ipo": "untouched", "new-co-ipo": "new", "x-ipo-x": "new"}
    a = r["a-ipo"]
    assert (a.status, a.price_min, a.gmp, sorted(a.changes)) == ("closed", 1.0, 5.0, ["documents", "status"])
    assert a.documents["rhp"].asDict() == {"url": "u2", "source": "nse", "status": "extracted"} and a.documents["drhp"].url == "d"
    assert set(a.sources) == {"nse", "upstox"} and a.updated_at == T1 and a.created_at == T0
    b = r["b-ipo"]
    assert (b.updated_at, b.changes, b.company_name, b.sources["nse"].last_fetched) == (T0, [], "B", T1)
    n = r["new-co-ipo"]
    assert (n.price_min, n.price_max, n.created_at) == (5.0, 4.0, T1)
    assert {x.action: x.rows for x in upsert.upsert_tally(out, inc.limit(2)).collect()} == {"new": 2, "updated": 1, "unchanged": 1, "errors": 2}


def test_unique_slugs_and_documents(spark):
    df = spark.createDataFrame([(1, "Acme", "AC", None), (2, "Acme Ltd", "NSE-123", None), (3, "Used", None, "INE00099")], "seq bigint, company_name string, symbol string, isin string")
    taken = spark.createDataFrame([("used-ipo",)], "slug string")
    assert {r.seq: r.slug for r in upsert.unique_slugs(df, taken).collect()} == {1: "acme-ipo", 2: "acme-ipo-nse123", 3: "used-ipo-0099"}
    cur = spark.createDataFrame([("a", "rhp", "u", "nse", "extracted")], "slug string, doc_type string, url string, source string, status string")
    inc = spark.createDataFrame([("a", "rhp", "u2", ""), ("a", "drhp", "d", "nse")], "slug string, doc_type string, url string, source string")
    got = {r.doc_type: (r.url, r.source, r.status) for r in upsert.merge_documents(cur, inc).collect()}
    assert got == {"rhp": ("u2", "nse", "extracted"), "drhp": ("d", "nse", None)}


def test_timeline(spark):
    t = timeline.build_timeline(master(spark))
    r = t.first()
    assert (r.open, r.close, r.allotment, r.listing, r.rhp_available, r.drhp_available) == (D(2026, 6, 5), D(2026, 6, 9), D(2026, 6, 10), D(2026, 6, 12), D(2026, 6, 5), None)
    ev = timeline.status_events(t)
    assert {(e.status, e.source) for e in ev.collect()} == {("rhp_available", "inferred"), ("open", "upstox"), ("close", "upstox"), ("allotment", "upstox"), ("listing", "upstox")}
    old = spark.createDataFrame([(0, "open", D(2026, 6, 5), "nse", T0)], "entity_id bigint, status string, date date, source string, detected_at timestamp")
    hist = timeline.append_status_history(old, ev, NOW())
    again = timeline.append_status_history(hist, ev, NOW())
    assert hist.count() == 5 and again.count() == 5
    order = [e.status for e in timeline.history_in_order(hist).first().history]
    assert order == ["open", "rhp_available", "close", "allotment", "listing"]


def test_series(spark):
    arr = spark.createDataFrame([("I", [["2026-06-14T00:00:00+05:30", "60", "62", "59", "61", "10", None], ["2026-06-12T00:00:00+05:30", "48", "52", "46", "50", "5", "1"], ["2026-06-13T00", None, None, None, "55", None, None]])],
                                "isin string, candles array<array<string>>")
    candles = map_candles(arr)
    m = series.listing_metrics(candles, spark.createDataFrame([("I", 45.0)], "isin string, issue_price double")).first()
    assert (m.listing_price, m.day_high, m.day_low, m.current_price, m.opening_gain, m.as_of) == (48, 52, 46, 61, 6.67, D(2026, 6, 14))
    new = candles.filter("date = '2026-06-13'").withColumn("close", F.lit(99.0))
    merged = {r.date: r.close for r in series.merge_price_history(candles, new).collect()}
    assert merged == {D(2026, 6, 12): 50, D(2026, 6, 13): 99, D(2026, 6, 14): 61}
    assert prefer_first(candles, candles.withColumn("isin", F.lit("J"))).count() == 6 and prefer_first(candles, candles).count() == 3


def test_premium(spark):
    lst = spark.createDataFrame([("Hexagon", "/gmp/hex/2199/", None, "8.5x", "45", "abc", "SME", "O"), (None, None, "/gmp/y/7", "x", "0", "0", None, None)],
                                "company_short_name string, gmp_href string, href string, gmp string, ipo_price string, gmp_perc string, ipo_category string, ipo_status string")
    a, b = map_premium_list(lst).collect()
    assert (a.id, a.premium, a.price, a.percent, b.id, b.premium, b.price) == (2199, 8.5, 45, None, 7, 0, None)
    hist = map_premium_history(spark.createDataFrame([(2199, "09-06-2026", "8"), (2199, "bad", "9")], "id bigint, gmp_date string, gmp string"))
    matches = spark.createDataFrame([("h", 2199, 8.5), ("solo", 5, 3.0), ("zero", 6, 0.0)], "slug string, id bigint, premium double")
    pts = series.premium_points(matches, hist, F.lit("2026-06-20").cast("date"))
    assert {(r.slug, r.date, r.value) for r in pts.collect()} == {("h", D(2026, 6, 9), 8.0), ("solo", D(2026, 6, 20), 3.0)}
    old = spark.createDataFrame([("h", D(2026, 6, 9), 1.0)], "slug string, date date, value double")
    got = {(r.slug, r.value, r.is_new) for r in series.upsert_premium_history(old, pts).collect()}
    assert got == {("h", 8.0, False), ("solo", 3.0, True)}
    li = spark.createDataFrame([("a", "open"), ("b", "closed"), ("c", None)], "slug string, status string")
    assert series.premium_targets(li).count() == 1
    slugs = spark.createDataFrame([("a",), ("b",), ("b",)], "slug string")
    assert {(r.slug, r.skip_reason) for r in series.premium_targets(li, slugs=slugs).collect()} == {("a", None), ("b", "status closed — no live GMP")}
    pct = spark.range(1).select(series.premium_percentage(F.lit(None).cast("double"), F.lit(8.0), F.lit(45.0)).alias("p"), series.premium_percentage(F.lit(None).cast("double"), F.lit(8.0), F.lit(0.0)).alias("q")).first()
    assert (pct.p, pct.q) == (17.78, None)


def test_listing(spark):
    df = spark.createDataFrame([
        ("a", "Alpha", "AL", "I1", "open", D(2026, 6, 1), T0, T0, {"nse": (T0, None)}, {"rhp": ("u.PDF?x", "n")}, None, None),
        ("b", "Beta", "BE", None, "listed", D(2026, 7, 1), T1, T0, {"nse": (T1, None), "groww": (T0, None)}, {"rhp": ("u.pdf", "n")}, None, None),
        ("c", "Gamma", None, None, None, None, T1, T1, None, {"drhp": ("u.html", "n")}, None, None)],
        "slug string, company_name string, symbol string, isin string, status string, bidding_start date, updated_at timestamp, created_at timestamp, "
        "sources map<string,struct<last_fetched:timestamp,url:string>>, documents map<string,struct<url:string,source:string>>, objects string, financials string")
    ids = lambda d: [r.slug for r in d.collect()]
    assert ids(listing.page_of(df)) == ["b", "a", "c"] and ids(listing.page_of(df, order="asc")) == ["c", "a", "b"]
    assert ids(listing.page_of(df, page=2, limit=2)) == ["c"] and ids(listing.page_of(df, sort="name", order="asc")) == ["a", "b", "c"]
    assert listing.page_info(df, 1, 2).first().has_more is True
    assert ids(listing.filter_listings(df, search="ALP|be")) == ["a", "b"] and ids(listing.filter_listings(df, source="groww")) == ["b"]
    assert ids(listing.filter_listings(df, document="drhp")) == ["c"] and ids(listing.filter_listings(df, status="open")) == ["a"]
    assert ids(listing.pending_documents(df)) == ["a"]
    fresh = {r.source: (r.entities, r.healthy, r.last_fetched) for r in listing.source_freshness(df).collect()}
    assert fresh["nse"] == (2, True, T1) and fresh["bse"] == (0, False, None) and len(fresh) == 6
    rng = lambda **k: ids(df.filter(listing.within_date_range(F.col("bidding_start"), **k)))
    assert rng(year=2026) == ["a", "b"] and rng(year=2025) == [] and rng(start="2026-06-15") == ["b"] and rng(start="2026-05-01", end="2026-06-15") == ["a"]
    assert feeds.drop_listed(df).count() == 2
    errs = spark.createDataFrame([("a", i, f"e{i}") for i in range(9)], "slug string, at int, error string")
    assert sorted(r.at for r in listing.last_errors(errs, n=5).collect()) == [4, 5, 6, 7, 8]
