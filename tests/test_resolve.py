"""Feeds, entity resolution and merging."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from offerloom.operators.components import connected_components
from offerloom.operators import matching
from offerloom.operators.matching import best_name_match, contains_match, find_existing
from offerloom.operators.merge import merge_records
from offerloom.operators.names import similar_names, similar_names_within
from offerloom.operators import resolve
from offerloom.operators.resolve import NEAR_SCORE, match_keys, name_pairs, name_runs, resolve_entities, run_days
from offerloom.sources import feeds
from tests.test_functions import model_score

D = dt.date


def payloads(spark, schema, rows, extra="seq bigint"):
    data = [dict(r, seq=i) for i, r in enumerate(rows)]
    full = f"{schema}, {extra}"
    import json

    return spark.read.schema(full).json(spark.sparkContext.parallelize([json.dumps(d) for d in data]))


def record(seq, source, name=None, day=None, isin=None, symbol=None, **kw):
    base = dict(seq=seq, source=source, isin=isin, symbol=symbol, company_name=name, status=None, bidding_start=day,
                price_min=None, price_max=None, rhp=None, drhp=None, listing_date=None)
    base.update(kw)
    return base


SCHEMA = ("seq bigint, source string, isin string, symbol string, company_name string, status string, bidding_start date, "
          "price_min double, price_max double, rhp string, drhp string, listing_date date")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_map_feed_a(spark):
    df = payloads(spark, feeds.FEED_A_SCHEMA, [
        {"name": "Genxai Analytics IPO", "symbol": "GENXAI", "isin": "", "minimum_price": 110, "maximum_price": 116,
         "timeline": {"application_start_date": "2026-06-05"}, "rhp_url": "http://x/rhp.pdf", "status": "open"}])
    r = feeds.map_feed_a(df).first()
    assert (r.company_name, r.isin, r.price_min, r.price_max, r.bidding_start, r.rhp, r.drhp) == (
        "Genxai Analytics", None, 110, 116, D(2026, 6, 5), "http://x/rhp.pdf", None)
    assert r.upstox.name == "Genxai Analytics IPO"


def test_map_feed_b_and_dedupe(spark):
    df = payloads(spark, feeds.FEED_B_SCHEMA, [
        {"symbol": "A", "companyName": "Alpha", "ipoStartDate": "21-MAY-2026", "priceRange": "Rs.326 to Rs.343", "bucket": "current", "status": "Active"},
        {"symbol": "A", "company": "Alpha Ltd", "bucket": "past"},
        {"symbol": None, "company": "Nameless", "bucket": "past"},
        {"symbol": None, "company": "Dropped", "bucket": "current"},
        {"symbol": "U", "companyName": "Upco", "bucket": "upcoming", "metaInfo": {"isin": "INE1", "rhpUrl": "http://r"}},
    ], "seq bigint, bucket string")
    mapped = feeds.map_feed_b(df)
    first = mapped.filter("seq = 0").first()
    assert (first.bidding_start, first.price_min, first.price_max, first.status) == (D(2026, 5, 21), 326, 343, "open")
    rows = {(r.symbol or r.company_name): r for r in feeds.dedupe_feed_b(mapped).collect()}
    assert set(rows) == {"A", "Nameless", "U"}
    assert (rows["A"].company_name, rows["A"].status, rows["U"].status, rows["U"].isin, rows["U"].rhp) == ("Alpha Ltd", "closed", "upcoming", "INE1", "http://r")
    details = spark.createDataFrame([("A", "INE9", "12-Jun-2026"), ("U", "INE8", None)], "symbol string, isin string, listing_date string")
    rich = {(r.symbol or r.company_name): r for r in feeds.enrich_past(feeds.dedupe_feed_b(mapped), details).collect()}
    assert (rich["A"].isin, rich["A"].listing_date, rich["U"].isin) == ("INE9", D(2026, 6, 12), "INE1")


def test_map_feed_c(spark):
    lists = payloads(spark, feeds.FEED_C_LIST_SCHEMA, [
        {"searchId": "a", "symbol": "A", "bidStartTimestamp": 1780633800000, "categories": [{"minPrice": 10, "maxPrice": 12}], "bucket": "open"},
        {"searchId": "a", "symbol": "A2", "bucket": "closed"},
        {"searchId": "b", "companyName": "Bee", "bucket": "upcoming"},
        {"bucket": "open"},
    ], "seq bigint, bucket string")
    deduped = feeds.dedupe_list(lists)
    assert {r.symbol for r in deduped.collect()} == {"A", None}
    details = payloads(spark, feeds.FEED_C_DETAIL_SCHEMA, [
        {"searchId": "b", "status": "UPCOMING", "documentUrl": "https://www.sebi.gov.in/filings/x", "minPrice": 5, "maxPrice": 6, "startDate": "2026-07-01"}]).drop("seq")
    rows = {r.groww.search_id: r for r in feeds.map_feed_c(deduped, details).collect()}
    a, b = rows["a"], rows["b"]
    assert (a.bidding_start, a.price_min, a.price_max, a.status, a.rhp) == (D(2026, 6, 5), 10, 12, "open", None)
    assert (b.status, b.drhp, b.rhp, b.bidding_start, b.price_min) == ("upcoming", "https://www.sebi.gov.in/filings/x", None, D(2026, 7, 1), 5)


def test_feed_d(spark):
    html = """<table><tr><td class="ipo-logo"><a href="/ipo/447807/hexagon-nutrition"><img/></a></td>
      <td class="name"><a href="/ipo/447807/hexagon-nutrition"><span class="ipo-symbol">HEXAGON<span class="ipo-type">Mainboard</span></span>
      <span class="ipo-name text-12 text-grey">Hexagon Nutrition</span></a></td>
      <td class="date"><span class="hidden">2026-06-12</span>05th – 09th Jun 2026</td><td class="date">12 Jun 2026</td>
      <td class="text-right">₹42 &ndash; ₹45</td></tr><tr><td class="name"><a href="/other/1/">x</a></td></tr></table>"""
    detail = """<a href="https://x/grievance.pdf">Grievances Redressal Mechanism</a>
      <a href="https://gyr.com/rhphorizon.pdf" target="_blank">Download prospectus (PDF)</a>"""
    pages = spark.createDataFrame([(1, html), (2, detail)], "page_id bigint, html string")
    rows = feeds.parse_listing_rows(pages).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.symbol, r.type, r.isSme, r.companyName, r.detailPath) == ("HEXAGON", "Mainboard", False, "Hexagon Nutrition", "/ipo/447807/hexagon-nutrition/")
    assert (r.biddingRange, r.listingDateText) == ("05th – 09th Jun 2026", "12 Jun 2026") and "42" in r.priceText
    links = feeds.first_matching_link(pages).collect()
    assert [(x.page_id, x.href) for x in links] == [(2, "https://gyr.com/rhphorizon.pdf")]
    df = feeds.parse_listing_rows(pages).withColumn("prospectusUrl", F.lit("https://gyr.com/x-final.pdf")).withColumn("seq", F.lit(0).cast("bigint"))
    m = feeds.map_feed_d(df, F.lit("2026-06-07").cast("date")).first()
    assert (m.status, m.bidding_start, m.price_min, m.price_max, m.rhp, m.drhp, m.listing_date) == (
        "open", D(2026, 6, 5), 42, 45, "https://gyr.com/x-final.pdf", None, D(2026, 6, 12))


def test_merge_precedence(spark):
    rows = [
        record(1, "upstox", "Apex A", D(2026, 6, 1), "I1", "APX", status="open", price_min=100.0, price_max=110.0, rhp="a-rhp"),
        record(2, "nse", "Apex B", D(2026, 6, 2), "I1", "APX", status="closed", price_min=90.0, price_max=120.0, rhp="b-rhp", drhp="b-drhp"),
    ]
    resolved, _ = resolve_entities(frame(spark, rows))
    m = merge_records(resolved).collect()
    assert len(m) == 1
    m = m[0]
    assert (m.company_name, m.status, m.bidding_start, m.price_min, m.rhp, m.drhp) == ("Apex A", "open", D(2026, 6, 2), 100, "b-rhp", "b-drhp")
    assert m.sources == ["nse", "upstox"]


def test_resolve_entities(spark):
    rows = [
        record(1, "upstox", "Apex Logistics Ltd", D(2026, 6, 1), "", ""),
        record(2, "nse", "Apex Logistix", D(2026, 6, 20)),               # similar name, 19 days
        record(3, "groww", "Apex Logistics", D(2026, 7, 15)),            # 25 days after 2: chained
        record(4, "groww", "Apex Logistics", D(2026, 12, 1)),            # too far: borderline
        record(5, "zerodha", "Zeta Foods", None, "INE5"),
        record(6, "zerodha", "Other", None, "INE5", "ZZ-EQ"),
        record(7, "nse", "Third", None, None, "zz"),
        record(8, "nse", None, None, "", ""),
        record(9, "nse", None, None, "", ""),
    ]
    resolved, border = resolve_entities(frame(spark, rows))
    got = {r.seq: r.entity_id for r in resolved.collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5, 8: 8, 9: 9}
    failed = {(r.left_name, r.right_name): r for r in border.filter("reason like 'fuzzy%'").collect()}
    both, own = failed["apex logistics", "apex logistix"], failed["apex logistics", "apex logistics"]
    assert (both.left_ids, both.right_ids, both.near_ids, both.pairs, both.left_id, both.right_id) == ("1,3,4", "2", "1:2,3:2", 1, 4, 2)
    assert (own.left_ids, own.pairs, own.left_id, own.right_id) == ("1,3,4", 3, 1, 3) and len(failed) == 2
    linked = {r.seq: r.entity_id for r in resolve.link_entities(frame(spark, rows)).collect()}
    assert linked == got


@pytest.mark.parametrize("threshold", [0.85, 0.9, 0.92])
def test_similar_names_exact(spark, threshold):
    rng = random.Random(3)
    stems = ["shree ganesh", "apex logistics", "green energy", "tata", "ab", "a", "nova tech systems", "xyz"]
    names = set(stems)
    while len(names) < 220:
        s = list(rng.choice(stems))
        for _ in range(rng.randint(0, 4)):
            op, pos = rng.randint(0, 2), rng.randint(0, max(0, len(s) - 1))
            if op == 0:
                s.insert(pos, rng.choice("abcdefgh 12"))
            elif op == 1 and len(s) > 1:
                s.pop(pos)
            elif s:
                s[pos] = rng.choice("aeioustr")
        name = " ".join("".join(s).split())
        if name:
            names.add(name)
    names = sorted(names)
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.left_name, r.right_name) for r in similar_names(df, df, threshold).collect()}
    want = {(a, b) for a in names for b in names if model_score(a, b) >= threshold}
    assert got == want
    ranked = spark.createDataFrame([(n, i * 7919 % 1009) for i, n in enumerate(names)], "name string, rank int")
    rank = {n: i * 7919 % 1009 for i, n in enumerate(names)}
    got = [(r.left_name, r.right_name) for r in similar_names_within(ranked, threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in want if rank[a] > rank[b]}


def brute_force_entities(rows):
    import re

    parent = {r["seq"]: r["seq"] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    norm = lambda s: " ".join(re.sub(r"[^a-z0-9 ]", "", re.sub(r"\b(limited|ltd)\b", "", (s or "").lower())).split())
    for i, b in enumerate(rows):
        for a in rows[:i]:
            same = (a["isin"] and a["isin"] == b["isin"]) or (a["symbol"] and a["symbol"] == b["symbol"])
            na, nb = norm(a["company_name"]), norm(b["company_name"])
            close = a["bidding_start"] and b["bidding_start"] and abs((a["bidding_start"] - b["bidding_start"]).days) <= 30
            if same or (close and model_score(nb, na) >= 0.9):
                x, y = find(a["seq"]), find(b["seq"])
                parent[max(x, y)] = min(x, y)
    return {r["seq"]: find(r["seq"]) for r in rows}


def test_resolve_against_brute_force(spark):
    rng = random.Random(11)
    base = ["apex logistics", "apex logistix", "green energy", "green energi", "nova tech", "shree foods", "shree food", "zed"]
    rows = []
    for i in range(160):
        day = None if rng.random() < 0.15 else D(2026, 1, 1) + dt.timedelta(days=rng.randint(0, 900))
        rows.append(record(i, "nse", rng.choice(base), day, rng.choice([None, None, None, f"I{rng.randint(0, 40)}"]), rng.choice([None, None, f"S{rng.randint(0, 60)}"])))
    resolved, border = resolve_entities(frame(spark, rows))
    want = brute_force_entities(rows)
    assert {r.seq: r.entity_id for r in resolved.collect()} == want
    assert {r.seq: r.entity_id for r in resolve.link_entities(frame(spark, rows)).collect()} == want
    # Every pair of runs under review, from the classes and from all pairs of runs.
    runs = name_runs(run_days(match_keys(frame(spark, rows)))).collect()
    first = {}
    for r in runs:
        first[r["name"]] = min(first.get(r["name"], r.run), r.run)
    pairs = set()
    for a in runs:
        for b in runs:
            if a.run < b.run:
                x, y = sorted((a, b), key=lambda r: (first[r["name"]], r.run))
                score = 1.0 if x["name"] == y["name"] else model_score(y["name"], x["name"])
                near = a.run_start and b.run_start and (a.run_start - b.run_end).days <= 30 and (b.run_start - a.run_end).days <= 30
                if score >= 0.85 and (score < 0.9 or not near):
                    pairs.add((x.run, y.run))
    got, total = set(), 0
    for r in border.collect():
        left, right = ([int(i) for i in ids.split(",")] for ids in (r.left_ids, r.right_ids))
        near = {tuple(map(int, x.split(":"))) for x in r.near_ids.split(",") if x}
        own = r.left_name == r.right_name
        got |= {(i, j) for i in left for j in right if (i, j) not in near and (not own or i < j)}
        assert (r.left_id, r.right_id) in got
        total += r.pairs
    assert got == pairs and total == len(pairs)


@pytest.mark.parametrize("few", [0, 2, 100])
def test_dated_name_pairs_need_meeting_times(spark, few):
    """Pairs within reach are all found, whatever names count as long active; pairs far apart leave no candidate."""
    rng = random.Random(few)
    base = ["apex logistics", "apex logistix", "apex logistic", "green energy", "green energi", "greens energy"]
    rows = []
    for i in range(150):
        name = rng.choice(base)
        # The last name of each family is active years later.
        start = D(2031, 1, 1) if name in ("apex logistic", "greens energy") else D(2026, 1, 1)
        rows.append(record(i, "nse", name, start + dt.timedelta(days=rng.choice([0, 10, 200, 260, 290]) + rng.randint(0, 40))))
    runs = name_runs(run_days(match_keys(frame(spark, rows))))
    swept = resolve.swept_pairs(runs, resolve.dated_name_pairs(runs, 0.9, few=few))
    got = {(r.u, r.v) for r in resolve.fuzzy_edges(swept).collect()}
    held = runs.collect()
    first = {}
    for r in held:
        first[r["name"]] = min(first.get(r["name"], r.run), r.run)
    want = {
        (a.run, b.run) for a in held for b in held
        if first[a["name"]] > first[b["name"]] and model_score(a["name"], b["name"]) >= 0.9
        and (a.run_start - b.run_end).days <= 30 and (b.run_start - a.run_end).days <= 30
    }
    assert got == want and want
    pairs = {frozenset((r.left_name, r.right_name)) for r in resolve.dated_name_pairs(runs, 0.9, few=few).collect()}
    assert pairs == {frozenset(base[:2]), frozenset(base[3:5])}


def test_name_runs_hot_name(spark):
    rows = [record(i, "nse", "Hot Name", D(2026, 1, 1) + dt.timedelta(days=(i % 10) * 40)) for i in range(500)] + [record(999, "nse", "Hot Name", None)]
    runs = name_runs(run_days(match_keys(frame(spark, rows))))
    assert runs.count() == 11 and runs.agg(F.sum("records")).first()[0] == 501
    assert name_pairs(runs, NEAR_SCORE).count() == 0


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 80)] + [(500, 501)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + k] == 100 for k in range(80)) and got[501] == 500


def test_find_existing(spark):
    existing = spark.createDataFrame([("acme-ipo", "I1", "ACM"), ("beta-ipo", "I2", "BET"), ("gamma-ipo", None, None)], "slug string, isin string, symbol string")
    inc = spark.createDataFrame([(1, "I2", "ACM", "x"), (2, None, "ACM", "x"), (3, "", "", "Gamma Ltd"), (4, None, None, "New")],
                                "seq bigint, isin string, symbol string, company_name string")
    got = {r.seq: r.existing_slug for r in find_existing(inc, existing).collect()}
    assert got == {1: "beta-ipo", 2: "acme-ipo", 3: "gamma-ipo", 4: None}


def test_premium_matches(spark):
    targets = spark.createDataFrame([("a", "Hexagon Nutrition Limited"), ("b", "Unrelated Foods"), ("c", "Hexagon Nutritions")], "slug string, company_name string")
    entries = spark.createDataFrame([("Hexagon Nutrition IPO", 8, 0), ("Hexagon Nutrition", 9, 1), ("Genxai", 3, 2)], "company_name string, id bigint, list_pos bigint")
    got = {r.slug: r.list_pos for r in best_name_match(targets, entries).collect()}
    assert got == {"a": 0, "c": 0}
    e = spark.createDataFrame([(1, "Hexagon"), (2, "The Genxai Analytics Corp"), (3, "abc"), (4, "zzz")], "entry_id bigint, company_name string")
    li = spark.createDataFrame([("h2", "Hexagon Nutrition", 1), ("h1", "New Hexagon", 0), ("g", "Genxai Analytics", 2), ("s", "abc", 3), ("t", "xabcx", 4)],
                               "slug string, company_name string, list_pos bigint")
    got = {r.entry_id: r.slug for r in contains_match(e, li).collect()}
    assert got == {1: "h1", 2: "g", 3: "s"}


def test_contains_match_with_a_hot_lead_word(spark):
    """Half the names start with one word: the rarest piece keeps candidates linear, and all matches are found."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    names = [("industrial " if i % 2 else "") + word() + " " + word() for i in range(400)]
    listings = [(f"s{i}", f"new {n} works" if i % 3 else n, i) for i, n in enumerate(names)]
    entries = [(i, n if i % 5 else n.split()[-1]) for i, n in enumerate(names)]
    e = spark.createDataFrame(entries, "entry_id bigint, company_name string")
    li = spark.createDataFrame(listings, "slug string, company_name string, list_pos bigint")
    want = {}
    for i, n in entries:
        hits = [(p, s) for s, m, p in listings if n == m or (len(n) >= 4 and n in m) or (len(m) >= 4 and m in n)]
        if hits:
            want[i] = min(hits)[1]
    assert {r.entry_id: r.slug for r in contains_match(e, li).collect()} == want
    short = e.selectExpr("company_name as name").distinct()
    long = li.selectExpr("company_name as name").distinct()
    # Candidates are counted before the names themselves are compared.
    counts = [matching.looked_up(short.orderBy("name").limit(n), long).count() for n in (150, 300)]
    assert counts[1] <= 3 * counts[0] and counts[1] <= 6 * 300


def test_review_classes_keep_the_records_of_each_run(spark):
    rows = [record(1, "upstox", "Apex Logistics", D(2026, 6, 1)), record(2, "nse", "Apex Logistics", D(2026, 6, 2)), record(3, "groww", "Apex Logistix", D(2026, 12, 1)), record(4, "nse", "Apex Logistics", D(2027, 6, 2))]
    _, border = resolve_entities(frame(spark, rows))
    got = {(r.left_name, r.right_name): (r.left_ids, r.left_counts, r.right_ids, r.right_counts) for r in border.collect()}
    assert got[("apex logistics", "apex logistix")] == ("1,4", "2,1", "3", "1") and got[("apex logistics", "apex logistics")][:2] == ("1,4", "2,1")
