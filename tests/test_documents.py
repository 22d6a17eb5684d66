"""Pages, markdown tables, positioned items and facts."""

import pytest
from pyspark.sql import functions as F

from offerloom.operators import facts, items, pages, parties, tables
from offerloom.plans import load_queries
from offerloom.rules import pages as PR

FIN = """
Intro text
| Particulars | 31 March 2025 | 31 March 2024 | 31 March 2023 |
|---|---:|:--:|---|
| Revenue from Operations | 1,652.47 | 2,374.71 | 900 |
| Total Income | 1,700 | 2,400 | 910 |
| EBITDA Margin | 5% | 6% | 7% |
| EBITDA | 250 | 300 | 100 |
| Profit after tax | (50) | 20.5 | — |
| Net worth | 10 | 20 | 30 |
middle
| lonely | row |
end
| Ratio | FY 2025 | FY 2024 |
| --- | --- | --- |
| RoCE | 12% | 10% |
| Return on Net Worth | 9 | 8 |
| Debt to Equity | 0.5 | — |
| Current Ratio | 1.2 | 1.1 |
"""


def docs(spark, *texts, **extra):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for k, v in extra.items():
        df = df.withColumn(k, F.lit(v))
    return df


def test_markdown_tables(spark):
    d = docs(spark, FIN, "", "no tables | here", "| a | b |\n| c |\n\n| x | y |\n|---|---|\n", "| a | |\r\n|  b | c")
    cells = tables.markdown_cells(d)
    shape = {(r.doc_id, r.table_idx): r.n for r in cells.filter("col_idx = 0").groupBy("doc_id", "table_idx").agg(F.count("*").alias("n")).collect()}
    assert shape[(0, 0)] == 7 and shape[(0, 1)] == 5 and (0, 2) not in shape and 1 not in [k[0] for k in shape] and shape[(4, 0)] == 2
    assert [r.cell for r in cells.filter("doc_id = 0 and table_idx = 0 and row_idx = 1").orderBy("col_idx").collect()] == ["Revenue from Operations", "1,652.47", "2,374.71", "900"]
    assert shape[(3, 0)] == 2 and (3, 1) not in shape


def test_metrics_and_ratios(spark):
    d = docs(spark, FIN)
    m = {}
    for r in tables.table_metrics(d).orderBy("key", "period_idx").collect():
        m.setdefault(r.key, []).append(r.value)
    assert m["revenueFromOperations"] == [1652.47, 2374.71, 900] and m["profitAfterTax"] == [-50, 20.5, None] and m["ebitda"] == [250, 300, 100]
    assert set(m) == {"revenueFromOperations", "totalIncome", "ebitda", "profitAfterTax", "netWorth"}
    assert tables.table_metrics(d).filter("period_idx = 0").first().period == "31 March 2025"
    k = {}
    for r in tables.table_ratios(d).orderBy("key", "period_idx").collect():
        k.setdefault(r.key, []).append(r.value)
    assert k == {"roce": [12, 10], "ronw": [9, 8], "debtEquity": [0.5, None], "currentRatio": [1.2, 1.1]}
    plain = docs(spark, "| RoCE | x | 12 | 13 |\n| RoE | 5 |\n| RoE | 6 |\n")
    assert {(r.key, r.value, r.period) for r in tables.table_ratios(plain).collect()} == {("roce", 12.0, None), ("roe", 5.0, None)}


def it(rows, page=1, doc=1):
    return [(doc, page, i, float(x), float(y), s) for i, (x, y, s) in enumerate(rows)]


ITEM = "doc_id bigint, page int, seq int, x double, y double, str string"
SHEET = [
    (50, 700, "Particulars"), (300, 700, "March 2025"), (400, 700, "March 2024"),
    (50, 680, "Revenue from Operations"), (300, 681, "1,652.47"), (401, 680, "2,374.71"),
    (50, 660, "Basic Earnings per share"), (302, 660, "3.25"), (399, 660, "4.99"),
    (50, 640, "Net Worth"), (300, 640, "10"),
    (50, 620, "Profit before tax"), (300, 620, "(120.50)"), (400, 620, "1,000"),
    (50, 600, "Finance costs"), (300, 600, "20.5"), (400, 600, "100.00"),
    (50, 580, "   "),
]


def test_item_rows(spark):
    df = spark.createDataFrame(it([(10, 80, "a"), (5, 81, "b"), (1, 125, "c"), (1, 50, "d")]), ITEM)
    got = {r.row_y: r.text for r in items.row_cells(df, 4).collect()}
    assert got == {80: "b a", 124: "c", 52: "d"}


def test_item_metrics(spark):
    df = spark.createDataFrame(it(SHEET), ITEM)
    f = {(r.field, r.col): r.value for r in items.page_fields(df).collect()}
    assert f[("revenueFromOperations", 0)] == 1652.47 and f[("revenueFromOperations", 1)] == 2374.71
    assert f[("basicEPS", 0)] == 3.25 and f[("basicEPS", 1)] == 4.99 and f[("netWorth", None)] == 10
    m = {(r.key, r.period_idx): r.value for r in items.item_statements(df).collect()}
    assert m[("revenueFromOperations", 0)] == 1652.47 and m[("profitBeforeTax", 0)] == -120.5 and m[("profitBeforeTax", 1)] == 1000
    assert m[("basicEPS", 1)] == 4.99 and ("netWorth", 0) not in m
    merged = items.derive_ebitda(items.first_page_wins(items.item_statements(df)))
    e = {r.period_idx: r.value for r in merged.filter("key = 'ebitda'").collect()}
    assert e == {0: -100.0, 1: 1100.0}
    assert items.first_page_wins(items.item_statements(df)).filter("period_idx = 0").first().period == "March 2025"


def test_page_merge_and_best_page(spark):
    two = it(SHEET) + it([(50, 700, "x"), (300, 700, "Mar 2023"), (400, 700, "Mar 2022"), (50, 680, "Revenue from operations"), (300, 680, "9.99"), (400, 680, "8.88"),
                          (50, 640, "Total income"), (300, 640, "7.77"), (400, 640, "6.66")], page=2)
    df = spark.createDataFrame(two, ITEM)
    got = {(r.key, r.period_idx): (r.page, r.value, r.period) for r in items.first_page_wins(items.item_statements(df)).collect()}
    assert got[("revenueFromOperations", 0)][0] == 1 and got[("totalIncome", 0)] == (2, 7.77, "March 2025")
    assert items.best_page(items.page_fields(df)).first().page == 1


def test_page_fields_read_a_row_once(spark):
    zero = [(50, 700, "Net worth"), (300, 700, "0"), (50, 680, "Net worth"), (300, 680, "7.5"), (50, 660, "Net worth"), (300, 660, "9")]
    years = [(50, 700, "x"), (300, 700, "March 2025"), (400, 700, "March 2024"), (50, 680, "Total income"), (290, 680, "1"), (310, 680, "2"), (400, 680, "3")]
    out = items.page_fields(spark.createDataFrame(it(zero) + it(years, page=2), ITEM))
    assert {tuple(r) for r in out.collect()} == {
        (1, 1, "netWorth", None, None, 7.5), (1, 2, "totalIncome", 0, "March 2025", 2.0), (1, 2, "totalIncome", 1, "March 2024", 3.0),
    }
    assert planned(out).count("revenue from operations") == 1 and planned(out).count("Aggregate ") == 1


def test_column_runs_are_cut_not_folded(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([40, None, 1, 20, 100, 60, 105, None],), ([],), ([7],)], "xs array<bigint>")
    got = df.select(items._centers(F.col("xs"), 20, 1).alias("c"))
    assert [[(c.center, c["items"]) for c in r.c] for r in got.collect()] == [[(11, 2), (40, 1), (60, 1), (103, 2), (None, 1), (None, 1)], [], [(7, 1)]]
    assert "aggregate(" not in planned(got) and "array_sort" not in planned(got)


def test_first_page_wins_reads_its_metrics_once(spark):
    rows = [(1, 1, "a", 0, "p1", 1.0), (1, 2, "a", 0, "p2", 2.0), (1, 2, "b", 1, "q2", 3.0), (2, 3, "b", 0, "p3", None), (2, 3, "b", 1, "q3", 4.0)]
    out = items.first_page_wins(spark.createDataFrame(rows, "doc_id bigint, page int, key string, period_idx int, period string, value double"))
    assert {tuple(r) for r in out.collect()} == {(1, "a", 1, 0, "p1", 1.0), (1, "b", 2, 1, None, 3.0), (2, "b", 3, 0, "p3", None), (2, "b", 3, 1, "q3", 4.0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_holding_and_tables(spark):
    df = spark.createDataFrame(it([(1, 90, "Total promoter group"), (50, 90, "70.5%"), (90, 90, "51.25")], page=3) + it([(1, 90, "Total promoter"), (50, 90, "x")], page=2), ITEM)
    r = items.promoter_holding(df).first()
    assert (r.pre_issue, r.post_issue) == (70.5, 51.25)
    grid = [(10 + 100 * c + (r % 3), 500 - 20 * r, f"h{c}" if r == 0 else (f"name{r}" if c == 0 else str(r * c * 11))) for r in range(6) for c in range(3)]
    t = items.detect_tables(spark.createDataFrame(it(grid), ITEM)).orderBy("row_idx").collect()
    assert len(t) == 6 and t[0].is_header and t[0].cells == ["h0", "h1", "h2"] and t[2].cells == ["name2", "22", "44"] and t[0].num_cols == 3
    centers = items.column_centers(spark.createDataFrame(it(grid), ITEM)).orderBy("col").collect()
    assert [c.center for c in centers] == [11, 111, 211]
    near = items.nearest_column(spark.createDataFrame([(1, 1, 61.0), (1, 1, 300.0)], "doc_id bigint, page int, x double"), items.column_centers(spark.createDataFrame(it(grid), ITEM)))
    assert sorted(r.col for r in near.collect()) == [0, 2]


def test_places_of_one_number_get_one_column(spark, tmp_path):
    """Two parts of an order may make the same number; each place had its own row."""
    lines = [(1, 2, 97, 5), (1, 4, 0, 20000), (1, 6, 20, 0), (1, 8, 21, 5)]
    table = spark.createDataFrame([(*x, 1.0) for x in lines], "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double")
    table.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = load_queries()[0]["nearest_column"](spark, str(tmp_path)).select("doc_id", "page", "seq", "col").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 20000, 0), (1, 1, 21005, 1), (1, 1, 97005, 0)]


def test_contents(spark):
    toc = [(1, 10 * i, f"{n} ....... {p}") for i, (n, p) in enumerate([("RISK FACTORS", 24), ("CAPITAL STRUCTURE", 60), ("OBJECTS OF THE ISSUE", 60), ("OUR BUSINESS", 200), ("OTHER", 210)])]
    body = [(1, 10, "Dividend Policy and more")]
    df = spark.createDataFrame(it(toc, page=2) + it(body, page=90) + it([(1, 1, "our business is old")], page=40), ITEM)
    got = {r.section: (r.printed_start, r.printed_end, r.pdf_start, r.origin) for r in items.locate_by_contents(df, last_span=60, most_span=80).collect()}
    assert got["RISK_FACTORS"] == (24, 59, None, "toc") and got["CAPITAL_STRUCTURE"] == (60, 59, None, "toc") and got["OUR_BUSINESS"] == (200, 260, None, "toc")
    assert got["DIVIDEND_POLICY"] == (None, None, 90, "fullscan")


def test_sections_and_windows(spark):
    texts = ["cover", "toc", "x", "x", "balance sheet on page five", "Risk Factors here", "nothing", "mention of risk factors", "Capital structure", "profit and loss", "end"]
    df = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "doc_id bigint, page int, text string")
    sec = {r.section: (r.start, r.end) for r in pages.detect_sections(df, front=5).collect()}
    assert sec == {"risk-factors": (6, 8), "capital-structure": (9, 9), "financials": (10, 11)}
    sl = pages.slice_sections(df, pages.detect_sections(df, front=5))
    assert sorted((r.section, r.page) for r in sl.collect())[-3:] == [("risk-factors", 6), ("risk-factors", 7), ("risk-factors", 8)]
    ratio = "Key Performance Indicators RoCE 10% RoE 12% return on net worth 5% debt equity ebitda margin 20%"
    kp = spark.createDataFrame([(1, 1, "table of contents return on equity 5%"), (1, 2, ratio), (1, 3, "RoE 5% 6% 7%"), (1, 4, "RoE"), (1, 9, ratio.replace("Key", "Kex"))], "doc_id bigint, page int, text string")
    sc = {r.page: r.s for r in kp.select("page", pages.ratio_score(F.col("text")).alias("s")).collect()}
    assert sc == {1: 0, 2: 17, 3: 5, 4: 2, 9: 14}
    assert {r.page for r in pages.ratio_window(kp, 6, reach=4).collect()} == {2, 3}
    assert {r.page for r in pages.ratio_window(kp, 6, 130, reach=4).collect()} == {2}
    st = "Revenue from operations total income 100 March 2025 March 2024 March 2023"
    sp = spark.createDataFrame([(1, 1, st), (1, 2, "total income restated 12"), (1, 3, st + " EBITDA"), (1, 5, "EBITDA restated 55"), (1, 6, "EBITDA none")], "doc_id bigint, page int, text string")
    assert [r.s for r in sp.orderBy("page").select(pages.statement_score(F.col("text")).alias("s")).collect()] == [5, 2, 6, 2, 0]
    assert sorted(r.page for r in pages.statement_window(sp, 5, 28000).collect()) == [1, 2, 3, 5]
    assert sorted(r.page for r in pages.statement_window(sp, window=2).collect()) == [2, 3]
    assert sorted(r.page for r in pages.statement_window(sp, max_chars=150).collect()) == [1, 2]


def test_overlap_and_grounding(spark):
    new = spark.createDataFrame([(1, h) for h in "aabcd"], "entity bigint, page_hash string")
    old = spark.createDataFrame([(1, h) for h in "abce"], "entity bigint, page_hash string")
    r = pages.version_skip(pages.page_overlap(new, old)).first()
    assert (r.pages, r.overlap, r.unique_pages, r.skipped, r.new_pages) == (5, 4, 1, False, 1)
    pg = spark.createDataFrame([(1, 1, "Revenue   from Operations 1,652.47 2,374.71 was good")], "doc_id bigint, page int, text string")
    f = spark.createDataFrame([(1, 1, "revenue from operations 1,652.47"), (1, 1, "abc"), (1, 2, "revenue from"), (1, 1, "Revenue 1,652.47 2,374.71 zzz"), (1, 1, "nothing at all here"), (1, 1, None)], "doc_id bigint, page int, quote string")
    got = {r.quote: r.grounded for r in pages.ground_facts(f, pg).collect()}
    assert got == {"revenue from operations 1,652.47": True, "abc": False, "revenue from": False, "Revenue 1,652.47 2,374.71 zzz": True, "nothing at all here": False, None: False}
    assert len(PR.CONTENTS_TARGETS) == 21


SHARES_SME = """
| Fresh Issue | 52,69,200 Equity Shares |
| Market Maker Reservation Portion | 2,64,000 Equity Shares |
| Net Issue to Public | 50,05,200 Equity Shares of 10 each |
| Equity Shares outstanding prior to the Issue | 1,42,46,200 |
| Equity Shares outstanding after the Issue | 1,95,15,400 |
| Total Issue Size | 52,69,200 Equity Shares |

The entire issue constitutes fresh issue. This is a fixed price issue on BSE SME (1).
Rikhav Securities Limited will act as the Market Maker. The market maker being Rikhav Securities Limited.
"""
SHARES_MAIN = """
| Offer for Sale | Up to 3,08,59,704 Equity Shares |
| Net Offer | 3,08,59,704 Equity Shares |
| Equity Shares outstanding prior to the Offer | 12,29,00,000 Equity Shares |
| Equity Shares outstanding after the Offer | 12,29,00,000 Equity Shares |
Through an offer for sale. Book Built offer, listed on NSE.
"""


def test_issue_details(spark):
    d = spark.createDataFrame([(1, SHARES_SME, True), (2, SHARES_MAIN, False), (3, "nothing", True)], "doc_id bigint, text string, is_sme boolean")
    r = {x.doc_id: x for x in facts.with_market_maker(facts.issue_details(d)).collect()}
    a, b, c = r[1], r[2], r[3]
    assert (a.fresh_issue_shares, a.market_maker_shares, a.net_offer_shares, a.ofs_shares, a.total_issue_shares) == (5269200, 264000, 5005200, 0, 5269200)
    assert (a.pre_issue_shares, a.post_issue_shares, a.confidence, a.issue_type, a.listing_at, a.sale_type) == (14246200, 19515400, "high", "Fixed Price", "BSE SME", "Fresh capital only")
    assert a.market_maker_name == "Rikhav Securities Limited"
    assert (b.fresh_issue_shares, b.ofs_shares, b.confidence, b.sale_type, b.pre_issue_shares == b.post_issue_shares) == (0, 30859704, "high", "Offer for Sale only", True)
    assert (c.confidence, c.market_maker_name) == ("low", None)
    am = {x.field: (x.rupees, x.amount, x.unit) for x in facts.issue_amounts(facts.issue_details(d).filter("doc_id = 1").withColumn("cap_price", F.lit(103.0))).collect()}
    assert am["freshIssue"] == (5269200 * 103.0, 5427.28, "Lakhs") and am["employeeReservation"] == (None, None, "Lakhs")


def test_reservation_match(one):
    arr = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<bigint>")
    r = one(v=facts.reservation_match(arr(4728000), arr(240000), arr(180000), arr(1, 4308000)), w=facts.reservation_match(arr(10, 20), arr(3), arr(), arr(17, 10)), n=facts.reservation_match(arr(10), arr(), arr(), arr(4)))
    assert tuple(r.v) == (4728000, 240000, 180000, 4308000)
    assert tuple(r.w) == (20, 3, None, 17) and tuple(r.n) == (10, None, None, 4)


@pytest.mark.parametrize("lot,price,market,want", [
    (70, 212.0, "mainboard", [("Retail", "Min", 1, 14840), ("Retail", "Max", 13, 192920), ("S-HNI", "Min", 14, 207760), ("S-HNI", "Max", 67, 994280), ("B-HNI", "Min", 68, 1009120)]),
    (1200, 116.0, "sme", [("Individual", "Fixed", 2, 278400), ("S-HNI", "Min", 3, 417600), ("S-HNI", "Max", 7, 974400), ("B-HNI", "Min", 8, 1113600)]),
    (1200, 300.0, "sme", [("Individual", "Fixed", 2, 720000), ("B-HNI", "Min", 3, 1080000)]),
])
def test_lot_tiers(spark, lot, price, market, want):
    df = spark.createDataFrame([(lot, price, market)], "lot_size int, price double, market_type string")
    assert [(r.category, r.type, r.lots, r.amount) for r in facts.lot_tiers(df).orderBy("tier_ord").collect()] == want


def test_lot_text_and_warnings(spark):
    d = docs(spark, "minimum of 333 shares. Retail (Min) 1 333 ₹14,985 Retail (Max) 13 4,329 1,94,805", "none")
    got = [(r.lot_size, r.category, r.type, r.lots, r.shares, r.amount) for r in facts.printed_lot_table(d).collect()]
    assert (333, "Retail", "Min", 1, 333, 14985) in got and all(g[0] == 333 for g in got)
    w = spark.createDataFrame([(100, 5000.0, "mainboard"), (10, 10.0, "sme"), (1200, 300.0, "sme")], "lot_size int, price double, market_type string")
    assert [r.warnings for r in facts.lot_warnings(w).collect()] == [["one_lot_exceeds_retail_cap"], ["sme_minimum_within_retail_cap"], ["small_hni_band_empty"]]


OBJ = """Amount (₹ in Lakhs)
| S.No. | Particulars | Amount | % |
|---|---|---|---|
| 1. | Funding working capital requirements | 1,500.00 | 50 |
| 2. | Repayment of borrowings* | 800.63 | 20 |
| 3. | General Corporate Purposes | 290 | 10 |
| | Net Proceeds | 2,590.63 | |
| Total | | 2,590.63 | 100 |
"""


def test_objects(spark):
    lst = "We intend the following objects: 1. Funding of capital expenditure; 2. Repayment of certain loans; 3. General corporate purposes. We"
    d = docs(spark, OBJ, lst, "none")
    got = {}
    for r in facts.objects_of_issue(d).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [r.name for r in got[0]] == ["Funding working capital requirements", "Repayment of borrowings", "General Corporate Purposes"]
    assert got[0][0].total == 2590.63 and got[0][0].total_cr == 25.91 and got[0][0].amount_cr == 15.0 and got[0][0].origin == "table"
    assert len(got[1]) == 3 and got[1][0].origin == "list" and got[1][0].total is None and 2 not in got


def test_promoters(spark):
    d = docs(
        spark,
        "PROMOTERS OF OUR COMPANY: AMIT SHAH, RAVI KUMAR AND NEHA PATEL DETAILS OF THE ISSUE",
        "Our Promoters are Amit Shah and Ravi Kumar. For further details",
        "nothing",
        "PROMOTERS OF OUR COMPANY ARE AMIT SHAH AND RAVI KUMAR INITIAL PUBLIC",
    )
    got = {r.doc_id: (r.promoters, r.confidence, r.origin) for r in facts.promoter_names(d).collect()}
    assert got[0] == (["AMIT SHAH", "RAVI KUMAR", "NEHA PATEL"], "high", "multi")
    assert got[1] == (["Amit Shah", "Ravi Kumar"], "medium", "prose") and 2 not in got
    assert got[3][0] == ["AMIT SHAH", "RAVI KUMAR"]


PARTY = """Book Running Lead Manager: Marwadi Chandarana Intermediaries Brokers Private Limited Tel: +91-22-69120027 Email: mb@marwadichandarana.com
Lead Manager to the Issue Marwadi Chandarana Intermediaries Brokers Limited
Registrar to the Issue: Kfin Technologies Limited Telephone: +91 40 6716 2222 Email: einward.ris@kfintech.com
Registered Office: 12 MG Road, Mumbai 400001 Tel: 022-1234567 Contact Person: Asha Rao E-mail: cs@vahhchemicals.com Website: https://www.vahhchemicals.com
"""


def test_parties(spark):
    d = docs(spark, PARTY, "none", company_name="Vahh Chemicals Limited")
    m = parties.party_mentions(d)
    p = {(r.role, r.name): r for r in parties.dedupe_parties(m).collect()}
    lm = p[("lead_manager", "Marwadi Chandarana Intermediaries Brokers Private Limited")]
    assert lm.mentions == 2 and lm.email == "mb@marwadichandarana.com" and lm.phone and lm.phone.startswith("+91")
    within = {(r.role, r.name): r for r in parties.parties_of(d).collect()}
    assert {k: r.asDict() for k, r in within.items()} == {k: r.asDict() for k, r in p.items()}
    reg = parties.pick_registrar(parties.dedupe_parties(m)).first()
    assert reg.name == "Kfin Technologies Limited" and reg.email == "einward.ris@kfintech.com"
    c = parties.company_contacts(d).filter("doc_id = 0").first()
    assert (c.registered_office, c.contact_person, c.email, c.website) == ("12 MG Road, Mumbai 400001", "Asha Rao", "cs@vahhchemicals.com", "https://www.vahhchemicals.com")


def test_party_windows_are_arguments(spark):
    """A phone far behind the name counts by default, and not within the surveyed window."""
    far = "Registrar to the Issue: Kfin Technologies Limited " + "see the section " * 40 + "Tel: +91 40 6716 2222"
    d = docs(spark, far, far + " Lead Manager: Second House Limited Phone: 040-55554444")
    whole = {(r.doc_id, r.role): r.phone for r in parties.party_mentions(d).collect()}
    assert whole[0, "registrar"] == whole[1, "registrar"] == "+91 40 6716 2222" and whole[1, "lead_manager"] == "040 55554444"
    near = {(r.doc_id, r.role): r.phone for r in parties.party_mentions(d, 300, 220).collect()}
    assert near[0, "registrar"] is None and near[1, "lead_manager"] == "040 55554444"
    office = "Registered Office: 1 Hill Road Tel: 022-1111111 " + "text " * 200 + "Contact Person: Asha Rao 12"
    c = docs(spark, office, company_name="None Ltd")
    assert parties.company_contacts(c).first().contact_person == "Asha Rao" and parties.company_contacts(c, office_chars=700).first().contact_person is None


def test_canonical_mention(spark):
    df = spark.createDataFrame([(["Rikhav Securities Limited", "RIKHAV SECURITIES LIMITED", "Other Broking Limited", "Other Broking Limited", "Other Broking Ltd Limited"],), ([],)], "names array<string>")
    got = [r.v for r in facts.canonical_mentions(df, "names", "v").collect()]
    assert got == [["Other Broking Limited", "Rikhav Securities Limited"], []]


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_row_labels_are_read_once_for_all_rules(spark):
    from offerloom.rules import tables as TR

    d = docs(spark, FIN)
    few, many = (planned(d.select(tables.rule_score(F.array(F.split("text", " ")), TR.STATEMENT_METRICS[:n]).alias("s"))) for n in (1, 9))
    assert few.count("trim(") == many.count("trim(")


def test_names_are_split_once(spark):
    from offerloom.functions import distinct_names, split_person_names

    d = spark.createDataFrame([("Asha Rao and asha rao, Mr. Dev Shah, xy",)], "t string")
    assert d.select(distinct_names(split_person_names(F.col("t")))).first()[0] == ["Asha Rao", "Dev Shah"]
    plan = planned(d.select(distinct_names(split_person_names(F.reverse("t"))).alias("n")))
    assert plan.count("reverse(") == 1


def test_object_list_is_searched_once(spark):
    d = docs(spark, "following objects: 1. Setting up of a plant (2); 2. setting UP of a plant; 3. New brand campaign*; ")
    out = facts.objects_of_issue(d)
    assert [r.name for r in out.orderBy("ord").collect()] == ["Setting up of a plant", "New brand campaign"]
    assert planned(out).count("following") == 1


def test_part_texts_are_spread_over_tasks(spark, tmp_path):
    from offerloom.plans import sheets

    spark.range(8).selectExpr("id AS p_partkey", "CAST(id AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for query in (sheets.issue_details, sheets.issue_structures):
        out = query(spark, str(tmp_path))
        assert "RepartitionByExpression" in planned(out) and out.count() == 8


def test_contents_read_their_pages_once(spark):
    lines = it([(1, 10 * i, f"{t} ..... {n}") for i, (t, n) in enumerate([("RISK FACTORS", 20), ("Capital Structure", 50), ("OUR BUSINESS", 90), ("Dividend Policy", 95)])], page=2)
    out = items.locate_by_contents(spark.createDataFrame(lines + it([(1, 5, "Our Management")], page=9), ITEM))
    got = {r.section: tuple(r)[2:] for r in out.collect()}
    assert got["RISK_FACTORS"] == (20, 49, None, None, "toc") and got["DIVIDEND_POLICY"] == (95, None, None, None, "toc")
    assert got["OUR_MANAGEMENT"] == (None, None, 9, None, "fullscan")
    assert planned(out).count("LogicalRDD") == 1


def test_stored_records_are_spread_over_tasks(spark, tmp_path):
    from offerloom.plans import records

    spark.range(9).selectExpr("id AS c_custkey", "CAST(id AS DOUBLE) AS c_acctbal").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert "RepartitionByExpression" in planned(records.documents_map(spark, str(tmp_path)))


def test_mentions_are_searched_once_per_text(spark):
    text = "Registrar to the Issue: Kfin Technologies Limited; Registrar to the Issue: Link Intime Limited; end"
    d = spark.createDataFrame([(text,), ("none",)], "t string")
    found = parties._found(F.col("t"), "registrar", r"(?i)registrar to the issue: (\w+)")
    assert [[(m.pos, m.raw) for m in r[0]] for r in d.select(found).collect()] == [[(0, "Kfin"), (51, "Link")], []]
    plan = planned(d.select(found.alias("f")))
    assert plan.count("regexp_extract_all(") == 2 and plan.count("split(") == 1
    assert "aggregate(" in plan and "split(" not in plan[plan.index("aggregate("):]
