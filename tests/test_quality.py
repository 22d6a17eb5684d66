"""Quality checks, gold scoring, files, streams and end-to-end jobs."""

import datetime as dt
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from offerloom.operators import gold, quality
from offerloom.plans.reconcile import extract_facts, reconcile, scrape_into
from offerloom.sources import feeds, files
from offerloom.streaming import jobs
from offerloom.streaming.store import BucketedSnapshot, cascade_delete_stored
from tests.test_documents import FIN, OBJ, PARTY, SHARES_SME
from tests.test_resolve import payloads

D = dt.date
LONG = "doc_id string, metric string, period_idx int, value double"


def statement(spark, values, labels=("FY25", "FY24"), doc="d"):
    rows = [(doc, k, i, v) for k, vs in values.items() for i, v in enumerate(vs)]
    m = spark.createDataFrame([(a, b, c, None if v is None else float(v)) for a, b, c, v in rows], LONG)
    p = spark.createDataFrame([(doc, i, x) for i, x in enumerate(labels)], "doc_id string, period_idx int, label string")
    return m, p


def grounded(spark, g, doc="d"):
    return spark.createDataFrame([(doc, g)], "doc_id string, grounding double")


GOOD = {"revenueFromOperations": [100, 90], "totalIncome": [105, 95], "profitAfterTax": [10, 9], "netWorth": [50, 45], "ronw": [20, 20], "basicEPS": [1.0, 0.9], "dilutedEPS": [1.0, 0.9], "ebitda": [20, 18]}


@pytest.mark.parametrize("change,ground,fails", [
    ({}, 1.0, set()),
    ({}, 0.5, {"grounding"}),
    ({"netWorth": [50]}, 1.0, {"values_aligned:netWorth"}),
    ({"ronw": [60, 20]}, 1.0, {"ronw_consistency:FY25"}),
    ({"basicEPS": [-1.0, 0.9]}, 1.0, {"eps_sign:FY25"}),
    ({"dilutedEPS": [1.5, 0.9]}, 1.0, {"diluted<=basic:FY25"}),
    ({"revenueFromOperations": [200, 90]}, 1.0, {"rev<=income:FY25"}),
    ({"ebitda": [500, 18]}, 1.0, {"ebitda_margin:FY25"}),
])
def test_metric_checks(spark, change, ground, fails):
    m, p = statement(spark, {**GOOD, **change})
    g = grounded(spark, ground)
    checks = quality.metric_checks(m, p, g)
    assert {r.name for r in checks.filter("status = 'fail'").collect()} == fails
    c = quality.statement_confidence(checks, g).first()
    assert (c.confidence >= 0.8 and not c.review_required) == (not fails or all(":FY" in f for f in fails))
    assert (c.hard_fails, c.soft_fails) == (sum(":FY" not in f for f in fails), sum(":FY" in f for f in fails))


def test_metric_checks_gather_a_document_once(spark):
    m, p = statement(spark, GOOD)
    lone = spark.createDataFrame([("e", 0, "FY25")], "doc_id string, period_idx int, label string")
    checks = quality.metric_checks(m, p.unionByName(lone), grounded(spark, 1.0).unionByName(grounded(spark, 1.0, "unread")))
    got = {(r.name, r.status) for r in checks.filter("doc_id <> 'd'").collect()}
    assert got == {("periods_count", "fail"), ("values_aligned", "pass"), ("has_metrics", "fail"), ("grounding", "fail")}
    plan = checks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 0 and plan.count("Aggregate ") == 1


def test_consistency(spark):
    row = dict(doc_id="d", postIssueShares=110, preIssueShares=100, freshIssueShares=10, totalIssueShares=15, ofsShares=5, netOfferShares=10, priceMin=5.0, priceMax=4.0, promoterCount=0, leadManagerCount=0, objectCount=0)
    df = spark.createDataFrame([row], ", ".join(f"{k} {'string' if k == 'doc_id' else 'double' if k.startswith('price') else 'bigint'}" for k in row))
    fail = lambda **k: {r.name for r in quality.consistency_checks(df, **k).filter("status = 'fail'").collect()}
    assert fail() == {"price_band_order", "promoters_non_empty"}
    assert fail(evident_intent=True) == {"price_band_order", "promoters_non_empty", "lead_managers_present", "objects_non_empty_on_fresh_issue"}
    wrong = df.withColumn("postIssueShares", F.lit(111)).withColumn("netOfferShares", F.lit(12))
    assert {"post_equals_pre_plus_fresh", "fresh_ge_reserved_sum"} <= {r.name for r in quality.consistency_checks(wrong).filter("status = 'fail'").collect()}


def test_bounds_and_score(spark):
    f = spark.createDataFrame([("d", "roe", 600.0), ("d", "faceValue", 0.1), ("d", "eps", 1.0), ("e", "other", 1e30)], "doc_id string, field string, value double")
    flags = quality.bounds_flags(f)
    assert {(r.field, r.reason) for r in flags.collect()} == {("roe", "above_max:500"), ("faceValue", "below_min:0.5")}
    docs = spark.createDataFrame([("d",), ("e",)], "doc_id string")
    checks = spark.createDataFrame([("d", "x", "fail"), ("e", "x", "pass")], "doc_id string, name string, status string")
    got = {r.doc_id: (r.score, r.needs_review, r.accepted) for r in quality.validation_score(docs, flags, checks).collect()}
    assert got == {"d": (0.6, True, False), "e": (1.0, False, True)}
    text = spark.createDataFrame([("d", "roe", None, False)], "doc_id string, field string, value double, is_number boolean")
    assert quality.bounds_flags(text).first().reason == "not_a_number"


def test_keys(spark):
    rows = [("roe", "x", "%", "roe"), ("other", "Return on capital employed", "%", "roce"), (None, "Inventory turnover", "x", "inventoryTurnover"), ("other", "zz", "", "other"), ("zz", "zz", "", "zz")]
    df = spark.createDataFrame(rows, "k string, l string, u string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", quality.canonical_key(F.col("k"), F.col("l"))).collect())
    rep = [("ebitdaMargin", "₹ Lakhs", "EBITDA", "ebitda"), ("patMargin", "%", "PAT margin", "patMargin"), ("other", "%", "EBITDA margin", "ebitdaMargin"), ("revenueGrowth", "₹ lakhs", "Revenue", "revenueFromOperations"),
           ("other", "₹ lakhs", "EBITDA", "ebitda"), ("other", "12.5", "Net asset value", "nav"), ("other", "days", "Profit", "other"), ("eps", None, None, "eps")]
    df = spark.createDataFrame(rep, "k string, u string, l string, want string")
    bad = [r for r in df.withColumn("got", quality.repair_key_by_unit(F.col("k"), F.col("u"), F.col("l"))).collect() if r.got != r.want]
    assert not bad


def test_reorder_and_runs(spark):
    v = spark.createDataFrame([("a", 0, D(2023, 3, 31), 13.0), ("a", 1, D(2025, 3, 31), 2.0), ("a", 2, D(2024, 3, 31), 20.0), ("b", 0, D(2023, 3, 31), 1.0), ("b", 1, None, 2.0)], "doc_id string, period_idx int, end_date date, value double")
    got = {}
    for r in quality.reorder_periods(v, ["doc_id"]).orderBy("doc_id", "new_idx").collect():
        got.setdefault(r.doc_id, []).append(r.value)
    assert got == {"a": [2, 20, 13], "b": [1, 2]}
    runs = spark.createDataFrame([("a", 0, True), ("a", 0, False), ("a", 1, True), ("a", 1, True), ("a", 2, True), ("a", 2, True)], "doc_id string, run int, grounded boolean")
    r = quality.best_run(runs).first()
    assert (r.run, r.grounded, r.facts) == (1, 2, 2)
    m = spark.createDataFrame([("a", "x", 0, 1.0), ("a", "x", 1, 2.0), ("a", "y", 0, 5.0), ("a", "y", 1, None)], LONG)
    assert {(x.field, x.value) for x in quality.flatten_metrics(m).collect()} == {("x", 2.0)}
    assert {(x.field, x.value) for x in quality.flatten_metrics(m, which="first").collect()} == {("x", 1.0), ("y", 5.0)}


def test_gold_scores(spark):
    truth = [("S", True, k, i, f"p{i}", float(10 * i + j)) for j, k in enumerate("abc") for i in range(3)] + [("S", True, "d", 0, "p0", None), ("U", False, "a", 0, "p0", 1.0)]
    gdf = spark.createDataFrame(truth, "symbol string, verified boolean, key string, period_idx int, period string, value double")
    fdf = spark.createDataFrame([("S", True), ("U", False), ("E", True)], "symbol string, verified boolean")
    ext = lambda rows: spark.createDataFrame(rows, "symbol string, key string, period_idx int, value double")
    perfect = [(s, k, i, v) for s, _, k, i, _, v in truth if s == "S" and v is not None]
    r = {x.symbol: x for x in gold.score_files(fdf, gold.compare_cells(gdf, ext(perfect))).collect()}
    assert (r["S"].cells, r["S"].correct, r["S"].accuracy, r["E"].cells, r["E"].precision, r["U"].missed) == (9, 9, 1.0, 0, 0.0, 1)
    missed = [p for p in perfect if p[1] != "c"]
    s = {x.symbol: x for x in gold.score_files(fdf, gold.compare_cells(gdf, ext(missed))).collect()}["S"]
    assert (s.missed, s.accuracy, s.precision, s.coverage) == (3, 0.667, 1.0, 0.667)
    wrong = [(a, k, i, v * 2 + 1 if (k, i) == ("b", 1) else v) for a, k, i, v in perfect]
    cells = gold.compare_cells(gdf, ext(wrong))
    s = {x.symbol: x for x in gold.score_files(fdf, cells).collect()}["S"]
    assert (s.wrong, s.precision) == (1, 0.889)
    c = gold.score_corpus(gold.score_files(fdf, cells)).first()
    assert (c.files_total, c.files_verified, c.cells, c.correct) == (3, 2, 9, 8)
    e = gold.cell_errors(cells).filter("symbol = 'S'").first()
    assert (e.key, e.period_idx, e.type, e.expected) == ("b", 1, "wrong", 11.0)


def test_files(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with open(f"{root}/A.gold.json", "w") as f:
        json.dump({"symbol": "A", "_verified": True, "periods": ["FY25", "FY24"], "metrics": {"ebitda": [1, None], "eps": [2.5, 3]}, "_hints": {"ebitda": {"_page": 3, "_quote": "q"}}}, f, indent=1)
    with open(f"{root}/B.gold.json", "w") as f:
        json.dump({"symbol": "B", "_verified": False, "periods": [], "metrics": {}}, f, indent=1)
    g = files.read_gold(spark, f"{root}/*.gold.json")
    cells = {(r.symbol, r.key, r.period_idx): (r.value, r.period, r.verified) for r in files.gold_cells(g).collect()}
    assert cells[("A", "ebitda", 0)] == (1.0, "FY25", True) and cells[("A", "ebitda", 1)][0] is None and files.gold_files(g).count() == 2
    import os

    os.makedirs(f"{root}/md/ACME")
    with open(f"{root}/md/ACME/rhp.md", "w") as f:
        f.write("line one\nline two")
    r = files.read_markdown(spark, f"{root}/md/*").first()
    assert (r.symbol, r.doc_type, r.text) == ("ACME", "rhp", "line one\nline two")
    df = spark.createDataFrame([("a",), ("b",)], "slug string")
    files.write_reconciled(df, df.limit(0), f"{root}/out")
    assert spark.read.parquet(f"{root}/out/master").count() == 2 and not os.path.exists(f"{root}/out/borderline")
    left = files.cascade_delete({"x": df, "y": df}, df.filter("slug = 'a'"))
    assert [d.count() for d in left.values()] == [1, 1]
    with open(f"{root}/m.json", "w") as f:
        json.dump([{"slug": "a"}, {"slug": "b"}], f)
    assert files.read_master(spark, f"{root}/m.json").count() == 2
    sl = spark.createDataFrame([(1, "s", 1, "t"), (1, "u", 2, "t2")], "doc_id bigint, section string, page int, text string")
    files.write_sections(sl, f"{root}/sec")
    assert sorted(os.path.basename(p) for p in os.listdir(f"{root}/sec") if p.startswith("section")) == ["section=s", "section=u"]
    m = files.section_manifest(spark.createDataFrame([(1, "s", 1, 3), (1, "u", 5, 4)], "doc_id bigint, section string, start int, end int")).first().sections
    assert m["s"].pages == "1-3" and m["u"].status == "skipped"
    assert files.with_artifact_key(spark.createDataFrame([("a b", "x", "rhp")], "symbol string, slug string, doc_type string")).first().artifact_key == "ipos/A_B/rhp.md"


def test_streams_restart_from_their_checkpoint(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "slug string, date date, value double, ts timestamp"
    t = lambda h: dt.datetime(2026, 6, 1, h)
    day = D(2026, 6, 1)
    store = BucketedSnapshot(f"{root}/out", spark.createDataFrame([("z", day, 3.0)], "slug string, date date, value double"), buckets=16)
    batches = [
        [("a", day, 1.0, t(1)), ("a", day, 2.0, t(3)), ("b", day, 5.0, t(1))],
        [("a", day, 9.0, t(4)), ("c", day, 7.0, t(1))],
        [("c", day, 8.0, t(9))],
    ]
    rows = spark.createDataFrame([(*r, n) for n, b in enumerate(batches) for r in b], schema + ", n int")
    jobs.replay(rows, [F.col("n") == i for i in range(3)], lambda s: jobs.premium_stream(s, store), "premiums")
    assert {(r.slug, r.value) for r in store.latest().collect()} == {("a", 9.0), ("b", 5.0), ("c", 8.0), ("z", 3.0)}
    # The last batch wrote the bucket of its one key; two manifests are left, and no file that neither names.
    assert store.versions() == [1, 2]
    new, old = store.manifest(2), store.manifest(1)
    assert [b for b, v in new.items() if v == 2] == store.touched(spark.createDataFrame([("c",)], "slug string"))
    on_disk = {(int(b), v) for v in store._numbers("rows", "v=") for b in store._numbers(f"rows/v={v}", "bucket=")}
    assert on_disk == set(new.items()) | set(old.items())
    ev = "entity_id bigint, status string, date date, n int"
    seen = spark.createDataFrame([(1, "open", day, 0), (1, "open", day, 0), (1, "close", day, 0), (1, "open", day, 1), (2, "open", day, 1)], ev)
    jobs.replay(seen, [F.col("n") == 0, F.col("n") == 1], lambda s: jobs.event_stream(s.drop("n"), f"{root}/events"), "events")
    assert sorted(map(tuple, spark.read.parquet(f"{root}/events").collect())) == [(1, "close", day), (1, "open", day), (2, "open", day)]


def test_bucketed_snapshot_retries_and_deletes(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    frame = lambda rows: spark.createDataFrame(rows, "slug string, n int")
    store = BucketedSnapshot(f"{root}/t", frame([(f"s{i}", i) for i in range(40)]), buckets=8)
    rows = lambda: {r.slug: r.n for r in store.latest().collect()}
    for _ in range(2):
        # A batch that runs again reads what its first run read.
        held = store.rows(store.before(0), store.touched(frame([("s1", 0)])))
        store.replace(0, held.withColumn("n", F.col("n") + F.when(F.col("slug") == "s1", 100).otherwise(0)), store.touched(frame([("s1", 0)])))
        assert rows()["s1"] == 101 and len(rows()) == 40
    other = BucketedSnapshot(f"{root}/o", frame([("s1", 1), ("s1", 2), ("x", 3)]), buckets=8)
    cascade_delete_stored([store, other], 1, frame([("s1", 0), ("unknown", 0)]))
    assert "s1" not in rows() and len(rows()) == 39 and [r.slug for r in other.latest().collect()] == ["x"]
    gone = BucketedSnapshot(f"{root}/g", frame([("a", 1)]), buckets=8)
    gone.delete(0, frame([("a", 1)]))
    assert gone.latest().count() == 0 and gone.latest().columns == ["slug", "n"]


def test_snapshot_stream(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    cols = "slug string, isin string, symbol string, company_name string, status string"
    start = spark.createDataFrame([(f"old-{i}-ipo", f"X{i}", None, f"Old {i}", "listed", None, None) for i in range(30)], cols + ", created_at timestamp, updated_at timestamp")
    store = BucketedSnapshot(f"{root}/out", start, buckets=16)
    rec = "seq bigint, isin string, symbol string, company_name string, status string, n int"
    rows = [(1, "I1", "A", "Acme", "open", 0), (2, None, None, "Beta", "open", 0), (3, "I1", None, "Acme Ltd", "closed", 1), (4, "X7", None, "New name", "open", 1)]
    now = lambda: F.lit("2026-06-07").cast("timestamp")
    jobs.replay(spark.createDataFrame(rows, rec), [F.col("n") == 0, F.col("n") == 1], lambda s: jobs.snapshot_stream(s.drop("n"), store, now), "records")
    got = {r.slug: (r.status, r.symbol) for r in store.latest().collect()}
    assert len(got) == 32 and got["acme-ipo"] == ("closed", "A") and got["beta-ipo"] == ("open", None) and got["old-7-ipo"] == ("open", None)
    # The second batch rewrote the buckets of two slugs.
    assert sum(v == 1 for v in store.manifest(1).values()) <= 2


def test_reconcile_and_scrape(spark):
    a = feeds.map_feed_a(payloads(spark, feeds.FEED_A_SCHEMA, [
        {"name": "Apex Logistics IPO", "symbol": "APX", "isin": "I1", "minimum_price": 100, "maximum_price": 110, "bidding_start_date": "2026-06-01", "status": "open"},
        {"name": "Old Co IPO", "symbol": "OLD", "bidding_start_date": "2025-01-01", "status": "listed"}]))
    b = feeds.map_feed_b(payloads(spark, feeds.FEED_B_SCHEMA, [{"symbol": "APX-EQ", "companyName": "Apex Logistics Limited", "ipoStartDate": "02-JUN-2026", "status": "Closed", "rhpUrl": "http://x/rhp.pdf"}]))
    master, border = reconcile([a, b, None], year=2026)
    m = master.collect()
    assert len(m) == 1 and m[0].bidding_start == D(2026, 6, 2) and m[0].rhp == "http://x/rhp.pdf" and m[0].open == D(2026, 6, 1) and border.count() == 0
    now = F.lit("2026-06-07").cast("timestamp")
    first = scrape_into(spark.createDataFrame([], "slug string, isin string, symbol string, company_name string, status string, price_min double, sources map<string,struct<last_fetched:timestamp,url:string>>, created_at timestamp, updated_at timestamp"), [a, b], now)
    r = first.collect()
    assert [(x.slug, x.action) for x in r] == [("apex-logistics-ipo", "new")]
    second = scrape_into(first.drop("action", "changes"), [a, b], now)
    assert [x.action for x in second.collect()] == ["unchanged"]


def test_extract_facts(spark):
    text = "\n\n".join([SHARES_SME, FIN, OBJ, PARTY, "PROMOTERS OF OUR COMPANY: AMIT SHAH AND RAVI KUMAR DETAILS OF THE ISSUE"])
    df = spark.createDataFrame([(1, text, True, "Vahh Chemicals Limited", 100.0, 103.0, 10.0, 103.0), (2, "empty", True, None, None, None, None, None)],
                               "doc_id bigint, text string, is_sme boolean, company_name string, price_min double, price_max double, face_value double, issue_price double")
    out = extract_facts(df)
    v = {r.doc_id: r for r in out["validation"].collect()}
    assert v[1].flagged == 0 and v[1].failed == 0 and v[1].accepted and v[2].score == 1.0
    assert out["facts"].filter("doc_id = 1 AND field = 'freshIssueShares'").first().value == 5269200
    assert out["promoters"].count() == 1 and out["objects"].filter("doc_id = 1").count() == 3
