"""Scalar functions against the fixture values and plain-Python models."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerloom import functions as fn
from offerloom.functions.doctype import admission, canonical_section, classify_by_cover, classify_by_name, classify_document, short_section
from offerloom.sources.feeds import status_from_detail

D = dt.date


def L(x):
    return F.lit(x)


@pytest.mark.parametrize("text,want", [
    ("Apex Corp & Co!", "apex"), ("Apex Logistics Limited", "apex logistics"), ("Foo Ltd.", "foo"),
    ("Acme IPO Details", "acme"), (None, ""), ("  A B  ", "a b"), ("Cocoa Company", "cocoa"),
])
def test_normalize_company(one, text, want):
    assert one(v=fn.normalize_company(L(text).cast("string"))).v == want


@pytest.mark.parametrize("text,want", [("RELIANCE-EQ", "RELIANCE"), ("500180.BO", "500180"), ("abc.ns", "ABC"), (None, "")])
def test_normalize_symbol(one, text, want):
    assert one(v=fn.normalize_symbol(L(text).cast("string"))).v == want


@pytest.mark.parametrize("text,suffix,want", [
    ("Foo & Bar Ltd.", None, "foo-and-bar-ipo"), ("Acme", "NSE-123", "acme-ipo-nse123"), ("Hexagon Nutrition Limited", None, "hexagon-nutrition-ipo"),
    (None, None, "unknown-ipo"), ("Limited", None, "unknown-ipo"),
])
def test_slugify(one, text, suffix, want):
    s = None if suffix is None else L(suffix)
    assert one(v=fn.slugify(L(text).cast("string"), s)).v == want


@pytest.mark.parametrize("text,want", [
    ("2026-05-25", D(2026, 5, 25)), ("25-MAY-2026", D(2026, 5, 25)), ("05 Jun 2026", D(2026, 6, 5)), ("5 June 2026", D(2026, 6, 5)),
    ("31-Feb-2026", None), ("Jun 5, 2026", D(2026, 6, 5)), ("2026-06-05T10:00:00Z", D(2026, 6, 5)), ("soon", None), (None, None),
    ("12-Xyz-2026", None),
])
def test_parse_date(one, text, want):
    assert one(v=fn.parse_date(L(text).cast("string"))).v == want


@pytest.mark.parametrize("text,want", [
    ("2026-06-09", D(2026, 6, 9)), ("9-Jun-2026", D(2026, 6, 9)), ("09-JUN-2026", D(2026, 6, 9)), ("2026-06-09T00:00", None),
    ("2026-13-01", None), ("32-Jun-2026", None), ("", None),
])
def test_strict_date(one, text, want):
    assert one(v=fn.strict_date(L(text))).v == want


def test_date_guard_and_status(one):
    d = lambda s: L(s).cast("date")
    row = one(
        a=fn.within_days(d("2026-06-05"), d("2026-06-15")), b=fn.within_days(d("2026-06-05"), d("2026-07-05")),
        c=fn.within_days(d("2026-06-05"), d("2026-07-10")), n=fn.within_days(d(None), d("2026-07-10")),
        s1=fn.infer_status(d("2026-06-05"), d("2026-06-09"), d("2026-06-12"), d("2026-06-07")),
        s2=fn.infer_status(d("2026-06-10"), d("2026-06-12"), d("2026-06-17"), d("2026-06-07")),
        s3=fn.infer_status(d("2026-05-01"), d("2026-05-05"), d("2026-05-08"), d("2026-06-07")),
        s4=fn.infer_status(d(None), d(None), d(None), d("2026-06-07")),
    )
    assert (row.a, row.b, row.c, row.n) == (True, True, False, False)
    assert (row.s1, row.s2, row.s3, row.s4) == ("open", "upcoming", "listed", None)


@pytest.mark.parametrize("text,start,end", [
    ("05th – 09th Jun 2026", D(2026, 6, 5), D(2026, 6, 9)), ("12 Jun 2026", D(2026, 6, 12), D(2026, 6, 12)), ("To be announced", None, None),
])
def test_day_range(one, text, start, end):
    v = one(v=fn.parse_day_range(L(text))).v
    assert (v.start, v.end) == (start, end)


@pytest.mark.parametrize("text,lo,hi", [
    ("Rs.326 to Rs.343", 326, 343), ("Rs.42 to Rs.45", 42, 45), ("100", 100, 100), ("1,200-1,300", 1200, 1300), ("", None, None),
    ("TBA", None, None), (None, None, None), ("0", None, None),
])
def test_price_range(one, text, lo, hi):
    v = one(v=fn.parse_price_range(L(text).cast("string"))).v
    assert (v.minimum, v.maximum) == (lo, hi)


@pytest.mark.parametrize("text,lo,hi", [("₹42 – ₹45", 42, 45), ("₹110 ₹116", 110, 116), ("₹1,053", 1053, 1053), ("To be announced", None, None)])
def test_price_band(one, text, lo, hi):
    v = one(v=fn.parse_price_band(L(text))).v
    assert (v.minimum, v.maximum) == (lo, hi)


@pytest.mark.parametrize("text,want", [
    ("(6.80)", -6.8), ("₹ 1,053", 1053), ("—", None), ("12%", 12), ("-5", -5), ("1.2.3", None), ("", None), ("(50)", -50), (None, None), (".5", 0.5),
])
def test_parse_num(one, text, want):
    assert one(v=fn.parse_num(L(text).cast("string"))).v == want


def test_other_numbers(one):
    row = one(
        i=fn.parse_indian_num(L("$ 1,234.5")), f=fn.leading_float(L("12abc")), g=fn.leading_float(L("abc")), n=fn.parse_indian_number(L("1,23,456x")),
        s=fn.parse_shares(L("1,42,46,200*")), t=fn.parse_shares(L("[●]")), r=fn.round2(L(-0.125)), r2=fn.round2(L(0.125)),
        p=fn.looks_like_period(L("31 March 2025")), q=fn.looks_like_period(L("FY24")), z=fn.looks_like_period(L("Particulars")),
        a=fn.approx_equal(L(None).cast("double"), L(1.0)), m=fn.values_match(L(None).cast("double"), L(1.0)), m2=fn.values_match(L(100.0), L(100.9)),
    )
    assert (row.i, row.f, row.g, row.n, row.s, row.t) == (1234.5, 12, None, 123456, 14246200, None)
    assert row.r == pytest.approx(-0.12) and row.r2 == 0.13
    assert (row.p, row.q, row.z, row.a, row.m, row.m2) == (True, True, False, None, False, True)


def test_paths_and_premium_dates(one):
    row = one(
        i=fn.trailing_path_id(L("/gmp/foo-ipo/2199/")), j=fn.trailing_path_id(L("/x")), d=fn.day_first_date(L("09-06-2026")), n=fn.day_first_date(L("9-6-26")),
        e=fn.epoch_ms_date(L(1780633800000)), z=fn.epoch_ms_date(L(0).cast("bigint")), u=fn.norm_url(L(" http://x/a/ ")), h=fn.page_hash(L("a  b\n")), h2=fn.page_hash(L("a b")),
        k=fn.artifact_key(L("ab&c"), L("rhp"), "md"), t=fn.trailing_page_number(L("Risk Factors ....... 24")), t2=fn.trailing_page_number(L("Risk")),
    )
    assert (row.i, row.j, row.d, row.n, row.e, row.z) == (2199, None, D(2026, 6, 9), None, D(2026, 6, 5), None)
    assert row.u == "http://x/a" and row.h == row.h2 and row.k == "ipos/AB_C/rhp.md" and (row.t, row.t2) == (24, None)


def test_names(one):
    row = one(
        o=fn.clean_object_name(L("1. Funding working capital (1)")), c=fn.canon_name(L("Lead Manager to the Issue, being Marwadi Chandarana Limited")),
        p=fn.clean_phone(L("+91-22 (1234)")), e=fn.clean_email(L(" A@B.com ")), t=fn.name_token(L("M/s. Marwadi")), ok=fn.looks_like_party(L("Marwadi Limited")),
        no=fn.looks_like_party(L("National Stock Exchange of India Limited")), s=fn.distinct_names(fn.split_person_names(L("Mr. Amit Shah, Ravi Kumar and AMIT SHAH."))),
        x=fn.split_person_names(L("the issue")), y=fn.split_person_names(L("our company shall, Raj")), h=fn.normalize_heading(L("Objects of the Issue!! ")),
    )
    assert row.o == "Funding working capital" and row.c == "Marwadi Chandarana Limited"
    assert (row.p, row.e, row.t, row.ok, row.no) == ("+91 22 1234", "a@b.com", "marwadi", True, False)
    assert row.s == ["Amit Shah", "Ravi Kumar"] and row.x == [] and row.y == [] and row.h == "objects of the issue"


def test_clean_text(one):
    assert one(v=fn.clean_text(L("a  \r\nb\x00\n\n\n\nc\t\n"))).v == "a\nb\n\nc"


@pytest.mark.parametrize("url,kind", [
    ("https://x/rhphorizon.pdf", "rhp"), ("https://x/abc-drhp.pdf", "drhp"), ("https://x/company-final.pdf", "final"), ("https://x/SUSAN_inprinciple.pdf", None),
    ("https://x/Draft%20Red%20Herring%20Prospectus.pdf", "drhp"), ("https://x/Red-Herring-Prospectus.pdf", "rhp"), ("https://www.sebi.gov.in/filings/public-issues/x.html", "drhp"),
])
def test_classify_by_name(one, url, kind):
    assert one(v=classify_by_name(L(url))).v.doc_type == kind


def test_classify_document(one):
    row = one(
        a=classify_by_cover(L("x draft red  herring\nprospectus")), b=classify_by_cover(L("RED HERRING PROSPECTUS")), c=classify_by_cover(L("the Prospectus")),
        n=classify_by_cover(L("nothing")), d=classify_document(L("https://x/a.pdf")), e=classify_document(L("https://x/drhp.pdf"), L("Red Herring Prospectus")),
        s=canonical_section(L("kpis")), s2=short_section(L("basisForOfferPrice")), s3=canonical_section(L("zz")),
    )
    assert (row.a.doc_type, row.b.doc_type, row.c.doc_type, row.n, row.d.doc_type, row.d.confidence, row.e.doc_type) == ("drhp", "rhp", "final", None, "drhp", 0.3, "rhp")
    assert (row.s, row.s2, row.s3) == ("basisForOfferPrice", "kpis", "zz")


@pytest.mark.parametrize("name,pages,head,want", [
    ("Corrigendum_x.pdf", 100, "", "not_a_prospectus"), ("abridged.pdf", 100, "", "abridged_detected"), ("a.pdf", 2, "", "not_a_prospectus"),
    ("a.pdf", 2, "Abridged", "abridged_detected"), ("a.pdf", 10, "abridged", "abridged_detected"), ("a.pdf", 0, "", "success"), ("a.pdf", 300, "abridged", "success"),
])
def test_admission(one, name, pages, head, want):
    assert one(v=admission(L(name), L(pages), L(head))).v == want


@pytest.mark.parametrize("bucket,status,price,on,want", [
    ("closed", None, 10.0, None, "listed"), ("open", "ACTIVE", None, [], "open"), ("open", "PRE_APPLY", None, None, "upcoming"),
    ("closed", "LISTED", None, ["NSE"], "listed"), ("closed", None, None, None, "closed"),
])
def test_status_from_detail(one, bucket, status, price, on, want):
    listed = L(None).cast("array<string>") if on is None else F.array(*[L(x) for x in on]).cast("array<string>")
    assert one(v=status_from_detail(L(bucket), L(status).cast("string"), L(price).cast("double"), listed)).v == want


def model_score(a, b):
    """Plain model of the similarity formula."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    free = list(range(len(b)))
    left, taken = [], []
    for i, ch in enumerate(a):
        j = next((j for j in free if abs(i - j) <= reach and b[j] == ch), None)
        if j is not None:
            free.remove(j)
            left.append(ch)
            taken.append(j)
    if not left:
        return 0.0
    right = [b[j] for j in sorted(taken)]
    m = len(left)
    t = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    p = 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return jaro + p * 0.1 * (1 - jaro)


def test_jaro_winkler_fixture(spark):
    rows = [("apex logistics", "tata motors"), ("apex logistics", "apex logistix"), ("apex logistics", "apex diagnostics"), ("apex", ""), ("apex", None), ("x", "x")]
    got = [r.s for r in spark.createDataFrame(rows, "a string, b string").select(fn.jaro_winkler(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[0] < 0.70 and got[1] >= 0.90 and got[2] >= 0.90 and got[3:] == [0, 0, 1]


def test_jaro_winkler_model():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcd e1") for _ in range(rng.randint(0, 14)))
    pairs = [(word(), word()) for _ in range(3000)] + [(w, "".join(rng.sample(w, len(w)))) for w in (word() for _ in range(2000))]
    a, b = (np.array(x, dtype=object) for x in zip(*pairs))
    got = fn.score_pairs(a, b)
    want = np.array([model_score(x, y) for x, y in pairs])
    assert np.abs(got - want).max() < 1e-12


def test_group_heads_score_only_pairs_that_may_be_near(monkeypatch):
    import random

    import numpy as np

    from offerloom.functions import similarity

    rng = random.Random(5)
    words = ["rikhav", "spread", "x", "securities", "broking", "nirmal", "bang", "limited", "ltd", "Ünal", ""]
    rows = [[" ".join(rng.choices(words, k=rng.randint(0, 4))) for _ in range(rng.randint(0, 7))] for _ in range(300)]
    a, b = (np.array([rng.choice(rng.choice(rows) or [""]) for _ in range(4000)], dtype=object) for _ in range(2))
    assert (similarity.most_scores(a, b) >= similarity.score_pairs(a, b) - 1e-9).all()
    scored, score = [], similarity.score_pairs
    monkeypatch.setattr(similarity, "score_pairs", lambda x, y: scored.append(len(x)) or score(x, y))
    got, few = similarity.group_heads(rows, 0.9), sum(scored)
    scored.clear()
    monkeypatch.setattr(similarity, "most_scores", lambda x, y: np.ones(len(x)))
    assert got == similarity.group_heads(rows, 0.9) and few < sum(scored) / 2
