"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from offerloom.llm import langid, line_rules, mixing, mtree, near_dup, packing, rans, sharding, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, shard int, slot int, node long, cell long, tokens string"
LONG = "wort " * 30_000
TEXTS = [None, "", "   \n\t ", "one", "one two three four five six", "one two three four five six", LONG, "Zwölf Boxkämpfer, jagen.\nViktor quer über den Sylter Deich!"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, s, None, 7, 0.5, 1, 2, 3, 4, "x") for i, t, la, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "a", "b"][i % 3]) for i, t in enumerate(TEXTS)]
    return frame(spark, [*rows, rows[4], rows[4], (None, "no id here at all", None, None)])


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_language(spark, odd, none):
    docs = odd.drop("score")
    model = langid.fit(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == odd.count()
    assert all((r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"]) == (not (r["text"] or "").strip()) for r in got)
    assert langid.identify(none.drop("score"), langid.fit(none)).count() == 0
    assert langid.identify(docs, langid.fit(none)).filter("lang_pred = 'und'").count() == odd.count()


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    docs = odd.drop("score")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert toxicity.score(none.drop("score"), toxicity.fit(none, labels.limit(0))).count() == 0


def test_line_rules(odd, none):
    got = line_rules.judge(odd).collect()
    assert len(got) == odd.count()
    by_text = {r["text"]: r for r in got}
    assert by_text[None]["clean_text"] is None and by_text[None]["base_failed"] and not by_text[None]["kept"]
    assert by_text[LONG]["n_words"] == 30_000 == by_text[LONG]["n_repeat_words"]
    assert line_rules.judge(none).count() == 0


def test_near_duplicates(odd, none):
    got = near_dup.near_duplicates(odd)
    rows = {(r["doc_id"], r["n_words"]): r["class_id"] for r in got.collect()}
    assert got.count() == odd.count()
    assert rows[0, 0] == rows[1, 0] == rows[2, 0] == 0 and rows[5, 6] == 4 and rows[7, 9] == 7
    assert rows[None, 5] is None
    stay = near_dup.one_of_each(odd)
    assert stay.columns == odd.columns and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in stay.collect()) == [(False, 0), (False, 3), (False, 4), (False, 6), (False, 7), (True, 0)]
    assert near_dup.near_duplicates(none).count() == 0


def test_mixing(odd, none):
    got = mixing.mix_digest(odd, block_words=4, shards=3)
    rows = got.collect()
    assert len(rows) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_digest(odd, block_words=4, shards=3).collect()))
    assert mixing.mix_documents(odd, block_words=4, shards=3).agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0] == sum(r["taken"] for r in rows)
    assert mixing.mix_digest(none).count() == 0 and mixing.mix_documents(none).count() == 0


def test_mixing_joins_its_sources_by_a_table_of_known_size(odd):
    placed = mixing.Mix(odd, 4, 3, {"text": F.col("text")}).placed
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and plan.count("LocalRelation") >= 1


def test_sharding(odd, none):
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == odd.count()
    for k in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    assert sharding.shard_documents(none).count() == 0


def test_packing(odd, none):
    rows = packing.pack_documents(odd).collect()
    assert {r["doc_id"] for r in rows} == {None, *range(len(TEXTS))}
    assert sum(r["length"] for r in rows if r["doc_id"] == 0) == 1
    assert packing.pack_documents(none).count() == 0


def test_token_files(odd, none):
    rows = rans.token_file_digest(odd).orderBy("start").collect()
    assert len(rows) == odd.count() and rows[0]["doc_id"] is None and rows[0]["start"] == 0
    assert [r["doc_id"] for r in rows[1:]] == sorted(r["doc_id"] for r in rows[1:])
    assert rans.token_file_digest(none).count() == 0


def test_warc(spark):
    fake = "x WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"
    pages = [(4, "u\r\nv", fake), (2, None, fake), (3, "u", None), (5, "u", ""), (None, "u", "n"), (6, "u", "ü" * 90_000), (6, "u", "ü" * 90_000), (7, "u", "ü" * 90_000)]
    table = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, refers_to string")
    got = warc.read_archives(spark, warc.write_archives(table), width=50_000).collect()
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == sorted([
        (2, len(fake), "response", None), (4, len(fake), "revisit", 2), (3, 0, "response", None), (5, 0, "revisit", 3),
        (0, 1, "response", None), (6, 180_000, "response", None), (6, 180_000, "response", None), (7, 180_000, "revisit", 6),
    ])
    assert warc.read_archives(spark, warc.write_archives(table.limit(0))).count() == 0


def test_mtree(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (20, [-1.0, 0.5]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (8, [2.0]), (20, [-1.0, 0.5])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mtree.top_products(table).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 20480), (0, 2, 2, 20480), (0, 3, 8, 8192), (0, 4, 20, 0), (0, 5, 20, 0), (20, 1, 0, 0), (20, 2, 1, 0), (20, 3, 2, 0), (20, 4, 8, -8192)]
    assert mtree.top_products(table.limit(0)).count() == 0


def test_warc_payloads_that_look_like_records(spark):
    """Lengths that are no number or too large, and magic lines without end, are only payload."""
    import time

    bad = ["99999999999999999999", "²", "-1", "", "1e3", "12 ", "9" * 18]
    pages = [f"WARC/1.0\r\nContent-Length: {x}\r\n\r\nrest" for x in bad] + ["WARC/1.0\r\n\r\n", "x WARC/1.0\r\nContent-Length: 3\r\n\r\n"]
    pages += ["WARC/1.0\r\na: b\r\n" * 60_000, "WARC/1.0\r\n" * 100_000, "\r\n\r\n" * 100_000, "no colon " * 100_000, "WARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 2_000]
    table = spark.createDataFrame([(i, f"http://h/{i}/WARC/1.0", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    folder = warc.write_archives(table.repartition(2))
    for width in (1 << 24, 30_011):
        begun = time.time()
        got = {r["page_id"]: r["payload_bytes"] for r in warc.read_archives(spark, folder, width=width).collect()}
        assert got == {i: len(p.encode()) for i, p in enumerate(pages)}
        assert time.time() - begun < 120


def test_warc_headers_are_read_in_linear_time(tmp_path):
    import time

    for text in (b"WARC/1.0\r\na: b\r\n" * 60_000, b"WARC/1.0\r\n" * 100_000, b"WARC/1.0\r\n" + b"no colon " * 120_000, b"WARC/1.0\r\nContent-Length: 99999999999999999999\r\n\r\n" * 20_000):
        (tmp_path / "f").write_bytes(text)
        begun = time.time()
        assert not list(warc._headers(f"file://{tmp_path}/f", 0, 1 << 24, len(text)))
        assert time.time() - begun < 5
