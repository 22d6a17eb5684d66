"""Hard negatives, sentence pieces and periodic runs against plain models, and on odd inputs."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerloom.llm import negatives, pieces, runs
from offerloom.llm.queries import QUERIES

ROWS = "vec_id long, label int, embedding array<double>, score double, block long, grp long, e string, place int"
DOCS = "doc_id long, text string, ids2 string, collapsed2 int, w string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with small documents and embeddings, as the queries read them."""
    rnd = random.Random(11)
    folder = tmp_path_factory.mktemp("tables")
    vectors = [(i, rnd.choice([0, 1, 1, 1, 2, None]), [rnd.gauss(0, 0.4) for _ in range(6)]) for i in range(700)]
    vectors += [(700, 1, [100.0] * 6), (14, 1, None), (100, 1, [None] * 6), (800, 2, [float("nan")] * 6), (None, 1, [1.0] * 6), (900, 1, [0.0] * 6)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    words = ["alpha", "beta", "gamma", "delta", "épsilon"]
    texts = [None, "", " \n\t", "one", "a b " * 20, "x" * 300, " " * 300, "\n".join(words * 9)]
    texts += [" ".join(rnd.choice(words[: rnd.randint(1, 5)]) for _ in range(rnd.randint(0, 90))) for _ in range(160)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def plain_negatives(rows, every, scale, k, top, low, high):
    """Rows (vec_id, label, vector) of distinct ids."""
    v = {i: (la, [int(np.floor(x * scale)) for x in e]) for i, la, e in rows}
    out = []
    for a, (la, q) in v.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, w, strict=False)), i, lb) for i, (lb, w) in v.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == la][:k]:
            hard = [(n, t) for t, n, lb in scored if lb != la and low * -s <= 100 * -t <= high * -s][:top]
            out += [(a, p, r, n, -s, -t) for r, (n, t) in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [256, 10**9, 10**12])
def test_negatives_against_all_pairs(spark, scale):
    rnd = random.Random(scale)
    rows = [(i, rnd.randint(0, 3), [rnd.choice([0.0, 0.25, -0.5, rnd.gauss(0, 1)]) for _ in range(rnd.choice([4, 5]))]) for i in range(150)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, scale=scale, positives=3, negatives=4, low=20, high=95, block=64, asked=8)
    want = plain_negatives([(i, la, [*e, 0.0][:5]) for i, la, e in rows], 10, float(scale), 3, 4, 20, 95)
    if scale < 10**12:
        assert sorted(map(tuple, got.collect())) == want
    else:
        # Scores are the nearest long, the count of rows per positive is not known.
        assert all(abs(r[4]) < 1 << 63 and abs(r[5]) < 1 << 63 for r in got.collect())


def test_packed_products_are_exact():
    rng = np.random.default_rng(3)
    for top in (1, 120, 70_000, 1 << 28):
        a, v = rng.integers(-top, top + 1, (9, 16)), rng.integers(-top, top + 1, (23, 16))
        want = a @ v.T
        reach = int(np.abs(want).max())
        bits = max((2 * reach).bit_length(), (2 * top).bit_length())
        assert (negatives.products(a, negatives.pack(v, bits, top), 23, bits, top, reach) == want).all()


def test_negatives_query(spark, tables):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    rows = [r for r in rows if None not in r and None not in r[2] and np.isfinite(r[2]).all()]
    rows = [(i, (la + 1) % 10 if i % 7 == 0 else la, e) for i, la, e in rows]
    got = sorted(map(tuple, QUERIES["op11_hard_negatives"](spark, tables).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    assert got and got == plain_negatives(rows, 100, 256, 5, 10, 30, 90)


def test_negatives_odd_rows(spark):
    rows = [
        (0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (0, 2, [3.0, 0.0]), (1, 1, [2.0, 0.0]), (1, 1, [2.0, 0.0]), (2, 2, [1.0, 0.0]), (2, 2, [1.0, 0.0]),
        (3, None, [1.0, 0.0]), (None, 1, [9.0, 0.0]), (4, 2, None), (5, 2, [None, 1.0]), (6, 2, [float("inf"), 1.0]), (7, 2, []), (8, 2, [1e300, 1e300]),
    ]
    frame = spark.createDataFrame([(*r, 1.0, 2, 3, "x", 4) for r in rows], ROWS)
    got = sorted(map(tuple, negatives.hard_negatives(frame, F.col("vec_id") == 0, scale=1).collect()))
    # The anchor is the least row of id 0; rows of its id are no results, repeated rows are.
    assert got == [(0, 1, r, 2, 2, 1) for r in (1, 1, 2, 2)]
    assert negatives.hard_negatives(frame.limit(0), F.col("vec_id") == 0).count() == 0
    assert negatives.hard_negatives(frame, F.col("vec_id") == 3).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return pieces.Pieces(pieces.default_model())


def odd_texts():
    rnd = random.Random(5)
    letters = "ab▁ \n\t\r{};)éßñ日本ｱ🙂\x00\x1c​<s>0x1the in\U00012345"
    yield from ("", " ", "  a  b ", "a\nb", "<s></s><unk><0x0A>", "▁", "﻿x", " x")
    yield from ("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(3000))
    yield from ("a" * n for n in range(80))
    yield from (" " * n + "x" * (n % 3) for n in range(120))
    yield from ("".join(rnd.choice(part) for _ in range(1500)) for part in ("abcdefghijklmnop0123ABC", [" ", "  ", "\n", "x", " th"], ["the", "ing", "wort", "und"], "日本語の"))


def test_pieces_equal_the_library(encoder):
    texts = list(odd_texts())
    lib = encoder.library
    want = lib.encode(texts, num_threads=1)
    assert [x.tolist() for x in encoder.encode(texts)] == want
    assert encoder.decode(want) == lib.decode(want)


def test_decoding_any_ids(encoder):
    rnd = random.Random(9)
    lists = [[rnd.randint(0, 600) for _ in range(rnd.randint(0, 12))] for _ in range(3000)]
    assert encoder.decode(lists) == [encoder.library.decode(x) for x in lists]


def test_pieces_of_very_long_texts(encoder):
    rnd = random.Random(2)
    for text in ("".join(rnd.choice("abcdefgh") for _ in range(1_200_000)), "wort und " * 400_000, " " * 60_000, "ab" * 700_000):
        assert encoder.encode([text])[0].tolist() == encoder.library.encode(text)


def test_pieces_survive_a_full_cache(encoder, monkeypatch):
    monkeypatch.setattr(pieces, "_HELD", 5)
    texts = [f"word{i % 7} other{i} and more" for i in range(60)]
    assert [encoder.encode([t])[0].tolist() for t in texts] == encoder.library.encode(texts)


def test_pieces_query_and_odd_rows(spark, tables, encoder):
    lib = encoder.library
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op12_sentence_pieces"](spark, tables).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        ids = lib.encode(r["text"] or "", add_eos=True)
        mine = got[r["doc_id"]]
        assert mine["n_tokens"] == len(ids)
        assert mine["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert mine["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    odd = spark.createDataFrame([(1, "x y", "a", 2, "b"), (1, "x y", "a", 2, "b"), (None, None, None, None, None)], DOCS)
    coded = pieces.encode_texts(odd)
    assert coded.columns == [*odd.columns, "ids"] and coded.count() == 3
    assert [r["decoded"] for r in pieces.decode_ids(coded).orderBy("doc_id").collect()] == ["", "x y", "x y"]
    nulls = spark.createDataFrame([(None,), ([None, 2],), ([],)], "ids array<int>")
    assert [r["decoded"] for r in pieces.decode_ids(nulls).collect()] == ["", "", ""]
    assert pieces.round_trip(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pieces.encode_texts(coded)
    with pytest.raises(ValueError):
        pieces.decode_ids(coded, text="text")


def plain_runs(w, shortest=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(shortest, 2 * q) and not any(all(w[k] == w[k + r] for k in range(i, i + n - r)) for r in range(1, q)):
                out.append((i, n, q))
            i = max(i, j) + 1
    return sorted(out)


def test_runs_against_all_periods():
    rnd = random.Random(1)
    for _ in range(1500):
        w = [rnd.choice("abcdefgh"[: rnd.choice([1, 2, 3, 8])]) for _ in range(rnd.randint(0, 60))]
        if len(w) > 10 and rnd.random() < 0.5:
            a = rnd.randrange(len(w))
            p = rnd.randint(1, max(1, (len(w) - a) // 3))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        for shortest in (2, 12):
            assert runs.runs_of(w, shortest) == plain_runs(w, shortest)
        # Several texts of one batch do not touch each other.
        both = list(runs.find([" ".join(w), " ".join(w)]))
        assert [r for _, r in both] == [plain_runs(w)] * 2


def test_runs_of_very_long_texts():
    same = "wort " * 700_000
    assert next(iter(runs.find([same])))[1] == [(0, 700_000, 1)]
    rnd = random.Random(4)
    far = [str(rnd.randrange(10**6)) for _ in range(120_000)]
    text = " ".join([*far, *far, "end", *["x"] * 12])
    assert next(iter(runs.find([text])))[1] == [(0, 240_000, 120_000), (240_001, 12, 1)]


def test_runs_query(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in QUERIES["op13_periodic_runs"](spark, tables).collect()}
    assert len(got) == len(docs)
    some = 0
    for r in docs:
        w = (r["text"] or "").encode().split()
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = plain_runs(w)
        some += bool(found)
        dropped = {j for s, length, q in found for j in range(s + q, s + length)}
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None,) * 3
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        mine = got[r["doc_id"]]
        assert (mine["n_runs"], mine["start"], mine["length"], mine["period"]) == (len(found), *best)
        assert mine["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert mine["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert mine["collapsed_sha256"] == hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in dropped)).hexdigest()
    assert some > 10


def test_runs_odd_rows(spark):
    odd = spark.createDataFrame([(1, "x " * 12, "a", 2, "b"), (1, "x " * 12, "a", 2, "b"), (None, None, None, None, None), (3, "", None, None, None)], DOCS)
    got = runs.find_runs(odd)
    assert got.columns == [*odd.columns, "runs", "collapsed"]
    rows = sorted((r["doc_id"] or 0, len(r["runs"]), r["collapsed"]) for r in got.collect())
    assert rows == [(0, 0, ""), (1, 1, "x"), (1, 1, "x"), (3, 0, "")]
    assert runs.digest(runs.find_runs(runs.planted(odd))).count() == 4
    assert runs.find_runs(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(got)
