"""What a Python worker holds at a time when texts are judged or vectors are searched."""

from __future__ import annotations

import tracemalloc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm import langid, mtree

LESSON = (["the cat sat on the mat and slept"] * 20 + ["der hund lief in den wald hinein"] * 20, ["en"] * 20 + ["de"] * 20)


def test_batches_of_long_texts_end_at_bytes(spark: SparkSession) -> None:
    """They had 10,000 rows, whatever the length of the texts."""
    docs = spark.range(4000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the cat sat. "), 300).alias("text"))
    judged = langid.identify(docs, langid.train(*LESSON, buckets=1 << 10))

    @F.pandas_udf("long")
    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([len(batch)] * len(batch))

    assert judged.filter("lang_pred = 'en'").count() == 4000
    assert docs.select(rows("text").alias("n")).agg(F.max("n")).first()[0] < 1000


def test_judging_many_texts_holds_few_characters() -> None:
    model = langid.train(*LESSON, buckets=1 << 10)
    texts = ["the cat sat on the mat " * 100] * 900
    tracemalloc.start()
    names = langid.judge_texts(model, texts)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(names) == {"en"}
    assert peak < 25e6


def test_queries_ask_subtrees_by_tiles(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Each query was a row, with its vector, for each subtree it asks."""
    v = np.random.default_rng(4).normal(size=(1200, 8))
    table = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    kept: dict[str, DataFrame] = {}
    real = mtree.stored
    monkeypatch.setattr(mtree, "stored", lambda df, name: kept.setdefault(name, real(df, name)))
    index = mtree.Index(mtree.quantised(table), subtree=60)
    got = index.search(index.vectors, 5).collect()
    q = np.floor(64 * v).astype(np.int64)
    want = []
    for i in range(1200):
        s = q @ q[i]
        want += [(i, r, j, int(s[j])) for r, j in enumerate([j for j in np.lexsort((np.arange(1200), -s)).tolist() if j != i][:5], 1)]
    assert sorted(map(tuple, got)) == want
    assert len(index.subtrees) > 10
    # Three tiles of at most 512 queries.
    assert 0 < kept["mtree-asked"].count() <= 3 * len(index.subtrees)


def test_asking_many_subtrees_holds_few_queries() -> None:
    """A worker held all subtrees that the queries of a batch ask, each with their vectors."""
    rng = np.random.default_rng(5)
    n, w, subs = 2048, 32, 1000
    whole, routers = rng.integers(-100, 100, (n, w)), rng.normal(0, 50, (20, w))
    norms = (whole.astype(float) ** 2).sum(axis=1)
    tiles = mtree._tiles(0, np.arange(n), whole, norms, np.full(n, mtree._NONE))
    subtrees = pd.DataFrame({"tree": np.arange(subs) % 20, "sub": np.arange(subs) // 20, "reach": np.full(subs, 1e3)})
    tracemalloc.start()
    rows = asked = sent = 0
    for frame in mtree.asking(iter([tiles]), False, subtrees, routers, float(norms.max())):
        rows, asked = rows + len(frame), asked + int(frame["n"].sum())
        sent += sum(frame[c].map(len).sum() for c in ("ids", "vectors", "norms", "least"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(tiles) * subs and asked == n * (subs - 1) and sent > 100e6
    assert peak < 60e6


def test_integers_travel_in_few_bytes() -> None:
    for top, size in ((0, 1), (127, 1), (128, 2), (1 << 40, 8), ((1 << 63) - 1, 8)):
        whole = np.array([[top, 0, -top - 1]])
        held = mtree._packed(whole)
        assert len(held) == 3 * size and mtree._unpacked(held, 1, 3).tolist() == whole.tolist()
