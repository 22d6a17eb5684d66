"""Hard negatives by exact integer products that are computed several at a time.

Components become integers. Several candidates share one 64-bit word per component: each candidate's biased
component has its own field. An anchor's component multiplies the whole word once, and the sum over
components holds every candidate's score plus the bias, field by field. By Cauchy and Schwarz a score lies
within ±R, R = |anchor| |candidate|; R is added before the fields are read, so none borrows from the next.
Sums are taken modulo 2^64, in which the fields fit; how many candidates share a word follows from the
largest norms of the anchors and of the block.

Candidates lie in blocks of bounded size, kept apart by groups of labels. A first pass meets the anchors with
blocks of their label's group and finds positives, a second with all blocks and finds negatives between the
bounds that each positive gives. Both keep the best rows per block before they are ranked.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

BLOCK, ASKED = 8192, 2048
_CHUNK = 64  # anchors multiplied at a time
_TOP = (1 << 63) - 1
_NO_SCORE = -_TOP - 1
_BLOCKS = "grp long, block long, n long, bits long, bias long, reach double, ids binary, labels binary, words binary"
_ANCHORS = "grp long, part long, ids binary, labels binary, vectors binary, scores binary"


def pack(v: np.ndarray, bits: int, bias: int) -> np.ndarray:
    """Words (candidates / fields, components) of integer vectors (candidates, components): fields of `bits` bits."""
    fields = 64 // bits
    held = np.zeros((-(-len(v) // fields) * fields, v.shape[1]), np.uint64)
    held[: len(v)] = (v + bias).view(np.uint64)
    held = held.reshape(-1, fields, v.shape[1])
    words = np.zeros((len(held), v.shape[1]), np.uint64)
    for f in range(fields):
        words += held[:, f] << np.uint64(f * bits)
    return words


def products(anchors: np.ndarray, words: np.ndarray, n: int, bits: int, bias: int, reach: int) -> np.ndarray:
    """Scores (anchors, n) of integer vectors against packed words; every score must lie within ±reach, 2 * reach < 2**bits."""
    fields = 64 // bits
    ones = sum(1 << (f * bits) for f in range(fields))
    shift = np.array([(reach - bias * int(s)) * ones & (1 << 64) - 1 for s in anchors.sum(axis=1)], np.uint64)
    sums = words @ anchors.view(np.uint64).T + shift[None, :]
    out = np.empty((len(anchors), len(words), fields), np.int64)
    mask = np.uint64((1 << bits) - 1)
    for f in range(fields):
        out[:, :, f] = ((sums >> np.uint64(f * bits)) & mask).view(np.int64).T
    return out.reshape(len(anchors), -1)[:, :n] - reach


def wide_products(anchors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Scores of vectors held as doubles with integer values of any size, as the nearest long."""
    a = np.array([[int(x) for x in r] for r in anchors], object).reshape(anchors.shape)
    v = np.array([[int(x) for x in r] for r in vectors], object).reshape(vectors.shape)
    return np.clip(a @ v.T, -_TOP, _TOP).astype(np.int64)


def _matrix(column: pd.Series, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles, at most the largest one; shorter vectors are filled up with zeros."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * scale), -sys.float_info.max, sys.float_info.max)


def _blocks(rows: DataFrame, width: int, scale: int, largest: float) -> DataFrame:
    """One row per block of candidates, packed for anchors whose norms are at most `largest`."""
    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["vec_id", "row"], ignore_index=True)
        v = _matrix(frame["e"], width, scale)
        top = float(np.abs(v).max(initial=0))
        # A little over the real bound, for what doubles round off.
        with np.errstate(over="ignore"):
            norm = float((v * v).sum(axis=1).max(initial=0))
        reach = math.sqrt(largest) * math.sqrt(norm) * (1 + 1e-9) + 1
        wide = not (reach < 2**62 and top < 2**62 and largest < 2.0**124)
        bits = 0 if wide else max(int(2 * reach).bit_length(), int(2 * top).bit_length(), 1)
        words = v if wide else pack(v.astype(np.int64), bits, int(top))
        return pd.DataFrame([(
            int(frame["grp"].iloc[0]), int(frame["block"].iloc[0]), len(v), bits, 0 if wide else int(top), reach,
            frame["vec_id"].to_numpy(np.int64).tobytes(), frame["label"].to_numpy(np.int64).tobytes(), words.tobytes(),
        )], columns=[c.split()[0] for c in _BLOCKS.split(", ")])

    return rows.groupBy("grp", "block").applyInPandas(build, _BLOCKS)


def _anchor_blocks(anchors: DataFrame, width: int, scale: int, keys: list[str]) -> DataFrame:
    """One row per block of anchors; `scores` are those of an anchor's positives, if any."""
    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", ignore_index=True)
        return pd.DataFrame([(
            int(frame["grp"].iloc[0]), int(frame["part"].iloc[0]), frame["vec_id"].to_numpy(np.int64).tobytes(), frame["label"].to_numpy(np.int64).tobytes(),
            _matrix(frame["e"], width, scale).tobytes(), np.concatenate([np.asarray(b, np.int64) for b in frame["scores"]]).tobytes(),
        )], columns=[c.split()[0] for c in _ANCHORS.split(", ")])

    return anchors.groupBy(*keys).applyInPandas(build, _ANCHORS)


def _scored(anchors: pd.Series, block: pd.Series, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """For some anchors at a time: the place of the first and the scores of the block's candidates."""
    vectors = np.frombuffer(anchors["vectors"]).reshape(-1, width)
    n, bits = int(block["n"]), int(block["bits"])
    words = np.frombuffer(block["words"], np.uint64 if bits else float).reshape(-1, width)
    for a in range(0, len(vectors), _CHUNK):
        some = vectors[a : a + _CHUNK]
        if not bits:
            yield a, wide_products(some, words)
        else:
            yield a, products(some.astype(np.int64), words, n, bits, int(block["bias"]), int(block["reach"]))


def _best(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores among `at` (ascending), ties by place."""
    if len(at) > k:
        edge = np.partition(scores[at], len(at) - k)[len(at) - k]
        above = at[scores[at] > edge]
        at = np.concatenate([above, at[scores[at] == edge][: k - len(above)]])
    return at[np.lexsort((at, -scores[at]))]


def _met(anchors: DataFrame, blocks: DataFrame, keys: list[str], tasks: int, look, schema: str) -> DataFrame:
    """Anchor blocks and candidate blocks of equal keys, one pair per key; a count of tasks, since small blocks are much work."""
    n = max(1, min(tasks, 20_000)) * 2
    left, right = (x.repartition(n, *keys).groupBy(*keys) for x in (anchors, blocks))
    return left.cogroup(right).applyInPandas(look, schema)


def hard_negatives(
    rows: DataFrame, anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK, asked: int = ASKED,
) -> DataFrame:
    """Rows (vec_id, label, embedding): per anchor and positive the best rows of other labels within bounds.

    `anchor` marks the anchors; `low` and `high` are percentages of the positive's score. Returns anchor_id,
    positive_id, rank, negative_id, positive_score and negative_score. Rows with a null id, label or vector, or a null
    or non-finite component, take no part; an empty vector and missing components count as zeros. Equal scores
    are ordered by id. An id that occurs in several rows asks once, with the least label and vector; each of its rows can be
    a positive or negative of others, none of its own. Scores beyond a long are the nearest long. Anchors without
    positives, and positives without negatives, give no rows; neither does an empty table.
    """
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), e.alias("e"), anchor.alias("asks"))
    kept = kept.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & F.coalesce(fine, F.lit(True)))
    # Not below the squared norm of the integers.
    square = F.aggregate("e", F.lit(0.0), lambda a, x: a + F.pow(F.abs(x * scale) + 1, F.lit(2.0)))
    kept = stored(kept.withColumn("norm", square).withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    count, asking, width, largest = kept.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1)), F.max(F.size("e")), F.max(F.when(F.col("asks"), F.col("norm")))).first()
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not asking:
        return rows.sparkSession.createDataFrame([], empty)
    width = max(1, width)
    # Labels are dealt to about as many groups as there are blocks; a large group has several blocks.
    grouped = kept.withColumn("grp", F.pmod(F.xxhash64("label"), F.lit(-(-count // block))))
    parts = grouped.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"), F.ceil(F.count(F.when(F.col("asks"), 1)) / asked).alias("parts"))
    parts = stored(parts, "negatives-groups")
    dealt = grouped.join(parts.select("grp", "blocks"), "grp").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
    blocks = stored(_blocks(dealt.select("grp", "block", "vec_id", "label", "e", "row"), width, scale, largest), "negatives-blocks")
    anchors = grouped.filter("asks").groupBy("vec_id").agg(F.min(F.struct("label", "e", "grp")).alias("a")).select("vec_id", "a.*")
    anchors = stored(anchors, "negatives-anchors")

    def nearest(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(mine) and len(theirs):
            a, b = mine.iloc[0], theirs.iloc[0]
            ids, labels = np.frombuffer(a["ids"], np.int64), np.frombuffer(a["labels"], np.int64)
            other, of = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["labels"], np.int64)
            for first, scores in _scored(a, b, width):
                for i, s in enumerate(scores, first):
                    best = _best(s, np.flatnonzero((of == labels[i]) & (other != ids[i])), positives)
                    out += zip([int(ids[i])] * len(best), other[best].tolist(), s[best].tolist(), strict=True)
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"]).astype("int64")

    known = parts.filter("parts > 0")
    asks = anchors.join(known.select("grp", "parts"), "grp").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).withColumn("scores", F.array().cast("array<long>"))
    asks = stored(_anchor_blocks(asks.select("grp", "part", "vec_id", "label", "e", "scores"), width, scale, ["grp", "part"]), "negatives-asks")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = asks.join(known.select("grp", "blocks"), "grp").withColumn("block", each(F.col("blocks"))).drop("blocks")
    right = blocks.join(known.select("grp", "parts"), "grp").withColumn("part", each(F.col("parts"))).drop("parts")
    pairs = known.agg(F.sum(F.col("blocks") * F.col("parts"))).first()[0]
    found = _met(left, right, ["grp", "block", "part"], pairs, nearest, "anchor_id long, positive_id long, positive_score long")
    order = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = stored(found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives), "negatives-positives")

    of_anchor = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    filled = F.concat(F.col("p.positive_score"), F.array_repeat(F.lit(_NO_SCORE), F.lit(positives) - F.size("p")))
    lots = -(-asking // asked)
    asks = anchors.join(of_anchor.select("vec_id", filled.alias("scores")), "vec_id").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(lots)))
    asks = stored(_anchor_blocks(asks.withColumn("grp", F.lit(0).cast("long")), width, scale, ["part"]), "negatives-bounded")

    def between(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for a, b in ((x, y) for _, x in mine.iterrows() for _, y in theirs.iterrows()):
            ids, labels = np.frombuffer(a["ids"], np.int64), np.frombuffer(a["labels"], np.int64)
            given = np.frombuffer(a["scores"], np.int64).reshape(len(ids), positives)
            other, of = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["labels"], np.int64)
            for first, scores in _scored(a, b, width):
                for i, s in enumerate(scores, first):
                    # Scores s with low * p <= 100 * s <= high * p; none where p is negative.
                    limits = [(place, max(-(-low * p // 100), -_TOP), min(high * p // 100, _TOP)) for place, p in enumerate(given[i].tolist(), 1) if p != _NO_SCORE]
                    least, most = min(lo for _, lo, _ in limits), max(hi for _, _, hi in limits)
                    open_ = np.flatnonzero((s >= least) & (s <= most) & (of != labels[i]) & (other != ids[i]))
                    held = s[open_]
                    for place, lo, hi in limits:
                        best = _best(s, open_[(held >= lo) & (held <= hi)], negatives)
                        out += zip([int(ids[i])] * len(best), [place] * len(best), other[best].tolist(), s[best].tolist(), strict=True)
        return pd.DataFrame(out, columns=["anchor_id", "place", "negative_id", "negative_score"]).astype("int64")

    # As many slots as blocks; those of one slot are met by the same task.
    slots = parts.agg(F.sum("blocks")).first()[0]
    left = asks.withColumn("slot", each(F.lit(slots).cast("long")))
    right = blocks.withColumn("slot", F.pmod(F.xxhash64("grp", "block"), F.lit(slots))).withColumn("part", each(F.lit(lots).cast("long")))
    found = _met(left, right, ["slot", "part"], slots * lots, between, "anchor_id long, place long, negative_id long, negative_score long")
    order = W.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.join(chosen, ["anchor_id", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
