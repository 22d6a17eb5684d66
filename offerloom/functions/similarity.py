"""Jaro-Winkler similarity as an Arrow UDF that scores a whole batch with numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

PREFIX_SCALE = 0.1  # Fixed value: weight of each of the first four equal characters.


def _codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as a matrix of code points, zero-padded, with their lengths."""
    texts = values.astype(np.str_)
    width = max(texts.dtype.itemsize // 4, 1)
    return texts.view(np.uint32).reshape(len(texts), width), np.char.str_len(texts)


def score_pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Scores of equally long arrays of texts; '' scores 0, equal texts score 1.

    Half transpositions are not rounded and the prefix bonus always applies.
    """
    n = len(left)
    if n == 0:
        return np.zeros(0)
    a, len_a = _codes(left)
    b, len_b = _codes(right)
    window = np.maximum(len_a, len_b) // 2 - 1
    hit_a = np.zeros(a.shape, dtype=bool)
    hit_b = np.zeros(b.shape, dtype=bool)
    reach = int(window.max(initial=0))
    for i in range(a.shape[1]):
        open_rows = i < len_a
        for j in range(max(0, i - reach), min(b.shape[1], i + reach + 1)):
            take = (
                open_rows
                & (j < len_b)
                & (abs(i - j) <= window)
                & ~hit_b[:, j]
                & (a[:, i] == b[:, j])
            )
            hit_a[take, i] = True
            hit_b[take, j] = True
            open_rows = open_rows & ~take
    matches = hit_a.sum(axis=1)
    # Matched characters of both sides, pushed to the front in reading order.
    width = max(a.shape[1], b.shape[1])
    order_a = np.argsort(~hit_a, axis=1, kind="stable")
    order_b = np.argsort(~hit_b, axis=1, kind="stable")
    seq_a = np.zeros((n, width), dtype=np.uint32)
    seq_b = np.zeros((n, width), dtype=np.uint32)
    seq_a[:, : a.shape[1]] = np.take_along_axis(a, order_a, axis=1)
    seq_b[:, : b.shape[1]] = np.take_along_axis(b, order_b, axis=1)
    inside = np.arange(width)[None, :] < matches[:, None]
    moved = ((seq_a != seq_b) & inside).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (matches / len_a + matches / len_b + (matches - moved / 2) / matches) / 3
    jaro = np.where(matches == 0, 0.0, jaro)
    head = min(4, a.shape[1], b.shape[1])
    same = (a[:, :head] == b[:, :head]) & (a[:, :head] != 0)
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    score = np.where(matches == 0, 0.0, jaro + prefix * PREFIX_SCALE * (1 - jaro))
    equal = (left == right) & (len_a > 0)
    return np.where(equal, 1.0, score)


def most_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bounds on score_pairs from above: the characters that two texts share in any places, and their common prefix.

    Characters are counted by their last six bits, which can only make the shared ones more.
    """
    n = len(left)
    if n == 0:
        return np.zeros(0)
    (a, len_a), (b, len_b) = _codes(left), _codes(right)

    def counts(codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        row, at = np.nonzero(np.arange(codes.shape[1])[None, :] < size[:, None])
        return np.bincount(row * 64 + (codes[row, at] & 63).astype(np.int64), minlength=n * 64).reshape(n, 64)

    shared = np.minimum(counts(a, len_a), counts(b, len_b)).sum(axis=1)
    jaro = np.where(shared == 0, 0.0, (shared / np.maximum(len_a, 1) + shared / np.maximum(len_b, 1) + 1) / 3)
    head = min(4, a.shape[1], b.shape[1])
    prefix = np.cumprod(a[:, :head] == b[:, :head], axis=1).sum(axis=1)
    return np.where(shared == 0, 0.0, jaro + prefix * PREFIX_SCALE * (1 - jaro))


@F.pandas_udf(DoubleType())
def _jaro_winkler(left: pd.Series, right: pd.Series) -> pd.Series:
    a = left.fillna("").to_numpy(dtype=object)
    b = right.fillna("").to_numpy(dtype=object)
    out = np.zeros(len(a))
    # Texts of similar length share a matrix, so one long text does not widen the batch.
    size = np.array([max(len(x), len(y)) for x, y in zip(a, b)], dtype=np.int64)
    band = np.ceil(np.log2(np.maximum(size, 1)))
    for value in np.unique(band):
        rows = np.flatnonzero(band == value)
        out[rows] = score_pairs(a[rows], b[rows])
    return pd.Series(out)


def jaro_winkler(left: Column, right: Column) -> Column:
    return _jaro_winkler(left, right)


def group_heads(rows: list[list[str]], threshold: float) -> list[list[str]]:
    """For each list of names the head of every name: the first earlier head it resembles.

    Position by position, all lists of a batch are scored in one call; pairs that cannot reach the threshold are not.
    """
    uniq = [list(dict.fromkeys(r)) for r in rows]
    heads: list[list[str]] = [[] for _ in rows]
    found: list[dict[str, str]] = [{} for _ in rows]
    for pos in range(max(map(len, uniq), default=0)):
        live = [i for i, names in enumerate(uniq) if pos < len(names)]
        owner = [i for i in live for _ in heads[i]]
        a = np.array([h.lower() for i in live for h in heads[i]], dtype=object)
        b = np.array([uniq[i][pos].lower() for i in owner], dtype=object)
        # The bound is computed in other steps than the score; the margin covers their rounding.
        open_pairs = np.flatnonzero(most_scores(a, b) >= threshold - 1e-9)
        near = np.zeros(len(a), dtype=bool)
        near[open_pairs] = score_pairs(a[open_pairs], b[open_pairs]) >= threshold
        flags, at = near.tolist(), 0
        for i in live:
            name, mine = uniq[i][pos], heads[i]
            first = next((k for k in range(len(mine)) if flags[at + k]), None)
            at += len(mine)
            found[i][name] = name if first is None else mine[first]
            if first is None:
                mine.append(name)
    return [[found[i][n] for n in r] for i, r in enumerate(rows)]


def name_groups(names: Column, threshold: float = 0.9) -> Column:
    """Array of names of one document → array with the group head of each name."""

    @F.pandas_udf(ArrayType(StringType()))
    def heads(batch: pd.Series) -> pd.Series:
        return pd.Series(group_heads([[] if r is None else list(r) for r in batch], threshold))

    return heads(names)
