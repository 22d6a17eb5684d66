"""Contiguous shards of least capacity: equal texts stay together, and the largest shard is as small as can be.

Groups of equal texts stand in the order of their least id. The smallest capacity for which a greedy
walk needs no more than the given number of shards is found by binary search. The walk only needs sums
over ranges of ids, of which the driver holds a few thousand. A walk over ranges bounds the capacity from
above, one that may cut inside ranges from below; only the ranges that the latter cuts are split, until the
bounds meet. Within that capacity the cuts then go where shards are most even.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, with_prefix

_RANGES = 4096


@dataclass
class _Ranges:
    """Ranges of ids in order: first id, log2 of the width, bytes and number of groups."""

    starts: list[int]
    shifts: list[int]
    sizes: np.ndarray
    counts: np.ndarray

    @property
    def before(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)])


def greedy(before: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Ends of the shards that a greedy walk fills to `capacity`, or None if these do not suffice."""
    ends, at, n = [], 0, len(before) - 1
    for _ in range(shards):
        to = int(np.searchsorted(before, before[at] + capacity, "right")) - 1
        if to == at < n:
            return None
        ends.append(to)
        at = to
    return ends if at == n else None


def least_capacity(before: np.ndarray, shards: int, least: int) -> int:
    """The smallest capacity from `least` on that the greedy walk can do with."""
    low, high = least, int(before[-1])
    while low < high:
        mid = (low + high) // 2
        if greedy(before, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def even_cuts(before: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Ends of shards near the mean of what is left, none over `capacity`; the greedy ones if that fails."""
    ends, at, n = [], 0, len(before) - 1
    for k in range(shards):
        goal = before[at] + (before[n] - before[at]) / (shards - k)
        to = int(np.searchsorted(before, goal))
        if to > at and to <= n and goal - before[to - 1] < before[to] - goal:
            to -= 1
        to = min(max(to, min(at + 1, n)), n)
        if before[to] - before[at] > capacity:
            to = int(np.searchsorted(before, before[at] + capacity, "right")) - 1
        ends.append(to)
        at = to
    return ends if at == n else greedy(before, capacity, shards)


def _reach(r: _Ranges, before: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Ranges of several groups in which cuts fall if these may be cut anywhere, or None if even so the shards do not suffice.

    No greedy walk over groups gets further: so a capacity that does not suffice here never does.
    """
    inside, at, total = [], 0, int(before[-1])
    for _ in range(shards):
        at += capacity
        if at >= total:
            return inside
        i = int(np.searchsorted(before, at, "right")) - 1
        if r.counts[i] == 1:
            at = int(before[i])
        elif before[i] < at:
            inside.append(i)
    return None


def _to_split(r: _Ranges, shards: int, floor: int) -> tuple[set[int], int, int]:
    """Ranges to split next, and bounds of the least capacity; once they meet, ranges beside the even cuts."""
    before, n = r.before, len(r.starts)
    high = least_capacity(before, shards, floor)
    low, to = floor, high
    while low < to:
        mid = (low + to) // 2
        if _reach(r, before, mid, shards) is None:
            low = mid + 1
        else:
            to = mid
    if low < high:
        return set(_reach(r, before, low, shards)), low, high
    beside = {i for cut in even_cuts(before, high, shards) for i in range(max(0, cut - 2), min(n, cut + 2))}
    return {i for i in beside if r.counts[i] > 1}, low, high


def plan_cuts(groups: DataFrame, shards: int) -> list[int]:
    """First ids of shards 1, 2, …; `groups` has first (long, the order) and size (long).

    Groups that share their first id count as one. Empty input gives no cuts.
    """
    low_id, high_id, total, largest = groups.groupBy("first").agg(F.sum("size").alias("size")).agg(F.min("first"), F.max("first"), F.sum("size"), F.max("size")).first()
    if total is None:
        return []
    shift = 0
    while (high_id >> shift) - (low_id >> shift) >= _RANGES:
        shift += 1

    def sums(rows: DataFrame, s: int) -> list:
        made = rows.groupBy(F.shiftright("first", s).alias("b")).agg(F.sum("size").alias("size"), F.count_distinct("first").alias("n"))
        return sorted((x["b"], x["size"], x["n"]) for x in made.collect())

    first = sums(groups, shift)
    r = _Ranges([b << shift for b, _, _ in first], [shift] * len(first), np.array([s for _, s, _ in first], np.int64), np.array([n for _, _, n in first]))
    floor = max(-(-total // shards), largest)
    while True:
        open_, floor, high = _to_split(r, shards, floor)
        if not open_:
            break
        shift = max(r.shifts[i] for i in open_)
        part = [i for i in open_ if r.shifts[i] == shift]
        finer = max(0, shift - max(1, int(np.log2(2 * _RANGES / len(part)))))
        wanted = F.shiftright("first", shift).isin([r.starts[i] >> shift for i in part])
        split: dict[int, list] = {}
        for b, size, n in sums(groups.filter(wanted), finer):
            split.setdefault((b << finer) >> shift << shift, []).append((b << finer, finer, size, n))
        rows = []
        for i in range(len(r.starts)):
            rows += split[r.starts[i]] if i in open_ and r.shifts[i] == shift else [(r.starts[i], r.shifts[i], int(r.sizes[i]), int(r.counts[i]))]
        r = _Ranges([x[0] for x in rows], [x[1] for x in rows], np.array([x[2] for x in rows], np.int64), np.array([x[3] for x in rows]))
    ends = even_cuts(r.before, high, shards)[:-1]
    return [r.starts[e] if e < len(r.starts) else high_id + 1 for e in ends]


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Shards of documents: doc_id, size, text_crc32, law, shard, slot, grown_shard; the law is `bytes`.

    A size is the text's UTF-8 bytes (null: none) plus 1. Null texts are a group of their own, apart from
    the empty text; a null id orders first. Every row, repeated or not, gets a slot; slots have no gaps.
    """
    text = F.col("text").cast("string")
    raw = F.coalesce(text.cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("key"),
    )
    rows = stored(rows, "shard-rows")
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    groups = stored(rows.groupBy("key").agg(F.min(order).alias("first"), F.sum("size").alias("size")), "shard-groups")
    shard = F.lit(0)
    for cut in plan_cuts(groups, shards):
        shard = shard + (F.col("first") >= cut).cast("int")
    placed = stored(rows.join(groups.select("key", "first"), "key").select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard")), "shard-places")
    slots = with_prefix(placed, ["shard"], ["doc_id", "text_crc32", "size"], F.lit(1).cast("long"), "slot", placed.count())
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
