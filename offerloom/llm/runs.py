"""Periodic runs in word sequences, with a suffix automaton and a link-cut tree over its suffix links.

Words are appended one by one. All nodes above the new prefix in the tree of suffix links now end here, so
the path to the root gets this place as its colour; before that, its segments of one colour tell where their
strings ended last. A segment's longest string, of L words, that ended d <= L words earlier is a square of
period d, and its run starts L + d - 1 words before this one. The last place that reports a period and a start is the
run's end. Preferred paths of the link-cut tree are the segments: an access walks them and makes one path of
them, in amortised logarithmic time.

A run of twelve words or more repeats each of its windows of six words, so texts are first searched for
repeated windows with numpy; the automaton reads only stretches of twelve words or more that such windows cover.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, slices
from .near_dup import mix

SHORTEST = 12
_RUN = "array<struct<start: long, length: long, period: long>>"
_U = np.uint64


class LinkCutTree:
    """Paths of one colour in a rooted forest; node 0 stands for none. Each path is a splay tree, by depth."""

    def __init__(self) -> None:
        self.up, self.left, self.right, self.colour = [0], [0], [0], [0]

    def add(self, parent: int) -> int:
        """A new leaf below `parent`, a path of its own."""
        self.up.append(parent)
        self.left.append(0)
        self.right.append(0)
        self.colour.append(0)
        return len(self.up) - 1

    def splay(self, x: int) -> None:
        """Make x the root of its path's splay tree, which carries the path's colour and the node above the path."""
        up, left, right, colour = self.up, self.left, self.right, self.colour
        p = up[x]
        while p and (left[p] == x or right[p] == x):
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            # Zig-zig turns the parent first.
            first = p if inner and (left[g] == p) == (left[p] == x) else x
            for y in (first, x) if inner else (x,):
                a = up[y]
                b = up[a]
                if left[a] == y:
                    c = left[a] = right[y]
                    right[y] = a
                else:
                    c = right[a] = left[y]
                    left[y] = a
                if c:
                    up[c] = a
                up[a] = y
                up[y] = b
                if b and left[b] == a:
                    left[b] = y
                elif b and right[b] == a:
                    right[b] = y
                else:
                    colour[y] = colour[a]
            p = up[x]

    def insert_above(self, node: int) -> int:
        """A new node between `node` and its parent, on the path of `node`."""
        self.splay(node)
        new = self.add(node)
        low = self.left[new] = self.left[node]
        if low:
            self.up[low] = new
        self.left[node] = new
        return new

    def access(self, node: int, colour: int) -> Iterator[tuple[int, int]]:
        """(deepest node, colour) of the path segments from `node` to the root, which then are one path of the new colour."""
        up, right, colours = self.up, self.right, self.colour
        below = 0
        while node:
            self.splay(node)
            yield node, colours[node]
            rest = right[node]
            if rest:
                colours[rest] = colours[node]
            right[node] = below
            below, node = node, up[node]
        colours[below] = colour


def squares(words: Sequence) -> dict[tuple[int, int], int]:
    """(period, start) -> last place, of all maximal repetitions of at least two periods."""
    tree = LinkCutTree()
    # Node 1 is the empty string. Transitions by word, longest string, suffix link.
    root = tree.add(0)
    step: list[dict] = [{}, {}]
    longest, link = [0, 0], [0, 0]
    found: dict[tuple[int, int], int] = {}
    last = root
    for i, word in enumerate(words):
        size = longest[last] + 1
        p = last
        while p and word not in step[p]:
            p = link[p]
        if not p:
            above = root
        else:
            q = step[p][word]
            if longest[q] == longest[p] + 1:
                above = q
            else:
                above = tree.insert_above(q)
                longest.append(longest[p] + 1)
                link.append(link[q])
                step.append(step[q].copy())
                link[q] = above
                while p and step[p].get(word) == q:
                    step[p][word] = above
                    p = link[p]
        current = tree.add(above)
        longest.append(size)
        link.append(above)
        step.append({})
        p = last
        while p and word not in step[p]:
            step[p][word] = current
            p = link[p]
        last = current
        # Places count from 1 as colours; 0 is never.
        for node, ended in tree.access(current, i + 1):
            if ended:
                period, long = i + 1 - ended, longest[node]
                if period <= long:
                    found[period, i + 1 - long - period] = i
    return found


def runs_of(words: Sequence, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of `shortest` words or more, by start, then period."""
    out = [(s, e + 1 - s, q) for (q, s), e in squares(words).items() if e + 1 - s >= shortest]
    return sorted((s, n, q) for s, n, q in out)


def _stretches(keys: np.ndarray, doc: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """Ranges of words that repeated windows of half the shortest run's words cover, as far as long enough for a run.

    `keys` are hashes of words, `doc` their document. A window counts if it occurs again in the same range.
    """
    span = shortest // 2
    edges = np.searchsorted(doc, np.arange(int(doc[-1]) + 2)) if len(doc) else np.zeros(1, int)
    starts, ends = edges[:-1], edges[1:]
    for _ in range(3):
        long = ends - starts >= shortest
        starts, ends = starts[long], ends[long]
        if not len(starts):
            break
        n = ends - starts - span + 1
        part = np.repeat(np.arange(len(starts)), n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + starts[part]
        h = mix(part.astype(np.uint64) + _U(1))
        for k in range(span):
            h = h * _U(0xC2B2AE3D27D4EB4F) + keys[at + k]
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        again = np.zeros(len(h), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        # Windows that follow each other within a window's words and part make one range.
        at, part = at[again], part[again]
        if not len(at):
            return []
        new = np.concatenate([[True], (np.diff(at) > span) | (np.diff(part) > 0)])
        starts, ends = at[new], at[np.concatenate([new[1:], [True]])] + span
    long = ends - starts >= shortest
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def find(texts: Sequence[str | None], shortest: int = SHORTEST) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Per text its words and its runs."""
    for a, b in slices([t or "" for t in texts]):
        words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts[a:b]]
        flat = [w for ws in words for w in ws]
        counts = np.array([len(w) for w in words])
        # Equal words have equal hashes; others that share one only make a stretch longer.
        keys = np.fromiter(map(hash, flat), np.int64, len(flat)).view(np.uint64)
        held: list[list[tuple[int, int, int]]] = [[] for _ in words]
        offsets = np.concatenate([[0], np.cumsum(counts)])
        doc = np.repeat(np.arange(len(words)), counts)
        for lo, hi in _stretches(keys, doc, shortest):
            d = int(doc[lo])
            held[d] += [(lo - int(offsets[d]) + s, n, q) for s, n, q in runs_of(flat[lo:hi], shortest)]
        yield from zip(words, map(sorted, held), strict=True)


def collapsed(words: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> str:
    """The words joined by spaces, without those that follow the first period of a run."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
        words = [words[i] for i in kept.tolist()]
    return b" ".join(words).decode("utf-8", "replace")


def find_runs(docs: DataFrame, text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """Add `runs`, by start, then period, and `collapsed`, the text without the repetitions.

    Words are divided by ASCII white space. A run is a stretch of words with a smallest period that occurs
    twice or more in it, at least `shortest` words long, which no neighbouring word extends. A null or empty text has no
    runs and an empty collapsed text. Rows stay as they are. Columns of these two names raise ValueError.
    Memory grows with the longest stretch that repeated windows cover, about a kilobyte a word.
    """
    for name in ("runs", "collapsed"):
        if name in docs.columns:
            raise ValueError(f"the column {name} is there already")
    docs = docs.withColumn(text, F.col(text).cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = docs.columns.index(text)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for words, runs in find(batch.column(at).to_pylist(), shortest):
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(collapsed(words, runs))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind), pa.array(texts, pa.string())], names=[*batch.schema.names, "runs", "collapsed"])

    return docs.mapInArrow(run, f"{schema}, runs {_RUN}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """The query's texts: in a tenth of the documents, by a checksum of doc_id, the words repeat from some place on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("w", F.when((h % 10 == 0) & F.col("text").isNotNull(), words))
    n = F.when(F.size("w") > 0, F.size("w"))
    first = g % n
    period = 1 + F.floor((n - first) / (3 + g % 8))
    place = lambda i: F.when(i < first, i).otherwise(first + (i - first) % period).cast("int")
    repeated = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", place(i))))
    return rows.select("doc_id", F.when(n.isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Per row of find_runs: doc_id, the number of runs, the longest run and digests of the runs and the collapsed text."""
    best: Column = F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], F.when(a["length"] > b["length"], -1).otherwise(1)).when(
        a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)))
    top = F.get(best, F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        F.floor(1000 * top["length"] / top["period"]).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
