"""Near-duplicate documents: ProbMinHash signatures, banding, exact verification.

The shingles of a document are its runs of five words, weighted by how often they occur. ProbMinHash
lets each shingle arrive at random places of a signature by a Poisson process of its weight; a place
keeps its first arrival, and a shingle stops once it is later than all places' arrivals. Two signatures
agree in a place with the probability Jaccard similarity of the documents. A document with repeated
shingles has a second signature, with all weights 1, whose places agree with the plain Jaccard similarity;
for any other document both are one. Bands of places of either give candidates, which are verified on
their whole texts.

Equal word sequences are one node from the start. Within a bucket of a band, nodes are not paired with
each other but with a pivot: first a random one, then the node with the most links. Nodes already in the
pivot's component are not tested again. Nodes of buckets that then still hold several components meet by
their rarest shingles, in a prefix-filter join that loses no link between them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import slices, stored

SPAN = 5
#: Words of a parity sketch: 1,024 bits.
SKETCH = 16
ROWS = 5
BANDS = 26
_M = ROWS * BANDS
_U = np.uint64
_R, _B1, _B2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1, 0x165667B19E3779F9 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_R))
_WHITE = np.isin(np.arange(256), [32, *range(9, 14)])


@functools.lru_cache(maxsize=12)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _power(base: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 modulo 2**64."""
    return _powers(base, max(20, (n - 1).bit_length() if n else 0))[:n]


def shingles(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of texts as (text index, hash), and per text two keys of its word sequence and its word count.

    Fewer than five words are one shingle; a text without words has none.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    white = _WHITE[data]
    before = np.concatenate([[True], white[:-1]])
    starts = np.flatnonzero(~white & before)
    ends = np.flatnonzero(white & ~before)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _power(_R, len(data)), dtype=np.uint64)])
    inverse = pow(_R, -1, 1 << 64)
    words = mix((sums[ends] - sums[starts]) * _power(inverse, len(data))[starts] + (ends - starts).astype(np.uint64))
    offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    edges = np.searchsorted(starts, offsets)
    counts = np.diff(edges)
    doc = np.repeat(np.arange(len(raw)), counts)
    place = np.arange(len(words)) - edges[:-1][doc]
    keys = []
    for base in (_B1, _B2):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _power(base, int(counts.max(initial=0)) + 1)[place], dtype=np.uint64)])
        keys.append(mix(total[edges[1:]] - total[edges[:-1]] + counts.astype(np.uint64)))
    whole = place + SPAN <= counts[doc]
    first = np.flatnonzero(whole)
    h = np.zeros(len(first), np.uint64)
    for k in range(SPAN):
        h = h * _U(_B1) + words[first + k]
    short = np.flatnonzero((counts > 0) & (counts < SPAN))
    return np.concatenate([doc[first], short]), np.concatenate([mix(h), keys[0][short]]), keys[0], keys[1], counts


def weighted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document and how often they occur, ordered by document and hash."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([np.ones(min(1, len(h)), bool), (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.concatenate([at, [len(h)]]))


def prob_minhash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, m: int = _M) -> np.ndarray:
    """Signatures (n, m) of documents 0 to n - 1; those without shingles have the largest value throughout.

    A place holds the 32-bit id of its first arrival. Each turn gives every shingle that can still be
    early its next arrivals: one, or sixteen when few shingles are left.
    """
    first = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    ids = mix(h ^ _U(_R)) & _U(0xFFFFFFFF)
    at, turn = np.zeros(len(h)), 0
    rate = weight.astype(float)
    live = np.arange(len(h))
    while len(live):
        some = 1 if len(live) > 20_000 else 16
        steps = np.arange(turn, turn + some, dtype=np.uint64)
        turn += some
        u = mix(h[live][:, None] + (steps * _U(0xD1B54A32D192ED03) + _U(0x8CB92BA72F3D8DD7))[None, :])
        gaps = -np.log(((u >> _U(11)).astype(float) + 1) / (1 << 53)) / rate[live][:, None]
        times = at[live][:, None] + np.cumsum(gaps, axis=1)
        at[live] = times[:, -1]
        place = (mix(u) >> _U(32)) * _U(m) >> _U(32)
        packed = times.astype(np.float32).view(np.uint32).astype(np.uint64) << _U(32) | ids[live][:, None]
        np.minimum.at(first, ((doc[live] * m)[:, None] + place.astype(np.int64)).ravel(), packed.ravel())
        latest = (first.reshape(n, m).max(axis=1) >> _U(32)).astype(np.uint32).view(np.float32)
        # An empty place shows as not a number: such a document goes on.
        live = live[~(at[live] > latest[doc[live]])]
    return (first & _U(0xFFFFFFFF)).reshape(n, m)


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    out = np.zeros(parts.shape[:2], np.uint64)
    for k in range(ROWS):
        out = mix(out * _U(_B2) + parts[:, :, k] + _U(1))
    return out.view(np.int64)


def bands_of(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> pa.ListArray:
    """Band hashes of documents 0 to n - 1, and after them those of weights 1 where shingles repeat.

    The band of an entry is its place modulo BANDS; a second entry equal to the first is null.
    """
    weighed = band_hashes(prob_minhash(doc, h, weight, n))
    repeats = np.bincount(doc, weights=weight > 1, minlength=n) > 0
    of, mine = np.cumsum(repeats) - 1, repeats[doc]
    plain = band_hashes(prob_minhash(of[doc[mine]], h[mine], np.ones(int(mine.sum())), int(repeats.sum())))
    offsets = np.concatenate([[0], np.cumsum(BANDS * (1 + repeats))])
    values, same = np.zeros(offsets[-1], np.int64), np.zeros(offsets[-1], bool)
    places = np.arange(BANDS)
    values[offsets[:-1, None] + places] = weighed
    second = offsets[:-1][repeats][:, None] + BANDS + places
    values[second], same[second] = plain, plain == weighed[repeats]
    return pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(values, mask=same))


def similarities(a: Sequence[str | None], b: Sequence[str | None]) -> np.ndarray:
    """For each pair of texts the larger of Jaccard (of distinct shingles) and probability Jaccard (by counts)."""
    out = np.zeros(len(a))
    for s, e in slices([(x or "") + (y or "") for x, y in zip(a, b, strict=True)]):
        sides = [weighted(*shingles(t[s:e])[:2]) for t in (a, b)]
        pair = np.concatenate([sides[0][0], sides[1][0]])
        h = np.concatenate([sides[0][1], sides[1][1]])
        w = np.concatenate([sides[0][2], sides[1][2]])
        left = np.arange(len(h)) < len(sides[0][0])
        order = np.lexsort((~left, h, pair))
        pair, h, w, left = pair[order], h[order], w[order], left[order]
        both = np.flatnonzero((pair[1:] == pair[:-1]) & (h[1:] == h[:-1]))
        shared = np.bincount(pair[both], minlength=e - s)
        union = np.bincount(pair, minlength=e - s) - shared
        jaccard = shared / np.maximum(union, 1)
        repeats = np.bincount(pair, weights=w > 1, minlength=e - s) > 0
        for i in np.flatnonzero(repeats & (jaccard > 0)).tolist():
            lo, hi = np.searchsorted(pair, [i, i + 1])
            _, code = np.unique(h[lo:hi], return_inverse=True)
            x, y = (np.bincount(code, weights=w[lo:hi] * side) for side in (left[lo:hi], ~left[lo:hi]))
            on = (x > 0) & (y > 0)
            ratios, which = np.unique(x[on] / y[on], return_inverse=True)
            sums = np.array([np.maximum(x, r * y).sum() for r in ratios])
            jaccard[i] = max(jaccard[i], float((x[on] / sums[which]).sum()))
        out[s:e] = jaccard
    return out


def _features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            lengths = [len(t or "") for t in texts.to_pylist()]
            at = 0
            while at < len(lengths):
                to, held = at, 0
                while to < len(lengths) and (to == at or held + lengths[to] <= 1 << 21):
                    held += lengths[to]
                    to += 1
                doc, h, k1, k2, n = shingles(texts.slice(at, to - at).to_pylist())
                distinct = weighted(doc, h)
                lists = bands_of(*distinct, to - at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(np.bincount(distinct[0], minlength=to - at)), lists],
                    ["doc_id", "text_hash", "k1", "k2", "n", "size", "bands"],
                )
                at = to

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, k1 long, k2 long, n long, size long, bands array<long>")


def _tested(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (u, v) with the similarity of their texts."""
    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(similarities(a.tolist(), b.tolist()))

    left = texts.select(F.col("node").alias("u"), F.col("text").alias("a"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("b"))
    met = pairs.join(left, "u").join(right, "v")
    return met.select("u", "v", similarity("a", "b").alias("similarity"))


def sketches(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Parity sketches (n, SKETCH) of documents 0 to n - 1: each distinct shingle flips one of 64 * SKETCH bits.

    The bits in which two sketches differ are at most as many as the shingles that only one of the two has.
    """
    bits = 64 * SKETCH
    at = (mix(h ^ _U(_B2)) >> _U(32)) * _U(bits) >> _U(32)
    odd = (np.bincount(doc * bits + at.astype(np.int64), minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(odd, axis=1).view(np.int64)


def _cells(texts: DataFrame) -> DataFrame:
    """Per node its distinct shingles: h and w, how often each occurs, and the words of its sketch."""
    columns = [f"s{i}" for i in range(SKETCH)]

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held, nodes = frame["text"].tolist(), frame["node"].to_numpy()
            for a, b in slices(held):
                doc, h, w = weighted(*shingles(held[a:b])[:2])
                cuts = np.searchsorted(doc, np.arange(1, b - a))
                words = sketches(doc, h, b - a)
                out = pd.DataFrame({"node": nodes[a:b], "hs": np.split(h.view(np.int64), cuts), "ws": np.split(w, cuts)})
                yield out.assign(**{c: words[:, i] for i, c in enumerate(columns)})

    schema = "node long, hs array<long>, ws array<long>, " + ", ".join(f"{c} long" for c in columns)
    return texts.select("node", "text").mapInPandas(spread, schema)


def prefix_pairs(texts: DataFrame, comps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v) of nodes in different components that may be linked: a prefix-filter join over weighted shingles.

    If x and y do not share the parts p and q of their weights, their probability Jaccard is at most
    (1 - p)(1 - q) / (1 - p q); with all weights 1 that is their plain Jaccard. Shingles are put in one order, the
    measured rarest first. Before the first shingle that two nodes share there is only weight that they do not
    share, so a linked pair meets at a shingle whose weights before it satisfy that bound, and one
    of them is at most (1 - t) / (1 + t). A node is entered under the shingles before which at most 1 - t of its
    weight lies; each of the two measures has its entries, one for both where no shingle repeats. Pairs without repeated
    shingles whose sketches differ in more bits than the shingles of a linked pair could do not leave the join.
    """
    held = stored(_cells(texts), "near-cells")
    cells = held.select("node", F.explode(F.arrays_zip("hs", "ws")).alias("z")).select("node", F.col("z.hs").alias("h"), F.col("z.ws").alias("w"))
    counts = stored(cells.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "near-counts")
    ranked = cells.join(counts, "h", "left").withColumn("c", F.coalesce("c", F.lit(1)))
    before = W.partitionBy("node").orderBy("c", "h").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("node")
    zero = F.lit(0).cast("long")
    placed = ranked.select(
        "node", "h", "c",
        (F.coalesce(F.count(F.lit(1)).over(before), zero) / F.count(F.lit(1)).over(whole)).alias("even"),
        (F.coalesce(F.sum("w").over(before), zero) / F.sum("w").over(whole)).alias("own"),
        (F.max("w").over(whole) > 1).alias("repeats"),
    ).filter("c > 1")
    both = F.array(F.struct(F.lit(2).alias("m"), F.col("even").alias("p")))
    each = F.array(F.struct(F.lit(0).alias("m"), F.col("even").alias("p")), F.struct(F.lit(1).alias("m"), F.col("own").alias("p")))
    entries = placed.select("node", "h", F.explode(F.when(F.col("repeats"), each).otherwise(both)).alias("e")).select("node", "h", "e.m", "e.p")
    slack = 1e-9
    entries = entries.filter(F.col("p") <= 1 - threshold + slack).join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    # A shingle whose nodes are of one component has nothing to tell.
    mixed = entries.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("h")
    words = [f"s{i}" for i in range(SKETCH)]
    entries = stored(entries.join(mixed, "h").join(held.select("node", F.size("hs").alias("size"), *words), "node"), "near-entries")
    left = entries.filter(F.col("p") <= (1 - threshold) / (1 + threshold) + slack)
    right = entries.select(*[F.col(c).alias(f"{c}_v") for c in ("h", "node", "m", "p", "comp", "size", *words)])
    same = (F.col("m") == F.col("m_v")) | (F.col("m") == 2) | (F.col("m_v") == 2)
    bound = (1 - F.col("p")) * (1 - F.col("p_v")) >= threshold * (1 - F.col("p") * F.col("p_v")) - slack
    # At least 2 t / (1 + t) of both sides' shingles are shared, so at most the rest differs.
    differ = reduce(add, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_v"))) for c in words])
    near = (F.col("m") == 1) | (F.col("m_v") == 1) | (differ <= (F.col("size") + F.col("size_v")) * ((1 - threshold) / (1 + threshold)) + slack)
    met = left.join(right, (F.col("h") == F.col("h_v")) & (F.col("comp") != F.col("comp_v")) & same & bound & near)
    return met.select(F.least("node", "node_v").alias("u"), F.greatest("node", "node_v").alias("v")).distinct()


def _hubs(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Bucket rows with their node's number of links, and as comp the node with most links among it and those it is linked to.

    Nodes of one comp are connected, which is enough to spare their test; components proper cost many more steps.
    """
    ends = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = stored(ends.groupBy("u").agg(F.count(F.lit(1)).alias("degree")), "near-degrees")
    around = ends.join(degree.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.max(F.struct("degree", "v")).alias("best"))
    own = F.struct("degree", F.col("u").alias("v"))
    hubs = degree.join(around, "u").select(F.col("u").alias("node"), "degree", F.greatest(own, F.col("best"))["v"].alias("hub"))
    return rows.join(stored(hubs, "near-hubs"), "node", "left").withColumn("comp", F.coalesce("hub", "node")).drop("hub")


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), n_words, text_hash and stays.

    Documents are linked if their similarity is `threshold` or more; classes are the components. Texts
    with equal word sequences are linked too, among them all texts without words (null ones as well).
    Repeated rows are kept. A null id counts as the least. `stays` marks the first document of a class.
    """
    none = F.lit(-(1 << 63))
    feats = stored(_features(docs), "near-features")
    own = F.struct(F.coalesce("doc_id", none).alias("rep"), "text_hash", "n", "size")
    nodes = feats.groupBy("k1", "k2").agg(F.min(own).alias("r"), F.min("bands").alias("bands"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "r.*", "bands"), "near-nodes")
    buckets = nodes.filter("n > 0").select("node", F.posexplode("bands").alias("place", "h")).filter("h is not null")
    buckets = buckets.select("node", (F.col("place") % BANDS).alias("band"), "h")
    shared = stored(buckets.groupBy("band", "h").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").drop("members"), "near-buckets")
    rows = stored(buckets.join(shared, ["band", "h"]), "near-rows")
    wanted = rows.select("node").distinct().join(nodes.select("node", "rep", "text_hash"), "node")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("rep"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    texts = stored(texts.join(wanted, ["rep", "text_hash"]).groupBy("node").agg(F.min("text").alias("text")), "near-texts")

    links, tested = None, None
    for turn in range(3):
        if links is None:
            rank, labelled = F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), F.col("node").alias("pivot")), rows.withColumn("comp", F.col("node"))
        else:
            labelled = _hubs(rows, links)
            rank = F.struct((-F.coalesce("degree", F.lit(0))).alias("o"), F.xxhash64("node", F.lit(turn)).alias("o2"), F.col("node").alias("pivot"))
        labelled = stored(labelled, "near-labelled")
        pivots = labelled.groupBy("band", "h").agg(F.min(F.struct(*[rank.alias("r")], F.col("comp").alias("c"))).alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        pivots = stored(pivots.filter("lo < hi").select("band", "h", F.col("p.r.pivot").alias("pivot"), F.col("p.c").alias("pivot_comp")), "near-pivots")
        pairs = labelled.join(pivots, ["band", "h"]).filter(F.col("comp") != F.col("pivot_comp"))
        pairs = pairs.select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("u", "v"), ["u", "v"], "left_anti")
        seen = stored(_tested(pairs, texts), "near-tested")
        tested = seen if tested is None else tested.unionByName(seen)
        links = tested.filter(F.col("similarity") >= threshold).select("u", "v")
    # The rest: nodes of buckets that still hold several components, by their rarest shingles.
    comps = stored(connected_components(links), "near-components").withColumnRenamed("id", "node")
    labelled = rows.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    split = labelled.groupBy("band", "h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("band", "h")
    apart = stored(rows.join(split, ["band", "h"]).select("node").distinct(), "near-apart")
    rest = prefix_pairs(texts.join(apart, "node"), comps, threshold).join(tested.select("u", "v"), ["u", "v"], "left_anti")
    last = stored(_tested(rest, texts), "near-rest")
    links = links.unionByName(last.filter(F.col("similarity") >= threshold).select("u", "v"))

    comps = stored(connected_components(links), "near-classes")
    placed = nodes.select("node", "k1", "k2", "rep", "text_hash").join(comps.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = stored(placed.groupBy("component").agg(F.min(F.struct("rep", "text_hash")).alias("first")), "near-least")
    classes = stored(placed.join(least, "component").select("k1", "k2", "first"), "near-class-of")
    out = feats.select("doc_id", "text_hash", "k1", "k2", "n").join(classes, ["k1", "k2"])
    first = F.struct(F.coalesce("doc_id", none).alias("rep"), "text_hash") == F.col("first")
    class_id = F.when(F.col("first.rep") != none, F.col("first.rep"))
    return out.select("doc_id", class_id.alias("class_id"), F.col("n").alias("n_words"), "text_hash", first.alias("stays"))


def one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The document of the least id of each class, once, with all its columns; of repeated rows any one."""
    stay = near_duplicates(docs, threshold).filter("stays").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    marked = docs.withColumn("_h", F.xxhash64(F.col("text").cast("string")))
    met = marked.join(stay, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")))
    return met.dropDuplicates(["_id", "_hash"]).select(*[F.col(f"`{c}`") for c in docs.columns])
