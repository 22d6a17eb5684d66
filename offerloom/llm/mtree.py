"""Exact top-k by inner product with an M-tree.

Inner products become distances: with the largest squared norm M of all vectors, a vector gets one more
coordinate sqrt(M - |v|²) and a query a zero, so the squared distance is |q|² + M - 2 q·v, least where the
product is largest. Distances obey the triangle inequality, on which an M-tree rests.

Vectors are dealt to the nearest of some sampled routing vectors, and large groups are split by hash: a
subtree has a bounded number of vectors. Its vectors lie in pages; a page has a routing vector, a covering
radius and its distance to the subtree's routing vector, and each entry its distance to the page's
routing vector. Queries first search the subtree nearest to them, which gives a bound on the k-th
distance; with it they search the other subtrees that the bound does not rule out, best page first.
Stored distances rule out pages and entries before their distance is computed. Queries travel in tiles: one
row holds all queries of a tile that ask a subtree, and no task holds a query's vector for all its subtrees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

PAGE = 128
SUBTREE = 4096
TILE = 512  # queries that travel and search together
_SENT = 8 << 20  # bytes of asking queries that leave a Python worker at a time
_NONE = -(1 << 63)  # a k-th score that is not known
_NODES = "tree long, sub long, page long, n long, ids binary, vectors binary, entry_dist binary, router binary, radius double, parent_dist double"
_TILES = "block long, n long, ids binary, vectors binary, norms binary, least binary"
_ASKED = f"tree long, sub long, {_TILES}"
_FOUND = "query_id long, vec_id long, score long"


def quantised(rows: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component as an integer; other vectors are left out.

    Left out are vectors that are null, empty, or hold a null or non-finite component.
    """
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("e")).filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & fine)
    return kept.select("vec_id", F.transform("e", lambda x: F.floor(x * scale)).alias("v"))


def _scores(queries: np.ndarray, vectors: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products of queries with vectors, as the nearest longs; exact ones may stay doubles."""
    if exact:
        return queries @ vectors.T
    wide = queries.astype(object) @ vectors.T.astype(object)
    top = (1 << 63) - 1
    return np.array([max(-top, min(top, x)) for x in wide.ravel().tolist()], np.int64).reshape(wide.shape)


def _gap(q: np.ndarray, qn: np.ndarray, v: np.ndarray, m: float) -> np.ndarray:
    """Distances of queries (rows of q, squared norms qn) to index vectors, whose squared norms are all m."""
    return np.sqrt(np.maximum(qn[:, None] + m - 2 * (q @ v.T), 0))


def _between(a: np.ndarray, an: np.ndarray, b: np.ndarray, bn: np.ndarray, m: float) -> np.ndarray:
    """Distances between augmented index vectors."""
    inner = a @ b.T + np.sqrt(np.maximum(m - an, 0))[:, None] * np.sqrt(np.maximum(m - bn, 0))[None, :]
    return np.sqrt(np.maximum(2 * m - 2 * inner, 0))


def _matrix(column: pd.Series, width: int, kind: type = float) -> np.ndarray:
    out = np.zeros((len(column), width), kind)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _packed(whole: np.ndarray) -> bytes:
    """Integers in the fewest bytes that hold each of them."""
    top = max(int(whole.max()), -int(whole.min()) - 1)
    return whole.astype(np.min_scalar_type(-top - 1)).tobytes()


def _unpacked(held: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(held, f"i{len(held) // (n * width)}").reshape(n, width)


def _tiles(block: int, ids: np.ndarray, whole: np.ndarray, norms: np.ndarray, least: np.ndarray) -> pd.DataFrame:
    cut = [slice(a, a + TILE) for a in range(0, len(ids), TILE)]
    rows = [(block, len(ids[c]), ids[c].tobytes(), _packed(whole[c]), norms[c].tobytes(), least[c].tobytes()) for c in cut]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _TILES.split(", ")])


def _bounds(norms: np.ndarray, least: np.ndarray, m: float) -> np.ndarray:
    """The distance of each query's k-th score; a score that may stand for smaller ones bounds nothing."""
    d = np.sqrt(np.maximum(norms + m - 2 * least.astype(float), 0))
    return np.where(least > _NONE + 1, d, np.inf)


def asking(frames: Iterator[pd.DataFrame], first: bool, subtrees: pd.DataFrame, routers: np.ndarray, m: float) -> Iterator[pd.DataFrame]:
    """Tiles of queries → per subtree the queries of a tile that ask it, in frames of bounded size.

    First that is the nearest subtree of each query, then all others that its bound does not rule out.
    """
    trees, subs, reach = subtrees["tree"].to_numpy(), subtrees["sub"].to_numpy(), subtrees["reach"].to_numpy(float)
    names, scale = [c.split()[0] for c in _ASKED.split(", ")], math.sqrt(m)
    rows: list[tuple] = []
    held = 0
    for frame in frames:
        for tile in frame.itertuples(index=False):
            ids, norms, least = np.frombuffer(tile.ids, np.int64), np.frombuffer(tile.norms), np.frombuffer(tile.least, np.int64)
            whole = _unpacked(tile.vectors, tile.n, routers.shape[1])
            d = _gap(whole.astype(float), norms, routers, m)[:, trees]
            home = np.zeros(d.shape, bool)
            home[np.arange(tile.n), d.argmin(axis=1)] = True
            ok = home if first else ~home & (d - reach - 1e-7 * (1 + d + scale) <= _bounds(norms, least, m)[:, None])
            for s in np.flatnonzero(ok.any(axis=0)):
                own = np.flatnonzero(ok[:, s])
                rows.append((trees[s], subs[s], tile.block, len(own), ids[own].tobytes(), whole[own].tobytes(), norms[own].tobytes(), least[own].tobytes()))
                held += sum(map(len, rows[-1][4:]))
                if held >= _SENT:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=names)


class Index:
    """A stored M-tree over quantised vectors."""

    def __init__(self, vectors: DataFrame, seed: int = 5, subtree: int = SUBTREE) -> None:
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        self.vectors = vectors = stored(vectors.withColumn("norm", square), "mtree-vectors")
        count, largest, width = vectors.agg(F.count(F.lit(1)), F.max("norm"), F.max(F.size("v"))).first()
        self.count, self.m, self.width = count, float(largest or 0), width or 1
        if not count:
            return
        # Products of doubles are exact below 2^53; beyond, scores are computed with Python integers.
        self.exact = self.m < 2**52
        # A bounded sample: at most about 256 routing vectors, drawn by a hash of the id.
        wanted = min(256, max(1, count // subtree))
        drawn = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * wanted / count)) + 1
        sample = vectors.filter(drawn).orderBy("vec_id").limit(wanted).toPandas()
        if not len(sample):
            sample = vectors.limit(1).toPandas()
        routers, norms, m, w = _matrix(sample["v"], self.width), sample["norm"].to_numpy(float), self.m, self.width
        self.routers = routers

        def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                d = _between(_matrix(frame["v"], w), frame["norm"].to_numpy(float), routers, norms, m)
                yield frame.assign(tree=d.argmin(axis=1), dist=d.min(axis=1))[["vec_id", "v", "norm", "tree", "dist"]]

        placed = stored(vectors.mapInPandas(assign, "vec_id long, v array<long>, norm double, tree long, dist double"), "mtree-placed")
        sizes = {r["tree"]: r["n"] for r in placed.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect()}
        parts = F.lit(1)
        for tree, n in sizes.items():
            parts = F.when(F.col("tree") == tree, F.lit(math.ceil(n / subtree))).otherwise(parts)
        placed = placed.withColumn("sub", F.pmod(F.xxhash64("vec_id"), parts))

        def build(frame: pd.DataFrame) -> pd.DataFrame:
            tree, sub = int(frame["tree"].iloc[0]), int(frame["sub"].iloc[0])
            frame = frame.sort_values("vec_id", ignore_index=True)
            whole, n = _matrix(frame["v"], w, np.int64), frame["norm"].to_numpy(float)
            v = whole.astype(float)
            pages = max(1, -(-len(v) // PAGE))
            seeds = np.random.default_rng(tree * 1_000_003 + sub).choice(len(v), pages, replace=False)
            near = _between(v, n, v[seeds], n[seeds], m).argmin(axis=1)
            rows = []
            for p in range(pages):
                mine = np.flatnonzero(near == p)
                for a in range(0, len(mine), 2 * PAGE):
                    own = mine[a : a + 2 * PAGE]
                    r, rn = v[seeds[p]][None, :], n[seeds[p]][None]
                    d = _between(v[own], n[own], r, rn, m)[:, 0]
                    up = float(_between(r, rn, routers[tree][None, :], norms[tree][None], m)[0, 0])
                    rows.append((tree, sub, len(rows), len(own), frame["vec_id"].to_numpy(np.int64)[own].tobytes(), _packed(whole[own]), d.tobytes(), r.tobytes(), float(d.max()), up))
            return pd.DataFrame(rows, columns=[c.split()[0] for c in _NODES.split(", ")])

        self.pages = stored(placed.groupBy("tree", "sub").applyInPandas(build, _NODES), "mtree-pages")
        # One row per subtree: count / subtree rows and at most one more per routing vector.
        self.subtrees = self.pages.groupBy("tree", "sub").agg(F.max(F.col("parent_dist") + F.col("radius")).alias("reach")).toPandas().sort_values(["tree", "sub"], ignore_index=True)

    def pages_for(self, asked: DataFrame) -> DataFrame:
        """The pages of each subtree once for every block of queries that asks it."""
        # A column of its own: the result meets the queries again.
        asks = asked.select("tree", "sub", (F.col("block") + 0).alias("block")).distinct()
        return self.pages.join(asks, ["tree", "sub"])

    def search(self, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
        """Up to k rows per query (vec_id, v): query_id, vec_id, score, by score, then smaller id; a query is not its own result."""
        m, w, subtrees, routers, exact, scale = self.m, self.width, self.subtrees, self.routers, self.exact, math.sqrt(self.m)
        blocks = max(1, -(-queries.count() // block))

        def pack(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("vec_id", ignore_index=True)
            whole = _matrix(frame["v"], w, np.int64)
            return _tiles(int(frame["block"].iloc[0]), frame["vec_id"].to_numpy(np.int64), whole, frame["norm"].to_numpy(float), frame["least"].to_numpy(np.int64))

        def look(asked: pd.DataFrame, pages: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(pages):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
            kind = float if exact else np.int64
            ids = [np.frombuffer(b, np.int64) for b in pages["ids"]]
            vs = [_unpacked(b, n, w).astype(kind) for b, n in zip(pages["vectors"], pages["n"], strict=True)]
            ds = [np.frombuffer(b) for b in pages["entry_dist"]]
            router = np.concatenate([np.frombuffer(b).reshape(1, w) for b in pages["router"]])
            radius, parent = (pages[c].to_numpy(float) for c in ("radius", "parent_dist"))
            above = routers[int(pages["tree"].iloc[0])][None, :]
            whole = np.concatenate([_unpacked(b, n, w).astype(kind) for b, n in zip(asked["vectors"], asked["n"], strict=True)])
            who, least = (np.concatenate([np.frombuffer(b, np.int64) for b in asked[c]]) for c in ("ids", "least"))
            norms = np.concatenate([np.frombuffer(b) for b in asked["norms"]])

            def tile(whole: np.ndarray, who: np.ndarray, norms: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                """The best of the subtree for some queries: places of the queries, ids, scores."""
                q, least, bound = whole.astype(float), least.copy(), _bounds(norms, least, m)
                up = _gap(q, norms, above, m)
                slack = 1e-7 * (1 + up + scale)
                # The parent's distance alone rules out pages.
                open_ = np.abs(up - parent) - radius - slack <= bound[:, None]
                asks = np.flatnonzero(open_.any(axis=0))
                d = np.full(open_.shape, np.inf)
                d[:, asks] = _gap(q, norms, router[asks], m)
                low = np.where(open_, np.maximum(d - radius, 0) - slack, np.inf)
                best = [np.zeros(0, np.int64)] * 3
                new: list[list[np.ndarray]] = []

                def settle() -> None:
                    """Keep the k best of each query; the last of them is its bound."""
                    nonlocal best, new, bound
                    at, x, score = (np.concatenate([best[j], *(c[j] for c in new)]) for j in range(3))
                    order = np.lexsort((x, -score, at))
                    at = at[order]
                    place = np.arange(len(at)) - np.searchsorted(at, at)
                    kept = order[place < k]
                    best, new = [at[place < k], x[kept], score[kept]], []
                    last = place == k - 1
                    least[at[last]] = np.maximum(least[at[last]], score[order][last])
                    bound = _bounds(norms, least, m)

                def visit(p: int, own: np.ndarray) -> None:
                    near = np.abs(ds[p] - d[own, p][:, None]) - slack[own] <= bound[own][:, None]
                    some = np.flatnonzero(near.any(axis=0))
                    score = _scores(whole[own], vs[p][some], exact)
                    i, j = np.nonzero(near[:, some] & (score >= least[own][:, None]) & (ids[p][some] != who[own][:, None]))
                    new.append([own[i], ids[p][some[j]], score[i, j].astype(np.int64)])
                    if sum(len(c[0]) for c in new) > 32 * TILE:
                        settle()

                # Each query's best page first, which gives a bound, then the others by their best query.
                nearest = low.argmin(axis=1)
                for p in np.unique(nearest).tolist():
                    visit(p, np.flatnonzero((nearest == p) & (low[:, p] <= bound)))
                settle()
                for p in np.argsort(low.min(axis=0), kind="stable").tolist():
                    own = np.flatnonzero((nearest != p) & (low[:, p] <= bound))
                    if len(own):
                        visit(p, own)
                settle()
                return best[0], best[1], best[2]

            out = []
            for a in range(0, len(who), TILE):
                c = slice(a, a + TILE)
                at, x, score = tile(whole[c], who[c], norms[c], least[c])
                out.append(pd.DataFrame({"query_id": who[c][at], "vec_id": x, "score": score}))
            return pd.concat(out, ignore_index=True)

        def searched(asked: DataFrame, first: bool, name: str) -> DataFrame:
            """Queries that meet a subtree come in blocks of bounded size; its pages go to the blocks that ask it, and to no others."""
            dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("block").applyInPandas(pack, _TILES)
            asks = stored(dealt.mapInPandas(lambda frames: asking(frames, first, subtrees, routers, m), _ASKED), name)
            keys = ["tree", "sub", "block"]
            return asks.groupBy(*keys).cogroup(self.pages_for(asks).groupBy(*keys)).applyInPandas(look, _FOUND)

        queries = stored(queries, "mtree-queries")
        unknown = F.lit(_NONE).cast("long")
        home = stored(searched(queries.withColumn("least", unknown), True, "mtree-first"), "mtree-home")
        kth = home.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
        bounded = queries.join(kth, "vec_id", "left").withColumn("least", F.coalesce("least", unknown))
        found = home.unionByName(searched(bounded, False, "mtree-asked"))
        first = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "vec_id", "score")


def top_products(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k best inner products of each row whose id is divisible by `every`, against all other rows.

    Components beyond a long are the nearest long, and so are scores. Repeated ids are candidates each by itself, and ask once, with the least vector; rows with the query's own id are not its results. Without
    a usable vector the result is empty. Shorter vectors count as filled up with zeros.
    """
    index = Index(quantised(embeddings))
    if not index.count:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = index.vectors.filter(F.pmod("vec_id", F.lit(every)) == 0)
    asked = asked.groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("q")).select("vec_id", "q.v", "q.norm")
    return index.search(asked, k)
