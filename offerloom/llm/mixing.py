"""Mix sources to target weights by blocks of words.

The words of a source, document after document, are cut into blocks of fixed length. Output shards draw
how many blocks they take of each source from a multinomial over what is left of the targets; the n-th
block that a source gives is found by a pseudorandom permutation of its block indexes, so a source is
used up evenly before any block comes again. Slots and blocks meet in a join on the block's index.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, with_prefix
from .line_rules import words_of

_CHUNK = 1 << 14
_TOKENS = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> dict[str | None, Fraction]:
    """Shares of the sum of sizes by weights, which repeat over the names by code point, null last.

    A target stops at `most` times its source's size; what is above is shared anew among the others.
    """
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    out: dict[str | None, Fraction] = {}
    free, left = list(names), Fraction(sum(sizes.values()))
    while free:
        unit = left / sum(weight[n] for n in free)
        full = [n for n in free if unit * weight[n] > most * sizes[n]]
        if not full:
            return out | {n: unit * weight[n] for n in free}
        for n in full:
            out[n] = Fraction(most * sizes[n])
            left -= out[n]
        free = [n for n in free if n not in out]
    return out


def plan(sizes: dict[str | None, int], block_words: int) -> list[Source]:
    goal = targets(sizes)
    out = []
    for name, size in sizes.items():
        blocks = -(-size // block_words)
        out.append(Source(name, size, float(goal[name]), blocks, round(goal[name] * blocks / size) if size else 0))
    return sorted(out, key=lambda s: (s.name is None, s.name or ""))


def draws(sources: list[Source], shards: int, seed: int = 11) -> np.ndarray:
    """Blocks that each shard takes of each source (shard, source); sums over shards are the sources' slots."""
    rng = np.random.default_rng(seed)
    left = np.array([s.slots for s in sources], np.int64)
    room = -(-int(left.sum()) // shards) if len(sources) else 0
    out = np.zeros((shards, len(sources)), np.int64)
    for k in range(shards):
        want = min(room, int(left.sum()))
        while want:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[k] += got
            left -= got
            want -= int(got.sum())
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of index under a pseudorandom permutation of range(size): a Feistel network, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, out = index.astype(np.uint64), np.full(len(index), -1, np.int64)
    open_ = np.ones(len(index), bool)
    while open_.any():
        left, right = x >> half, x & mask
        for turn in range(4):
            h = (right + key.astype(np.uint64) + np.uint64(turn * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h ^ h >> np.uint64(32)) & mask)
        x = left << half | right
        inside = open_ & (x < size.astype(np.uint64))
        out[inside] = x[inside].astype(np.int64)
        open_ &= ~inside
    return out


def slots_of(spark: SparkSession, sources: list[Source], shards: int) -> DataFrame:
    """One row per slot of the mix: shard, source number, slot number of the source, and its block.

    They come from few rows of ranges, so Spark would think them few and broadcast them: joins say "merge".
    """
    taken = draws(sources, shards)
    first = np.cumsum(taken, axis=0) - taken
    rows = [(k, i, int(first[k, i]), int(taken[k, i]), sources[i].blocks) for k in range(shards) for i in range(len(sources)) if taken[k, i]]

    @F.pandas_udf("long")
    def block(source: pd.Series, slot: pd.Series, blocks: pd.Series) -> pd.Series:
        n, at = blocks.to_numpy(np.int64), slot.to_numpy(np.int64)
        key = source.to_numpy(np.int64) * 1_000_003 + at // n
        return pd.Series(permuted(at % n, n, key))

    ranges = spark.createDataFrame(rows, "shard int, src int, first long, n long, blocks long")
    chunks = ranges.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _CHUNK))))
    chunks = chunks.repartition(F.col("src"), F.col("shard"), F.col("c"))
    last = F.least(F.col("n"), (F.col("c") + 1) * _CHUNK) - 1
    slot = chunks.select("shard", "src", "blocks", F.explode(F.sequence(F.col("first") + F.col("c") * _CHUNK, F.col("first") + last)).alias("slot"))
    return slot.select("shard", "src", "slot", block("src", "slot", "blocks").alias("block"))


class Mix:
    """Documents placed in their source's blocks, and the slots that take them."""

    def __init__(self, docs: DataFrame, block_words: int, shards: int, carry: dict) -> None:
        spark = docs.sparkSession
        words = F.size(words_of(F.coalesce(F.col("text").cast("string"), F.lit("")))).cast("long")
        rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"), *[v.alias(k) for k, v in carry.items()])
        self.rows = rows = stored(rows, "mix-rows")
        held = {r["source"]: (r["size"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}
        self.sources = plan({k: v[0] for k, v in held.items()}, block_words)
        # An Arrow table has a known size: if it is as small as a broadcast may be, Spark broadcasts it before the texts are shuffled.
        facts = {"src": range(len(self.sources)), "name": [s.name for s in self.sources], "source_size": [s.size for s in self.sources], "target": [s.target for s in self.sources]}
        table = spark.createDataFrame(pa.table(facts, pa.schema({"src": pa.int32(), "name": pa.string(), "source_size": pa.int64(), "target": pa.float64()})))
        numbered = rows.join(table, F.col("source").eqNullSafe(F.col("name"))).drop("name")
        order = ["doc_id", *(["text_key"] if "text_key" in carry else []), "size"]
        self.placed = with_prefix(numbered, ["src"], order, F.col("size"), "at", sum(n for _, n in held.values()))
        self.slots = slots_of(spark, self.sources, shards)
        self.block_words = block_words

    def pieces(self, *kept: str) -> DataFrame:
        """Parts of documents by block: start (word of the document) and n_words; empty documents have none."""
        b = F.lit(self.block_words)
        block = F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b)))
        cut = self.placed.filter(F.col("size") > 0).select("src", "doc_id", "at", "size", *kept, block.alias("block"))
        start = F.greatest(F.col("block") * b - F.col("at"), F.lit(0))
        end = F.least((F.col("block") + 1) * b - F.col("at"), F.col("size"))
        return cut.withColumn("start", start).withColumn("n_words", end - start)


def mix_digest(docs: DataFrame, block_words: int = 64, shards: int = 64) -> DataFrame:
    """Per document: doc_id, size, source_size, target and taken, the words that the mix takes of it.

    A null text has no words; a document without words, or of which no block is drawn, has taken 0.
    Repeated rows are documents of their own. A null source is a source, the last one.
    """
    mix = Mix(docs, block_words, shards, {"text_key": F.xxhash64(F.col("text").cast("string"))})
    times = mix.slots.groupBy("src", "block").agg(F.count(F.lit(1)).alias("times"))
    facts = ["source_size", "target"]
    taken = (
        mix.pieces(*facts).join(times.hint("merge"), ["src", "block"], "left")
        .groupBy("src", "at", "doc_id", "size", *facts).agg(F.sum(F.col("n_words") * F.coalesce("times", F.lit(0))).alias("taken"))
    )
    empty = mix.placed.filter(F.col("size") == 0).withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "size", *facts, "taken"]
    return taken.select(*columns).unionByName(empty.select(*columns))


def mix_documents(docs: DataFrame, block_words: int = 256, shards: int = 64) -> DataFrame:
    """The mixed text: rows of shard, slot, start, doc_id, text, lang, source, n_chars.

    A row is the part of a document that lies in a block taken by a slot, with the document's own white
    space between words; (shard, source, slot, start) is the order of the output.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mix = Mix(docs, block_words, shards, {"text": text, "lang": F.col("lang"), "text_key": F.xxhash64(text)})
    tokens = F.regexp_extract_all("text", F.lit(_TOKENS), F.lit(0))
    b = F.lit(block_words)
    whole = mix.placed.filter(F.col("size") > 0).withColumn("tokens", tokens)
    first, last = F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b)

    def part(k):
        start = F.greatest(k * b - F.col("at"), F.lit(0))
        end = F.least((k + 1) * b - F.col("at"), F.col("size"))
        return F.struct(k.alias("block"), start.alias("start"), F.array_join(F.slice("tokens", (start + 1).cast("int"), (end - start).cast("int")), "").alias("text"))

    parts = whole.select("src", "doc_id", "lang", "source", F.explode(F.transform(F.sequence(first, last), part)).alias("p"))
    parts = parts.select("src", "doc_id", "lang", "source", "p.*")
    out = parts.join(mix.slots.hint("merge"), ["src", "block"])
    return out.select("shard", "slot", "start", "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
