"""Row-picking helpers that combine on the map side, so hot keys never fill one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick_row(df: DataFrame, keys: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """The first (or last) whole row per key by the ordering columns; nulls order lowest."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def first_by(value: Column, order: Column) -> Column:
    """Aggregate: first non-null value in order."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def last_by(value: Column, order: Column) -> Column:
    """Aggregate: last non-null value in order."""
    return F.max_by(value, F.when(value.isNotNull(), order))


def top_structs(value: Column, order: Column, n: int, ascending: bool = False) -> Column:
    """Aggregate: the n rows with the highest (or lowest) order, best first."""
    pairs = F.collect_list(F.struct(order.alias("o"), value.alias("v")))
    return F.transform(F.slice(F.sort_array(pairs, asc=ascending), 1, n), lambda p: p["v"])


def once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """df + columns whose expressions are evaluated once per row.

    A filter or projection above a plain column is rewritten in terms of its expression, which
    would run expensive text work again; a generated one-element array keeps it in place.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))).alias("_once")
    kept = [c for c in df.columns if c not in cols]
    return df.select(*kept, made).select(*kept, *[F.col(f"_once.{n}").alias(n) for n in cols])


#: Key hashes are marked in this many bits: at most 4,096 bitmaps of 4 kB, 16 MB in all.
_SLOTS, _PER_BITMAP = 1 << 27, 1 << 15


def may_meet(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df whose key may be in `keys`; the others never enter a shuffle.

    The keys' hashes are marked in bitmaps of bounded size, which all tasks get. Of rows without a key in
    `keys`, a share of len(keys) / 2**27 passes at most, so an exact join must follow. Null keys do not pass.
    """
    slot = F.pmod(F.xxhash64(*on), F.lit(_SLOTS))
    marked = keys.dropna(subset=on).select(slot.alias("s"))
    bitmaps = marked.groupBy(F.floor(F.col("s") / _PER_BITMAP).alias("_part")).agg(F.bitmap_construct_agg(F.col("s") % _PER_BITMAP).alias("_bits"))
    known = df.withColumn("_s", slot).withColumn("_part", F.floor(F.col("_s") / _PER_BITMAP)).withColumn("_at", (F.col("_s") % _PER_BITMAP).cast("int"))
    byte = F.conv(F.hex(F.expr("substring(_bits, _at div 8 + 1, 1)")), 16, 10).cast("int")
    held = known.join(F.broadcast(bitmaps), "_part").filter(F.getbit(byte, F.col("_at") % 8) == 1)
    return held.dropna(subset=on).select(*df.columns)
