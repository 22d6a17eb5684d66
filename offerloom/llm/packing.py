"""Best-fit packing of tokenized documents into sequences, with certified sequence counts.

Pieces are dealt into cells of some thousands. Each cell is packed by best-fit decreasing, and dual
feasible functions give a lower bound on its sequences; a cell that meets its bound is certified and
done. Cells with a gap exchange the documents of their sequences that are not full: these are dealt
anew into larger cells and packed again, and the new packing is taken where the total falls.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .tokens import default_tokenizer, pieces

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = f"{_PIECE}, cell long, sequence_id long, offset long, cell_sequences long, cell_bound long"
_BINS = 1 << 20


def token_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = 2, capacity: int = 1024) -> DataFrame:
    """Documents as pieces of at most `capacity` ids; of a cut document the first piece may be shorter.

    Null and empty texts are the end id alone; without an end id they give no piece.
    """
    path, end = tokenizer or default_tokenizer(), b"" if end_id is None else np.array([end_id], "<u2").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces(path)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: list[tuple] = []
            for a in range(0, len(names), 256):
                for name, blob in zip(names[a : a + 256], encoder.encode(texts.slice(a, 256).to_pylist()), strict=True):
                    ids = np.frombuffer(blob + end, "<u2").astype("<u4")
                    first = len(ids) % capacity or min(capacity, len(ids))
                    starts = [0, *range(first, len(ids), capacity)] if len(ids) else []
                    for k, (x, y) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                        rows.append((name, k, x, y - x, zlib.crc32(ids[x:y])))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, _PIECE)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs, by two families of dual feasible functions."""
    if not len(lengths):
        return 0
    held = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((held * size).sum()) // capacity)
    count, total = np.cumsum(held), np.cumsum(held * size)
    for least in range(1, capacity // 2 + 1):  # sizes below `least` count 0, those above capacity - least count whole
        middle = int(total[capacity - least] - total[least - 1])
        best = max(best, int(count[capacity] - count[capacity - least]) - (-middle // capacity))
    for k in range(1, 65):  # sizes rounded down to multiples of 1 / k, unless a multiple of capacity / (k + 1)
        whole = (k + 1) * size
        worth = np.where(whole % capacity == 0, size * k, whole // capacity * capacity)
        best = max(best, -(-int((held * worth).sum()) // (capacity * k)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: the sequence and offset of each length, and the number of sequences."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences by the room left
    left, n = 0, 0  # left: bit r is set if a sequence has room r
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        fits = left >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                left &= ~(1 << r)
        else:
            r, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - r
        if r > size:
            room[r - size].append(b)
            left |= 1 << (r - size)
    return bins, offsets, n


def _packed(rows: DataFrame, cells: int, turn: int, capacity: int) -> DataFrame:
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "ids_crc32", "doc_id", "piece"], kind="stable", ignore_index=True)
        lengths = frame["length"].to_numpy(np.int64)
        bins, offsets, n = best_fit(lengths, capacity)
        cell = int(frame["cell"].iloc[0])
        return frame.assign(sequence_id=cell * _BINS + bins, offset=offsets, cell_sequences=n, cell_bound=lower_bound(lengths, capacity))

    cell = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(cells)) + F.lit(turn << 32)
    own = [c.split()[0] for c in _PIECE.split(", ")]
    dealt = rows.select(*own, cell.alias("cell"))
    return stored(dealt.groupBy("cell").applyInPandas(pack, _PACKED), f"packing-{turn}")


def _totals(packed: DataFrame) -> tuple[int, int]:
    per_cell = packed.groupBy("cell").agg(F.max("cell_sequences").alias("n"), F.max("cell_bound").alias("least"))
    row = per_cell.agg(F.sum("n"), F.sum("least")).first()
    return row[0] or 0, row[1] or 0


def pack_pieces(rows: DataFrame, capacity: int = 1024, cell_rows: int = 8192, turns: int = 2) -> DataFrame:
    """Assign pieces (all of length 1 to capacity) to sequences: adds cell, sequence_id, offset, cell_sequences, cell_bound.

    Every row keeps its place in exactly one sequence; repeated rows are packed each by itself. A cell
    of about `cell_rows` rows is packed in one task. At most `turns` exchanges follow the first packing.
    """
    rows = stored(rows, "pieces")
    n = rows.count()
    packed = _packed(rows, max(1, -(-n // cell_rows)), 0, capacity)
    for turn in range(1, turns + 1):
        used, least = _totals(packed)
        if used == least:
            break
        fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
        marked = packed.join(fill, "sequence_id").withColumn("free", (F.col("cell_sequences") > F.col("cell_bound")) & (F.col("fill") < capacity))
        marked = stored(marked.drop("fill"), "exchange")
        pool, rest = marked.filter("free").drop("free"), marked.filter(~F.col("free")).drop("free")
        before, pooled = pool.agg(F.count_distinct("sequence_id"), F.count(F.lit(1))).first()
        again = _packed(pool, max(1, -(-pooled // (cell_rows << turn))), turn, capacity)
        after, _ = _totals(again)
        if after >= before:
            break
        # What stayed in a cell is as good as before there: its sequences are full, or the cell is certified.
        full = rest.groupBy("cell").agg(F.count_distinct("sequence_id").alias("n"))
        rest = rest.join(full, "cell").withColumn("cell_sequences", F.col("n")).withColumn("cell_bound", F.col("n")).drop("n")
        packed = rest.select(*packed.columns).unionByName(again)
    return packed


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = 2, capacity: int = 1024) -> DataFrame:
    """Pack whole documents, cut only where longer than `capacity`; no documents give no rows.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null ids are kept.
    """
    return pack_pieces(token_pieces(docs, tokenizer, end_id, capacity), capacity).drop("cell", "cell_sequences", "cell_bound")
