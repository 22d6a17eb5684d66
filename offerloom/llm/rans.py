"""Files of token ids, coded by a static range asymmetric numeral system (rANS).

A file holds whole documents, up to about `file_tokens` ids. One frequency table serves all of its
blocks. A block of `BLOCK` ids is coded by itself in `LANES` interleaved states; the file's index keeps
each block's first word (its checkpoint), its first states and a crc32, so any block can be decoded
alone. Blocks of a file are coded side by side in numpy.

Layout: magic, header length, JSON header, then the zlib-compressed document table (ids, null flags,
lengths) and frequency table, then states (unsigned 64-bit) and words (unsigned 32-bit) of the blocks.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import files
from .common import scratch, stored
from .tokens import default_tokenizer, pieces

MAGIC = b"RANSTOK1"
SCALE = 20
LANES = 32
BLOCK = 1 << 16
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)


class DamagedFile(ValueError):
    """A checksum or the layout of a file does not hold."""


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE; every id that occurs keeps at least 1."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.uint64)
    f = np.where(counts > 0, np.maximum(1, counts.astype(np.int64) * (1 << SCALE) // total), 0)
    rest = (1 << SCALE) - int(f.sum())
    if rest >= 0:
        f[np.argmax(f)] += rest
    else:
        order = np.argsort(-f, kind="stable")
        spare = np.cumsum(f[order] - 1)
        before = np.concatenate([[0], spare[:-1]])
        f[order] -= np.clip(-rest - before, 0, f[order] - 1)
    return f.astype(np.uint64)


def _grid(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids as (step, block, lane), and which of the places are in use."""
    blocks, steps = len(lengths), -(-int(lengths.max()) // LANES)
    grid = np.zeros((blocks, steps * LANES), np.int64)
    used = np.arange(steps * LANES)[None, :] < lengths[:, None]
    grid[used] = ids
    shape = (blocks, steps, LANES)
    return np.ascontiguousarray(grid.reshape(shape).transpose(1, 0, 2)), np.ascontiguousarray(used.reshape(shape).transpose(1, 0, 2))


def encode_blocks(ids: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """First states (block, lane), the words of each block, and the blocks' lengths in ids."""
    lengths = np.full(-(-len(ids) // BLOCK), BLOCK, np.int64)
    if not len(ids):
        return np.zeros((0, LANES), np.uint64), [], lengths
    lengths[-1] = len(ids) - BLOCK * (len(lengths) - 1)
    grid, used = _grid(ids, lengths)
    below = np.concatenate([[0], np.cumsum(f)[:-1]]).astype(np.uint64)
    state = np.full(grid.shape[1:], _LOW, np.uint64)
    words, owners = [], []
    for t in range(len(grid) - 1, -1, -1):
        # An unused place counts as a symbol that fills the range: it changes nothing.
        fs = np.where(used[t], f[grid[t]], np.uint64(1 << SCALE))
        cs = np.where(used[t], below[grid[t]], np.uint64(0))
        full = used[t] & (state >= fs << np.uint64(31 - SCALE + 32))
        block, lane = np.nonzero(full)
        words.append((state[block, lane] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        owners.append(block.astype(np.int32))
        state = np.where(full, state >> _32, state)
        q = state // fs
        state = np.where(used[t], (q << np.uint64(SCALE)) + (state - q * fs) + cs, state)
    words, owners = np.concatenate(words[::-1]), np.concatenate(owners[::-1])
    order = np.argsort(owners, kind="stable")
    return state, np.split(words[order], np.cumsum(np.bincount(owners, minlength=len(lengths)))[:-1]), lengths


def decode_blocks(states: np.ndarray, words: Sequence[np.ndarray], lengths: np.ndarray, f: np.ndarray) -> list[np.ndarray]:
    """Ids of each block; blocks may be any of a file."""
    if not len(lengths):
        return []
    below = np.concatenate([[0], np.cumsum(f)[:-1]]).astype(np.uint64)
    of_slot = np.repeat(np.arange(len(f)), f.astype(np.int64))
    stream = np.concatenate([*words, np.zeros(1, np.uint32)]).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])[:-1]])
    steps = -(-int(lengths.max()) // LANES)
    used = (np.arange(steps * LANES)[None, :] < lengths[:, None]).reshape(len(lengths), steps, LANES)
    out = np.zeros((steps, len(lengths), LANES), np.uint16)
    state = states.copy()
    for t in range(steps):
        u = used[:, t]
        slot = state & np.uint64((1 << SCALE) - 1)
        s = of_slot[slot.astype(np.int64)]
        out[t] = s
        state = np.where(u, f[s] * (state >> np.uint64(SCALE)) + slot - below[s], state)
        low = u & (state < _LOW)
        rank = np.cumsum(low, axis=1)
        place = np.minimum(at[:, None] + rank - 1, len(stream) - 1)
        state = np.where(low, (state << _32) | stream[np.where(low, place, 0)], state)
        at = at + rank[:, -1]
    if (state != _LOW).any():
        raise DamagedFile("a block does not end in the state it was begun with")
    flat = out.transpose(1, 0, 2).reshape(len(lengths), -1)
    return [flat[i, :n] for i, n in enumerate(lengths.tolist())]


def pack_file(doc_ids: Sequence[int | None], blobs: Sequence[bytes]) -> bytes:
    """The bytes of one file; blobs are the documents' ids, unsigned 16-bit."""
    ids = np.frombuffer(b"".join(blobs), "<u2")
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    f = frequencies(counts)
    states, words, lengths = encode_blocks(ids, f)
    cuts = np.cumsum(lengths)[:-1] if len(lengths) else []
    table = zlib.compress(
        np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "?").tobytes()
        + np.array([len(b) // 2 for b in blobs], "<i8").tobytes(), 1,
    )
    freq = zlib.compress(f.astype("<u4").tobytes(), 1)
    header = {
        "docs": len(blobs), "tokens": len(ids), "symbols": len(f), "table": len(table), "freq": len(freq),
        "lengths": lengths.tolist(), "words": [len(w) for w in words],
        "crc32": [zlib.crc32(x.astype("<u2").tobytes()) for x in np.split(ids, cuts)] if len(ids) else [],
        "sums": [zlib.crc32(table), zlib.crc32(freq)],
    }
    head = json.dumps(header).encode()
    body = [states.astype("<u8").tobytes(), *[w.astype("<u4").tobytes() for w in words]]
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, table, freq, *body])


class TokenFile:
    """Reads a file's bytes: `docs` has (doc_id, length), `blocks(a, b)` decodes blocks a to b - 1 alone."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise DamagedFile("not a token file")
        n = int.from_bytes(data[8:12], "little")
        self.header = h = json.loads(data[12 : 12 + n])
        table, freq = data[12 + n : (a := 12 + n + h["table"])], data[a : (b := a + h["freq"])]
        if [zlib.crc32(table), zlib.crc32(freq)] != h["sums"]:
            raise DamagedFile("a table's checksum does not hold")
        raw, k = zlib.decompress(table), h["docs"]
        ids, null = np.frombuffer(raw, "<i8", k), np.frombuffer(raw, "?", k, 8 * k)
        self.lengths = np.frombuffer(raw, "<i8", k, 9 * k)
        self.docs = [None if x else d for d, x in zip(ids.tolist(), null.tolist(), strict=True)]
        self.f = np.frombuffer(zlib.decompress(freq), "<u4").astype(np.uint64)
        blocks = len(h["lengths"])
        self.states = np.frombuffer(data, "<u8", blocks * LANES, b).reshape(blocks, LANES)
        self.words = np.frombuffer(data, "<u4", sum(h["words"]), b + 8 * blocks * LANES)
        self.starts = np.concatenate([[0], np.cumsum(h["words"])]).astype(np.int64)

    def blocks(self, first: int, last: int) -> list[np.ndarray]:
        h = self.header
        words = [self.words[self.starts[i] : self.starts[i + 1]] for i in range(first, last)]
        out = decode_blocks(self.states[first:last], words, np.array(h["lengths"][first:last], np.int64), self.f)
        for i, ids in enumerate(out, first):
            if zlib.crc32(ids.astype("<u2").tobytes()) != h["crc32"][i]:
                raise DamagedFile(f"the checksum of block {i} does not hold")
        return out

    def read(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document and its ids; 64 blocks are decoded at a time."""
        held, docs = np.zeros(0, np.uint16), zip(self.docs, self.lengths.tolist(), strict=True)
        doc = next(docs, None)
        for a in range(0, len(self.header["lengths"]), 64):
            held = np.concatenate([held, *self.blocks(a, min(a + 64, len(self.header["lengths"])))])
            at = 0
            while doc is not None and at + doc[1] <= len(held):
                yield doc[0], held[at : at + doc[1]]
                at += doc[1]
                doc = next(docs, None)
            held = held[at:]
        while doc is not None:
            if doc[1]:
                raise DamagedFile("the file ends within a document")
            yield doc[0], held[:0]
            doc = next(docs, None)


def write_files(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = 0, file_tokens: int = 1 << 22) -> DataFrame:
    """Encode (doc_id, text) in ascending doc_id order; returns one row per file, in `part`, `file` order.

    Null and empty texts are documents of the end id alone (of no ids, without one); null ids come
    first; rows that repeat an id are ordered by a hash of their ids. Texts are encoded where they are read, and only
    their ids, two bytes each, are sorted; a task holds one file's ids. Files are written
    under a temporary name and renamed, so a task that runs again leaves the same files.
    """
    path, folder = tokenizer or default_tokenizer(), scratch(docs.sparkSession, "token-files")
    end = b"" if end_id is None else np.array([end_id], "<u2").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                blobs = [blob + end for blob in encoder.encode(batch.column(1).slice(a, 256).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 256), pa.array(blobs, pa.binary())], ["doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, ids, blobs, held = 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, ids, blobs, held
            data = pack_file(ids, blobs)
            files.put(uri := f"{folder}/{part:06d}-{number:06d}.rans", data)
            row = {"part": [part], "file": [number], "path": [uri], "docs": [len(ids)], "tokens": [sum(map(len, blobs)) // 2], "bytes": [len(data)]}
            number, ids, blobs, held = number + 1, [], [], 0
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(name)
                blobs.append(blob)
                # A document without ids counts too, so a file has a bounded number of them.
                held += len(blob) // 2 + (not end)
                if held >= file_tokens:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = rows.mapInArrow(encode, "doc_id long, ids binary")
    # The row number only tells equal rows apart, which may follow each other in any order.
    coded = stored(coded.select("doc_id", F.xxhash64("ids").alias("h"), F.monotonically_increasing_id().alias("row"), "ids"), "token-ids")
    order = ["doc_id", "h", "row"]
    ordered = coded.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    return stored(ordered.mapInArrow(write, "part long, file long, path string, docs long, tokens long, bytes long"), "token-manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 (unsigned, 32-bit ids)."""
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("all"))
    far = parts.select("part", (F.sum("all").over(W.orderBy("part")) - F.col("all")).alias("far"))
    near = W.partitionBy("part").orderBy("file")
    at = manifest.join(far, "part").select("path", (F.col("far") + F.sum("tokens").over(near) - F.col("tokens")).alias("base"))
    n = max(1, manifest.count())

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri, start in zip(frame["path"], frame["base"].tolist(), strict=True):
                rows = []
                for doc, ids in TokenFile(files.get(uri)).read():
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield out.astype({"doc_id": "Int64"})

    return at.repartition(n, "path").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, tokenizer: str | None = None, file_tokens: int = 1 << 22) -> DataFrame:
    """Write documents as token files and read them back; empty input gives no rows."""
    return read_files(write_files(docs, tokenizer, 0, file_tokens))
