"""SentencePiece BPE ids of whole texts, and texts of ids, by vectorised merge rounds.

A text's symbols are its characters, with spaces as `▁` and one more in front. The library merges, again and
again, the neighbouring pair whose joined piece has the best score, of equals the leftmost. No piece holds `▁`
behind another character, nor a line feed, so words (white space and what follows) merge by themselves. The
distinct new words of a batch lie in one flat numpy array. A round finds each word's least pair rank with a
segmented minimum, merges all its leftmost non-overlapping occurrences at once, and compacts the array; words
without a pair leave it. Ids of words are kept in a bounded cache.

Merging all occurrences at once is exact if no merge of that rank can give a pair of the same or a better
rank. Where a piece's score allows that (runs of `▁` have equal scores), a round merges only a word's first
occurrence; words with many are worked off in order. Long words are cut where the symbols around a place are
part of no piece, across which no merge can ever reach.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SPACE = "▁"
#: Words of more symbols are cut; a word with more occurrences that must come in order leaves the rounds.
_LONG, _MANY = 64, 32
_RECUT = 16  # rounds between cuts
_HELD, _HELD_CHARS = 100_000, 1 << 23
_NONE = np.int32(1 << 30)
_CODES = 0x110000

codecs.register_error("offerloom-bytes", lambda e: ("�" * (e.end - e.start), e.end))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Decoder:
    """Texts of ids; all that a reader needs of a model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.end = lib.get_piece_size(), lib.eos_id()
        names = [lib.id_to_piece(i) for i in range(self.size)]
        self.silent = [lib.is_control(i) for i in range(self.size)]
        self.special = [c or lib.is_unknown(i) or lib.is_byte(i) for i, c in enumerate(self.silent)]
        self.byte = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.names = names
        self.spaced = [n.startswith(SPACE) and not special for n, special in zip(names, self.special, strict=True)]
        table = [b"" if silent else n.replace(SPACE, " ").encode() for n, silent in zip(names, self.silent, strict=True)]
        for b, i in enumerate(self.byte.tolist()):
            table[i] = bytes([b])
        table[lib.unk_id()] = " ⁇ ".encode()
        self.table = table

    def decode(self, lists: Sequence[Sequence[int]]) -> list[str]:
        """The text of each list of ids; bytes that are no UTF-8 become U+FFFD each."""
        table, silent, spaced = self.table, self.silent, self.spaced
        out = []
        for ids in lists:
            found = [table[i] for i in ids]
            # Control ids have no text; bytes on both sides of one make no common character.
            if b"" in found[:-1]:
                first = next((i for i in ids if not silent[i]), None)
                parts = self._between(found)
            else:
                first, parts = ids[0] if len(found) else None, [b"".join(found)]
            text = "".join([p.decode("utf-8", "offerloom-bytes") for p in parts])
            out.append(text[1:] if first is not None and spaced[first] else text)
        return out

    @staticmethod
    def _between(found: list[bytes]) -> list[bytes]:
        parts: list[list[bytes]] = [[]]
        for x in found:
            parts[-1].append(x) if x else parts.append([])
        return [b"".join(p) for p in parts]


class Pieces(Decoder):
    """Encoder and decoder of one model file.

    The model must be BPE with byte fallback, a space in front, and no other normalisation; a few texts are
    compared with the library when it is loaded, and ValueError tells of another kind of model.
    """

    def __init__(self, path: str) -> None:
        super().__init__(path)
        lib, size, special = self.library, self.size, self.special
        if any(lib.is_unused(i) for i in range(size)):
            raise ValueError("pieces must not be marked unused")
        self.vocabulary = {n: i for i, n in enumerate(self.names) if not special[i]}
        # Ranks: 0 is the best score; equal scores share one.
        scores = np.array([0.0 if special[i] else -lib.get_score(i) for i in range(size)])
        ranks = np.unique(scores, return_inverse=True)[1].astype(np.int32)
        alone = {ord(n): i for n, i in self.vocabulary.items() if len(n) == 1}
        self.codes = np.array(sorted(alone), np.int64)
        self.code_ids = np.array([alone[c] for c in sorted(alone)], np.int64)
        merges: dict[int, int] = {}
        unsafe = np.zeros(int(ranks.max()) + 1, bool)
        for name, i in self.vocabulary.items():
            for k in range(1, len(name)):
                left, right = self._symbol(name[:k]), self._symbol(name[k:])
                for part in (left, right):
                    if part is not None and part < size and ranks[part] >= ranks[i]:
                        unsafe[ranks[part]] = True
                if left is not None and right is not None:
                    merges[self._key(left, right)] = i
        self.unsafe = unsafe
        self.keys = np.array(sorted(merges), np.int64)
        self.into = np.array([merges[k] for k in sorted(merges)], np.int64)
        self.rank_of = ranks[self.into]
        self.merges = {k: (int(ranks[i]), i) for k, i in merges.items()}
        long = [n for n in self.vocabulary if len(n) > 1]
        if any(SPACE in n.lstrip(SPACE) or "\n" in n for n in long):
            self.words = re.compile("(?s).+")
        else:
            self.words = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        for text in ("", " ", "  two  words \n", "ﬁ ½ Ａ", "a▁b", "x \U0001f642\U00012345"):
            ids, back = self.encode([text])[0].tolist(), lib.encode(text)
            if ids != back or self.decode([ids])[0] != lib.decode(back):
                raise ValueError("the model normalises texts or lacks byte fallback")

    def _symbol(self, part: str) -> int | None:
        """Pieces have their ids; a character that is no piece stands for itself behind all ids."""
        found = self.vocabulary.get(part)
        return self.size + ord(part) if found is None and len(part) == 1 else found

    def _key(self, left, right):
        return left * (self.size + _CODES) + right

    @functools.cached_property
    def live(self) -> np.ndarray:
        """Keys of neighbouring symbols that lie together in some piece."""
        keys = array("q")
        for name in self.vocabulary:
            for i in range(len(name) - 1):
                for j in range(i + 1, len(name)):
                    left = self._symbol(name[i:j])
                    if left is not None:
                        rights = (self._symbol(name[j:k]) for k in range(j + 1, len(name) + 1))
                        keys.extend(self._key(left, r) for r in rights if r is not None)
        return np.unique(np.frombuffer(keys, np.int64))

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; pairs that make no piece have the rank _NONE."""
        key = self._key(left, right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], _NONE), self.into[at]

    def _cut(self, sym: np.ndarray, seg: np.ndarray) -> np.ndarray:
        """Segments, cut where two symbols lie together in no piece."""
        key = self._key(sym[:-1], sym[1:])
        at = np.minimum(np.searchsorted(self.live, key), len(self.live) - 1)
        new = (seg[1:] != seg[:-1]) | (self.live[at] != key)
        return np.concatenate([[0], np.cumsum(new)])

    def _in_order(self, sym: list[int], until: int) -> list[tuple[int, int]]:
        """(place, symbol) of one word once all its pairs of rank `until` or better are merged one by one."""
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        ranks, joined = self._pairs(np.array(sym[:-1]), np.array(sym[1:]))
        # Ascending places of one rank or better are a heap once sorted.
        heap = sorted((r, i, p, sym[i], sym[i + 1]) for i, (r, p) in enumerate(zip(ranks.tolist(), joined.tolist(), strict=True)) if r <= until)
        while heap:
            _, i, piece, left, right = heapq.heappop(heap)
            if sym[i] != left or after[i] >= len(sym) or sym[after[i]] != right:
                continue
            gone = after[i]
            sym[i], sym[gone], after[i] = piece, -1, after[gone]
            if after[i] < len(sym):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(sym):
                    r, p = self.merges.get(self._key(sym[k], sym[after[k]]), (until + 1, 0))
                    if r <= until:
                        heapq.heappush(heap, (r, k, p, sym[k], sym[after[k]]))
        return [(i, s) for i, s in enumerate(sym) if s >= 0]

    def _rounds(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as bytes of 32-bit integers."""
        lengths = np.array([len(w) for w in words])
        edges = np.concatenate([[0], np.cumsum(lengths)])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        sym = np.where(self.codes[at] == codes, self.code_ids[at], self.size + codes)
        seg, place = np.repeat(np.arange(len(words)), lengths), np.arange(len(codes))
        if lengths.max() > _LONG:
            seg = self._cut(sym, seg)
        rank, into = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
        def update(which: np.ndarray) -> None:
            which = which[which < len(sym) - 1]
            r, p = self._pairs(sym[which], sym[which + 1])
            rank[which] = np.where(seg[which] == seg[which + 1], r, _NONE)
            into[which] = p

        update(np.arange(len(sym)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        turn = 0
        while len(sym):
            turn += 1
            starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            count = np.diff(np.concatenate([starts, [len(sym)]]))
            if turn % _RECUT == 0 and count.max() > _LONG:
                # Pairs that could merge are never cut, so ranks stay.
                seg = self._cut(sym, seg)
                starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
                count = np.diff(np.concatenate([starts, [len(sym)]]))
            best = np.minimum.reduceat(rank, starts)
            ready = np.repeat(best == _NONE, count)
            if ready.any():
                done.append((place[ready], sym[ready]))
                sym, seg, place, rank, into = (x[~ready] for x in (sym, seg, place, rank, into))
                count, best = count[best < _NONE], best[best < _NONE]
                if not len(sym):
                    break
            chosen = np.flatnonzero(rank == np.repeat(best, count))
            # Of occurrences that overlap, every other one from the left.
            new = np.diff(chosen, prepend=-2) != 1
            first = chosen[np.maximum.accumulate(np.where(new, np.arange(len(chosen)), 0))]
            chosen = chosen[(chosen - first) % 2 == 0]
            careful = self.unsafe[rank[chosen]]
            if careful.any():
                of = seg[chosen]
                lead = np.concatenate([[True], of[1:] != of[:-1]])
                held, times = np.unique(of[careful], return_counts=True)
                for s in held[times > _MANY].tolist():
                    lo, hi = np.searchsorted(seg, [s, s + 1])
                    left = self._in_order(sym[lo:hi].tolist(), int(rank[lo:hi].min()))
                    places = np.array([i for i, _ in left]) + lo
                    sym[places] = [x for _, x in left]
                    sym[np.setdiff1d(np.arange(lo, hi), places)] = -1
                ordered = np.isin(of, held[times > _MANY])
                chosen = chosen[(~careful | lead) & ~ordered]
            else:
                ordered = careful
            sym[chosen] = into[chosen]
            stays = sym >= 0
            stays[chosen + 1] = False
            sym, seg, place, rank, into = (x[stays] for x in (sym, seg, place, rank, into))
            if ordered.any():
                update(np.arange(len(sym)))
                rank[-1] = _NONE
            else:
                moved = chosen - np.arange(len(chosen))
                rank[moved] = _NONE
                update(np.concatenate([moved, moved[moved > 0] - 1]))
        place, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place)
        place, sym = place[order], sym[order]
        where, n = np.searchsorted(place, edges), np.ones(len(sym), np.int64)
        other = np.flatnonzero(sym >= self.size)
        if len(other):
            spelled = [chr(c).encode("utf-8", "surrogatepass") for c in (sym[other] - self.size).tolist()]
            n[other] = [len(b) for b in spelled]
            flat = np.repeat(sym, n)
            flat[flat >= self.size] = self.byte[np.frombuffer(b"".join(spelled), np.uint8)]
            where = np.concatenate([[0], np.cumsum(n)])[where]
            sym = flat
        raw = sym.astype("<i4").tobytes()
        where = (where * 4).tolist()
        return [raw[a:b] for a, b in zip(where[:-1], where[1:], strict=True)]

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > _HELD or self.held > _HELD_CHARS:
            self.known, self.older, self.held = {}, self.known, 0
        new = words.difference(self.known)
        again = {w for w in new if w in self.older}
        self.known.update({w: self.older[w] for w in again})
        fresh = list(new - again)
        if fresh:
            self.known.update(zip(fresh, self._rounds(fresh), strict=True))
        self.held += sum(map(len, new))

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of each text, without an end id; null counts as empty."""
        out: list[np.ndarray] = []
        texts = [t or "" for t in texts]
        for a, b in slices(texts):
            words = [self.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts[a:b]]
            self._learn(set().union(*words))
            look = self.known.__getitem__
            out += [np.frombuffer(b"".join(map(look, w)), "<i4") for w in words]
        return out

@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One encoder per Python worker."""
    return Pieces(path)


@functools.lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    """One decoder per Python worker."""
    return Decoder(path)


def _mapped(rows: DataFrame, added: dict[str, str], take: str, give) -> DataFrame:
    """Add columns computed from batches of another; all other columns pass through."""
    for name in added:
        if name in rows.columns:
            raise ValueError(f"the column {name} is there already")
    schema = ", ".join(f"`{n}` {k}" for n, k in [*((f.name, f.dataType.simpleString()) for f in rows.schema.fields), *added.items()])
    at = rows.columns.index(take)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Arrays of some hundred thousand ids or characters at a time.
            step = max(1, min(batch.num_rows, 1 + (1 << 19) * batch.num_rows // max(1, batch.nbytes)))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                yield pa.RecordBatch.from_arrays([*part.columns, *give(part.column(at))], names=[*part.schema.names, *added])

    return rows.mapInArrow(run, schema)


def _lists(found: Sequence[np.ndarray], tail: np.ndarray) -> pa.Array:
    lengths = np.array([len(f) + len(tail) for f in found], np.int64)
    flat = np.concatenate([x for f in found for x in (f, tail)]) if found else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat.astype(np.int32)))


def encode_texts(docs: DataFrame, text: str = "text", ids: str = "ids", model: str | None = None, end: bool = True, decoded: str | None = None) -> DataFrame:
    """Add the ids of each text as array<int>, by default closed by the end id, and where named, the text decoded from them.

    Equal to the library's encode(text) without sampling, and its decode(ids). A null text counts as empty, an
    empty one has the end id only. Rows stay as they are, repeated ones too. A column named as a new one raises ValueError.
    """
    path = model or default_model()

    def give(texts: pa.Array) -> list[pa.Array]:
        encoder = pieces(path)
        found = encoder.encode(texts.to_pylist())
        out = [_lists(found, np.array([encoder.end] * end, np.int32))]
        return [*out, pa.array(encoder.decode([f.tolist() for f in found]), pa.string())] if decoded else out

    added = {ids: "array<int>"} | ({decoded: "string"} if decoded else {})
    return _mapped(docs.withColumn(text, F.col(text).cast("string")), added, text, give)


def decode_ids(rows: DataFrame, ids: str = "ids", text: str = "decoded", model: str | None = None) -> DataFrame:
    """Add the text of each list of ids, as the library's decode(ids) gives it.

    A null list gives an empty text; null ids are left out. A column named as the new one raises ValueError.
    """
    path = model or default_model()

    def give(lists: pa.Array) -> list[pa.Array]:
        if lists.null_count or lists.flatten().null_count:
            given = [[i for i in v if i is not None] if v else [] for v in lists.to_pylist()]
        else:
            flat, edges = lists.flatten().to_pylist(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).tolist()
            given = [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return [pa.array(decoder(path).decode(given), pa.string())]

    return _mapped(rows, {text: "string"}, ids, give)


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per document: doc_id, the number of ids, and digests of the ids and of the text decoded from them."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # One Python worker a task does both.
    back = encode_texts(rows, model=model, decoded="decoded")
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
