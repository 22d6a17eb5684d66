"""Token ids of whole texts by a tokenizer file, with a bounded cache of pieces.

A byte-level BPE tokenizer splits a text before it merges bytes. Texts are cut here at places where it
surely splits: around a word of letters, or before white space that follows a word. Each distinct piece
is encoded by the tokenizers library when it is first met, and then only looked up. Added tokens, such as
`<|endoftext|>`, are cut out first and have their own ids, as in the library.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Sequence

import numpy as np

from .common import SLICE_CHARS, slices

#: A word of letters that ASCII punctuation, white space or the end follows (ASCII words first, for speed), else
#: characters up to white space, else white space.
_PIECES = re.compile(
    r" ?[A-Za-z]++(?![^\t-\r -/:-@\[-`{-~])| ?[^\W\d_]++(?![^\s!-/:-@\[-`{-~])| ?\S++|\s+(?!\S)|\s+"
)
#: White space to Python but not to the tokenizer; such texts are encoded whole.
_ODD = re.compile("[\x1c-\x1f]")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_NEWLINE = 198
_HELD = 450_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The printable character by which a byte-level vocabulary writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Pieces:
    """Encodes texts to little-endian unsigned 16-bit ids; keeps at most about 900,000 pieces.

    Words of letters go to the tokenizer's model by themselves; other pieces pass through all of it.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized or re.search(r"\s", t.content) for t in added):
            raise ValueError("added tokens must stand for themselves, wherever they are")
        self.specials = longest = sorted((t.content for t in added), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, longest)) + ")")
        if self.tokenizer.get_vocab_size() > 1 << 16 or self._ids(["\n"]) != [[_NEWLINE]]:
            raise ValueError("a byte-level tokenizer of at most 65,536 ids is needed")
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[list[str]]) -> None:
        if len(self.known) > _HELD:
            self.known, self.older = {}, self.known
        new = set().union(*pieces).difference(self.known)
        again = {p for p in new if p in self.older}
        self.known.update({p: self.older[p] for p in again})
        new -= again
        words: list[str] = []
        others: list[str] = []
        for p in new:
            (words if p.isalpha() or (p[0] == " " and p[1:].isalpha()) else others).append(p)
        for piece, ids in zip(others, self._ids(others), strict=True):
            self.known[piece] = array("H", ids).tobytes()
        if words:
            spelled = "\n".join(words).encode().decode("latin-1").translate(self.letters).split(self.letters[10])
            tokenize = self.tokenizer.model.tokenize
            for piece, word in zip(words, spelled, strict=True):
                self.known[piece] = array("H", [t.id for t in tokenize(word)]).tobytes()

    def _cut(self, text: str) -> list[str]:
        if not any(t in text for t in self.specials):
            return _PIECES.findall(text)
        # Every other part is an added token.
        parts = self.added.split(text)
        return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else _PIECES.findall(part))]

    def _parts(self, text: str) -> list[str]:
        """A very long text in parts that the tokenizer would split too."""
        parts, start = [], 0
        while len(text) - start > SLICE_CHARS and (m := _CUT.search(text, start + SLICE_CHARS)):
            parts.append(text[start : m.start()])
            start = m.start()
        return [*parts, text[start:]]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text as bytes; null counts as empty."""
        out: list[bytes] = []
        texts = [t or "" for t in texts]
        for a, b in slices(texts):
            batch = texts[a:b]
            if len(batch) == 1 and len(batch[0]) > SLICE_CHARS:
                parts = [batch[0]] if _ODD.search(batch[0]) else self._parts(batch[0])
                out.append(b"".join(self._encode([p])[0] for p in parts))
            else:
                out += self._encode(batch)
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        odd = {i for i, t in enumerate(texts) if _ODD.search(t)}
        pieces = [[] if i in odd else self._cut(t) for i, t in enumerate(texts)]
        self._learn(pieces)
        look = self.known.__getitem__
        out = [b"".join(map(look, p)) for p in pieces]
        for i in odd:
            out[i] = np.array(self._ids([texts[i]])[0], "<u2").tobytes()
        return out


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One encoder per Python worker."""
    return Pieces(path)
