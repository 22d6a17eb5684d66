"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's words are runs of letters, in lower case, between boundary marks. Their character n-grams are
hashed into buckets; a text is the mean of its n-grams' embeddings, and a linear layer with a softmax
gives the languages. Stochastic gradient descent in numpy trains both on a bounded sample. Afterwards
embedding and layer are multiplied into one table of logits per bucket, so a prediction over a whole
text is a mean of table rows. A temperature and a rejection threshold are fitted on training rows that
the descent has not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_batches
from .common import slices

NGRAMS = (1, 2, 3, 4)
UNKNOWN = "und"
#: Characters that count as of a word, yet are neither letters nor decimal digits: fractions, Roman and circled numbers.
_NUMBERS = re.compile("[" + "".join(c for c in map(chr, range(0xB2, 0x1FBFA)) if c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]+")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: A text's length class is the number of these bounds that its number of n-grams reaches.
LENGTHS = (24, 96, 384, 1536)
#: Characters that are judged at a time: numpy holds about 60 bytes for each of them.
_JUDGED = 1 << 18


@dataclass(frozen=True)
class Model:
    """Logits per bucket (bucket, language), temperature, and per length class the score below which a text is rejected."""

    langs: tuple[str, ...]
    table: np.ndarray
    temperature: float
    thresholds: tuple[float, ...]


def normal(text: str | None) -> str:
    """Letters in lower case, other runs as one space, a space at both ends; empty without letters."""
    s = _NOT_LETTERS.sub(" ", (text or "").lower())
    if not s.isascii() and not s.replace(" ", "").isalpha():
        # The long pattern is slow, so only texts with such a character are searched.
        s = re.sub(" +", " ", _NUMBERS.sub(" ", s))
    s = s.strip(" ")
    return f" {s} " if s else ""


def gram_buckets(points: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram that starts at each place, and whether it has no space inside it."""
    size = max(0, len(points) - n + 1)
    h = np.full(size, 0x811C9DC5 + n, np.uint32)
    for k in range(n):
        h ^= points[k : k + size]
        h *= np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    space = points == 32
    ok = ~space[:size] if n == 1 else np.ones(size, bool)
    for k in range(1, n - 1):
        ok &= ~space[k : k + size]
    if n == 2:
        ok &= ~(space[:size] & space[1 : 1 + size])
    return (h & np.uint32(buckets - 1)).astype(np.int64), ok


def _grams(text: str, buckets: int, rng: np.random.Generator, most: int = 3000) -> np.ndarray:
    """A text's n-grams; of a long text a lesson draws `most` of them."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = [gram_buckets(points, n, buckets) for n in NGRAMS]
    grams = np.concatenate([b[ok] for b, ok in found])
    return grams if len(grams) <= most else rng.choice(grams, most)


def _windows(text: str, rng: np.random.Generator) -> list[str]:
    """The whole text and spans of its words, so that short texts are learned and judged too."""
    words = text.split()
    spans = [text]
    for n in (1, 3, 12):
        if len(words) > n:
            a = int(rng.integers(len(words) - n))
            spans.append(normal(" ".join(words[a : a + n])))
    return spans


def _descend(lesson: list[tuple[np.ndarray, int]], langs: int, buckets: int, width: int, epochs: int, rate: float, rng: np.random.Generator) -> np.ndarray:
    """Table of logits after stochastic gradient descent; buckets never seen say nothing."""
    embed = rng.normal(0, 0.1, (buckets, width)).astype(np.float32)
    layer = np.zeros((width, langs), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(lesson)):
            g, y = lesson[i]
            mean = embed[g].mean(axis=0)
            z = mean @ layer
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = layer @ p
            layer -= step * np.outer(mean, p)
            np.subtract.at(embed, g, (step * 8 / len(g)) * back)
    seen = np.zeros(buckets, bool)
    for g, _ in lesson:
        seen[g] = True
    return np.ascontiguousarray((embed @ layer) * seen[:, None], np.float32)


def _logits(table: np.ndarray, spans: list[tuple[np.ndarray, int]]) -> np.ndarray:
    return np.array([table[g].mean(axis=0) for g, _ in spans]).reshape(len(spans), table.shape[1])


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least loss on rows that the descent has not seen.

    As if one row more were of another language: without an error among the rows the loss would fall for ever.
    """
    n, k = z.shape
    slip = 1 / (n + 2) if k > 1 else 0.0

    def loss(t: float) -> float:
        s = (z - z.max(axis=1, keepdims=True)) / t
        s = np.log(np.exp(s).sum(axis=1))[:, None] - s
        right = s[np.arange(n), y]
        return float(np.mean((1 - slip) * right + slip * (s.sum(axis=1) - right) / max(1, k - 1)))

    return min((float(2.0**e) for e in np.arange(-9, 3.01, 0.25)), key=loss)


def _confidence(z: np.ndarray, temperature: float) -> np.ndarray:
    s = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
    return s.max(axis=1) / s.sum(axis=1)


def length_class(grams: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, grams, side="right")


def train(
    texts: Sequence[str], labels: Sequence[str], buckets: int = 1 << 18, width: int = 16, epochs: int = 5, rate: float = 0.5, seed: int = 7,
    kept: float = 0.999, folds: int = 5, rejected: float = 0.95,
) -> Model:
    """Fit a model; a tenth of the rows is held back to fit the temperature and the thresholds.

    Texts without letters are left out. The threshold of a length class rejects the share `rejected` of texts in
    languages that a model has not learned: the languages are left out of further models, in at most `folds`
    groups, and scored by them. It stays below 0.95 times the score that the share `kept` of the class's held-back
    spans reaches that are rightly classed. With two languages or fewer only that bound is there. With no usable row the model
    knows no language and answers `und` always.
    """
    rng = np.random.default_rng(seed)
    rows = [(normal(t), la) for t, la in zip(texts, labels, strict=True)]
    rows = [r for r in rows if r[0]]
    langs = tuple(sorted({la for _, la in rows}))
    if not langs:
        return Model((), np.zeros((buckets, 0), np.float32), 1.0, (0.0,) * (len(LENGTHS) + 1))
    y_of = {la: i for i, la in enumerate(langs)}
    held = rng.random(len(rows)) < 0.1
    spans: dict[bool, list[tuple[np.ndarray, int]]] = {False: [], True: []}
    for (text, la), h in zip(rows, held, strict=True):
        spans[bool(h)] += [(_grams(s, buckets, rng), y_of[la]) for s in _windows(text, rng)]
    lesson = spans[False] or spans[True]
    judged = spans[True] or spans[False]
    table = _descend(lesson, len(langs), buckets, width, epochs, rate, rng)
    z, y = _logits(table, judged), np.array([la for _, la in judged])
    temperature = _temperature(z, y)
    score, right = _confidence(z, temperature), z.argmax(axis=1) == y
    size = length_class(np.array([len(g) for g, _ in judged]))
    strange: list[tuple[np.ndarray, np.ndarray]] = []
    groups = [g for g in np.array_split(np.arange(len(langs)), min(folds, len(langs))) if len(g)] if len(langs) > 2 else []
    for group in groups:
        left = {la: i for i, la in enumerate(sorted(set(range(len(langs))) - set(group.tolist())))}
        part = _descend([(g, left[la]) for g, la in lesson if la in left], len(left), buckets, width, max(1, epochs // 2), rate, rng)
        known, other = [(g, left[la]) for g, la in judged if la in left], [(g, la) for g, la in judged if la not in left]
        if known and other:
            own = _temperature(_logits(part, known), np.array([la for _, la in known]))
            strange.append((_confidence(_logits(part, other), own), length_class(np.array([len(g) for g, _ in other]))))
    thresholds = []
    for c in range(len(LENGTHS) + 1):
        mine = score[right & (size == c)]
        most = float(np.quantile(mine, 1 - kept)) * 0.95 if len(mine) else 0.0
        unknown = np.concatenate([s[k == c] for s, k in strange]) if strange else np.zeros(0)
        thresholds.append(min(most, float(np.quantile(unknown, rejected))) if len(unknown) else most)
    return Model(langs, table, temperature, tuple(thresholds))


def score_texts(model: Model, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each whole text; `und` and 0 without letters."""
    return judge_texts(model, texts)[:2]


def judge_texts(model: Model, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether it is rejected, of each whole text; texts without letters are."""
    n, buckets = len(model.langs), len(model.table)
    names, scores, rejects = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    limits = np.array(model.thresholds)
    for a, b in slices([t or "" for t in texts], _JUDGED):
        clean = [normal(t) for t in texts[a:b]]
        sizes = np.array([len(c) for c in clean])
        live = np.flatnonzero(sizes)
        if not len(live) or not n:
            continue
        joined = "".join(clean)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.concatenate([[0], np.cumsum(sizes[live])[:-1]])
        sums, counts = np.zeros((len(live), n)), np.zeros(len(live))
        # Every text has a space at both ends: a gram from one into the next has two spaces inside or at its
        # edge, and is told by that but for the pair of spaces itself, which gram_buckets leaves out.
        for k in NGRAMS:
            h, ok = gram_buckets(points, k, buckets)
            rows = model.table[h]
            rows[~ok] = 0
            counts += np.add.reduceat(np.concatenate([ok, np.zeros(k - 1, bool)]).astype(np.int64), starts)
            pad = np.zeros(k - 1)
            for j in range(n):
                sums[:, j] += np.add.reduceat(np.concatenate([rows[:, j], pad]).astype(np.float64), starts)
        z = sums / np.maximum(counts, 1)[:, None] / model.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        low = p.max(axis=1) < limits[length_class(counts)]
        for i, k in enumerate(live.tolist()):
            names[a + k] = model.langs[int(p[i].argmax())]
            scores[a + k] = float(p[i].max())
            rejects[a + k] = low[i]
    return names, scores, rejects


def remainder(divisor: int, of: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(of).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def fit(docs: DataFrame, rows_per_lang: int = 500, longest: int = 20_000) -> Model:
    """Train on about `rows_per_lang` rows of each lang, drawn by a hash of id and text; repeated rows count once.

    The sample leaves out texts of over `longest` characters and ends after 2 x rows x languages, so at most that
    many texts of that length reach the driver. Only rows with a text and a lang are used.
    """
    rows = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= longest))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(rows_per_lang / n)).otherwise(share)
    rank = F.xxhash64("doc_id", "text", F.lit("langid"))
    drawn = rows.withColumn("rank", rank).filter(F.pmod("rank", F.lit(1 << 30)) < share * (1 << 30)).distinct()
    sample = drawn.orderBy("rank", "doc_id", "lang", "text").limit(2 * rows_per_lang * max(1, len(counts))).drop("rank").toPandas()
    sample = sample.sort_values(["doc_id", "text", "lang"], kind="stable")
    return train(sample["text"].tolist(), sample["lang"].tolist())


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred, score and rejected to the rows of docs; columns that have these names are replaced.

    A text that is null or has no letter is `und` with score 0. Rejected are those and texts whose score
    is under the model's threshold for their length. Rows are kept as they are, repeated rows too.
    """
    shared = small_batches(docs.sparkSession).sparkContext.broadcast(model)
    results = ["lang_pred", "score", "rejected"]

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores, rejects = judge_texts(shared.value, [t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang_pred": names, "score": scores, "rejected": rejects})

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in results]
    return docs.withColumn("_langid", predict(F.col(f"`{text}`").cast("string"))).select(*kept, *[F.col(f"_langid.{c}") for c in results])
