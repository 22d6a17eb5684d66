"""Toxicity by weak supervision.

Voters are lexicons, term patterns mined from the labelled rows (a word or a word's beginning), and
patterns of typing. Each votes toxic, clean, or not at all. A generative label model estimates by
expectation maximisation how often each voter's votes are right, and from the votes that two voters
share beyond their class, their correlation, by which it discounts evidence cast together. Its
posterior labels train a sparse linear classifier on a text's terms; that scores every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_CHARS

PREFIXES = (4, 5, 6)
_WORDS = re.compile(r"[^\W\d_]+")

#: Word lists of the lexicon voters: common insults and threats, in lower case.
LEXICONS = {
    "stupidity": "idiot idiots moron morons stupid imbecile dimwit dumb dumbass fool foolish halfwit cretin dunce".split(),
    "contempt": "loser losers pathetic worthless useless scum trash garbage vermin filth clown clowns lowlife parasite".split(),
    "disgust": "disgusting disgraceful revolting repulsive sickening pervert".split(),
    "profanity": "fuck fucking fucker shit shitty bullshit bitch bastard asshole crap prick dick cunt whore slut".split(),
    "threat": "kill murder shoot stab destroy".split(),
    "deutsch": "idiot dummkopf arschloch scheiße scheisse trottel abschaum versager wichser".split(),
    "français": "idiot imbécile connard connasse salope merde crétin ordure abruti".split(),
    "español": "idiota imbécil estúpido estúpida mierda cabrón puta pendejo basura escoria".split(),
}
#: Typing patterns, and the vote they cast.
PATTERNS = {
    "shouting": (re.compile(r"[A-Z]{3}!{2}"), 1),
    "shouted_words": (re.compile(r"(?:[A-Z]{4,} ){4}"), 1),
    "links": (re.compile(r"https?://"), -1),
}


def terms(text: str | None) -> set[str]:
    """Distinct words in lower case, and their beginnings of 4 to 6 letters marked by a star."""
    low = (text or "").lower()
    words = set(_WORDS.findall(low)) if len(low) <= SLICE_CHARS else {m.group() for m in _WORDS.finditer(low)}
    found = set(words)
    for n in PREFIXES:
        found.update({w[:n] + "*" for w in words if len(w) >= n})
    return found


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float


def mined_terms(found: Sequence[set[str]], labels: np.ndarray, most: int = 96) -> list[str]:
    """Terms at least thirty times likelier in toxic rows, by the likelihood ratio; at most `most` of them."""
    toxic, clean = Counter(), Counter()
    for t, y in zip(found, labels.tolist(), strict=True):
        (toxic if y else clean).update(t)
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    scored = []
    for term, a in toxic.items():
        b = clean[term]
        if a < 4 or (b + 0.5) * n1 * 30 > (a + 0.5) * n0:
            continue
        cells, whole = ((a, n1), (b, n0), (n1 - a, n1), (n0 - b, n0)), n1 + n0
        rate = (a + b) / whole
        ratio = 2 * sum(k * np.log(k / (n * r)) for (k, n), r in zip(cells, (rate, rate, 1 - rate, 1 - rate), strict=True) if k)
        if ratio > 50:
            scored.append((-ratio, -len(term), term))
    taken: list[str] = []
    for _, _, term in sorted(scored):
        stem = term.rstrip("*")
        # Of a word and its beginnings one is enough: the first, by rank.
        if not any(stem.startswith(t.rstrip("*")) and t.endswith("*") or t.startswith(stem) and term.endswith("*") for t in taken):
            taken.append(term)
    return taken[:most]


def votes_of(texts: Sequence[str | None], found: Sequence[set[str]], mined: Sequence[str]) -> np.ndarray:
    """Votes (text, voter): 1 toxic, -1 clean, 0 none."""
    lexicons = [set(v) for v in LEXICONS.values()]
    rows = []
    for text, t in zip(texts, found, strict=True):
        row = [int(not lex.isdisjoint(t)) for lex in lexicons] + [int(m in t) for m in mined]
        nothing = not any(row)
        row += [v if p.search(text or "") else 0 for p, v in PATTERNS.values()]
        rows.append([*row, -1 if nothing else 0])
    return np.array(rows, np.int8).reshape(len(rows), len(lexicons) + len(mined) + len(PATTERNS) + 1)


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 20, strength: float = 20, most: float = 0.995) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each row, the voters' accuracies and their correlations.

    A voter's accuracy starts from its agreement with the labels `gold` and keeps them as a prior worth
    `strength` votes; it is never taken to be worse than chance. Within a row, a vote counts once
    over one plus its correlations (given the class) with the other votes cast.
    """
    cast = (votes != 0).astype(float)
    n = cast.sum(axis=0)
    agrees = (votes == np.where(gold == 1, 1, -1)[:, None]) & (votes != 0)
    classes = np.maximum(1, np.array([(gold == 0).sum(), (gold == 1).sum()]))
    by_class = np.where(gold == 1, 1 / classes[1], 1 / classes[0])[:, None]
    anchor = ((agrees * by_class).sum(axis=0) + 1e-4) / ((cast * by_class).sum(axis=0) + 2e-4)
    values = votes.astype(float)

    def correlations(q: np.ndarray) -> np.ndarray:
        """Positive correlations of the votes given the class, which is toxic with probability q."""
        means = np.stack([((1 - q) @ values) / ((1 - q).sum() + 1e-9), (q @ values) / (q.sum() + 1e-9)])
        rest = values - (q[:, None] * means[1] + (1 - q[:, None]) * means[0])
        spread = np.sqrt(np.maximum((rest**2).mean(axis=0), 1e-9))
        corr = (rest.T @ rest) / max(1, len(votes)) / np.outer(spread, spread)
        np.fill_diagonal(corr, 0)
        return np.where(corr > 0.1, corr, 0)

    by_labels = correlations((gold == 1).astype(float))
    accuracy, corr, p = anchor, by_labels, np.full(len(votes), 0.5)
    for _ in range(rounds):
        clear = np.clip(accuracy, 0.5, most)
        weight = np.log(clear / (1 - clear))
        z = (votes * weight / (1 + cast @ corr)).sum(axis=1)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        right = np.where(votes > 0, p[:, None], np.where(votes < 0, 1 - p[:, None], 0))
        accuracy = (right.sum(axis=0) + strength * anchor) / (n + strength)
        # Voters that fully make up the posterior seem independent given it; the labels show that they are not.
        corr = np.maximum(by_labels, correlations(p))
    return p, accuracy, corr


def _sparse_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l1: float = 1e-5, l2: float = 1e-5, steps: int = 1500) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for logistic loss with l1 and l2 penalties; y are probabilities."""
    n, k = x.shape
    step = 4 / (np.linalg.norm(x * np.sqrt(weight[:, None]), 2) ** 2 + 1) if k else 2.0
    w, b, w0, b0 = np.zeros(k), 0.0, np.zeros(k), 0.0
    for t in range(1, steps + 1):
        mom = (t - 1) / (t + 2)
        wy, by = w + mom * (w - w0), b + mom * (b - b0)
        g = weight * (1 / (1 + np.exp(-np.clip(x @ wy + by, -30, 30))) - y)
        w0, b0 = w, b
        raw = wy - step * (x.T @ g + l2 * wy)
        w, b = np.sign(raw) * np.maximum(np.abs(raw) - step * l1, 0), by - step * float(g.sum())
    return w, b


def train(texts: Sequence[str | None], labels: Sequence[int], share: float) -> Model:
    """Fit on labelled rows; `share` is the share of toxic rows among all labelled ones.

    Without rows of both classes every text scores `share`.
    """
    seen = dict(zip(texts, labels, strict=True))  # copies of a text count once
    texts, y = list(seen), np.array(list(seen.values()), int)
    share = min(max(share, 1e-4), 1 - 1e-4)
    if not len(y) or y.min() == y.max():
        return Model({}, float(np.log(share / (1 - share))))
    found = [terms(t) for t in texts]
    mined = mined_terms(found, y)
    votes = votes_of(texts, found, mined)
    # The annotators are a voter too, though not taken at their word.
    p, _, _ = label_model(np.column_stack([votes, np.where(y == 1, 1, -1)]), y, most=0.97)
    vocabulary = mined_terms(found, (p > 0.5).astype(int), 400)
    x = np.array([[t in f for t in vocabulary] for f in found], float).reshape(len(found), len(vocabulary))
    # The sample's classes are weighed to their shares among all labelled rows.
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w, b = _sparse_logistic(x, p, weight / weight.sum())
    return Model({t: float(v) for t, v in zip(vocabulary, w, strict=True) if v}, float(b))


def score_texts(model: Model, texts: Sequence[str | None]) -> np.ndarray:
    by_length = {n: {t: w for t, w in model.weights.items() if t.endswith("*") and len(t) == n + 1} for n in PREFIXES}
    whole = {t: w for t, w in model.weights.items() if not t.endswith("*")}
    z = np.full(len(texts), model.bias)
    for i, text in enumerate(texts):
        if not text:
            continue
        low = text.lower()
        words = set(_WORDS.findall(low)) if len(low) <= SLICE_CHARS else {m.group() for m in _WORDS.finditer(low)}
        z[i] += sum(whole[t] for t in sorted(whole.keys() & words))
        for n, weights in by_length.items():
            if weights:
                z[i] += sum(weights[t] for t in sorted(weights.keys() & {w[:n] + "*" for w in words if len(w) >= n}))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = 2500, longest: int = 20_000) -> Model:
    """Train on at most about `rows_per_class` labelled rows of each class, drawn by a hash of the id.

    The drawn ids are a table of that size, which meets the documents by a broadcast. Texts of over
    `longest` characters are left out of the sample, not of the scoring. Null labels are left out.
    """
    marks = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for toxic, n in counts.items():
        share = F.when(F.col("toxic") == toxic, F.lit(rows_per_class / n)).otherwise(share)
    drawn = marks.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) < share * (1 << 30)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "text").filter(F.length(F.coalesce("text", F.lit(""))) <= longest).join(F.broadcast(drawn), "doc_id")
    sample = rows.toPandas().sort_values(["doc_id", "text"], kind="stable")
    total = sum(counts.values())
    return train(sample["text"].tolist(), sample["toxic"].tolist(), counts.get(1, 0) / total if total else 0.5)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Add score and predicted (1 from `threshold` on); columns of these names are replaced. Null and empty texts are scored too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score_texts(shared.value, [t if isinstance(t, str) else None for t in texts]))

    out = docs.withColumn("score", toxic(F.col("text").cast("string")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
