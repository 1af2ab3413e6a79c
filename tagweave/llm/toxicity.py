"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams that occur in it (lower-cased, of 3 to 6 code points; each counts
once). Their log-count ratios between the two classes scale the features of a logistic regression; with both
multiplied out, a text is scored by the sum of one weight per n-gram. Whole texts are scored, of any length.

Fitting takes a bounded sample of labelled rows to the driver (``FIT_ROWS`` rows and ``FIT_CHARS`` characters of a
class at most); only the array of weights is sent to the executors (``BUCKETS`` floats).

Null and empty texts have no n-gram and get the score of the intercept. Without rows of both classes to learn from
every score is the share of label 1, or 0 where there are none. Other columns of the documents are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tagweave.llm.common import fit_logistic, fold, labelled_sample, score_texts, sigmoid

ORDERS = (3, 4, 5, 6)
BUCKETS = 1 << 20
FIT_ROWS, FIT_CHARS = 4000, 6_000_000


@dataclass
class ToxicityModel:
    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[str]) -> list[float]:
        return sigmoid(self.sums(texts)).tolist()

    def sums(self, texts: list[str]) -> np.ndarray:
        grams = NGrams()
        return np.array([self.intercept + self.weights[grams(t)].sum(dtype=np.float64) for t in texts])


class NGrams:
    """Distinct n-gram buckets of a text, by hashes built one code point at a time over the whole text."""

    def __init__(self):
        self.last = np.zeros(BUCKETS, np.int32)

    def __call__(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(points) < ORDERS[0]:
            return np.zeros(0, np.int64)
        mixed = points * np.uint32(0x9E3779B1)
        hashes, parts = mixed.copy(), []
        for n in range(2, ORDERS[-1] + 1):
            if n > len(points):
                break
            hashes = hashes[:-1] * np.uint32(0x01000193) ^ mixed[n - 1:]
            if n in ORDERS:
                spread = (hashes ^ (hashes >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                parts.append((spread >> np.uint32(12)) & np.uint32(BUCKETS - 1))
        found = np.concatenate(parts).astype(np.int64)
        places = np.arange(len(found), dtype=np.int32)
        self.last[found] = places  # of repeats, the last one stays
        return found[self.last[found] == places]


def fit(texts: list[str], labels: np.ndarray, smooth: float = 1.0, least: int = 3, surprise: float = 3.0,
        l2: float = 0.2, rounds: int = 40, folds: int = 3) -> ToxicityModel:
    """Learn from texts and 0/1 labels.

    An n-gram is used if it occurs in ``least`` texts and its counts in the classes differ by ``surprise`` standard
    deviations, so that the many n-grams of long texts that tell nothing add nothing. The sums are calibrated to
    probabilities on texts that ``folds`` models, each fitted without a part of the texts, have not seen.
    """
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.0
        return ToxicityModel(np.zeros(BUCKETS, np.float32), float(np.log(share + 1e-9) - np.log(1 - share + 1e-9)))
    model = _fit(texts, labels, smooth, least, surprise, l2, rounds)
    part, sums = np.arange(len(texts)) % folds, np.zeros(len(texts))
    for k in range(folds):
        rest = part != k
        if len(set(labels[rest].tolist())) < 2:
            return model
        own = _fit([t for t, r in zip(texts, rest) if r], labels[rest], smooth, least, surprise, l2, rounds)
        sums[~rest] = own.sums([t for t, r in zip(texts, rest) if not r])
    slope, shift = fit_logistic(sums[:, None], labels)
    if slope <= 0:
        return model
    return ToxicityModel((model.weights * slope).astype(np.float32), float(model.intercept * slope + shift))


def _fit(texts, labels, smooth, least, surprise, l2, rounds) -> ToxicityModel:
    weights = np.zeros(BUCKETS, np.float32)
    grams, counts = NGrams(), np.zeros((2, BUCKETS), np.float32)
    for text, label in zip(texts, labels):
        counts[label, grams(text)] += 1
    sizes = np.array([(labels == k).sum() for k in (0, 1)], np.float64)
    rates = (counts + smooth) / (sizes + 2 * smooth)[:, None]
    ratio = np.log(rates[1] / rates[0])
    pooled = counts.sum(0) / sizes.sum()
    spread = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / sizes).sum())
    used = (np.abs(counts[1] / sizes[1] - counts[0] / sizes[0]) >= surprise * spread) & (counts.sum(0) >= least)
    column = np.full(BUCKETS, -1, np.int32)
    column[used] = np.arange(used.sum())
    rows, cols = [], []
    for i, text in enumerate(texts):
        c = column[grams(text)]
        c = c[c >= 0]
        rows.append(np.full(len(c), i, np.int32))
        cols.append(c)
    row, col, scale = np.concatenate(rows), np.concatenate(cols), ratio[used]
    w, b = _descend(row, col, scale, labels, l2, rounds)
    weights[used] = w * scale
    return ToxicityModel(weights, b)


def _descend(row, col, scale, labels, l2, rounds) -> tuple[np.ndarray, float]:
    """Logistic regression on the scaled features by L-BFGS; both classes weigh the same."""
    n, m = len(labels), len(scale)
    value = scale[col]
    share = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())

    def cost(v):
        z = np.bincount(row, value * v[:m][col], n) + v[m]
        signed = np.where(labels == 1, z, -z)
        slack = (sigmoid(z) - labels) * share
        grad = np.append(np.bincount(col, value * slack[row], m) + l2 * v[:m] / n, slack.sum())
        return (share * np.logaddexp(0, -signed)).sum() + l2 / (2 * n) * (v[:m] ** 2).sum(), grad

    v, steps = np.zeros(m + 1), []
    f, g = cost(v)
    for _ in range(rounds):
        d, back = g.copy(), []
        for s, y in reversed(steps):
            a = (s @ d) / (s @ y)
            d -= a * y
            back.append(a)
        if steps:
            s, y = steps[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(back)):
            d += (a - (y @ d) / (s @ y)) * s
        t = 1.0 if steps else 1.0 / (np.abs(g).max() * np.sqrt(m + 1) + 1e-12)
        while t > 1e-10:
            f2, g2 = cost(v - t * d)
            if f2 <= f - 1e-4 * t * (g @ d):
                break
            t /= 2
        else:
            break
        s, y = -t * d, g2 - g
        if s @ y > 1e-14:
            steps = [*steps[-9:], (s, y)]
        v, done, f, g = v + s, f - f2 < 1e-9, f2, g2
        if done:
            break
    return v[:m], float(v[m])


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic") -> ToxicityModel:
    texts, known, _totals = labelled_sample(docs, labels, label, usable, FIT_ROWS, FIT_CHARS)
    return fit(texts, known)  # the sample is more even than the corpus: misses weigh more than its shares say


def score(docs: DataFrame, model: ToxicityModel, carried: list[str], name: str = "score") -> DataFrame:
    """The carried columns of every row and its score, as column ``name``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return score_texts(docs, lambda texts: sent.value.scores(texts), carried, name)


def judged(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; ids of part ``held`` are never learnt from.

    A null id is of no part: held_out is false.
    """
    model = learn(docs, labels, fold(F.col("doc_id"), parts) != held)
    return score(docs, model, ["doc_id"]).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
