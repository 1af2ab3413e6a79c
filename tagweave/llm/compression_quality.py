"""Quality by compression: which of two zstandard dictionaries, of good or of bad text, makes a text smaller.

One dictionary is built from texts labelled good, one from texts labelled bad. A text is cut into blocks of ``BLOCK``
bytes (so that its own history does not outweigh the dictionary), each compressed under either; the difference of the
two sums per byte of text is the normalised difference. A logistic curve, fitted on labelled texts that are in neither
dictionary, turns it into the probability of label 1. Whole texts are scored, of any length.

Fitting takes a bounded sample of labelled rows to the driver (``FIT_ROWS`` rows and ``FIT_CHARS`` characters of a
class at most); the two dictionaries (``DICTIONARY`` bytes each at most) go to the executors.

Null and empty texts have the difference 0. Without rows of both classes to learn from every score is the share of
label 1, or 1 where there are none, so that a filter rejects nothing. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tagweave.llm.common import fit_logistic, fold, labelled_sample, score_texts, sigmoid

DICTIONARY, PIECE, BLOCK, LEVEL = 110_000, 1000, 512, 3
FIT_ROWS, FIT_CHARS = 4000, 12_000_000
#: Every so many-th text of a class is kept out of the dictionaries, for the curve.
CURVE = 3


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    shift: float

    def scores(self, texts: list[str]) -> list[float]:
        if not self.good:
            return [self.shift] * len(texts)
        return sigmoid(self.slope * differences(self.good, self.bad, texts) + self.shift).tolist()


def differences(good: bytes, bad: bytes, texts: list[str]) -> np.ndarray:
    """(bytes under the bad dictionary - bytes under the good one) per byte of text."""
    under = [_compressor(d) for d in (bad, good)]
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        view = memoryview(raw)
        blocks = [view[k:k + BLOCK] for k in range(0, len(raw), BLOCK)]
        by_bad, by_good = (sum(len(c.compress(b)) for b in blocks) for c in under)
        out[i] = (by_bad - by_good) / max(len(raw), 1)
    return out


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    kept = zstandard.ZstdCompressionDict(dictionary)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_content_size=False, write_checksum=False,
                                    write_dict_id=False)


def build_dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; of too little text to train on, the text itself."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    pieces = [r[i:i + PIECE] for r in raws for i in range(0, len(r), PIECE)]
    total = sum(map(len, pieces))
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(total // 4, 256)), pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(raws)[:DICTIONARY] or b"\n" * 8


def fit(texts: list[str], labels: np.ndarray, totals: np.ndarray | None = None) -> CompressionModel:
    """Learn from texts and 0/1 labels; ``totals`` are the sizes of the classes that the texts are a sample of."""
    if len(set(labels.tolist())) < 2:
        return CompressionModel(b"", b"", 0.0, float(labels.mean()) if len(labels) else 1.0)
    place = np.zeros(len(labels), np.int64)
    for k in (0, 1):
        place[labels == k] = np.arange((labels == k).sum())
    held = place % CURVE == CURVE - 1
    if len(set(labels[held].tolist())) < 2:
        held[:] = True
        inside = np.ones(len(labels), bool)
    else:
        inside = ~held
    good, bad = (build_dictionary([t for t, y, use in zip(texts, labels, inside) if use and y == k]) for k in (1, 0))
    x = differences(good, bad, [t for t, use in zip(texts, held) if use])
    unit = float(x.std()) or 1.0
    slope, shift = fit_logistic(x[:, None] / unit, labels[held])
    if totals is not None:
        held_sizes = [(labels[held] == k).sum() for k in (0, 1)]
        shift += np.log(totals[1] / totals[0]) - np.log(held_sizes[1] / held_sizes[0])
    return CompressionModel(good, bad, float(max(slope, 0.0) / unit), float(shift))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality") -> CompressionModel:
    return fit(*labelled_sample(docs, labels, label, usable, FIT_ROWS, FIT_CHARS))


def score(docs: DataFrame, model: CompressionModel, carried: list[str], name: str = "score") -> DataFrame:
    """The carried columns of every row and its score, as column ``name``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return score_texts(docs, lambda texts: sent.value.scores(texts), carried, name)


def judged(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; ids of part ``held`` are never learnt from.

    A null id is of no part: held_out is false.
    """
    model = learn(docs, labels, fold(F.col("doc_id"), parts) != held)
    return score(docs, model, ["doc_id"]).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
