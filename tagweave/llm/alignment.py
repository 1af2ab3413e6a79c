"""Alignment of the tokens of two tokenizers on the same texts.

Tokens are byte ranges of a space and the text. Where a token of A and one of B end at the same byte they are linked, and
the links cut the tokens into groups. Documents of a batch are merged in lockstep: one state vector holds the place of
each in its A and its B tokens, each step compares the ends there, moves the side that is behind (both, where the ends
meet: a link and a cut), and documents that are through leave the vector. A long document takes several places in it: it
is parted at ends that both sides have, so the number of steps follows ``LANE``, not the longest text.

How often a pair of ids is linked in the whole corpus is counted by Spark. Of two linked tokens one is a suffix of the
other, so the number of different pairs is bounded by the vocabularies (their tokens' suffixes), whatever the corpus:
these counts are broadcast, and a second pass over the written links adds them up.

Texts are taken whole. Null and empty texts, and texts whose tokens do not spell a space and the text, have no tokens.
Repeated rows and null ids are rows like others; other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tagweave.llm import packing, sentencepieces
from tagweave.llm.common import small_batches, written

#: Tokens of A that one place in the state vector goes through, about, and bytes of text merged at once.
LANE, BYTES = 256, 1 << 20


class Tokenizers:
    """A byte-level tokenizer (A) and a sentencepiece model (B), with the bytes of their tokens."""

    def __init__(self, tokenizer: str, ranks: str | None, pattern: str | None, model: str):
        self.a = packing.Encoder(tokenizer, ranks, pattern)
        self.a.exact.encode_special_tokens, self.a.special = True, []  # their strings are plain text
        self.b = sentencepieces.Encoder(model)
        chars = _byte_chars()
        names = {i: n for n, i in self.a.exact.get_vocab().items()}
        self.bytes_a = [bytes(chars.get(c, 63) for c in names.get(i, "")) for i in range(max(names) + 1)]
        pieces = self.b.pieces
        self.bytes_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else
                        pieces.id_to_piece(i).replace(sentencepieces.SPACE, " ").encode()
                        for i in range(pieces.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, t)), np.int64) for t in (self.bytes_a, self.bytes_b))
        # Ids as text with what may follow them: in a group ids are parted by commas, sides by a bar, groups by semicolons.
        self.shown = [f"{i}{end}" for t, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for end in ends
                      for i in range(len(t))]

    def __call__(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B of every text; both empty where they do not spell it."""
        b_ids = [i[1:-1] for i in self.b.ids([t or "" for t in texts])]
        a_ids = [self.a(" " + t) if t else np.zeros(0, np.uint32) for t in texts]
        for n, text in enumerate(texts):
            want = (" " + text).encode() if text else b""
            for ids, table in ((a_ids[n], self.bytes_a), (b_ids[n], self.bytes_b)):
                if not text or b"".join(map(table.__getitem__, ids.tolist())) != want:
                    a_ids[n] = b_ids[n] = np.zeros(0, np.uint32)
                    break
        return a_ids, b_ids


def _byte_chars() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 as it is, others from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


@lru_cache(maxsize=2)
def tokenizers(*files: str | None) -> Tokenizers:
    return Tokenizers(*files)


class Merged:
    """The tokens of some documents, one after the other, and their links: ``link_a`` and ``link_b`` are the places of
    the tokens of A and B whose ends meet, in order; ``first_a``, ``first_b`` and ``first_link`` where documents begin."""

    def __init__(self, a_ids: list[np.ndarray], b_ids: list[np.ndarray], sizes_a: np.ndarray, sizes_b: np.ndarray,
                 lane: int = LANE):
        self.a, self.b = (np.concatenate([*t, np.zeros(0, np.uint32)]).astype(np.int64) for t in (a_ids, b_ids))
        self.first_a, self.first_b = (np.cumsum([0, *map(len, t)]) for t in (a_ids, b_ids))
        # Documents lie one after the other, and both sides spell the same, so ends grow over all of them.
        ends_a, ends_b = np.cumsum(sizes_a[self.a]), np.cumsum(sizes_b[self.b])
        self.link_a, self.link_b = _lockstep(ends_a, ends_b, *self._lanes(ends_a, ends_b, lane))
        self.first_link = np.searchsorted(self.link_a, self.first_a)

    def _lanes(self, ends_a: np.ndarray, ends_b: np.ndarray, lane: int) -> tuple[np.ndarray, ...]:
        """Where parts begin and end, in tokens of A and of B: documents, and long ones parted at common ends."""
        tries = np.concatenate([np.arange(s + lane, e, lane) for s, e in zip(self.first_a, self.first_a[1:])]
                               + [np.zeros(0, np.int64)])
        other = np.searchsorted(ends_b, ends_a[tries - 1])
        common = ends_b[np.minimum(other, len(ends_b) - 1)] == ends_a[tries - 1] if len(tries) else np.zeros(0, bool)
        a = np.concatenate([self.first_a, tries[common]])
        b = np.concatenate([self.first_b, other[common] + 1])
        a.sort()
        b.sort()
        return a[:-1], a[1:], b[:-1], b[1:]


def _lockstep(ends_a: np.ndarray, ends_b: np.ndarray, at_a: np.ndarray, stop_a: np.ndarray, at_b: np.ndarray,
              stop_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and B that end together, of all parts at once, in order."""
    open_ = (at_a < stop_a) & (at_b < stop_b)
    state, stop = np.stack([at_a[open_], at_b[open_]]), np.stack([stop_a[open_], stop_b[open_]])
    links = []
    while state.shape[1]:
        far = ends_a[state[0]] - ends_b[state[1]]
        links.append(state[:, far == 0])
        state[0] += far <= 0
        state[1] += far >= 0
        going = (state < stop).all(axis=0)
        if not going.all():
            state, stop = state[:, going], stop[:, going]
    a, b = np.concatenate([np.zeros((2, 0), np.int64), *links], axis=1)
    return np.sort(a), np.sort(b)  # along all documents both grow together


def _shown(m: Merged, t: Tokenizers) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of every document."""
    n_a, n_b = len(t.bytes_a), len(t.bytes_b)
    last_a, last_b = np.zeros(len(m.a), bool), np.zeros(len(m.b), bool)
    last_a[m.link_a], last_b[m.link_b] = True, True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    # A group's A tokens come before its B tokens: a token follows all of the other side that is before it.
    until_b = np.append(0, m.link_b + 1)[group_a]
    until_a = (m.link_a + 1)[group_b]
    codes = np.empty(len(m.a) + len(m.b), np.int64)
    codes[np.arange(len(m.a)) + until_b] = m.a + n_a * last_a
    codes[np.arange(len(m.b)) + until_a] = m.b + 2 * n_a + n_b * last_b
    firsts = m.first_a + m.first_b
    return ["".join(map(t.shown.__getitem__, codes[s:e].tolist()))[:-1] for s, e in zip(firsts, firsts[1:])]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    ends = np.cumsum([len(t or "") for t in texts])
    cuts = np.unique([0, *np.searchsorted(ends, np.arange(BYTES, ends[-1] if len(ends) else 0, BYTES)), len(texts)])
    return zip(cuts.tolist(), cuts[1:].tolist())


def aligned(docs: DataFrame, carried: list[str], tokenizer: str, model: str, ranks: str | None = None,
            pattern: str | None = None) -> DataFrame:
    """The carried columns, the ids of A and B, and ``links``: the places of linked tokens in both. A link ends a group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(tokenizer, ranks, pattern, model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for s, e in _chunks(texts):
                a_ids, b_ids = t(texts[s:e])
                m = Merged(a_ids, b_ids, t.sizes_a, t.sizes_b)
                links = []
                for n, (low, high) in enumerate(zip(m.first_link, m.first_link[1:])):
                    pairs = zip((m.link_a[low:high] - m.first_a[n]).tolist(), (m.link_b[low:high] - m.first_b[n]).tolist())
                    links.append([{"a": a, "b": b} for a, b in pairs])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(s, e - s) for c in carried), *(pa.array(
                        [i.astype(np.int32) for i in ids], pa.list_(pa.int32())) for ids in (a_ids, b_ids)),
                     pa.array(links, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
                    [*carried, "a_ids", "b_ids", "links"])

    small_batches(docs.sparkSession)
    new = StructType.fromDDL("a_ids array<int>, b_ids array<int>, links array<struct<a:int,b:int>>")
    return docs.select(*carried, "text").mapInArrow(run, StructType([*docs.select(*carried).schema.fields, *new]))


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def linked(docs: DataFrame, tokenizer: str, model: str, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and ``pairs`` (for each link its A id times the number of B ids
    plus its B id) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(tokenizer, ranks, pattern, model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for s, e in _chunks(texts):
                m = Merged(*t(texts[s:e]), t.sizes_a, t.sizes_b)
                shas = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in _shown(m, t)]
                counts = [pa.array(np.diff(f)) for f in (m.first_a, m.first_b, m.first_link, m.first_link)]
                pairs = pa.array(m.a[m.link_a] * len(t.bytes_b) + m.b[m.link_b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(s, e - s), *counts, pa.array(shas, pa.string()),
                     pa.ListArray.from_arrays(pa.array(m.first_link.astype(np.int32)), pairs)], [*COLUMNS, "pairs"])

    small_batches(docs.sparkSession)
    new = StructType.fromDDL("n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
                             "pairs array<bigint>")
    return docs.select("doc_id", "text").mapInArrow(run, StructType([docs.schema["doc_id"], *new]))


def counted(docs: DataFrame, tokenizer: str, model: str, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    A pair's count is the number of links between its ids in all rows; ``count_sum`` adds it up over a row's links, and
    ``n_best`` counts those whose pair is the most frequent one of its B id, ties included.
    """
    rows = written(linked(docs, tokenizer, model, ranks, pattern), "links")
    n_b = tokenizers(tokenizer, ranks, pattern, model).b.pieces.get_piece_size()
    counts = written(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").count(), "counts")
    most = counts.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("count").alias("most"))
    # One row per pair of ids: at most as many as the tokens of both vocabularies have suffixes.
    got = (counts.withColumn("b", F.col("pair") % n_b).join(most, "b")
           .select("pair", "count", (F.col("count") == F.col("most")).alias("best")).orderBy("pair").toArrow())
    sent = rows.sparkSession.sparkContext.broadcast(tuple(
        got.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "count", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = sent.value
        for b in batches:
            ends = np.append(0, np.cumsum(b.column("n_links").to_numpy()))
            at = np.searchsorted(pair, b.column("pairs").flatten().to_numpy())
            sums = [np.append(0, np.cumsum(v[at], dtype=np.int64))[ends] for v in (best, count)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in COLUMNS), *(pa.array(np.diff(s)) for s in sums)], [*COLUMNS, "n_best", "count_sum"])

    new = StructType.fromDDL("n_best bigint, count_sum bigint")
    return rows.mapInArrow(run, StructType([*rows.select(*COLUMNS).schema.fields, *new]))
