"""Packing documents into as few sequences of a fixed number of tokens as it can.

Which documents meet in a sequence depends on lengths alone, so the plan is made from the histogram of piece lengths
(one row per length at most, ``CAPACITY`` in all), whatever the number of documents. It is made by bin completion:
around the largest length left, fillings of the rest of the sequence are tried, least waste first; a filling is applied
as often as its lengths last; branches whose waste cannot beat the incumbent are pruned. Not all undominated fillings
are enumerated: only the best single length and the best pairs, a pair extended by the largest lengths that still fit,
and of those ``CHILDREN`` a node; the best fillings of three or more small lengths can be missed. The best-fit decreasing solution is the first incumbent, and the search ends at the lower bound or after
``NODES`` nodes with the best solution so far. Each application uses up a length, so a plan has few patterns.

Pieces are then numbered within their length (in buckets, so that a length that holds a third of all pieces is many
tasks' work), and a piece's number says which copy of which pattern it belongs to. No pair of documents is compared.

A document's tokens are its ids and ``END``. Only longer ones are cut, into pieces of ``CAPACITY``; the first piece is
the shorter one. A null or empty text is the id ``END`` alone. Rows are packed as they come: repeated rows and null
ids are documents like any other. Other columns are not looked at. An empty table gives an empty result.

Ids are those of the ``tokenizers`` library for the given file. Where it certainly gives the same (texts of code points
below U+0250 without the end marker's text and without very long words), the same vocabulary's rank file is used with
``tiktoken``, which takes a quarter of the time; tests hold the two against each other.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagweave.llm.common import small_batches, written
from tagweave.operators.ordering import rank_in_group

CAPACITY, END = 2048, 0
NODES, CHILDREN = 20_000, 4
#: Pieces of one length that are numbered in one task.
NUMBERED = 1000
WORD = 1000

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


class Encoder:
    """Ids of texts, as arrays of unsigned 32-bit integers."""

    def __init__(self, tokenizer: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer
        self.exact = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.plain = re.compile("[\x00-ɏ]*")

    def __call__(self, text: str) -> np.ndarray:
        if (self.fast and self.plain.fullmatch(text) and not any(s in text for s in self.special)
                and (len(text) <= WORD or max(map(len, text.split(" "))) <= WORD and " " * WORD not in text)):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None,
           capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer, ranks, pattern)
        for b in batches:
            rows: list[tuple] = []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(i, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
            index, piece, start, length, crc = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(index, pa.int64())), pa.array(piece, pa.int32()),
                 *(pa.array(c, pa.int64()) for c in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, "
             "ids_crc32 bigint")


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over counted lengths: patterns and how many sequences have them."""
    bins: dict[Pattern, int] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        open_bins = sorted((capacity - _total(p), p) for p in bins if capacity - _total(p) >= size)
        for room, pattern in open_bins:
            if not left:
                break
            left = _fill(bins, pattern, size, room // size, left)
        if left:
            bins[()] = bins.get((), 0) + -(-left // (capacity // size))
            left = _fill(bins, (), size, capacity // size, left)
    return [(p, n) for p, n in bins.items() if n]


def _fill(bins: dict[Pattern, int], pattern: Pattern, size: int, each: int, left: int) -> int:
    """Put up to ``each`` more of a length into sequences of a pattern; how many are left over."""
    whole = min(bins[pattern], left // each)
    over = left - whole * each if whole < bins[pattern] else 0
    for many, of in ((whole, each), (1 if 0 < over < each else 0, over)):
        if many:
            bins[pattern] -= many
            new = (*pattern, (size, of))
            bins[new] = bins.get(new, 0) + many
            left -= many * of
    if not bins[pattern]:
        del bins[pattern]
    return left


def _total(pattern: Pattern) -> int:
    return sum(s * n for s, n in pattern)


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[Pattern, int]]:
    """Patterns and their numbers of sequences that hold all counted lengths (1 to ``capacity``)."""
    best = best_fit(counts, capacity)
    fewest = sum(n for _p, n in best)
    total = sum(s * n for s, n in counts.items())
    least = -(-total // capacity)
    start = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        start[s] = n
    path: list[tuple[Pattern, int]] = []
    # One entry per level: the counts there, the fillings still to try, sequences and waste so far.
    stack = [(start, _fillings(start, capacity), 0, 0)]
    while stack and fewest > least and nodes > 0:
        state, todo, used, waste = stack[-1]
        del path[len(stack) - 1:]
        if not todo:
            stack.pop()
            continue
        nodes -= 1
        filling = todo.pop(0)
        times = min(int(state[s]) // n for s, n in filling)
        waste += times * (capacity - _total(filling))
        if waste > (fewest - 1) * capacity - total:
            continue
        state = state.copy()
        for s, n in filling:
            state[s] -= n * times
        used += times
        path.append((filling, times))
        if not state.any():
            if used < fewest:
                best, fewest = list(path), used
            path.pop()
            continue
        rest = int((state * np.arange(capacity + 1)).sum())
        if used + -(-rest // capacity) >= fewest:
            path.pop()
            continue
        stack.append((state, _fillings(state, capacity), used, waste))
    return best


def _fillings(state: np.ndarray, capacity: int) -> list[Pattern]:
    """Fillings around the largest length left, least waste first, none dominated by another of them.

    A filling is dominated when another holds lengths that its own could be exchanged into: of single lengths only the
    largest that fits counts, and of pairs, for each larger one, the largest partner that fits, if both together
    exceed the best single. One filling that leaves no waste with one length is enough.
    """
    sizes = np.flatnonzero(state)
    if not len(sizes):
        return []
    large = int(sizes[-1])
    left = state.copy()
    left[large] -= 1
    room, sizes = capacity - large, np.flatnonzero(left)
    sizes = sizes[sizes <= room]
    if not len(sizes):
        return [((large, 1),)]
    single = int(sizes[-1])
    found = [_pattern([large, single])]
    if single == room:
        return found
    fits = sizes[sizes + sizes[0] <= room]
    if len(fits):
        partner = sizes[np.searchsorted(sizes, room - fits, "right") - 1]
        # A length that is there once cannot be its own partner: then the next smaller one.
        twice = (partner == fits) & (left[fits] < 2)
        place = np.searchsorted(sizes, partner) - twice
        ok = (place >= 0) & (partner <= fits)
        a, b = fits[ok], sizes[np.maximum(place[ok], 0)]
        better = a + b > single
        a, b = a[better], b[better]
        order = np.lexsort((-a, -(a + b)))[:CHILDREN]
        for x, y in zip(a[order], b[order]):
            # What room is left takes the largest lengths that fit, one after the other.
            chosen, spare = [large, int(x), int(y)], room - int(x + y)
            taken = left.copy()
            taken[x] -= 1
            taken[y] -= 1
            while spare > 0:
                more = np.flatnonzero(taken[:spare + 1])
                if not len(more):
                    break
                chosen.append(int(more[-1]))
                taken[more[-1]] -= 1
                spare -= int(more[-1])
            found.append(_pattern(chosen))
    return sorted(dict.fromkeys(found), key=lambda p: (-_total(p), [-s for s, _n in p]))[:CHILDREN]


def _pattern(sizes: list[int]) -> Pattern:
    counted: dict[int, int] = {}
    for s in sizes:
        counted[s] = counted.get(s, 0) + 1
    return tuple(sorted(counted.items(), reverse=True))


def placed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (from :func:`pieces`, written out) with sequence_id and offset."""
    counts = dict(parts.groupBy("length").count().collect())  # a row per length, ``capacity`` at most
    steps = []
    taken: dict[int, int] = {}
    base = 0
    for pattern, times in plan(counts, capacity):
        offset = 0
        for size, many in pattern:
            steps.append((size, taken.get(size, 0), many, base, offset))
            taken[size] = taken.get(size, 0) + many * times
            offset += size * many
        base += times
    table = np.array(sorted(steps), dtype=np.int64).reshape(-1, 5)
    sent = parts.sparkSession.sparkContext.broadcast(table)
    spread = parts.sparkSession.createDataFrame(
        [(s, -(-n // NUMBERED)) for s, n in counts.items()], "length bigint, buckets bigint")
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets"))
    ranked = rank_in_group(parts.join(F.broadcast(spread), "length"), ["length"],
                           ["doc_id", "piece", "start", "ids_crc32"], bucket, "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, low, many, first, offset = sent.value.T
        for b in batches:
            length = b.column("length").to_numpy()
            place = b.column("place").to_numpy() - 1
            at = np.searchsorted(size * (1 << 50) + low, length * (1 << 50) + place, "right") - 1
            copy, slot = np.divmod(place - low[at], many[at])
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in names), pa.array(first[at] + copy), pa.array(offset[at] + slot * length)],
                [*names, "sequence_id", "offset"])

    kind = parts.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
                                  "sequence_id bigint, offset bigint")


def packed(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None,
           capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    return placed(written(pieces(docs, tokenizer, ranks, pattern, capacity), "pieces"), capacity)
