"""Passages of benchmark items in documents, found by winnowing.

A window is ``SIZE`` consecutive words of an item; an item of fewer words, but not none, is one window. Both sides keep
the hash of the smallest k-gram (``GRAM`` words, the last of equal ones) of every run of ``SIZE`` words, so any two equal
windows share a kept k-gram at the same place: no shared span of ``SIZE`` words or more is missed. An item of fewer
words is its own k-gram, and all k-grams of that many words are kept of a document.

Kept k-grams of documents first meet a bitmap of the items' (broadcast; its size is clamped, past that it only lets more
through), then the items' k-grams themselves in a join. What is left are hits, and they are extended: the windows around
a hit are looked up by their content (a 128-bit digest). Documents with the same windows form a class, and items are
listed once per class, so a passage that a third of all documents share costs no more than one of them. No document is
compared with an item, and no pair of windows is built.

Texts are taken whole; the arrays of one text take about 15 bytes a byte of it. A null or empty text has no words.
Repeated documents each get their row; null ids are ids like others. Rows of items without an ``item_id`` are no items;
rows that repeat one belong to the same item. Other columns than the ids and ``text`` are not looked at, but for
``carried`` ones. Without items nothing is hit; without documents the result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tagweave.llm.common import free_name, small_batches, written

SIZE, GRAM = 10, 5
#: Bits of the bitmap for each k-gram of the items, and the fewest and most bits in all (as powers of two).
BITS, FEWEST, MOST = 64, 16, 27
#: Bytes of text whose words are hashed at once.
STEP = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
#: A random number for each byte; an odd factor and its inverse modulo 2^64.
BYTE = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(of: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n, of)), dtype=np.uint64)


class Words:
    """The words of some texts: places in their lower-cased bytes, and hashes."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode() for t in texts]
        self.data = LOWER[np.frombuffer(b" ".join([*raw, b""]), np.uint8)]
        inside = np.append(False, WORD[self.data])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[0::2], edges[1::2]
        places = np.cumsum([0, *(len(r) + 1 for r in raw)])
        #: First word of each text, and last of all the number of words.
        self.first = np.searchsorted(self.starts, places)
        self.counts = np.diff(self.first)
        #: For each word, the end of its text (as a word).
        self.limit = np.repeat(self.first[1:], self.counts)
        self.hashes = self._hashes()

    def _hashes(self) -> np.ndarray:
        """Polynomials of the bytes: differences of running sums, brought down by the inverse of the factor."""
        out = np.empty(len(self.starts), np.uint64)
        at, up, down = 0, _powers(FACTOR, STEP), _powers(INVERSE, STEP)
        while at < len(out):
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, base + STEP, "right")))
            bytes_ = self.data[base:self.ends[to - 1]]
            if len(bytes_) > len(up):  # one very long word
                up, down = _powers(FACTOR, len(bytes_)), _powers(INVERSE, len(bytes_))
            sums = np.append(np.uint64(0), np.cumsum(BYTE[bytes_] * up[:len(bytes_)], dtype=np.uint64))
            start, end = self.starts[at:to] - base, self.ends[at:to] - base
            out[at:to] = (sums[end] - sums[start]) * down[start]
            at = to
        return _stir(out)

    def starts_of(self, size: int) -> np.ndarray:
        """The words that ``size`` words of the same text begin with."""
        return np.flatnonzero(np.arange(len(self.limit)) + size <= self.limit)

    def grams(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on (also across texts: see :meth:`starts_of`)."""
        n = max(len(self.hashes) - size + 1, 0)
        total = np.full(n, size, np.uint64)
        for k in range(size):
            total = total * FACTOR + self.hashes[k:k + n]
        return _stir(total)

    def winnowed(self, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the k-grams kept: of every ``size`` words the smallest, the last of equal ones."""
        hashes, begin = self.grams(gram), self.starts_of(size)
        if not len(begin):
            return begin, hashes[:0]
        least, place = hashes[begin], begin.copy()
        for k in range(1, size - gram + 1):
            other = hashes[begin + k]
            lower = other <= least
            least, place = np.where(lower, other, least), np.where(lower, begin + k, place)
        place = np.unique(place)
        return place, hashes[place]

    def digest(self, start: int, size: int) -> str:
        """128 bits that stand for the content of a window."""
        words = [self.data[s:e].tobytes() for s, e in zip(self.starts[start:start + size], self.ends[start:start + size])]
        return hashlib.blake2b(b" ".join(words), digest_size=16).hexdigest()


def _signed(h: np.ndarray) -> list[int]:
    return h.view(np.int64).tolist()


def fingerprints(items: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """item_id (as a string), and of each row the window size, kept k-grams and digests of all windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
                w = Words([text])
                n = len(w.starts)
                short = 0 < n < size
                kept = w.grams(n) if short else w.winnowed(size, gram)[1]
                wide = n if short else size
                out.append((item, wide, sorted(set(_signed(kept))),
                            sorted({w.digest(s, wide) for s in range(n - wide + 1)}) if n else []))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate(
                    (pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string())))],
                ["item_id", "size", "grams", "digests"])

    small_batches(items.sparkSession)
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id IS NOT NULL")
    return rows.mapInArrow(run, "item_id string, size int, grams array<bigint>, digests array<string>")


def _bitmap(grams: DataFrame, n: int) -> np.ndarray:
    """A bitmap of hashes, ``2^MOST`` bits at most, made by Spark; its words come to the driver."""
    bits = min(max(int(n * BITS).bit_length(), FEWEST), MOST)
    low = F.col("gram").bitwiseAND((1 << bits) - 1)
    rows = (grams.select(F.shiftright(low, 6).alias("at"), F.expr("shiftleft(1L, cast(gram & 63 AS int))").alias("bit"))
            .groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow())
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bit").to_numpy().view(np.uint64)
    return out


def _known(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _marks(w: Words, size: int, gram: int, sizes: list[int], bitmap: np.ndarray) -> list[dict]:
    """For each text: kept k-gram that the bitmap knows -> (window size, digest) -> starts of the windows around it."""
    out: list[dict] = [{} for _ in w.counts]
    for wide in sizes:
        if wide == size:
            places, hashes = w.winnowed(size, gram)
        else:
            hashes = w.grams(wide)
            places = w.starts_of(wide)
            hashes = hashes[places]
        seen = _known(bitmap, hashes)
        places, hashes = places[seen], hashes[seen]
        texts = np.searchsorted(w.first, places, "right") - 1
        digests: dict[int, str] = {}
        for place, key, text in zip(places.tolist(), _signed(hashes), texts.tolist()):
            around = out[text].setdefault(key, {})
            reach = size - gram if wide == size else 0
            for start in range(max(place - reach, int(w.first[text])), min(place, int(w.first[text + 1]) - wide) + 1):
                if start not in digests:
                    digests[start] = w.digest(start, wide)
                around.setdefault((wide, digests[start]), set()).add(start - int(w.first[text]))
    return out


def contaminated(docs: DataFrame, items: DataFrame, carried: list[str], size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """The carried columns of every document, ``n_words``, ``spans`` (start and end, in words, of each passage of words
    inside windows of items, in order) and ``item_ids`` (of the items with such windows, as strings, in order)."""
    spark = docs.sparkSession
    own = written(fingerprints(items, size, gram), "items")
    grams = written(own.select(F.explode("grams").alias("gram")).distinct(), "grams")
    windows = written(own.select("item_id", F.explode("digests").alias("digest")).distinct(), "windows")
    contents = written(windows.select("digest").distinct(), "contents")
    sizes = sorted(r["size"] for r in own.filter("size(digests) > 0").select("size").distinct().collect())  # ``size`` rows
    bitmap = spark.sparkContext.broadcast(_bitmap(grams, grams.count()))
    row = free_name(docs, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            ends = np.cumsum([len(t or "") for t in texts])
            cuts = np.unique([0, *np.searchsorted(ends, np.arange(STEP, ends[-1] if len(ends) else 0, STEP)), len(texts)])
            for a, e in zip(cuts.tolist(), cuts[1:].tolist()):
                w = Words(texts[a:e])
                marks = [[{"gram": g, "around": [{"size": n, "digest": d, "starts": sorted(s)} for (n, d), s in m.items()]}
                          for g, m in found.items()] for found in _marks(w, size, gram, sizes, bitmap.value)]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(a, e - a) for c in [row, *carried]), pa.array(w.counts.astype(np.int64)),
                     pa.array(marks, MARKS)], [row, *carried, "n_words", "marks"])

    small_batches(spark)
    kept = docs.withColumn(row, F.monotonically_increasing_id())
    fields = StructType([*kept.select(row, *carried).schema.fields, *StructType.fromDDL(
        "n_words bigint, marks array<struct<gram:bigint,around:array<struct<size:int,digest:string,starts:array<int>>>>>")])
    # Written out, the numbers of the rows stay what they are, and the joins below read plain tables that Spark can split.
    rows = written(kept.select(row, *carried, "text").mapInArrow(run, fields), "documents")

    hits = (rows.select(F.col(row).alias("row"), F.inline("marks")).join(grams, "gram", "left_semi")
            .select("row", F.inline("around")))
    found = written(hits.join(contents, "digest", "left_semi").groupBy("row").agg(
        F.collect_list(F.struct("size", "starts")).alias("hits"), F.array_sort(F.collect_set("digest")).alias("digests"))
        .select("row", "hits", F.sha2(F.array_join("digests", ","), 256).alias("class"), "digests"), "found")
    classes = written(found.select("class", "digests").dropDuplicates(["class"])
                      .select("class", F.explode("digests").alias("digest")).join(windows, "digest")
                      .groupBy("class").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")), "classes")
    spans = found.select("row", "class", "hits").mapInArrow(
        _merged, "row bigint, class string, spans array<struct<start:bigint,end:bigint>>")
    result = spans.join(classes, "class").select(F.col("row").alias(row), "spans", "item_ids")
    return (rows.drop("marks").join(result, row, "left").drop(row)
            .withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")))
            .withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>"))))


MARKS = pa.list_(pa.struct([("gram", pa.int64()), ("around", pa.list_(pa.struct(
    [("size", pa.int32()), ("digest", pa.string()), ("starts", pa.list_(pa.int32()))])))]))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that overlap or touch become one span."""
    for b in batches:
        out = []
        for hits in b.column("hits").to_pylist():
            pairs = sorted({(s, s + h["size"]) for h in hits for s in h["starts"]})
            spans: list[dict] = []
            for start, end in pairs:
                if spans and start <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], end)
                else:
                    spans.append({"start": start, "end": end})
            out.append(spans)
        yield pa.RecordBatch.from_arrays(
            [b.column("row"), b.column("class"), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            ["row", "class", "spans"])


def judged(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    rows = contaminated(docs.select("doc_id", "text"), items, ["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"])
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"),
                       F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                       (n_hit > 0).alias("contaminated"))
