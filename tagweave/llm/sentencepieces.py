"""SentencePiece encoding that keeps offsets, and decoding.

Ids are those of the sentencepiece library for the given model. To say which bytes of the source each piece stands for,
the text is normalised here as the model's specification says: at each place the longest prefix that the compiled
character map knows is replaced (else one character stands), white space is trimmed, prefixed and escaped as asked, and
for each normalised byte the place in the source where it comes from is recorded. Pieces tile the normalised text, so
sums of their lengths are places in that record, and these give each piece's span of source bytes.

Null and empty texts give the begin and end ids alone. Spans of begin and end ids are empty. Texts of any length are
taken whole. Repeated rows and null ids are encoded like any other; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tagweave.llm.common import small_batches

SPACE = "▁"
#: Words whose ids a task remembers, and their greatest length.
REMEMBERED, SHORT = 300_000, 24


class CharacterMap:
    """A model's compiled character map: a trie of byte strings as a double array, and their replacements."""

    def __init__(self, compiled: bytes):
        self.replace: dict[str, str] = {}
        if compiled:
            size = int.from_bytes(compiled[:4], "little")
            units = np.frombuffer(compiled[4:4 + size], dtype="<u4").tolist()
            self._read(units, compiled[4 + size:])
        self.longest = max(map(len, self.replace), default=0)
        starts = sorted({k[0] for k in self.replace})
        self.known = re.compile("[" + "".join(map(re.escape, starts)) + "]") if starts else None

    def _read(self, units: list[int], targets: bytes) -> None:
        """Walk the trie: a unit holds its label, whether a value hangs on it, and the offset of its children."""
        def children(unit: int) -> int:
            return (unit >> 10) << ((unit & 512) >> 6)

        todo = [(children(units[0]), b"")]
        while todo:
            base, key = todo.pop()
            for label in range(1, 256):
                at = base ^ label
                if at >= len(units) or units[at] & 0x800000FF != label:
                    continue
                unit, found = units[at], key + bytes([label])
                below = at ^ children(unit)
                if unit >> 8 & 1:
                    start = units[below] & 0x7FFFFFFF
                    self.replace[found.decode()] = targets[start:targets.index(b"\0", start)].decode()
                todo.append((below, found))

    def split(self, text: str) -> Iterator[tuple[str, str]]:
        """(source, normalised) parts of a text; a part is a known prefix, or what stands as it is."""
        at = 0
        while self.known:
            hit = self.known.search(text, at)
            if not hit:
                break
            if hit.start() > at:
                yield text[at:hit.start()], text[at:hit.start()]
            at = hit.start()
            for n in range(min(self.longest, len(text) - at), 0, -1):
                if text[at:at + n] in self.replace:
                    break
            else:
                n = 1
            part = text[at:at + n]
            yield part, self.replace.get(part, part)
            at += n
        if at < len(text):
            yield text[at:], text[at:]


class Normalizer:
    def __init__(self, compiled: bytes = b"", prefix: bool = True, trim: bool = False, escape: bool = True):
        self.map, self.prefix, self.trim, self.escape = CharacterMap(compiled), prefix, trim, escape

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each (and their end) the source byte that they come from."""
        out, places, at = [], [], 0
        for source, made in self.map.split(text):
            size = len(source.encode())
            raw = made.encode()
            out.append(raw)
            places.append(np.arange(at, at + size) if source == made else np.full(len(raw), at))
            at += size
        raw = np.frombuffer(b"".join(out), np.uint8)
        place = np.append(np.concatenate(places) if places else np.zeros(0, np.int64), at)
        # Bytes inside a character come from where the character begins.
        inner = np.append((raw & 0xC0) == 0x80, False)
        place = place[np.maximum.accumulate(np.where(inner, 0, np.arange(len(place))))]
        if self.trim and len(raw):
            space = raw == 32
            keep = ~space | np.append(False, ~space[:-1])
            full = np.flatnonzero(~space)
            end = full[-1] + 1 if len(full) else 0
            keep[end:] = False
            place = np.append(place[:-1][keep], place[end])
            raw = raw[keep]
        if not len(raw):
            return b"", place[-1:]
        if self.prefix:
            raw, place = np.append(np.uint8(32), raw), np.append(place[0], place)
        if self.escape:
            mark = np.frombuffer(SPACE.encode(), np.uint8)
            many = np.where(raw == 32, len(mark), 1)
            first = np.cumsum(many) - many
            wide = np.repeat(raw, many)
            for k, byte in enumerate(mark):
                wide[first[raw == 32] + k] = byte
            raw, place = wide, np.append(np.repeat(place[:-1], many), place[-1])
        made = raw.tobytes()
        while self.trim and self.escape and made.endswith(SPACE.encode()):  # a mark in the source ends like a space
            made = made[:-len(SPACE.encode())]
        return made, place[:len(made) + 1]


class Encoder:
    """A model with its normaliser and the byte lengths of its pieces."""

    def __init__(self, model: str):
        import sentencepiece
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        with open(model, "rb") as f:
            self.normalizer = Normalizer(**normalizer_of(f.read()))
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.sizes = np.array([0 if self.pieces.is_control(i) else 1 if self.pieces.is_byte(i) else len(p.encode())
                               for i, p in enumerate(names)])
        self.unknown = self.pieces.unk_id()
        self.ends = [array("I", [max(i, 0)]).tobytes() for i in (self.pieces.bos_id(), self.pieces.eos_id())]
        # No merge crosses the border before a space mark if no piece has one inside; then words are encoded apart.
        n = self.normalizer
        self.by_word = (n.prefix and n.escape and not n.trim and not n.map.replace and min(self.pieces.bos_id(),
                        self.pieces.eos_id()) >= 0 and not any(SPACE in p.lstrip(SPACE) for p in names))
        self.known: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with begin and end ids, as little-endian unsigned 32-bit integers."""
        split = [t.split(" ") if self.by_word and SPACE not in t else [""] for t in texts]
        split = [words if all(words) else None for words in split]
        new = [w for w in set().union(*filter(None, split)) if w not in self.known]
        if len(self.known) > REMEMBERED:
            self.known.clear()
            new = list(set().union(*filter(None, split)))
        for word, ids in zip(new, self.pieces.encode(new, num_threads=1)):
            self.known[word] = array("I", ids).tobytes()
        out = [np.frombuffer(b"".join([self.ends[0], *map(self.known.__getitem__, words), self.ends[1]]), np.uint32)
               if words else np.array(self.pieces.encode(t, add_bos=True, add_eos=True), np.uint32)
               for t, words in zip(texts, split)]
        for word in new:
            if len(word) > SHORT:
                del self.known[word]
        return [i.astype("<u4", copy=False) for i in out]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) source byte of each id."""
        sizes = self.sizes[ids]
        if (ids == self.unknown).any():
            names = self.pieces.encode(text, out_type=str)
            sizes[1:-1] = [s if i != self.unknown else len(p.encode()) for i, s, p in zip(ids[1:-1], sizes[1:-1], names)]
        normal, place = self.normalizer(text)
        ends = np.cumsum(sizes)
        if ends[-1] != len(normal):
            raise ValueError(f"pieces cover {ends[-1]} bytes of a normalised text of {len(normal)}")
        return place[ends - sizes], place[ends]


def normalizer_of(model: bytes) -> dict:
    """The normaliser's settings in a serialised model (field 3: the map in 2, its switches in 3, 4 and 5)."""
    found = dict(_fields(next(v for k, v in _fields(model) if k == 3)))
    return {"compiled": found.get(2, b""), "prefix": bool(found.get(3, 1)), "trim": bool(found.get(4, 1)),
            "escape": bool(found.get(5, 1))}


def _fields(message: bytes) -> Iterator[tuple[int, bytes | int]]:
    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(message):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, message[at:at + size]
            at += size


@lru_cache(maxsize=2)
def encoder(model: str) -> Encoder:
    return Encoder(model)


def encoded(docs: DataFrame, model: str, carried: list[str]) -> DataFrame:
    """The carried columns, and ids, starts and ends (source bytes of each id) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for b in batches:
            texts = ["" if t is None else t for t in b.column("text").to_pylist()]
            ids = e.ids(texts)
            spans = [e.spans(t, i) for t, i in zip(texts, ids)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in carried), _lists([i.astype(np.int32) for i in ids]),
                 _lists([s[0] for s in spans]), _lists([s[1] for s in spans])], [*carried, "ids", "starts", "ends"])

    small_batches(docs.sparkSession)
    longs = ArrayType(LongType())
    return docs.select(*carried, "text").mapInArrow(run, StructType([
        *docs.select(*carried).schema.fields, StructField("ids", ArrayType(IntegerType())),
        StructField("starts", longs), StructField("ends", longs)]))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def decoded(rows: DataFrame, model: str, carried: list[str]) -> DataFrame:
    """The carried columns and the text that ``ids`` decode to (null ids: the empty text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(model).pieces
        for b in batches:
            texts = [pieces.decode(i or []) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), pa.array(texts, pa.string())],
                                             [*carried, "text"])

    kept = rows.select(*carried)
    return rows.select(*dict.fromkeys([*carried, "ids"])).mapInArrow(
        run, StructType([*kept.schema.fields, StructField("text", StringType())]))


def round_trips(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and span_bytes (source bytes that the spans cover) of every row."""
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "span_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for b in batches:
            rows = []
            texts = ["" if t is None else t for t in b.column("text").to_pylist()]
            for text, ids in zip(texts, e.ids(texts)):
                starts, ends = e.spans(text, ids)
                rows.append((len(ids), hashlib.sha256(ids).hexdigest(),
                             hashlib.sha256(e.pieces.decode(ids.tolist()).encode()).hexdigest(),
                             int((ends - starts).sum())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(
                pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64())))],
                ["doc_id", *names])

    small_batches(docs.sparkSession)
    kinds = (LongType(), StringType(), StringType(), LongType())
    return docs.select("doc_id", "text").mapInArrow(run, StructType(
        [docs.schema["doc_id"], *(StructField(n, k) for n, k in zip(names, kinds))]))
