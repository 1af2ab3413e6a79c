"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming radius by BK-trees.

Fingerprint: A-Z is lower-cased, words are runs without ASCII white space, shingles of ``width`` words (repeats
included, joined by a space) are hashed with XXH64 (seed 42); a bit is set if it is in over half of the hashes. Fewer
words make one shingle; no word (also a null text) makes the fingerprint zero, which links like any other.

Links: equal fingerprints become one node first, so copies cost nothing. The 64 bits are cut into 6 blocks; two
fingerprints within 4 bits agree on two whole blocks at least, so they meet in one of the 15 shards that the pairs of
blocks name. A shard's fingerprints are the nodes of a BK-tree (children keyed by their distance to the parent); a
search follows only the edges whose key is within the radius of the distance at hand. Trees of all shards together
grow with the corpus, so they are not broadcast whole: each is built in the task that holds its shard, and searches
are routed to it by the shuffle. A shard of more than ``TREE`` fingerprints is dealt out as several trees of about
that size, each in any task, and its fingerprints are sent to each of them. No pair within the radius is lost and none
is emitted that the component does not need: a tree returns each fingerprint with one that it is connected to.

Every row comes back, null ids and repeated rows too; a component without any id has a null component_id. Other
columns are not looked at. An empty table gives an empty one.

:func:`keep_one`, the stage of the pipeline, links by similarity instead: two texts are near copies if the sets of their
shingles of five words have a Jaccard similarity of 0.8 or more. Such pairs differ in about 10 of 64 bits, too many for
shards of whole blocks, so shards are named by bands of minima of the shingles' hashes; a pair at 0.8 meets in one of 16
bands of 4 minima with probability 0.9998, a closer one more surely. The BK-trees search a shard within 22 bits, and a
link counts only when both shingle sets confirm the similarity. Texts with equal sets are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tagweave.llm.common import free_name, small_batches, written
from tagweave.llm.components import stars

WIDTH, RADIUS, SEED = 4, 4, 42
#: Lowest bit and width of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
TREE = 2048
#: Rows a task takes in at a time, and pairs of search and node that it looks at in one step.
ROWS_AT_ONCE, SEARCHES_AT_ONCE = 200_000, 1024


#: Words of a shingle and least Jaccard similarity of a near copy in the pipeline.
COPY_WIDTH, COPY_SIMILARITY = 5, Fraction(4, 5)
#: Bands that name its shards, minima in each, bands that are searched first, and the radius of its trees.
BANDS, MINIMA, FIRST_BANDS, COPY_RADIUS = 16, 4, 2, 22
#: Bytes of rows with shingle sets that a task takes in at a time, and searches and comparisons at once among them.
SET_BYTES, SET_SEARCHES = 64 << 20, 256


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    return _majority(_hashes(text, width))


def _hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of the shingles in the order of the text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[:-width]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[width - 1:])]
    return np.array(hashes, dtype="<u8")


def _majority(values: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for k in range(0, len(values), 8192):
        bits = np.unpackbits(values[k:k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in range(64) if 2 * counts[i] > len(values)))


def fingerprints(docs: DataFrame, carried: list[str], width: int = WIDTH) -> DataFrame:
    """The carried columns and ``fp``, the fingerprint as a signed bigint, of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), pa.array(made)], [*carried, "fp"])

    small_batches(docs.sparkSession)
    schema = StructType([*docs.select(*carried).schema.fields, StructField("fp", LongType())])
    return docs.select(*carried, "text").mapInArrow(run, schema)


def near_links(nodes: DataFrame, tree: int = TREE) -> DataFrame:
    """Links ``a``, ``b`` between the distinct fingerprints in ``fp`` that connect all pairs within 4 differing bits."""
    shards = F.array(*[
        F.struct(F.lit(n).alias("pair"), (_block(i) * (1 << BLOCKS[j][1]) + _block(j)).alias("value"))
        for n, (i, j) in enumerate(combinations(range(6), 2))])
    rows = nodes.select("fp", F.explode(shards).alias("s")).select("fp", "s.pair", "s.value")
    large = rows.groupBy("pair", "value").count().filter(F.col("count") > tree)
    rows = (rows.join(large, ["pair", "value"], "left")
            .withColumn("trees", F.ceil(F.coalesce(F.col("count"), F.lit(1)) / tree).cast("int"))
            .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
            .withColumn("tree", F.explode(F.sequence(F.col("own"), F.col("trees") - 1)))
            .select("pair", "value", "tree", (F.col("tree") != F.col("own")).alias("guest"), "fp"))
    met = rows.repartition("pair", "value", "tree").sortWithinPartitions("pair", "value", "tree", "guest")
    return met.mapInArrow(_search_shards, "a bigint, b bigint")


def _block(i: int):
    low, width = BLOCKS[i]
    return F.shiftrightunsigned(F.col("fp"), low).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def _search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0
    for b in batches:
        shard = (b.column("pair").to_numpy(zero_copy_only=False).astype(np.int64) << 54 |
                 b.column("value").to_numpy(zero_copy_only=False) << 24 | b.column("tree").to_numpy(zero_copy_only=False))
        held.append(np.stack([shard, b.column("guest").to_numpy(zero_copy_only=False).astype(np.int64),
                              b.column("fp").to_numpy(zero_copy_only=False)]))
        size += b.num_rows
        if size >= ROWS_AT_ONCE:
            rows = np.concatenate(held, axis=1)
            cut = int(np.searchsorted(rows[0], rows[0, -1]))  # the last shard may go on
            if cut:
                yield _links(*rows[:, :cut])
                held, size = [rows[:, cut:]], rows.shape[1] - cut
            else:
                held = [rows]
    if held:
        yield _links(*np.concatenate(held, axis=1))


def _links(shard: np.ndarray, guest: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    """Each fingerprint with the first one of its shard that it is connected to there."""
    alone = np.append(True, shard[1:] != shard[:-1]) & np.append(shard[:-1] != shard[1:], True)
    shard, guest, fp = shard[~alone], guest[~alone].astype(bool), fp[~alone]
    label = np.arange(len(fp))
    if len(fp):
        forest = Forest(fp.view(np.uint64), shard, ~guest)
        for k in range(0, len(fp), SEARCHES_AT_ONCE):
            label = _joined(label, *forest.search(np.arange(k, min(k + SEARCHES_AT_ONCE, len(fp))), RADIUS))
    new = label != np.arange(len(fp))
    return pa.RecordBatch.from_arrays([pa.array(fp[new]), pa.array(fp[label[new]])], ["a", "b"])


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after linking rows x and y: each row's label is the smallest row that it is connected to."""
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            return label
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]


class Forest:
    """BK-trees of many shards at once, as arrays; the first own member of a shard is its root."""

    def __init__(self, values: np.ndarray, shard: np.ndarray, own: np.ndarray):
        self.values = values
        first = np.append(True, shard[1:] != shard[:-1])
        starts = np.flatnonzero(first)
        self.root = starts[np.cumsum(first) - 1]  # own members come before guests
        self.root = np.where(own[self.root], self.root, -1)
        parents, keys, children = [], [], []
        # All members go down their trees together: the first to reach a free (parent, distance) settles there.
        moving = np.flatnonzero(own & (self.root != np.arange(len(values))))
        at = self.root[moving]
        while len(moving):
            far = _distance(values[moving], values[at])
            place = at * 65 + far
            taken, index, inverse = np.unique(place, return_index=True, return_inverse=True)
            settled = moving[index]
            parents.append(at[index])
            keys.append(far[index])
            children.append(settled)
            rest = np.ones(len(moving), bool)
            rest[index] = False
            at, moving = settled[inverse[rest]], moving[rest]
        parent, key, child = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (parents, keys, children))
        order = np.lexsort((key, parent))
        self.place, self.child = (parent * 65 + key)[order], child[order]

    def search(self, rows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, member within the radius in the row's tree), the row itself left out."""
        asked, at = rows[self.root[rows] >= 0], self.root[rows][self.root[rows] >= 0]
        hits = []
        while len(asked):
            far = _distance(self.values[asked], self.values[at])
            near = (far <= radius) & (asked != at)
            hits.append((asked[near], at[near]))
            low = np.searchsorted(self.place, at * 65 + np.maximum(far - radius, 0))
            high = np.searchsorted(self.place, at * 65 + np.minimum(far + radius, 64), "right")
            many = high - low
            asked = np.repeat(asked, many)
            step = np.arange(len(asked)) - np.repeat(np.cumsum(many) - many, many)
            at = self.child[np.repeat(low, many) + step]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def components(prints: DataFrame, tree: int = TREE) -> DataFrame:
    """Per distinct ``fp``: ``component_id``, the smallest doc_id reachable over links, and ``root``, its component's
    smallest fingerprint. ``prints`` has doc_id and fp."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    return _rooted(nodes, stars(near_links(nodes, tree)), "fp")


def _rooted(nodes: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """``node``, ``root`` and ``component_id`` of every row of ``nodes`` (node, first_id)."""
    rooted = (nodes.select(node, "first_id").join(roots.withColumnRenamed("node", node), node, "left")
              .withColumn("root", F.coalesce("root", node)))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return written(rooted.join(smallest, "root").select(node, "root", "component_id"), "components")


def near_duplicates(docs: DataFrame, width: int = WIDTH, tree: int = TREE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text)."""
    prints = written(fingerprints(docs, ["doc_id"], width), "prints")
    return (prints.join(components(prints, tree), "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


# ---- near copies by similarity, the stage of the pipeline --------------------------------------

_XOR, _FACTOR = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * MINIMA), np.uint64) | np.uint64(1)


def shingle_set(text: str | None, width: int = COPY_WIDTH) -> np.ndarray:
    """Distinct hashes of the shingles, in order of size."""
    return np.unique(_hashes(text, width))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key per band: sets share it, but for chance, if the band's minima are the same shingles."""
    lowest = np.full(BANDS * MINIMA, 2**64 - 1, np.uint64)
    for k in range(0, len(shingles), 1024):
        lowest = np.minimum(lowest, ((shingles[k:k + 1024, None] ^ _XOR) * _FACTOR).min(axis=0))
    keys = np.zeros(BANDS, np.uint64)
    for minima in lowest.reshape(BANDS, MINIMA).T:
        keys = (keys ^ minima) * _FACTOR[0]
        keys ^= keys >> np.uint64(29)
    return keys


def _marked(docs: DataFrame, carried: list[str]) -> DataFrame:
    """The carried columns with ``node`` (a hash of the shingle set), its fingerprint ``fp`` and the keys b0, b1, ..."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.zeros((b.num_rows, 2 + BANDS), np.uint64)
            for n, text in enumerate(b.column("text").to_pylist()):
                shingles = shingle_set(text)
                made[n, :2] = xxhash.xxh64_intdigest(shingles.tobytes(), SEED), _majority(shingles)
                made[n, 2:] = band_keys(shingles)
            arrays = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in made.T]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), *arrays], names)

    small_batches(docs.sparkSession)
    new = ["node", "fp", *(f"b{n}" for n in range(BANDS))]
    names = [*carried, *new]
    schema = StructType([*docs.select(*carried).schema.fields, *(StructField(c, LongType()) for c in new)])
    return docs.select(*carried, "text").mapInArrow(run, schema)


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """``node`` and its shingle set as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shingle_set(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(made, pa.binary())], ["node", "shingles"])

    small_batches(texts.sparkSession)
    schema = StructType([StructField("node", LongType()), StructField("shingles", BinaryType())])
    return texts.select("node", "text").mapInArrow(run, schema)


def copy_links(nodes: DataFrame, docs: DataFrame, tree: int = TREE) -> DataFrame:
    """Links ``a``, ``b`` that connect the nodes (node, row_hash, fp, b0, ...) whose sets are similar; ``docs`` has
    row_hash and text. All pairs that share a band and are within the radius are connected if they are near copies."""
    bands = F.explode(F.array(*[F.struct(F.lit(n).alias("band"), F.col(f"b{n}").alias("value")) for n in range(BANDS)]))
    rows = nodes.select("node", "fp", bands.alias("s")).select("node", "fp", "s.band", "s.value")
    shared = rows.groupBy("band", "value").count().filter("count > 1")
    met = written(rows.join(shared, ["band", "value"]), "met")
    wanted = met.select("node").distinct().join(nodes.select("node", "row_hash"), "node").select("node", "row_hash")
    sets = written(_shingle_sets(docs.join(wanted, "row_hash")).dropDuplicates(["node"]), "sets")

    def confirmed(rows: DataFrame) -> DataFrame:
        dealt = (rows.withColumn("trees", F.ceil(F.col("count") / tree).cast("int"))
                 .withColumn("own", F.pmod(F.xxhash64("node"), F.col("trees")).cast("int"))
                 .withColumn("tree", F.explode(F.sequence(F.col("own"), F.col("trees") - 1)))
                 .withColumn("guest", F.col("tree") != F.col("own")).join(sets, "node")
                 .select("band", "value", "tree", "guest", "node", "root", "fp", "shingles"))
        dealt = dealt.repartition("band", "value", "tree").sortWithinPartitions("band", "value", "tree", "guest", "node")
        return dealt.mapInArrow(_confirm_shards, "a bigint, b bigint")

    # Most copies are connected by few bands; of the others only shards that hold two components are looked at.
    first = written(confirmed(met.filter(F.col("band") < FIRST_BANDS).withColumn("root", F.col("node"))), "links")
    later = (met.filter(F.col("band") >= FIRST_BANDS).join(stars(first), "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    later = written(later, "later")
    apart = (later.groupBy("band", "value").agg(F.min("root").alias("low"), F.max("root").alias("high"))
             .filter("low <> high").select("band", "value"))
    return first.unionByName(confirmed(later.join(apart, ["band", "value"])))


def _confirm_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    fresh = 0
    for b in batches:
        held.append(b)
        fresh += b.nbytes
        if fresh >= SET_BYTES:
            rows = pa.Table.from_batches(held)
            cut = int(np.argmax(_shards(rows) == _shards(rows)[-1]))  # the last shard may go on
            if cut:
                yield _confirmed(rows.slice(0, cut))
            rows = rows.slice(cut)
            guest = rows.column("guest").to_numpy()
            if guest[-1]:  # its tree is whole, so the guests so far can go
                yield _confirmed(rows)
                rows = rows.filter(pa.array(~guest))
            held, fresh = rows.to_batches(), 0
    if held:
        yield _confirmed(pa.Table.from_batches(held))


def _shards(rows: pa.Table) -> np.ndarray:
    """A number per row that changes with the shard and the tree."""
    keys = [rows.column(c).to_numpy() for c in ("band", "value", "tree")]
    return np.cumsum(np.append(False, np.any([k[1:] != k[:-1] for k in keys], axis=0)))


def _confirmed(rows: pa.Table) -> pa.RecordBatch:
    """Roots with the first root that confirmed pairs of rows within the radius connect them to."""
    shard, guest = _shards(rows), rows.column("guest").to_numpy()
    sets = [np.frombuffer(v, "<u8") for v in rows.column("shingles").to_pylist()]
    size = np.array([len(v) for v in sets])
    roots, at = np.unique(rows.column("root").to_numpy(), return_inverse=True)
    label = np.arange(len(roots))
    forest = Forest(rows.column("fp").to_numpy().view(np.uint64), shard, ~guest)
    starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    for k in range(0, len(sets), SET_SEARCHES):
        now = label[at]
        apart = (np.minimum.reduceat(now, starts) != np.maximum.reduceat(now, starts))[shard]
        asked = np.arange(k, min(k + SET_SEARCHES, len(sets)))
        x, y = forest.search(asked[apart[asked]], COPY_RADIUS)
        once = guest[x] | (x < y)
        low, high = np.minimum(x, y)[once], np.maximum(x, y)[once]
        close = _alike(np.minimum(size[low], size[high]), np.maximum(size[low], size[high])) & (now[low] != now[high])
        low, high = low[close], high[close]
        order = np.argsort(low, kind="stable")
        low, high = low[order], high[order]
        for lead, others in zip(low[np.append(True, low[1:] != low[:-1])] if len(low) else (),
                                np.split(high, np.flatnonzero(low[1:] != low[:-1]) + 1)):
            for n in range(0, len(others), SET_SEARCHES):
                some = others[n:n + SET_SEARCHES]
                some = some[label[at[some]] != label[at[lead]]]
                if len(some):
                    shared = _shared(sets[lead], [sets[i] for i in some])
                    alike = some[_alike(shared, size[lead] + size[some] - shared)]
                    label = _joined(label, np.full(len(alike), at[lead]), at[alike])
    new = label != np.arange(len(roots))
    return pa.RecordBatch.from_arrays([pa.array(roots[new]), pa.array(roots[label[new]])], ["a", "b"])


def _alike(shared: np.ndarray, all_: np.ndarray) -> np.ndarray:
    return shared * COPY_SIMILARITY.denominator >= all_ * COPY_SIMILARITY.numerator


def _shared(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many members of ``one`` each of the others has; all are ordered and have members."""
    flat = np.concatenate(others)
    found = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    return np.add.reduceat(found, np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one row left of each component of near copies: that of its smallest doc_id.

    Of rows that repeat that id one stays, the one with the smallest hash of all its columns. A component without any
    id keeps one row, too. All columns are kept.
    """
    hashed = docs.select("doc_id", "text", F.xxhash64(*docs.columns).alias("row_hash"))
    marked = written(_marked(hashed, ["doc_id", "row_hash"]), "prints")
    same = [F.min(c).alias(c) for c in marked.columns if c not in ("node", "doc_id")]  # a node has one fp and key
    nodes = written(marked.groupBy("node").agg(F.min("doc_id").alias("first_id"), *same), "nodes")
    roots = _rooted(nodes, stars(copy_links(nodes, hashed.select("row_hash", "text"))), "node")
    best = (marked.select("doc_id", "row_hash", "node").join(roots, "node")
            .filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .groupBy("root", "doc_id", "row_hash").agg(F.count("*").alias("times"))
            .groupBy("root").agg(F.min(F.struct("doc_id", "row_hash", "times")).alias("kept")))
    key, times = free_name(docs, "kept_hash"), free_name(docs, "kept_times")
    chosen = written(best.select(F.col("kept.row_hash").alias(key), F.col("kept.times").alias(times)), "kept")
    rows = docs.join(chosen, F.xxhash64(*docs.columns) == F.col(key))
    once = rows.filter(F.col(times) == 1).select(*docs.columns)
    if chosen.filter(F.col(times) > 1).isEmpty():
        return once
    return once.unionByName(rows.filter(F.col(times) > 1).dropDuplicates([key]).select(*docs.columns))
