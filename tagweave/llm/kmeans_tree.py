"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample (``SAMPLE`` distinct vectors, those with the smallest hash), on the driver, and
sent to the tasks; every vector is put into the leaf that a descent to the nearest centroids leads to. A query keeps a
priority queue of branches, best centroid first, and visits leaves in the order in which it takes them. How many it
visits is calibrated: for ``PROBES`` query vectors the exact neighbours among all rows are found by a scan in blocks,
and visits are widened until ``TARGET`` of them lie in the visited leaves on average.

Copies of a vector become one entry with its smallest ``k + 1`` ids (more of them cannot be among k neighbours), so a
vector that a third of all rows share costs one entry. Leaves next to each other in the tree form shards; a query is
sent once to each shard with the leaves that it visits there. A shard of more than ``SHARD_PART`` entries is dealt out
as several parts, and the queries that visit it go to each. Scores are inner products in double precision of the
original components; candidates are first narrowed by a matrix product, then scored exactly.

Vectors that are null or zero, hold null or non-finite components, or have another dimension than most, take no part,
nor do rows with a null id; repeated rows count once. Ties go to the smaller id. An empty table gives an empty result.
Other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tagweave.llm.common import written
from tagweave.operators.ordering import top_per_group

SAMPLE, BRANCHES, LEAF_SAMPLE = 20_000, 16, 16
PROBES, TARGET = 256, 0.95
#: Leaves (neighbours in the tree) whose entries are held together, and how many entries a task holds of them.
SHARD_LEAVES, SHARD_PART = 128, 16_384


@dataclass
class Tree:
    """Nodes as arrays; node 0 is the root. ``leaf`` numbers the nodes without children, else it is -1."""
    centroids: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vectors), np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            near = _nearest(vectors[rows], self.centroids[self.children[node]])
            todo += [(child, rows[near == i]) for i, child in enumerate(self.children[node])]
        return out

    def visits(self, queries: np.ndarray, many: int) -> list[list[int]]:
        """The first ``many`` leaves of each query, best bin first."""
        found = []
        for rank in (self.centroids ** 2).sum(1) / 2 - queries @ self.centroids.T:
            queue, leaves = [(0.0, 0)], []
            while queue and len(leaves) < many:
                _rank, node = heapq.heappop(queue)
                if self.leaf[node] >= 0:
                    leaves.append(int(self.leaf[node]))
                for child in self.children[node]:
                    heapq.heappush(queue, (rank[child], child))
            found.append(leaves)
        return found


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids ** 2).sum(1) - 2 * (vectors @ centroids.T), axis=1)


def fit_tree(sample: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF_SAMPLE, rounds: int = 12) -> Tree:
    centroids, children, leaves = [sample.mean(0) if len(sample) else np.zeros(sample.shape[1])], [[]], [-1]
    todo, count, rng = [(0, np.arange(len(sample)))], 0, np.random.default_rng(7)
    while todo:
        node, rows = todo.pop()
        parts: list[np.ndarray] = []
        if len(rows) > leaf:
            points = sample[rows]
            centres = points[rng.choice(len(points), min(branches, len(points)), replace=False)]
            for _ in range(rounds):
                near = _nearest(points, centres)
                centres = np.array([points[near == i].mean(0) if (near == i).any() else centres[i]
                                    for i in range(len(centres))])
            near = _nearest(points, centres)
            parts = [np.flatnonzero(near == i) for i in range(len(centres))]
        if sum(len(p) > 0 for p in parts) < 2:
            leaves[node], count = count, count + 1
            continue
        for i, part in enumerate(parts):
            if len(part):
                children[node].append(len(centroids))
                centroids.append(centres[i])
                children.append([])
                leaves.append(-1)
                todo.append((len(centroids) - 1, rows[part]))
    return Tree(np.array(centroids), children, np.array(leaves))


def usable(rows: DataFrame) -> DataFrame:
    """Rows that take part, once each: vec_id and embedding (array of float)."""
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    fine = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")).cast(kind)))
        & F.exists("embedding", lambda x: x != 0)).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    usual = (fine.groupBy(F.size("embedding").alias("n")).count()
             .orderBy(F.desc("count"), "n").limit(1).collect())  # one row
    return fine.filter(F.size("embedding") == usual[0].n if usual else F.lit(False)).distinct()


def search(rows: DataFrame, is_query: Column, k: int = 20, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of every query row among all rows but itself."""
    rows = written(usable(rows), "vectors")
    spark = rows.sparkSession
    members = (top_per_group(rows, ["embedding"], ["vec_id"], k + 1)  # cut in every task before the shuffle
               .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
               .withColumn("entry", F.col("members")[0]))
    entries = written(members, "entries")
    sample = entries.orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE).select("embedding").toArrow()
    fitted = _matrix(sample.column("embedding"))
    tree = spark.sparkContext.broadcast(fit_tree(fitted))
    asking = written(rows.filter(is_query).join(entries.select("embedding", "entry"), "embedding")
                     .select(F.col("vec_id").alias("query_id"), "entry"), "asking")
    queries = written(entries.join(asking.select("entry").distinct(), "entry", "left_semi")
                      .select("entry", "embedding"), "queries")
    indexed = written(entries.select("entry", "embedding").mapInArrow(
        _with_leaf(tree), "entry bigint, embedding array<float>, leaf int"), "indexed")
    visits = _calibrated(queries, indexed, tree, k, target)
    found = written(_search_leaves(queries, indexed, tree, visits, k), "found")
    best = top_per_group(found, ["query"], [F.desc("score"), "entry"], k + 1)
    each = (best.drop("rank").join(entries.select("entry", F.explode("members").alias("vec_id")), "entry")
            .select(F.col("query").alias("entry"), "vec_id", "score"))
    near = written(top_per_group(each, ["entry"], [F.desc("score"), "vec_id"], k + 1).drop("rank"), "near")
    own = asking.join(near, "entry").filter("vec_id <> query_id")
    return (top_per_group(own, ["query_id"], [F.desc("score"), "vec_id"], k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _with_leaf(tree) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.value.assign(_matrix(b.column("embedding"))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("entry"), b.column("embedding"), pa.array(leaf)],
                                             ["entry", "embedding", "leaf"])
    return run


def _calibrated(queries: DataFrame, indexed: DataFrame, tree, k: int, target: float) -> int:
    """Leaf visits after which ``target`` of the true neighbours of the probe queries are in visited leaves."""
    probes = queries.orderBy(F.xxhash64("entry"), "entry").limit(PROBES).toArrow()
    if not probes.num_rows:
        return 1
    ids, asked = probes.column("entry").to_numpy(), _matrix(probes.column("embedding"))
    sent = indexed.sparkSession.sparkContext.broadcast((ids, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = sent.value
        for b in batches:
            entry, leaf = b.column("entry").to_numpy(), b.column("leaf").to_numpy()
            for query, chosen, score in _nearest_of(ids, asked, entry, _matrix(b.column("embedding")), k + 1):
                place = np.searchsorted(entry, chosen, sorter=(order := np.argsort(entry)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(chosen), query)), pa.array(chosen), pa.array(score),
                     pa.array(leaf[order[place]])], ["query", "entry", "score", "leaf"])

    truth = top_per_group(indexed.mapInArrow(run, "query bigint, entry bigint, score double, leaf int"),
                          ["query"], [F.desc("score"), "entry"], k + 1).filter("query <> entry").collect()
    leaves = int(tree.value.leaf.max()) + 1
    order = dict(zip(ids.tolist(), tree.value.visits(asked, leaves)))
    turn = {q: {leaf: n for n, leaf in enumerate(o)} for q, o in order.items()}
    needed = np.sort([turn[t.query][t.leaf] + 1 for t in truth])
    if not len(needed):
        return 1
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)])


def _nearest_of(ids: np.ndarray, asked: np.ndarray, entry: np.ndarray, vectors: np.ndarray,
                k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best entries, best first, ties to the smaller entry."""
    if not len(entry):
        return
    rough = asked @ vectors.T
    for i, query in enumerate(ids):
        if len(entry) > k:
            least = np.partition(rough[i], len(entry) - k)[len(entry) - k]
            near = np.flatnonzero(rough[i] >= least - 1e-9 * max(1.0, abs(least)))
        else:
            near = np.arange(len(entry))
        exact = (vectors[near] * asked[i]).sum(axis=1)
        best = np.lexsort((entry[near], -exact))[:k]
        yield int(query), entry[near][best], exact[best]


def _search_leaves(queries: DataFrame, indexed: DataFrame, tree, visits: int, k: int) -> DataFrame:
    """query, entry and score of the k + 1 best entries that each shard part has in the visited leaves."""
    shard = F.floor(F.col("leaf") / SHARD_LEAVES).cast("int").alias("shard")
    # A row per shard, SAMPLE / SHARD_LEAVES at most.
    sizes = indexed.groupBy(shard).count().select("shard", F.ceil(F.col("count") / SHARD_PART).cast("int").alias("parts"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, shards, leaves = [], [], []
            for i, found in enumerate(tree.value.visits(_matrix(b.column("embedding")), visits)):
                found = np.sort(np.array(found, np.int32))
                for part in np.split(found, np.flatnonzero(np.diff(found // SHARD_LEAVES)) + 1):
                    rows.append(i)
                    shards.append(part[0] // SHARD_LEAVES)
                    leaves.append(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int32()), b.column("entry").take(pa.array(rows, pa.int64())),
                 b.column("embedding").take(pa.array(rows, pa.int64())), pa.array(leaves, pa.list_(pa.int32()))],
                ["shard", "entry", "embedding", "leaves"])

    routed = queries.mapInArrow(route, "shard int, entry bigint, embedding array<float>, leaves array<int>")
    guests = (routed.join(F.broadcast(sizes), "shard")
              .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .select("shard", "part", F.lit(1).alias("guest"), "entry", "embedding", "leaves"))
    hosts = (indexed.select("*", shard).join(F.broadcast(sizes), "shard")
             .select("shard", F.pmod(F.xxhash64("entry"), F.col("parts")).cast("int").alias("part"),
                     F.lit(0).alias("guest"), "entry", "embedding", F.array("leaf").alias("leaves")))
    met = hosts.unionByName(guests).repartition("shard", "part").sortWithinPartitions("shard", "part", "guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, ready = None, [], False
        for b in batches:
            shard, part, guest = (b.column(c).to_numpy() for c in ("shard", "part", "guest"))
            entry, vector, leaves = b.column("entry").to_numpy(), _matrix(b.column("embedding")), b.column("leaves")
            edge = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (part[1:] != part[:-1])
                                            | (guest[1:] != guest[:-1])))
            for s, e in zip(edge, [*edge[1:], len(shard)]):
                if (shard[s], part[s]) != here:
                    here, held, ready = (shard[s], part[s]), [], False
                if not guest[s]:
                    held.append((leaves.slice(s, e - s).flatten().to_numpy(), entry[s:e], vector[s:e]))
                elif held:
                    if not ready:
                        joined = [np.concatenate(x) for x in zip(*held)]
                        order = np.argsort(joined[0], kind="stable")
                        held, ready = [tuple(x[order] for x in joined)], True
                    yield _best_rows(*held[0], entry[s:e], vector[s:e], leaves.slice(s, e - s).to_pylist(), k + 1)

    return met.mapInArrow(run, "query bigint, entry bigint, score double")


def _best_rows(leaf, entry, vectors, queries, asked, visited, k: int) -> pa.RecordBatch:
    """Of entries sorted by leaf, the k best of each query among those of the leaves that it visits."""
    hits = []
    for query, vector, leaves in zip(queries, asked, visited):
        low, high = np.searchsorted(leaf, leaves), np.searchsorted(leaf, leaves, "right")
        rows = np.concatenate([np.arange(a, b) for a, b in zip(low, high)]) if len(leaves) else np.zeros(0, np.int64)
        hits += _nearest_of([query], vector[None, :], entry[rows], vectors[rows], k)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat([h[0] for h in hits], [len(h[1]) for h in hits]).astype(np.int64)),
         pa.array(np.concatenate([h[1] for h in hits]) if hits else np.zeros(0, np.int64)),
         pa.array(np.concatenate([h[2] for h in hits]) if hits else np.zeros(0))], ["query", "entry", "score"])
