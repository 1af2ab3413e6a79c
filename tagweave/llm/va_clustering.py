"""Centroid clustering in exact integers on a VA-file: vectors approximated by a cell of a byte per dimension.

Each dimension is cut at marks (quantiles of a bounded sample of ``SAMPLE`` vectors, the same for the same rows), and
a vector's approximation is the number of its cell in every dimension. All vectors are approximated; the outer cells end at
the smallest and largest value of all vectors, so what follows holds for every vector, in the sample or not. In every round,
tables give for each centroid, dimension and cell the least and greatest share of the distance, and their sums enclose a
vector's distance to each centroid. Shares are counted less the distance to the mean of the centroids, which is the same
for all of them, so only differences between centroids widen an interval. Where one interval lies below all others, the
approximation settles the vector. Only where intervals overlap, or where the cluster is another one than before (sums have
to follow), the full vector is fetched, by a join on its number.

Approximations travel with the clusters in a table that is written anew in every round; full vectors lie in a table in
buckets of their number, so a fetch shuffles the approximations fetched for, never the vectors. Tasks add up what
clusters gain and lose, and the driver holds the centroids and their sums. A round in which no vector moves is the last
one needed, as later ones would repeat it. All arithmetic is in integers.

Rows take part whose array has ``DIMENSIONS`` components, none null or non-finite, and each within 2^26 in absolute value
once multiplied (so that a squared distance fits a long). Ids may be null (such rows start a centroid last of all) or
repeat (each row counts; equal hashes are ordered by the vectors). With fewer rows than centroids there are as many
centroids as rows; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tagweave.llm.common import small_batches, written
from tagweave.session import run_folder

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3"
#: Cells of a dimension (a byte), vectors that the marks are taken from, greatest absolute value of a component.
CELLS, SAMPLE, GREATEST = 256, 20_000, 1 << 26


def integers(rows: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """row (a number), vec_id and vector (integers) of the rows that take part."""
    kept = rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * scale).alias("scaled")).filter(
        (F.size("scaled") == dimensions) & F.forall("scaled", lambda x: x.isNotNull() & (F.abs(x) <= GREATEST)))
    return kept.select(F.monotonically_increasing_id().alias("row"), "vec_id",
                       F.transform("scaled", lambda x: F.floor(x).cast("int")).alias("vector"))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.int64)


class Grid:
    """The marks of all dimensions: cell ``c`` of a dimension holds ``left[c]`` to ``right[c]``, both included."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray):
        marks = np.quantile(sample, np.arange(1, CELLS) / CELLS, axis=0, method="higher").astype(np.int64)
        self.marks = [np.unique(np.clip(m, low[d] + 1, high[d])) if low[d] < high[d] else m[:0]
                      for d, m in enumerate(marks.T)]
        self.left, self.right = np.zeros((2, len(low), CELLS), np.int64)
        for d, m in enumerate(self.marks):
            self.left[d, :len(m) + 1], self.right[d, :len(m) + 1] = np.append(low[d], m), np.append(m - 1, high[d])

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(m, v, "right") for m, v in zip(self.marks, vectors.T)], axis=1).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> np.ndarray:
        """Least shares of all centroids, then greatest ones, by dimension and cell."""
        mean = centroids.sum(axis=0) // len(centroids)
        away = (mean - centroids).T[:, None, :]
        both = (centroids + mean).T[:, None, :]
        at_left, at_right = away * (2 * self.left[:, :, None] - both), away * (2 * self.right[:, :, None] - both)
        return np.concatenate([np.minimum(at_left, at_right), np.maximum(at_left, at_right)], axis=2)


def intervals(cells: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the distance of every vector to every centroid, all less the same number for a vector."""
    total = np.zeros((len(cells), tables.shape[2]), np.int64)
    for table, column in zip(tables, cells.T):
        total += table[column]
    return total[:, :tables.shape[2] // 2], total[:, tables.shape[2] // 2:]


def _approximated(vectors: DataFrame, grid: Grid) -> DataFrame:
    """The rows with their cells; vectors as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("vector"), len(grid.marks))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), _bytes(v.astype("<i4")),
                                              _bytes(grid.cells(v))], ["row", "vec_id", "vector", "cells"])

    new = StructType.fromDDL("vector binary, cells binary")
    return vectors.mapInArrow(run, StructType([*vectors.select("row", "vec_id").schema.fields, *new]))


def _bytes(rows: np.ndarray) -> pa.Array:
    wide = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [
        None, pa.py_buffer(np.arange(0, (len(rows) + 1) * wide, wide, dtype=np.int32)), pa.py_buffer(rows.tobytes())])


def _array(column: pa.Array, kind: str, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dimensions)


def _bounded(state: DataFrame, grid: Grid, centroids: np.ndarray) -> DataFrame:
    """row, cells, cluster (the one before, or -1) and ``open`` (a bit for each centroid that may be the nearest)."""
    tables = grid.tables(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least, most = intervals(_array(b.column("cells"), "u1", len(tables)), tables)
            may = least <= most.min(axis=1, keepdims=True)
            bits = (may << np.arange(may.shape[1], dtype=np.int64)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("cells"), b.column("cluster"),
                                              pa.array(bits, pa.int64())], ["row", "cells", "cluster", "open"])

    return state.mapInArrow(run, "row bigint, cells binary, cluster int, open bigint")


def _nearest(vectors: np.ndarray, bits: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the open centroids (of equally near ones the first), and the squared distance."""
    far = np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    far[(bits[:, None] >> np.arange(len(centroids)) & 1) == 0] = np.iinfo(np.int64).max
    best = far.argmin(axis=1)
    return best, far[np.arange(len(far)), best]


def _moved(fetched: DataFrame, centroids: np.ndarray) -> DataFrame:
    """row, cells and new cluster of every row; and, once a task, a row without number for each cluster with what it
    gained: how many vectors, and their sums."""
    n, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.zeros((n, dimensions + 1), np.int64)
        for b in batches:
            vectors = _array(b.column("vector"), "<i4", dimensions).astype(np.int64)
            best, _far = _nearest(vectors, b.column("open").to_numpy(), centroids)
            before = b.column("cluster").to_numpy()
            counted = np.column_stack([np.ones(len(best), np.int64), vectors])
            for c in range(n):
                gain[c] += counted[(best == c) & (before != c)].sum(axis=0) - counted[(best != c) & (before == c)].sum(axis=0)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("cells"), pa.array(best, pa.int32()), pa.nulls(len(best), pa.list_(pa.int64()))],
                ["row", "cells", "cluster", "gain"])
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(np.arange(n), pa.int32()),
             pa.array(list(gain), pa.list_(pa.int64()))], ["row", "cells", "cluster", "gain"])

    return fetched.mapInArrow(run, "row bigint, cells binary, cluster int, gain array<bigint>")


def _distances(fetched: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = _array(b.column("vector"), "<i4", centroids.shape[1]).astype(np.int64)
            best, far = _nearest(vectors, b.column("open").to_numpy(), centroids)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(best, pa.int32()), pa.array(far)],
                                             ["vec_id", "cluster", "distance"])

    kept = fetched.select("vec_id", "open", "vector")
    return kept.mapInArrow(run, StructType([kept.schema["vec_id"], *StructType.fromDDL("cluster int, distance bigint")]))


def _grid(vectors: DataFrame, dimensions: int) -> Grid:
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dimensions, GREATEST + 1), np.full(dimensions, -GREATEST - 1)
        for b in batches:
            v = _matrix(b.column("vector"), dimensions)
            low, high = np.minimum(low, v.min(axis=0)), np.maximum(high, v.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions)), pa.array(low), pa.array(high)], ["d", "low", "high"])

    ends = (vectors.select("vector").mapInArrow(ranges, "d bigint, low bigint, high bigint")
            .groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").toArrow())
    sample = vectors.orderBy(F.xxhash64("vec_id", "vector"), "vec_id", "vector").limit(SAMPLE).select("vector").toArrow()
    return Grid(_matrix(sample.column("vector").combine_chunks(), dimensions),
                ends.column("low").to_numpy(), ends.column("high").to_numpy())


def clustered(rows: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
              scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster and (squared) distance of every vector that takes part, and the final centroids.

    The first centroids are the vectors with the smallest sha256 of ``seed``, a colon and the id, in that order.
    """
    spark = rows.sparkSession
    small_batches(spark)
    vectors = written(integers(rows, dimensions, scale), "vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(hashed.asc_nulls_last(), "vector").limit(centroids).select("vector").collect()
    now = np.array([r.vector for r in first], np.int64)
    if not len(now):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), []
    grid = _grid(vectors, dimensions)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"va_{uuid.uuid4().hex}"
    (_approximated(vectors, grid).repartition(buckets, "row").write.bucketBy(buckets, "row")
     .option("path", run_folder(spark, "buckets")).saveAsTable(name))
    full = spark.table(name)
    state = full.select("row", "cells", F.lit(-1).alias("cluster"))
    sums = [[0] * (dimensions + 1) for _ in now]
    for _ in range(rounds):
        bounded = written(_bounded(state, grid, now), "bounds")
        settled = F.expr("open = shiftleft(1L, cluster)")
        fetched = bounded.filter(~settled).join(full.select("row", "vector"), "row")
        moved = written(_moved(fetched, now), "moved")
        gains = moved.filter("row IS NULL").groupBy("cluster").agg(
            *[F.sum(F.col("gain")[k].cast("decimal(20,0)")).alias(f"g{k}") for k in range(dimensions + 1)]).collect()
        for r in gains:
            sums[r.cluster] = [s + int(g) for s, g in zip(sums[r.cluster], r[1:])]
        new = np.array([[s // total[0] for s in total[1:]] if total[0] else old.tolist() for total, old in zip(sums, now)])
        state = (bounded.filter(settled).select("row", "cells", "cluster")
                 .unionByName(moved.filter("row IS NOT NULL").select("row", "cells", "cluster")))
        if (new == now).all():  # nothing moves from here on
            break
        now = new
    last = _bounded(state, grid, now).select("row", "open").join(full.select("row", "vec_id", "vector"), "row")
    assigned = written(_distances(last, now), "assigned")
    spark.sql(f"DROP TABLE {name}")  # the name only: the files are in the shared folder
    return assigned, now.tolist()


def judged(rows: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    assigned, centroids = clustered(rows)
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)"))).collect()  # a row per centroid
    total = sum(int(s) for _c, s in sums)
    per = rows.sparkSession.createDataFrame(
        [(c, int(s), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                                             "centroid_sha256")
