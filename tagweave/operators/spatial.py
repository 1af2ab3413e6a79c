"""Overlap operators on boxes: suppression, one-to-one matching, anti-overlap, tiles.

Two boxes with IoU above a threshold t have widths (and heights) within a factor 1/t. Every box
therefore registers on grids of two neighbouring scales per axis, at most four cells per axis, and
any pair above the threshold shares a cell. For thresholds under 0.05 that factor is large or
without bound; boxes then register on all scales from their own up to ``WIDEST``. All joins are
equi-joins on those cells. A box without area, or with a missing corner, overlaps nothing.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tagweave.functions.geometry import (
    Box, clip, iou, normalized_line, ordered, tiles, usable,
)
from tagweave.operators.components import connected
from tagweave.operators.ordering import rank_by_range
from tagweave.schema import BOX_COLUMNS
from tagweave.session import cut_lineage, small_methods

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SMALL_GROUP = 2048
#: Rows of a group up to which all its pairs are compared.
FEW_ROWS = 32
#: Connected boxes that one task walks.
LONG_WALK = 200_000
#: Side of the largest boxes that small thresholds are exact for.
WIDEST = 1e7


def _axis_cells(low: Column, high: Column, threshold: float) -> Column:
    base = 1.000001 / min(max(threshold, 0.05), 0.95)
    size = F.greatest(high - low, F.lit(1e-6))
    level = F.floor(F.log(size) / math.log(base))
    top = F.lit(math.ceil(math.log(WIDEST) / math.log(base)))
    levels = F.array(level, level + 1) if threshold >= 0.05 else F.sequence(level, F.greatest(level + 1, top))
    cell = lambda s: F.pow(F.lit(base), s + 1.0)
    return F.flatten(F.transform(levels, lambda s: F.transform(
        F.sequence(F.floor(low / cell(s)), F.floor(high / cell(s))),
        lambda c: F.struct(s.alias("s"), c.alias("c")))))


def grid_cells(box: Box, threshold: float) -> Column:
    """Hashed cell ids of a box; two boxes with IoU above the threshold share one."""
    xs = _axis_cells(box.x_min, box.x_max, threshold)
    ys = _axis_cells(box.y_min, box.y_max, threshold)
    return F.array_distinct(F.flatten(F.transform(
        xs, lambda x: F.transform(ys, lambda y: F.xxhash64(x, y)))))


def oversized_groups(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    return df.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys)


def suppress_overlaps(df: DataFrame, keys: list[str], order: list[Column], threshold: float,
                      cap: Column | int | None = None, small_group: int = SMALL_GROUP,
                      rank: str = "kept_rank", hot: DataFrame | None = None) -> DataFrame:
    """Greedy suppression per key: walk rows in order, drop a row that overlaps a kept one.

    ``order`` must be total within a key. ``cap`` keeps only the first rows of the result and may
    be an aggregate over the group. Ordinary groups are sorted and walked as streams of batches. A group with more than
    ``small_group`` rows is cut into components of boxes connected by grid cells, and each component is walked by itself;
    one of more than ``LONG_WALK`` boxes is resolved by parallel rounds over grid cells. The result is the same.
    ``hot`` lists the groups that may be large (by some of the keys), so that the rows need not be made twice to be counted.
    """
    order = [c.alias(f"k{i}") for i, c in enumerate(order)]
    hot = oversized_groups(df, keys, small_group) if hot is None else hot
    if hot.isEmpty():
        return _suppress_in_order(df, keys, order, threshold, cap, rank)
    hot = cut_lineage(hot)
    calm = df.join(hot, hot.columns, "left_anti").select(*df.columns)
    busy = df.join(hot, hot.columns, "left_semi").select(*df.columns)
    return _suppress_in_order(calm, keys, order, threshold, cap, rank).unionByName(
        _suppress_by_components(busy, keys, order, threshold, cap, rank))


def _cap_column(cap: Column | int) -> Column:
    return F.lit(cap) if isinstance(cap, int) else cap


def _suppress_in_order(df, keys, order, threshold, cap, rank) -> DataFrame:
    """Groups are sorted by Spark, streamed, and walked whole batches at a time. Rows of equal order follow their boxes,
    then their other values."""
    place = Window.partitionBy(*keys).orderBy(*order, *BOX_COLUMNS, *df.columns)
    placed = df.withColumn("_place", F.row_number().over(place))
    # No shuffle comes between the sorted partitions and the walk.
    kept = placed.mapInArrow(lambda batches: _walk_groups(batches, threshold),
                             StructType([*df.schema.fields, StructField(rank, LongType())]))
    if cap is None:
        return kept
    if isinstance(cap, int):
        return kept.filter(F.col(rank) <= cap)
    caps = df.groupBy(*[F.col(k).alias(f"_cap_{k}") for k in keys]).agg(cap.cast("int").alias("_cap"))
    same = [F.col(k).eqNullSafe(F.col(f"_cap_{k}")) for k in keys]
    return kept.join(caps, same).filter(F.col(rank) <= F.col("_cap")).select(*df.columns, rank)


def _walk_groups(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Kept rows with their rank; a group starts at ``_place`` 1, the last one of a batch may go on in the next."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        cut = int(np.flatnonzero(rows.column("_place").to_numpy() == 1)[-1])
        held = rows.slice(cut)
        if cut:
            yield _kept_of(rows.slice(0, cut), threshold)
    if held is not None:
        yield _kept_of(held, threshold)


def _kept_of(rows: pa.RecordBatch, threshold: float) -> pa.RecordBatch:
    starts = np.flatnonzero(rows.column("_place").to_numpy() == 1)
    corners = [rows.column(c).cast(pa.float64()) for c in BOX_COLUMNS]
    missing = np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in corners])
    kept = _first_come([c.to_numpy(zero_copy_only=False) for c in corners], missing, starts, threshold)
    group = np.cumsum(np.bincount(starts, minlength=len(kept))) - 1
    before = np.concatenate([[0], np.cumsum(kept)])
    ranks = before[1:] - before[starts][group]
    columns = [rows.column(i) for i, name in enumerate(rows.schema.names) if name != "_place"]
    names = [name for name in rows.schema.names if name != "_place"]
    return pa.RecordBatch.from_arrays([*columns, pa.array(ranks, pa.int64())], [*names, "_rank"]).filter(pa.array(kept))


def _first_come(corners: list[np.ndarray], missing: np.ndarray, starts: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows the walk keeps. In groups of few rows, rows at a distance of 1, 2, ... are compared all at once; larger
    ones are walked a row at a time against the rows kept before it."""
    n = len(missing)
    ends = np.append(starts[1:], n)
    sizes = ends - starts
    kept = np.ones(n, bool)
    end = np.repeat(np.where(sizes <= FEW_ROWS, ends, 0), sizes)
    at, step, pairs = np.arange(n), 1, []
    while len(at := at[at + step < end[at]]):
        hits = at[_clash(corners, missing, at, at + step, threshold)]
        pairs.append(np.stack([hits, hits + step]))
        step += 1
    if pairs:
        first, second = np.concatenate(pairs, axis=1)
        by_first = np.argsort(first, kind="stable")
        # All that can drop a row comes before it, so a row is settled when its own pairs come.
        for i, j in zip(first[by_first].tolist(), second[by_first].tolist()):
            if kept[i]:
                kept[j] = False
    for low, high in zip(starts[sizes > FEW_ROWS], ends[sizes > FEW_ROWS]):
        chosen, count = np.empty(high - low, np.int64), 0
        for i in range(low, high):
            if _clash(corners, missing, chosen[:count], i, threshold).any():
                kept[i] = False
            else:
                chosen[count] = i
                count += 1
    return kept


def _clash(corners: list[np.ndarray], missing: np.ndarray, a, b, threshold: float) -> np.ndarray:
    """IoU above the threshold, with Spark's order of values: NaN is the largest."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        (ax, ay, au, av), (bx, by, bu, bv) = ([c[i] for c in corners] for i in (a, b))
        both = (np.maximum(0.0, np.fmin(au, bu) - np.maximum(ax, bx)) * np.maximum(0.0, np.fmin(av, bv) - np.maximum(ay, by)))
        area = np.maximum(0.0, au - ax) * np.maximum(0.0, av - ay)
        union = area + np.maximum(0.0, bu - bx) * np.maximum(0.0, bv - by) - both
        share = np.where((union > 0) | np.isnan(union), both / union, 0.0)
    return ~(missing[a] | missing[b]) & ((share > threshold) | np.isnan(share))


def _suppress_by_components(df, keys, order, threshold, cap, rank, long_walk: int | None = None) -> DataFrame:
    """Boxes that share no cell, nor are linked by others that do, decide nothing for each other."""
    box = Box.of()
    by_box = [*keys, *BOX_COLUMNS]
    solid = F.coalesce(box.area > 0, F.lit(False))
    # What overlaps nothing is kept as it is.
    flat = df.filter(~solid).select(*keys, F.struct(*order).alias("_o"), F.struct("*").alias("_row"))
    # Of equal boxes only the first can be kept, so copies collapse before anything else.
    rows = (df.filter(solid).groupBy(*by_box)
            .agg(F.min(F.struct(F.struct(*order).alias("o"), F.struct("*").alias("row"))).alias("m"))
            .select(*by_box, F.col("m.o").alias("_o"), F.col("m.row").alias("_row"), F.xxhash64(*by_box).alias("_node")))
    rows = cut_lineage(rows.withColumn("_cells", grid_cells(box, threshold)))
    # A hash that two boxes or cells share makes a component larger, which changes nothing.
    links = rows.select(F.col("_node").alias("a"), *keys, F.explode("_cells").alias("_cell")).select(
        "a", F.xxhash64(*keys, "_cell").alias("b"))
    found = connected(links).select(F.col("node").alias("_node"), F.col("root").alias("_group"))
    rows = cut_lineage(rows.join(found, "_node").drop("_node"))
    inside = [*keys, "_group"]
    large = cut_lineage(oversized_groups(rows, inside, LONG_WALK if long_walk is None else long_walk))
    kept = flat.unionByName(_walked(rows.join(large, inside, "left_anti"), inside, threshold).select(*keys, "_o", "_row"))
    if not large.isEmpty():
        kept = kept.unionByName(_in_rounds(rows.join(large, inside, "left_semi"), inside, threshold).select(*keys, "_o", "_row"))
    ranked = rank_by_range(kept, keys, [F.col("_o")], "_rank")
    if cap is not None:
        caps = df.groupBy(*keys).agg(_cap_column(cap).alias("_cap"))
        ranked = ranked.join(caps, keys).filter(F.col("_rank") <= F.col("_cap"))
    return ranked.select("_row.*", F.col("_rank").alias(rank))


def _walked(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Rows kept when each group is walked in order: sorted by Spark, streamed, and looked up by cell. A row is told by
    its place in the sorted partition only on the way through Python, so any columns can ride along."""
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "_o").withColumn("_no", F.monotonically_increasing_id())
    ordered = cut_lineage(ordered)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, kept = None, {}
        for batch in batches:
            out = []
            for number, name, cells, *corners in zip(*[batch[c].tolist() for c in ("number", "name", "cells", *BOX_COLUMNS)]):
                if name != group:
                    group, kept = name, {}
                if not any(_above(corners, other, threshold) for c in cells for other in kept.get(c, ())):
                    out.append(number)
                    for c in cells:
                        kept.setdefault(c, []).append(corners)
            yield pd.DataFrame({"_no": np.array(out, np.int64)})

    # No shuffle comes between the sorted partitions and the walk.
    told = ordered.select(F.col("_no").alias("number"), F.to_json(F.struct(*keys)).alias("name"), F.col("_cells").alias("cells"),
                          *[F.col(c).cast("double").alias(c) for c in BOX_COLUMNS])
    return ordered.join(told.mapInPandas(walk, "_no bigint"), "_no", "left_semi")


def _above(a: list[float], b: list[float], threshold: float) -> bool:
    across, down = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if across <= 0 or down <= 0:
        return threshold < 0
    both = across * down
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both) > threshold


def _in_rounds(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Rounds: a box first in all its cells is kept, boxes it overlaps leave, repeat.

    The first of all open boxes always leads, so every round settles at least one box.
    """
    box = Box.of()
    open_rows, kept = cut_lineage(rows), None
    left = open_rows.count()
    while left:
        spread = open_rows.select(*keys, "_o", *BOX_COLUMNS, F.size("_cells").alias("_n"),
                                  F.explode("_cells").alias("_cell"))
        firsts = spread.groupBy(*keys, "_cell").agg(
            F.min(F.struct("_o", "_n", *BOX_COLUMNS)).alias("f"))
        leaders = (firsts.groupBy(*keys, F.col("f._o").alias("_o"))
                   .agg(F.count("*").alias("c"), F.first("f").alias("f"))
                   .filter(F.col("c") == F.col("f._n")).select(*keys, "_o", "f"))
        leaders = cut_lineage(leaders)
        lead_cells = leaders.select(
            *keys, F.col("_o").alias("_lead"), *[F.col(f"f.{c}").alias(f"l_{c}") for c in BOX_COLUMNS],
            F.explode(grid_cells(Box(*[F.col(f"f.{c}") for c in BOX_COLUMNS]), threshold)).alias("_cell"))
        gone = (spread.join(lead_cells, [*keys, "_cell"])
                .filter((iou(box, Box.of("l_")) > threshold) | (F.col("_o") == F.col("_lead")))
                .select(*keys, "_o").distinct())
        chosen = open_rows.join(leaders.select(*keys, "_o"), [*keys, "_o"], "left_semi")
        chosen = cut_lineage(chosen)
        kept = chosen if kept is None else kept.unionByName(chosen)
        open_rows = cut_lineage(open_rows.join(gone, [*keys, "_o"], "left_anti"))
        before, left = left, open_rows.count()
        if left >= before:
            raise RuntimeError("suppression makes no progress; is the order total within the keys?")
    return rows if kept is None else kept


def without_overlap(df: DataFrame, others: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Rows that overlap no box of ``others`` within the same key by more than the threshold."""
    boxes = (others.select(*keys, *[F.col(c).alias(f"o_{c}") for c in BOX_COLUMNS]).distinct()
             .withColumn("_cell", F.explode(grid_cells(Box.of("o_"), threshold))))
    own = df.select(*keys, *BOX_COLUMNS).distinct()
    hit = (own.withColumn("_cell", F.explode(grid_cells(Box.of(), threshold)))
           .join(boxes, [*keys, "_cell"])
           .filter(iou(Box.of(), Box.of("o_")) > threshold)
           .select(*keys, *BOX_COLUMNS).distinct())
    return df.join(hit, [*keys, *BOX_COLUMNS], "left_anti")


def match_boxes(truth: DataFrame, predicted: DataFrame, keys: list[str], truth_order: str,
                predicted_order: str, threshold: float = 0.15,
                small_group: int = SMALL_GROUP) -> DataFrame:
    """Greedy one-to-one match: truth rows in order take the free prediction of highest IoU.

    Returns ``(keys, truth_order, predicted_order, iou)`` for matched rows. Of equal IoUs the smaller
    predicted order is taken; rows that repeat an order value follow each other by their boxes.
    """
    t = small_methods(truth).select(*keys, F.col(truth_order).alias("_t"), F.struct(*BOX_COLUMNS).alias("_tb"))
    p = predicted.select(*keys, F.col(predicted_order).alias("_p"),
                         F.struct(*BOX_COLUMNS).alias("_pb"))
    sizes = (t.select(*keys).unionByName(p.select(*keys)))
    hot = oversized_groups(sizes, keys, small_group)
    out = [F.col("_t").alias(truth_order), F.col("_p").alias(predicted_order), F.col("iou")]
    if hot.isEmpty():
        return _match_in_arrays(t, p, keys, threshold).select(*keys, *out)
    hot = cut_lineage(hot)
    calm = _match_in_arrays(t.join(hot, keys, "left_anti"), p.join(hot, keys, "left_anti"),
                            keys, threshold)
    busy = _match_by_proposals(_told_apart(t.join(hot, keys, "left_semi"), keys, "_t", "_tb"),
                               _told_apart(p.join(hot, keys, "left_semi"), keys, "_p", "_pb"), keys, threshold)
    busy = busy.select(*keys, F.col("_t.o").alias("_t"), F.col("_p.o").alias("_p"), "iou")
    return calm.unionByName(busy).select(*keys, *out)


def _told_apart(rows: DataFrame, keys: list[str], order: str, box: str) -> DataFrame:
    """Order values made unique: rows of one value follow their boxes, equal boxes are numbered."""
    same = Window.partitionBy(*keys, order, box).orderBy(F.lit(0))
    return rows.withColumn(order, F.struct(F.col(order).alias("o"), F.col(box).alias("b"),
                                           F.row_number().over(same).alias("n")))


def _match_in_arrays(t, p, keys, threshold) -> DataFrame:
    """The walk over the pairs above the threshold, in order; rows are told apart by their place in sorted arrays."""
    truths = t.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_t", "_tb"))).alias("ts"))
    preds = p.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_p", "_pb"))).alias("ps"))
    pairs = (truths.join(preds, keys).select(*keys, "ps", F.posexplode("ts").alias("i", "x"))
             .select(*keys, "i", "x", F.posexplode("ps").alias("j", "y"))
             .select(*keys, "i", "j", F.col("x._t").alias("_t"), F.col("y._p").alias("_p"),
                     (-iou(Box.struct(F.col("x._tb")), Box.struct(F.col("y._pb")))).alias("n"))
             .filter((F.col("n") <= -threshold) & (F.col("n") < 0)))
    # Of a truth row's pairs the best free one is the first whose ends are both free.
    near = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        "i", "n", "j", "_t", "_p"))).alias("ps"))

    def step(done: Column, pair: Column) -> Column:
        held = F.exists(done, lambda d: (d["i"] == pair["i"]) | (d["j"] == pair["j"]))
        return F.when(held, done).otherwise(F.array_append(done, pair))

    return near.select(*keys, F.inline(F.aggregate("ps", F.slice("ps", 1, 0), step))).select(
        *keys, "_t", "_p", (-F.col("n")).alias("iou"))


def _match_by_proposals(t, p, keys, threshold) -> DataFrame:
    """Same result by rounds of proposals.

    Every truth row proposes to its best prediction that no earlier truth row holds; a prediction
    holds the earliest proposer. Predictions rank all truth rows alike (by order), so the stable
    outcome is unique and is the one of the sequential walk.
    """
    tc = t.withColumn("_cell", F.explode(grid_cells(Box.struct(F.col("_tb")), threshold)))
    pc = p.withColumn("_cell", F.explode(grid_cells(Box.struct(F.col("_pb")), threshold)))
    score = iou(Box.struct(F.col("_tb")), Box.struct(F.col("_pb")))
    pairs = (tc.join(pc, [*keys, "_cell"]).withColumn("iou", score)
             .filter((F.col("iou") >= threshold) & (F.col("iou") > 0))
             .select(*keys, "_t", "_p", "iou").distinct())
    pairs = cut_lineage(pairs)
    held: DataFrame | None = None
    while True:
        if held is None:
            open_pairs = pairs
        else:
            holder = held.select(*keys, "_p", F.col("_t").alias("_h"))
            placed = held.select(*keys, "_t")
            open_pairs = (pairs.join(placed, [*keys, "_t"], "left_anti")
                          .join(holder, [*keys, "_p"], "left")
                          .filter(F.col("_h").isNull() | (F.col("_t") < F.col("_h"))).drop("_h"))
        proposals = (open_pairs.groupBy(*keys, "_t")
                     .agg(F.min(F.struct((-F.col("iou")).alias("n"), "_p", "iou")).alias("b"))
                     .select(*keys, "_t", "b._p", "b.iou"))
        proposals = cut_lineage(proposals)
        if proposals.isEmpty():
            break
        pool = proposals if held is None else held.unionByName(proposals)
        held = cut_lineage(pool.groupBy(*keys, "_p").agg(F.min(F.struct("_t", "iou")).alias("b"))
                           .select(*keys, "b._t", "_p", "b.iou"))
    empty = pairs.select(*keys, "_t", "_p", "iou").limit(0)
    return empty if held is None else held.select(*keys, "_t", "_p", "iou")


def cut_into_tiles(boxes: DataFrame, width: Column, height: Column, size: int = 640,
                   stride: int = 512, min_visibility: float = 0.25,
                   label: Column | None = None, max_tiles: int = 0) -> DataFrame:
    """One row per box and tile it is visible in, with a label line local to the tile."""
    source = Box.of()
    spread = boxes.select("*", F.posexplode(
        tiles(width, height, size, stride, max_tiles, floor_sizes=False)).alias("tile_no", "tile"))
    t = Box(*[F.col(f"tile.{c}").cast("double") for c in BOX_COLUMNS])
    cut = Box(F.greatest(source.x_min, t.x_min), F.greatest(source.y_min, t.y_min),
              F.least(source.x_max, t.x_max), F.least(source.y_max, t.y_max))
    local = cut.shifted(-t.x_min, -t.y_min)
    visible = cut.area / F.greatest(source.area, F.lit(1.0))
    line = normalized_line(local, t.x_max - t.x_min, t.y_max - t.y_min,
                           F.lit(0) if label is None else label)
    return (spread.filter(usable(cut) & (visible >= min_visibility))
            .withColumn("visibility", visible).withColumn("line", line))


def valid_boxes(df: DataFrame, width: Column, height: Column, swap: bool = False) -> DataFrame:
    """Clip boxes to the frame and drop those thinner than three pixels."""
    cut = clip(Box.of(), width, height)
    cut = ordered(cut) if swap else cut
    return df.select(*[c for c in df.columns if c not in BOX_COLUMNS], *cut.columns()).filter(
        usable(Box.of()))
