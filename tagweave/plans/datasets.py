"""Jobs on detector label sets and experiment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagweave.functions.geometry import Box, clip, normalized_line, usable
from tagweave.operators import labels as lb, reports, timejoin
from tagweave.operators.spatial import SMALL_GROUP, cut_into_tiles, oversized_groups, suppress_overlaps, valid_boxes
from tagweave.schema import BOX_COLUMNS
from tagweave.session import cut_lineage


def label_frames(labels: DataFrame, frames: DataFrame, reach_ms: float) -> DataFrame:
    """Valid label boxes on the frame nearest to their timestamp."""
    placed = timejoin.frame_at(labels, frames, ["video_id"], "frame_timestamp", "ts_ms", reach_ms)
    sized = labels.join(placed, ["video_id", "frame_timestamp"]).join(
        frames.select("video_id", "ts_ms", "width", "height"), ["video_id", "ts_ms"])
    return valid_boxes(sized, F.col("width"), F.col("height"))


def full_frame_labels(boxes: DataFrame, frame_keys: list[str], order: str) -> DataFrame:
    """Label lines per frame, exact copies kept once (first in order)."""
    lines = boxes.withColumn("line", normalized_line(Box.of(), F.col("width"), F.col("height"), F.lit(0)))
    return lb.first_of_equal(lines.filter(F.col("line").isNotNull()), frame_keys, "line", order)


def build_full_frame(base: DataFrame, propagated: DataFrame, order: str, val_ratio: float = 0.2,
                     mode: str = "frame_id") -> DataFrame:
    """Label lines of base and propagated frames with frame ids and splits.

    Both inputs carry (video_id, frame_timestamp, offset, box, width, height) and ``order``.
    """
    keys = ["video_id", "frame_timestamp", "offset"]
    lines = full_frame_labels(base.unionByName(propagated), keys, order)
    # Frames are numbered base first, then backward, then forward steps.
    step = F.struct((F.col("offset") > 0).alias("a"), F.abs("offset").alias("b"))
    frames = lines.select(*keys).distinct()
    if mode == "timestamp_hash":
        split = lb.hash_split(F.col("video_id"), F.col("frame_timestamp"), val_ratio)
        frames = frames.withColumn("frame_id", F.lit(None).cast("bigint")).withColumn("split", split)
    elif mode == "frame_id":
        frames = number_by_video_time(frames, step)
        frames = frames.withColumn("split", lb.modulo_split(F.col("frame_id"), val_ratio))
    else:
        raise ValueError(f"unknown split mode {mode!r}")
    return lines.join(frames, keys)


def number_by_video_time(frames: DataFrame, step: Column) -> DataFrame:
    """Frame ids over videos, label times and steps."""
    return lb.number_frames(frames, [F.col("video_id"), F.col("frame_timestamp"), step])


def build_report(lines: DataFrame, rejected: int | Column = 0, empty: int | Column = 0) -> DataFrame:
    """Counts of a built label set, one row."""
    frames = lines.groupBy("video_id", "frame_timestamp", "offset", "split").agg(F.count("*").alias("n"))
    return frames.agg(
        F.count_if(F.col("split") == "train").alias("train_images"),
        F.count_if(F.col("split") == "val").alias("val_images"), F.count("*").alias("labels"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("instances"),
        F.count_if(F.col("offset") == 0).alias("base_frames"),
        F.count_if(F.col("offset") != 0).alias("propagated_frames"),
        F.lit(rejected).cast("bigint").alias("rejected_propagations"),
        F.lit(empty).cast("bigint").alias("empty_labels"))


def build_tiled(boxes: DataFrame, frame_keys: list[str], order: str, size: int = 640, stride: int = 512,
                min_visibility: float = 0.25, near_equal: float = 0.92, val_fraction: float = 0.2,
                seed: int = 42) -> DataFrame:
    """Label lines per tile with visible boxes, near-identical ones once, and an exact split."""
    # Boxes are shuffled as they are, by frame; their tiles and lines are made after, where they are compared and joined.
    boxes = boxes.select(*dict.fromkeys([*frame_keys, order, "width", "height", *BOX_COLUMNS])).repartition(*frame_keys)
    tiled = cut_into_tiles(boxes, F.col("width"), F.col("height"), size, stride, min_visibility)
    tiled = tiled.filter(F.col("line").isNotNull()).select(*frame_keys, "tile_no", order, "line")
    parsed = lb.parse_label_lines(tiled.withColumnRenamed(order, "line_no")).select(
        *frame_keys, "tile_no", "line_no", "line", "values", "cx", *BOX_COLUMNS)
    # A tile has no more lines than its frame has boxes.
    hot = oversized_groups(boxes, frame_keys, SMALL_GROUP)
    kept = lb.drop_near_equal(parsed, [*frame_keys, "tile_no"], near_equal, hot)
    frames = boxes.select(*frame_keys).distinct()
    split = lb.exact_split(frames, F.concat_ws(":", *frame_keys), seed, val_fraction)
    return kept.join(split, frame_keys).select(*frame_keys, "split", "tile_no", "line_no", "line")


def add_propagated_to_train(base: DataFrame, propagated: DataFrame) -> DataFrame:
    """Neighbour frames only ever enlarge the training part."""
    return base.unionByName(propagated.withColumn("split", F.lit("train")))


def build_training_set(labels: DataFrame, frames: DataFrame, moved: DataFrame, order: str, steps: int, reach_ms: float,
                       min_score: float = 0.42, val_ratio: float = 0.2, mode: str = "frame_id",
                       neighbours: str = "any") -> tuple[DataFrame, DataFrame]:
    """Label boxes and their measured places in neighbour frames to label lines with splits, and the report.

    ``labels`` (video_id, frame_timestamp, ``order``, box) meet the nearest of ``frames`` (video_id,
    ts_ms, width, height). ``moved`` has a row per box, direction (-1 or 1) and step up to ``steps``:
    its place there and the match ``score``. A chain of steps ends at the first one with a score under
    ``min_score`` or without a usable box; each chain that ends early is a rejection. ``neighbours``:
    ``any`` splits neighbour frames like the others, ``train`` adds them to the training part only.
    """
    keys = ["video_id", "frame_timestamp"]
    base = cut_lineage(label_frames(labels, frames, reach_ms).withColumn("offset", F.lit(0)))
    sized = moved.join(base.select(*keys, "width", "height").distinct(), keys)
    cut = clip(Box.of(), F.col("width"), F.col("height"))
    chain = cut_lineage(timejoin.propagate_chain(
        sized.withColumn("box_ok", F.coalesce(usable(cut), F.lit(False))), keys, min_score).filter("reached"))
    passed = sized.join(chain.select(*keys, "direction", "step"), [*keys, "direction", "step"])
    passed = valid_boxes(passed, F.col("width"), F.col("height")).withColumn("offset", F.col("direction") * F.col("step"))
    columns = [*keys, "offset", order, "width", "height", *BOX_COLUMNS]
    base, passed = base.select(*columns), passed.select(*columns)
    if neighbours == "train":
        own = build_full_frame(base, passed.limit(0), order, val_ratio, mode)
        more = full_frame_labels(passed, [*keys, "offset"], order)
        lines = add_propagated_to_train(own, more.withColumn("frame_id", F.lit(None).cast("bigint")))
    elif neighbours == "any":
        lines = build_full_frame(base, passed, order, val_ratio, mode)
    else:
        raise ValueError(f"unknown place for neighbours {neighbours!r}")
    lines = cut_lineage(lines)
    whole = chain.filter(F.col("step") == steps).count()
    bases = base.select(*keys).distinct().count()
    tried = bases + chain.count()
    return lines, build_report(lines, 2 * bases - whole, tried - lines.select(*keys, "offset").distinct().count())


def dedupe_labels(lines: DataFrame, keys: list[str], threshold: float = 0.75,
                  class_aware: bool = False) -> DataFrame:
    return lb.suppress_labels(lb.parse_label_lines(lines), keys, threshold, class_aware)


def dedupe_totals(lines: DataFrame, kept: DataFrame) -> DataFrame:
    n = lines.agg(F.count("*").alias("labels_in"))
    m = kept.agg(F.count("*").alias("labels_out"))
    both = n.select("labels_in", F.lit(0).cast("bigint").alias("labels_out")).unionByName(
        m.select(F.lit(0).cast("bigint").alias("labels_in"), "labels_out"))
    return both.agg(F.sum("labels_in").alias("labels_in"), F.sum("labels_out").alias("labels_out")).withColumn(
        "removed", F.col("labels_in") - F.col("labels_out"))


def qa_labels(images: DataFrame, lines: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Checked images and their totals."""
    checked = lb.check_labels(images, lb.parse_label_lines(lines), keys)
    return checked, lb.label_totals(checked)


def import_annotations(pairs: DataFrame, key: str, val_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Split imported image/label pairs; background images keep an empty label."""
    rows = lb.exact_split(pairs, F.col(key), seed, val_fraction)
    return rows.withColumn("background", ~F.col("has_label"))


def pseudo_label(detections: DataFrame, video: str, frame: str, width: Column, height: Column,
                 order: list[Column], every: int = 1, min_detections: int = 1,
                 max_frames: int = 0) -> tuple[DataFrame, DataFrame]:
    """Manifest and label lines of sampled frames with enough detections."""
    manifest = lb.frame_manifest(detections, video, frame, "train", every, min_detections, max_frames)
    chosen = manifest.select(F.col("video").alias(video), F.col("frame").alias(frame))
    lines = detections.join(chosen, [video, frame], "left_semi").withColumn(
        "line", normalized_line(Box.of(), width, height, F.coalesce("class_id", F.lit(0))))
    return manifest, lines.filter(F.col("line").isNotNull())


def name_classes(detections: DataFrame, names: DataFrame) -> DataFrame:
    """Class name per detection, the id itself where it has none."""
    return detections.join(names.select("class_id", "name"), "class_id", "left").withColumn(
        "class_name", F.coalesce("name", F.col("class_id").cast("string"))).drop("name")


def regions_by_class(boxes: DataFrame, crops: DataFrame, zones: Column, order: list[Column]) -> DataFrame:
    """First box per crop and class; the fixed zone where a crop has no box of that class."""
    first = boxes.groupBy("crop_id", F.col("class_name").alias("zone")).agg(
        F.min_by(F.struct(*BOX_COLUMNS), F.struct((-F.col("confidence")).alias("c"), *order)).alias("b"))
    fixed = crops.select("crop_id", F.inline(zones)).select(
        "crop_id", "zone", F.struct(*BOX_COLUMNS).alias("z"))
    joined = first.join(fixed, ["crop_id", "zone"], "full")
    return joined.select("crop_id", "zone", F.coalesce("b", "z").alias("box"),
                         F.when(F.col("b").isNotNull(), "detected").otherwise("fixed").alias("origin"))


def candidate_boxes(sources: list[DataFrame], keys: list[str], order: list[Column],
                    threshold: float = 0.42, limit: int = 80, colour_limit: int = 32) -> DataFrame:
    """Union of candidate sources, suppressed per frame and capped."""
    rows = None
    for number, source in enumerate(sources):
        part = source.withColumn("source_order", F.lit(number))
        rows = part if rows is None else rows.unionByName(part)
    cap = F.when(F.bool_and(F.col("source").startswith("color_")), min(limit, colour_limit)).otherwise(limit)
    return suppress_overlaps(rows, keys, [-F.col("confidence"), F.col("source_order"), *order], threshold, cap)


def roi_candidates(inside: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes found inside the rail band, moved to the frame; whole-frame boxes where it had none."""
    moved = Box.of().shifted(F.col("roi_x"), F.col("roi_y"))
    rest = [c for c in inside.columns if c not in (*BOX_COLUMNS, "roi_x", "roi_y")]
    shown = inside.select(*rest, *moved.columns()).withColumn("source", F.concat("source", F.lit(":rail_roi")))
    missing = whole.join(inside.select(*keys).distinct(), keys, "left_anti")
    return shown.unionByName(missing.select(*shown.columns))


def variant_tables(metrics: DataFrame, baseline: str) -> tuple[DataFrame, DataFrame]:
    summary = reports.variant_summary(metrics)
    return summary, reports.variant_report(summary, baseline)
