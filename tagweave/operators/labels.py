"""Detector label sets: reading lines, checks, de-duplication, splits and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagweave.functions.geometry import from_normalized
from tagweave.functions.text import fixed_decimals
from tagweave.operators.ordering import rank_by_range, rank_in_group, settled
from tagweave.operators.spatial import suppress_overlaps
from tagweave.schema import BOX_COLUMNS

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def split_lines(files: DataFrame, keys: list[str], text: str = "value") -> DataFrame:
    """Whole label files to (keys, line_no from 1, line)."""
    lines = F.split(F.col(text), r"\r\n|\n|\r")
    return files.select(*keys, F.posexplode(lines).alias("_i", "line")).select(
        *keys, (F.col("_i") + 1).alias("line_no"), "line")


def parse_label_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add class, centre, size, corners and a ``warning``; ``is_box`` marks usable rows.

    A row outside the unit square is warned about but stays a box. Blank lines drop out.
    """
    parts = F.split(F.trim(F.regexp_replace(F.col(line), r"(?U)\s+", " ")), " ")
    rows = settled(lines, _p=parts).filter(F.col("_p")[0] != "")
    value = lambda i: F.when(F.get("_p", F.lit(i)).rlike(NUMBER), F.get("_p", F.lit(i)).try_cast("double"))
    names = ["_c", "cx", "cy", "w", "h"]
    rows = settled(rows, **{n: value(i) for i, n in enumerate(names)})
    short = F.size("_p") < 5
    broken = F.greatest(*[F.col(n).isNull().cast("int") for n in names]) == 1
    flat = (F.col("w") <= 0) | (F.col("h") <= 0)
    inside = F.lit(True)
    for n in names[1:]:
        inside = inside & F.col(n).between(0, 1)
    warning = (F.when(short, F.concat(F.lit("expected 5 values, got "), F.size("_p")))
               .when(broken, "cannot parse numbers").when(flat, "non-positive box size")
               .when(~inside, "values are outside [0, 1]"))
    box = from_normalized(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
    return rows.withColumns({
        "class_id": F.col("_c").cast("int"), "warning": warning,
        "is_box": ~(short | broken | flat), "values": F.size("_p"),
        **{c: getattr(box, c) for c in BOX_COLUMNS}}).drop("_p", "_c")


def check_labels(images: DataFrame, parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Per image its boxes and warnings; an image without a label file has one warning."""
    counts = parsed.groupBy(*keys).agg(
        F.count_if("is_box").alias("boxes"), F.count("warning").alias("warnings"))
    joined = images.join(counts.withColumn("_found", F.lit(True)), keys, "left")
    return joined.select(
        *images.columns, F.coalesce("boxes", F.lit(0)).alias("boxes"),
        F.when(F.col("_found").isNull() & ~F.coalesce(F.col("has_label"), F.lit(False)), 1)
        .otherwise(F.coalesce("warnings", F.lit(0))).alias("warnings"))


def label_totals(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("images"), F.coalesce(F.sum("boxes"), F.lit(0)).alias("boxes"),
                       F.count_if(F.col("warnings") > 0).alias("images_with_warnings"))


def suppress_labels(parsed: DataFrame, keys: list[str], threshold: float = 0.75,
                    class_aware: bool = False) -> DataFrame:
    """Greedy suppression of label boxes, by class then line; only lines of five values count."""
    rows = parsed.filter((F.col("values") == 5) & F.col("cx").isNotNull() & F.col("class_id").isNotNull())
    group = [*keys, "class_id"] if class_aware else keys
    return suppress_overlaps(rows, group, [F.col("class_id"), F.col("line_no")], threshold)


def drop_near_equal(parsed: DataFrame, keys: list[str], threshold: float = 0.92, hot: DataFrame | None = None) -> DataFrame:
    """Keep the first of near-identical label boxes, in line order; ``hot`` as for ``suppress_overlaps``."""
    rows = parsed.filter((F.col("values") == 5) & F.col("cx").isNotNull())
    return suppress_overlaps(rows, keys, [F.col("line_no")], threshold, hot=hot)


def first_of_equal(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Keep the first of exactly equal values per key."""
    return rows.groupBy(*keys, value).agg(F.min(order).alias(order))


# ---- splits -------------------------------------------------------------------------------

def seeded_key(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def exact_split(frames: DataFrame, key: Column, seed: int = 42, fraction: float = 0.2,
                name: str = "split") -> DataFrame:
    """Shuffle by seed; the first ``max(1, int(n * fraction))`` rows are validation (none if n < 2)."""
    n = frames.count()
    n_val = max(1, int(n * fraction)) if n > 1 else 0
    hashed = frames.withColumn("_h", seeded_key(seed, key))
    ranked = rank_by_range(hashed, [], [F.col("_h"), key], "_r")
    return ranked.withColumn(name, F.when(F.col("_r") <= n_val, "val").otherwise("train")).drop("_h", "_r")


def hash_split(video: Column, time: Column, ratio: float) -> Column:
    """Split by the hash of video and time, so that a frame and its neighbours stay together."""
    key = F.concat_ws(":", video.cast("string"), F.rint(time).cast("bigint").cast("string"))
    share = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / float(0xFFFFFFFF)
    if ratio <= 0 or ratio >= 1:
        return F.lit("val" if ratio >= 1 else "train")
    return F.when(share < ratio, "val").otherwise("train")


def modulo_split(frame_id: Column, ratio: float) -> Column:
    if ratio <= 0 or ratio >= 1:
        return F.lit("val" if ratio >= 1 else "train")
    return F.when(frame_id % max(1, round(1 / ratio)) == 0, "val").otherwise("train")


def number_frames(frames: DataFrame, order: list[Column], name: str = "frame_id") -> DataFrame:
    """Consecutive ids from 0 over the whole table."""
    ranked = rank_by_range(frames, [], order, "_r")
    return ranked.withColumn(name, F.col("_r") - 1).drop("_r")


def seeded_sample(rows: DataFrame, key: Column, limit: int, seed: int = 42) -> DataFrame:
    return rows.orderBy(seeded_key(seed, key), key).limit(limit)


# ---- manifests ----------------------------------------------------------------------------

def frame_manifest(detections: DataFrame, video: str, frame: str, split: str = "train",
                   every: int = 1, min_detections: int = 1, max_frames: int = 0) -> DataFrame:
    """One row per sampled frame with enough detections; a limit counts over all videos."""
    rows = (detections.filter(F.col(frame) % every == 0).groupBy(video, frame)
            .agg(F.count("*").alias("detections")).filter(F.col("detections") >= min_detections))
    rows = _limit_frames(rows, video, frame, max_frames)
    return _manifest_columns(rows.withColumn("track_id", F.lit("")), video, frame, split)


def first_sight_manifest(detections: DataFrame, video: str, frame: str, track: str,
                         split: str = "train", max_frames: int = 0) -> DataFrame:
    """One row per frame that shows a track for the first time, listing its new tracks."""
    from tagweave.operators.timejoin import first_seen
    new = first_seen(detections.filter(F.col(track).isNotNull()), [video, track], frame)
    ids = F.array_sort(F.collect_list(F.col(track)))
    rows = new.groupBy(video, frame).agg(
        F.count("*").alias("detections"), F.array_join(F.transform(ids, lambda i: i.cast("string")), " ")
        .alias("track_id"))
    return _manifest_columns(_limit_frames(rows, video, frame, max_frames), video, frame, split)


def _limit_frames(rows: DataFrame, video: str, frame: str, max_frames: int) -> DataFrame:
    return rows.orderBy(video, frame).limit(max_frames) if max_frames else rows


def _manifest_columns(rows: DataFrame, video: str, frame: str, split: str) -> DataFrame:
    image = F.concat(F.col(video).cast("string"), F.lit("_f"), F.lpad(F.col(frame).cast("string"), 7, "0"),
                     F.lit(".jpg"))
    return rows.select(F.lit(split).alias("split"), F.col(video).alias("video"),
                       F.col(frame).alias("frame"), "track_id", image.alias("image"), "detections")


def crop_manifest(detections: DataFrame, image: str, width: Column, height: Column,
                  order: list[Column], bucket: Column) -> DataFrame:
    """Whole-pixel crop rows per detection, numbered within the image; empty crops drop out.

    ``bucket`` is any value that grows with the order, as for ``rank_in_group``.
    """
    whole = lambda c: F.col(c).cast("bigint")
    numbered = rank_in_group(detections, [image], order, bucket, "crop_no").withColumn(
        "crop_no", F.col("crop_no") - 1)
    rows = numbered.select(
        image, "crop_no", fixed_decimals(F.col("confidence"), 4).alias("conf"),
        F.greatest(F.lit(0), whole("x_min")).alias("x1"), F.greatest(F.lit(0), whole("y_min")).alias("y1"),
        F.least(width.cast("bigint"), whole("x_max")).alias("x2"),
        F.least(height.cast("bigint"), whole("y_max")).alias("y2"))
    name = F.concat(F.col(image).cast("string"), F.lit("_crop"),
                    F.format_string("%02d", F.col("crop_no")), F.lit(".jpg"))
    return rows.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).withColumn("filename", name)


# ---- reviews ------------------------------------------------------------------------------

def latest_decisions(events: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return events.groupBy(key).agg(F.max_by("decision", F.struct(*order)).alias("decision"))


def apply_decisions(dataset: DataFrame, events: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The dataset without images whose latest decision removed them."""
    removed = latest_decisions(events, key, order).filter(F.col("decision").startswith("remove_"))
    return dataset.join(removed.select(key), key, "left_anti")


def review_summary(events: DataFrame) -> DataFrame:
    d = F.col("decision")
    return events.agg(
        F.count_if((d == "keep") | d.startswith("remove_")).alias("reviewed"),
        F.count_if(d == "keep").alias("kept"), F.count_if(d.startswith("remove_")).alias("removed"),
        F.count_if(d == "skip_unreadable").alias("skipped"))


def review_items(checked: DataFrame, image: str, include_empty: bool = True,
                 start_at: str | None = None) -> DataFrame:
    rows = checked if start_at is None else checked.filter(F.col(image) >= start_at)
    return rows if include_empty else rows.filter(F.col("boxes") > 0)
