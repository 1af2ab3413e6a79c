"""Writers: record CSV, run files, label trees, manifests and logs. All write from executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagweave.operators.records import normalize_records
from tagweave.schema import RECORD_COLUMNS


def write_records_csv(records: DataFrame, path: str, mode: str = "overwrite",
                      byte_order_mark: bool = True, files: int | None = None) -> None:
    """Normalised records; each part file starts with a byte-order mark and the header."""
    df = normalize_records(records)
    if files:
        df = df.coalesce(files)
    if byte_order_mark:
        df = df.withColumnRenamed("filename", "\ufefffilename")
    df.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def append_results(rows: DataFrame, path: str, video: str = "filename", first: bool = False) -> None:
    """Result rows of one or more videos, one folder per video."""
    extras = [c for c in ("_quality", "_track_id") if c in rows.columns]
    df = rows.select(*RECORD_COLUMNS, *extras).withColumn("video", F.col(video))
    df.write.mode("overwrite" if first else "append").partitionBy("video").option("header", True).option(
        "escape", '"').csv(path)


def write_run_files(rows: DataFrame, folder: str) -> None:
    """``output.csv`` with the known columns at hand, ``debug.json`` with every column, whose names stand in every row: both
    are compressed, which readers see by the files' names."""
    known = [c for c in [*RECORD_COLUMNS, "_quality", "_track_id"] if c in rows.columns]
    rows.select(*known).write.mode("overwrite").option("header", True).option("escape", '"').option(
        "compression", "gzip").csv(f"{folder}/output.csv")
    rows.write.mode("overwrite").option("compression", "gzip").json(f"{folder}/debug.json")


def write_nested(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_label_lines(labels: DataFrame, path: str, split: str = "split", image: str = "image",
                      order: str = "line_no", class_names: list[str] | None = None) -> None:
    """Label lines by split and image, in order within the image; class names beside them."""
    if class_names is not None:
        names = labels.sparkSession.createDataFrame(list(enumerate(class_names)), "class_id int, name string")
        names.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}.classes")
    rows = labels.select(F.col(split).alias("split"), F.col(image).alias("image"), order, "line")
    (rows.repartition("split", "image").sortWithinPartitions("split", "image", order)
     .write.mode("overwrite").partitionBy("split").parquet(path))


def write_label_tree(labels: DataFrame, path: str, folder: str, order: str = "line_no",
                     file: str | None = None) -> None:
    """Label text files under the same relative folders as they came from; with ``file`` one per source
    file, in a folder of its name."""
    by = [folder, *([file] if file else [])]
    (labels.repartition(*by).sortWithinPartitions(*by, order).select(*by, "line")
     .write.mode("overwrite").partitionBy(*by).text(path))


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").option("header", True).csv(path)


def append_review_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def write_experiment(metrics: DataFrame, summary: DataFrame, folder: str) -> None:
    metrics.write.mode("overwrite").option("header", True).csv(f"{folder}/full_results")
    summary.write.mode("overwrite").option("header", True).csv(f"{folder}/summary")
