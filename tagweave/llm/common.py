"""What the corpus operators share: reading tables, folds, bounded label samples, written intermediate tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tagweave.session import run_folder

#: Rows and bytes of an Arrow batch; texts can be long, so a batch is kept far below a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, in folders by the columns ``by``: computed once, and safe
    when executors are lost."""
    path = run_folder(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column is called so."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id falls into no part."""
    return F.crc32(doc_id.cast("string")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int,
                    max_chars: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts and 0/1 labels to fit a model on, a bounded sample that is the same for the same rows; and how many
    labelled ids each class has in all.

    ``usable`` says which doc_ids may be learnt from. Of each class the ``per_class`` rows with the smallest
    hash of the id are chosen; they are taken in that order until ``max_chars`` characters per class. Rows with
    a null id, label or text are passed over; an id with both labels counts as 1.
    """
    known = (labels.select(F.col("doc_id"), F.col(label).alias("label"))
             .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & usable)
             .groupBy("doc_id").agg(F.max("label").alias("label"))
             .withColumn("place", F.xxhash64("doc_id")))
    chosen = known.filter("label = 0").orderBy("place", "doc_id").limit(per_class).unionByName(
        known.filter("label = 1").orderBy("place", "doc_id").limit(per_class))
    rows = (docs.select("doc_id", F.substring("text", 1, max_chars).alias("text")).filter(F.col("text").isNotNull())
            .join(F.broadcast(chosen), "doc_id")  # 2 * per_class rows at most
            .groupBy("doc_id", "label", "place").agg(F.min("text").alias("text")))
    running = Window.partitionBy("label").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    used = (rows.withColumn("size", F.sum(F.length("text") + 1).over(running))
            .filter(F.col("size") <= max_chars).orderBy("place", "doc_id"))
    got = used.select("text", "label").toArrow()
    totals = dict(known.groupBy("label").count().collect())  # two rows
    return (got.column("text").to_pylist(), np.array(got.column("label").to_pylist(), dtype=np.int64),
            np.array([totals.get(0, 0), totals.get(1, 0)]))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression on few columns, by Newton steps."""
    full = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(full.shape[1])
    penalty = np.full(full.shape[1], l2)
    penalty[-1] = 1e-9
    for _ in range(rounds):
        p = sigmoid(full @ w)
        slope = full.T @ (p - y) / len(y) + penalty * w
        bend = (full * (p * (1 - p))[:, None]).T @ full / len(y) + np.diag(penalty + 1e-9)
        step = np.linalg.solve(bend, slope)
        w = w - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def score_texts(docs: DataFrame, score, carried: list[str], name: str = "score") -> DataFrame:
    """``carried`` columns and a double per row: ``score`` maps a list of texts (null: empty) to numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["" if t is None else t for t in b.column("text").to_pylist()]
            cols = [b.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(score(texts), pa.float64())], [*carried, name])

    small_batches(docs.sparkSession)
    taken = docs.select(*carried, "text") if "text" not in carried else docs.select(*carried)
    schema = StructType([*docs.select(*carried).schema.fields, StructField(name, DoubleType())])
    return taken.mapInArrow(run, schema)
