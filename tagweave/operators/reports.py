"""Evaluation, experiment and quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagweave.operators.records import compare_records
from tagweave.operators.spatial import match_boxes
from tagweave.session import cut_lineage
from tagweave.schema import QUALITY_COLUMNS


def evaluate(truth: DataFrame, predicted: DataFrame, keys: list[str], truth_order: str,
             predicted_order: str, threshold: float = 0.15, match_keys: list[str] | None = None) -> DataFrame:
    """Quality of predicted records per key (sequence).

    Boxes are matched within ``match_keys`` (default: the keys themselves, whatever the timestamp).
    """
    match_keys = match_keys or keys
    pairs = match_boxes(truth, predicted, match_keys, truth_order, predicted_order, threshold)
    left = truth.select(*match_keys, truth_order, *[F.col(c).alias(f"t_{c}") for c in QUALITY_COLUMNS])
    right = predicted.select(*match_keys, predicted_order,
                             *[F.col(c).alias(f"p_{c}") for c in QUALITY_COLUMNS])
    joined = pairs.join(left, [*match_keys, truth_order]).join(right, [*match_keys, predicted_order])
    compared = compare_records(joined, list(dict.fromkeys([*match_keys, "iou"])))
    scored = compared.groupBy(*keys).agg(
        F.count("*").alias("matched"), F.count_if(F.col("field_accuracy") >= 0.8).alias("good"),
        F.avg("iou").alias("avg_iou"), F.avg("field_accuracy").alias("avg_field_accuracy"))
    t = truth.groupBy(*keys).agg(F.count("*").alias("truth_rows"))
    p = predicted.groupBy(*keys).agg(F.count("*").alias("predicted_rows"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = t.join(p, keys, "full").join(scored, keys, "left")
    return rows.select(
        *keys, zero("truth_rows").alias("truth_rows"), zero("predicted_rows").alias("predicted_rows"),
        zero("matched").alias("matched_rows"), zero("good").alias("quality_rows_at_80pct"),
        F.round(zero("good") / F.greatest(F.lit(1), zero("truth_rows")), 6).alias("proxy_score"),
        F.greatest(F.lit(0), zero("predicted_rows") - zero("matched")).alias("duplicate_rows"),
        F.round(F.coalesce("avg_iou", F.lit(0.0)), 6).alias("avg_iou"),
        F.round(F.coalesce("avg_field_accuracy", F.lit(0.0)), 6).alias("avg_field_accuracy"))


def mean_proxy_score(per_sequence: DataFrame) -> DataFrame:
    return per_sequence.agg(F.count("*").alias("sequences"), F.coalesce(
        F.round(F.avg("proxy_score"), 6), F.lit(0.0)).alias("mean_proxy_score"))


def variant_summary(metrics: DataFrame, variant: str = "variant") -> DataFrame:
    """Per variant: decodes, totals, means and the decode rate in percent."""
    rate = F.col("decoded_count") / F.col("total") * 100
    return (metrics.groupBy(variant).agg(
        F.count_if("decoded").alias("decoded_count"), F.count("*").alias("total"),
        F.count_if(F.col("reader_a") != "").alias("reader_a_ok"),
        F.count_if(F.col("reader_b") != "").alias("reader_b_ok"),
        F.round(F.avg("lapvar"), 6).alias("avg_lapvar"),
        F.round(F.avg("bar_contrast"), 6).alias("avg_bar_contrast"),
        F.round(F.avg("edge_density"), 6).alias("avg_edge_density"))
        .withColumn("decode_rate", F.bround(rate, 1)))


def variant_report(summary: DataFrame, baseline: str, variant: str = "variant") -> DataFrame:
    """Best variant against the baseline, one row."""
    best = F.max_by(F.struct(variant, "decode_rate", "avg_lapvar"),
                    F.struct(F.col("decoded_count"), F.col("decode_rate"), F.col(variant)))
    base = F.max(F.when(F.col(variant) == baseline, F.col("decode_rate")))
    return summary.agg(F.count("*").alias("variants"), best.alias("b"), base.alias("baseline_rate")).select(
        "variants", F.col(f"b.{variant}").alias("best_variant"), F.col("b.decode_rate").alias("best_rate"),
        "baseline_rate", F.round(F.col("b.decode_rate") - F.col("baseline_rate"), 1).alias("improvement"))


def best_variant_per_crop(metrics: DataFrame, crop: str, order: list[Column], variant: str = "variant") -> DataFrame:
    """Winner per crop: decoded first, then sharpness; the earlier variant wins a tie."""
    score = F.when(F.col("decoded"), 10000.0).otherwise(0.0) + F.col("lapvar")
    rows = metrics.withColumn("score", score).filter(F.col("score") > -1)
    best = F.min_by(F.struct(variant, "score"), F.struct((-F.col("score")).alias("s"), *order))
    return rows.groupBy(crop).agg(best.alias("b")).select(crop, f"b.{variant}", "b.score")


def try_variants(crops: DataFrame, variants: dict[str, dict[str, Column]]) -> DataFrame:
    """Every crop under every named variant: one row each, with an ``error`` column.

    A variant maps output columns to expressions. The list is part of the plan, so rows multiply
    inside the scan stage without a join.
    """
    names = list(next(iter(variants.values())))
    tried = F.array(*[F.struct(F.lit(i).alias("variant_no"), F.lit(v).alias("variant"),
                               *[exprs[n].alias(n) for n in names])
                      for i, (v, exprs) in enumerate(variants.items())])
    return crops.select(*crops.columns, F.inline(tried))


def value_histogram(rows: DataFrame, keys: list[str], value: str, low: float, high: float,
                    bins: int) -> DataFrame:
    """Counts per bin; the last bin includes its upper edge, values outside are left out."""
    width = (high - low) / bins
    number = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1))
    return (rows.filter(F.col(value).between(low, high)).groupBy(*keys, number.alias("bin"))
            .agg(F.count("*").alias("n")))


def histogram_peak(histogram: DataFrame, keys: list[str], low: float, high: float, bins: int) -> DataFrame:
    """Centre of the fullest bin, the lowest of equal ones."""
    width = (high - low) / bins
    peak = F.max_by("bin", F.struct(F.col("n"), (-F.col("bin")).alias("b")))
    return histogram.groupBy(*keys).agg(F.max("n").alias("n"), peak.alias("bin")).withColumn(
        "center", F.round(low + (F.col("bin") + 0.5) * width, 6))


def exact_quantiles(rows: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """Interpolated quantiles of one column without collecting or sorting it in one task.

    Equal values become one counted row; counts are summed within ranges of sampled quantiles, and
    only the ranges' totals are ordered together. Outliers and hot values are no matter.
    """
    values = rows.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    counted = values.groupBy("v").count().repartitionByRange("v").withColumn("_range", F.spark_partition_id())
    counted = cut_lineage(counted)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    totals = counted.groupBy("_range").agg(F.sum("count").alias("n"))
    totals = totals.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_earlier"))
    upto = Window.partitionBy("_range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    last = F.sum("count").over(upto) + F.col("_earlier")
    ranked = counted.join(F.broadcast(totals), "_range").withColumn("last", last)
    n = counted.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    places = {q: (n - 1) * q for q in shares}
    wanted = sorted({int(p) + 1 + k for p in places.values() for k in (0, 1)})
    hits = ranked.select("v", F.explode(F.filter(F.array(*[F.lit(w).cast("bigint") for w in wanted]), lambda w: (
        w <= F.col("last")) & (w > F.col("last") - F.col("count")))).alias("r"))
    at = hits.agg(F.map_from_arrays(F.collect_list("r"), F.collect_list("v")).alias("m"))

    def quantile(p: float) -> Column:
        low_v = F.try_element_at("m", F.lit(int(p) + 1).cast("bigint"))
        high_v = F.coalesce(F.try_element_at("m", F.lit(int(p) + 2).cast("bigint")), low_v)
        return low_v + (high_v - low_v) * (p - int(p))
    return at.select(F.lit(column).alias("metric"), *[
        F.round(quantile(p), 6).alias(f"p{int(q * 100)}") for q, p in places.items()])


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles, one row per column."""
    parts = [F.struct(
        F.lit(c).alias("metric"), F.count(c).alias("count"), F.round(F.avg(c), 6).alias("mean"),
        F.round(F.stddev(c), 6).alias("std"), F.min(F.col(c).cast("double")).alias("min"),
        F.max(F.col(c).cast("double")).alias("max")) for c in columns]
    basic = rows.agg(F.array(*parts).alias("_a")).select(F.inline("_a"))
    quantiles = reduce(DataFrame.unionByName, (exact_quantiles(rows, c, [0.25, 0.5, 0.75]) for c in columns))
    return basic.join(quantiles, "metric")


def track_summary(observations: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Per track: count, its best observation and its sources."""
    best = F.max_by(F.struct("ts_ms", "score", "x_min", "y_min"),
                    F.struct(F.col("score"), (-F.col(seq)).alias("s")))
    return observations.groupBy(*keys).agg(
        F.count("*").alias("observations"), best.alias("b"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")).select(
        *keys, "observations", F.col("b.ts_ms").alias("best_timestamp"),
        F.bround("b.score", 3).alias("best_score"), F.col("b.x_min").alias("best_x_min"),
        F.col("b.y_min").alias("best_y_min"), "sources")


def run_counters(frames: DataFrame, detections: DataFrame, records: DataFrame, video: str) -> DataFrame:
    f = frames.groupBy(video).agg(F.count("*").alias("frames_seen"))
    d = detections.groupBy(video).agg(F.count("*").alias("detections_seen"))
    r = records.groupBy(video).agg(F.count("*").alias("rows"))
    joined = f.join(d, video, "full").join(r, video, "full")
    return joined.select(video, *[F.coalesce(c, F.lit(0)).alias(c) for c in
                                  ("frames_seen", "detections_seen", "rows")])


def improvements(best: DataFrame, n: int, crop: str) -> DataFrame:
    return best.orderBy(F.desc("score"), crop).limit(n)
