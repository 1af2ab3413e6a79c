"""Crop scores, colour, fingerprints and rail bands from measured columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tagweave.schema import ABSENT, COLOR_HINTS, QUALITY_COLUMNS
from tagweave.functions.text import is_noise, let, normalize_value


def fusion_crop_score(sharpness: Column, area: Column, confidence: Column, decoded: Column,
                      border: Column) -> Column:
    cap = lambda c: F.least(F.lit(1.0), c)
    return (0.30 * cap(sharpness / 500.0) + 0.25 * cap(area / 80_000.0) + 0.20 * confidence
            + F.when(decoded, 0.20).otherwise(0.0) + F.when(border, 0.0).otherwise(0.05))


def best_crop_score(laplacian: Column, block_artifact: Column, high_frequency: Column) -> Column:
    sharp = F.least(laplacian / 2000.0, F.lit(1.0))
    penalty = F.least(F.greatest(block_artifact - 1.0, F.lit(0.0)) / 2.0, F.lit(1.0))
    detail = F.least(high_frequency / 0.6, F.lit(1.0))
    score = 0.4 * sharp + 0.4 * detail - 0.2 * penalty
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def completeness(columns: dict[str, Column] | None = None) -> Column:
    """How many of the key fields hold a usable value."""
    def usable(name: str) -> Column:
        value = normalize_value(columns[name] if columns else name)
        return F.when((value != "") & (value != ABSENT) & ~is_noise(value), 1).otherwise(0)
    return reduce(lambda a, b: a + b, (usable(c) for c in QUALITY_COLUMNS))


def observation_score(confidence: Column, filled: Column, sharpness: Column) -> Column:
    return confidence * 2.0 + filled + sharpness / 500.0


def hue_color(histogram: Column, coloured_share: Column) -> Column:
    """Colour class from an 18-bin hue histogram and the share of coloured pixels."""
    peak = F.array_position(histogram, F.array_max(histogram)) - 1
    hue = peak * 10.0 + 5.0
    named = (F.when((hue < 15) | (hue >= 165), "red").when(hue < 38, "yellow")
             .when(hue < 90, "green").when(hue < 135, "blue").otherwise("purple"))
    blank = (coloured_share < 0.01) | (F.array_max(histogram) <= 0)
    return F.when(blank, "white").otherwise(named)


def mask_color(red: Column, yellow: Column, green: Column, white: Column,
               least_share: float = 0.08) -> Column:
    """Colour with the largest mask share; the earlier colour wins a tie."""
    shares = F.array(red, yellow, green, white)
    top = F.array_max(shares)
    names = F.array(*[F.lit(c) for c in COLOR_HINTS])
    return F.when(top >= least_share, names[F.array_position(shares, top).cast("int") - 1]).otherwise("")


def color_hint(label: Column, source: Column) -> Column:
    return reduce(lambda rest, name: F.when((label == name) | source.endswith(name), name)
                  .otherwise(rest), reversed(COLOR_HINTS), F.lit(""))


def colour_candidate_confidence(fill: Column) -> Column:
    return F.when(fill >= 0.18, F.least(F.lit(0.68), 0.25 + fill * 0.55))


def fingerprint_bits(coefficients: Column) -> Column:
    """64-bit fingerprint: which coefficients exceed the mean of all but the first."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    values = F.transform(coefficients, lambda v: v.cast("double"))
    mean = F.aggregate(F.slice(values, 2, 63), F.lit(0.0), lambda a, v: a + v) / 63.0
    return let(mean, lambda m: F.aggregate(values, zero, lambda bits, v: F.shiftleft(bits, 1).bitwiseOR(
        F.when(v > m, one).otherwise(zero))))


def fingerprint_hex(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def hamming(left: Column, right: Column) -> Column:
    return F.coalesce(F.bit_count(left.bitwiseXOR(right)), F.lit(64))


def rail_band(row_scores: Column, width: Column, height: Column, scale: Column,
              margin_ratio: float = 0.12, min_ratio: float = 0.18,
              max_ratio: float = 0.45) -> Column:
    """Horizontal band around the strongest row, with its score."""
    n = F.size(row_scores)
    ordered = F.array_sort(row_scores)
    at = lambda i: F.get(ordered, i.cast("int"))
    middle = (n - 1) / 2.0
    median = (at(F.floor(middle)) + at(F.ceil(middle))) / 2.0
    base = median + 1e-6
    peak_value = F.array_max(row_scores)
    peak = F.array_position(row_scores, peak_value) - 1
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (peak_value - base) / (base * 6.0)))
    low, high = F.rint(height * min_ratio), F.rint(height * max_ratio)
    tall = F.when(high < low, low).otherwise(
        F.greatest(low, F.least(high, F.rint(height * margin_ratio * 2.0))))
    top = F.greatest(F.lit(0.0), F.rint(peak / scale) - F.floor(tall / 2.0))
    bottom = F.least(height.cast("double"), top + tall)
    return F.struct(
        F.lit(0.0).alias("x_min"), F.greatest(F.lit(0.0), bottom - tall).alias("y_min"),
        width.cast("double").alias("x_max"), bottom.alias("y_max"), score.alias("score"))
