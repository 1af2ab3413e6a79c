"""Record tables: normal form, validation, derived fields, comparison and profiling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tagweave.functions import text as t
from tagweave.functions.quality import completeness
from tagweave.operators.ordering import settled
from tagweave.schema import (
    ABSENT, DETECTION_COLUMN_NAMES, DETECTION_REQUIRED, FILL_RATE_COLUMNS,
    FUSION_ABSENT_DEFAULTS, LEGACY_COLUMN_NAMES, QUALITY_COLUMNS, RECORD_COLUMNS, VOTED_COLUMNS,
)
from tagweave.session import small_methods


def empty_record(filename: Column | None = None, fusion: bool = True) -> list[Column]:
    """A record with nothing read yet, under either set of defaults."""
    return [
        (filename if c == "filename" and filename is not None else
         F.lit(ABSENT if fusion and c in FUSION_ABSENT_DEFAULTS else "")).alias(c)
        for c in RECORD_COLUMNS
    ]


def rename_known(df: DataFrame, aliases: dict[str, str] = LEGACY_COLUMN_NAMES,
                 lower: bool = False) -> DataFrame:
    """Trim header names and give aliased ones their standard name."""
    names = {}
    for c in df.columns:
        clean = c.strip().lstrip("\ufeff")
        names[c] = aliases.get(clean.lower() if lower else clean, clean)
    return df.withColumnsRenamed({k: v for k, v in names.items() if k != v})


def rename_detection_columns(df: DataFrame) -> DataFrame:
    return rename_known(df, DETECTION_COLUMN_NAMES, lower=True)


def has_detection_columns(columns: list[str]) -> bool:
    return set(DETECTION_REQUIRED) <= set(columns)


def normalize_records(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The 29 columns in order; unknown columns dropped, missing ones filled by default."""
    df = rename_known(df)
    defaults = dict(zip(RECORD_COLUMNS, empty_record()))
    return df.select(*(extra or []), *[
        t.normalize_value(c).alias(c) if c in df.columns else defaults[c] for c in RECORD_COLUMNS])


def validate_fields(df: DataFrame, keys: list[str], fields: list[str] | None = None) -> DataFrame:
    """Long table (keys, field, value, normalized, valid).

    Fields are stacked before any rule runs, so that the code of a task has each kind of rule once.
    """
    from tagweave.operators.voting import stack_fields
    fields = fields or VOTED_COLUMNS
    rows = stack_fields(small_methods(df).select(*keys, *fields), keys, fields, {"raw": lambda c: F.col(c).cast("string")})
    rows = settled(rows, value=t.normalize_value("raw"))
    value, by_rule = F.col("value"), lambda rule: t.by_field(F.col("field"), rule, F.col("value"), fields)
    # A missing value is its own normal form, and never valid.
    return rows.select(*keys, "field", "value", F.when(t.is_missing(value), value).otherwise(by_rule(t.normalize_field)).alias("normalized"),
                       (t.is_present(value) & by_rule(t.valid_field)).alias("valid"))


def rejection_rates(validated: DataFrame) -> DataFrame:
    """Per field: values given, valid ones and the share rejected."""
    given = t.is_present(F.col("value"))
    return (validated.groupBy("field")
            .agg(F.count_if(given).alias("given"), F.count_if(F.col("valid")).alias("valid"))
            .withColumn("rejected_share", F.when(F.col("given") > 0, F.round(
                1 - F.col("valid") / F.col("given"), 6)).otherwise(0.0)))


def discount_from_prices(default: Column, card: Column) -> Column:
    """``-n%`` from two valid prices, empty when there is no saving."""
    full, paid = t.price_value(default), t.price_value(card)
    percent = F.rint((full - paid) / full * 100).cast("bigint").cast("string")
    return F.when((full > 0) & (paid > 0) & (paid < full),
                  F.concat(F.lit("-"), percent, F.lit("%"))).otherwise("")


# Fixed values: (target, source) copies in the order they apply.
FIELD_COPIES = [
    ("qr_code_barcode", "barcode"), ("barcode", "qr_code_barcode"),
    ("price1_qr", "price_default"), ("price_default", "price1_qr"),
    ("price4_qr", "price_card"), ("price_card", "price4_qr"),
    ("action_price_qr", "price_discount"), ("price_discount", "action_price_qr"),
]


def derive_fields(df: DataFrame, copy_payload_fields: bool = False) -> DataFrame:
    """Fill fields from each other, then the discount from the two prices."""
    df = df.withColumns({c: t.normalize_value(c) for c in RECORD_COLUMNS if c in df.columns})
    if copy_payload_fields:
        for target, source in FIELD_COPIES:
            take = t.is_missing(F.col(target)) & t.is_present(F.col(source))
            df = df.withColumn(target, F.when(take, F.col(source)).otherwise(F.col(target)))
    derived = discount_from_prices(F.col("price_default"), F.col("price_card"))
    fill = t.is_missing(F.col("discount_amount")) & (derived != "")
    return df.withColumn("discount_amount",
                         F.when(fill, derived).otherwise(F.col("discount_amount")))


def fill_missing(primary: DataFrame, secondary: DataFrame, keys: list[str],
                 columns: list[str]) -> DataFrame:
    """Per key and column the primary text, or the secondary one where that is empty."""
    s = secondary.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    value = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}"), F.lit(""))
    return primary.join(s, keys, "full").select(*keys, *[value(c).alias(c) for c in columns])


def compare_records(pairs: DataFrame, keys: list[str], left: str = "t_", right: str = "p_") -> DataFrame:
    """Per matched pair the share of key fields with equal canonical text."""
    pairs = small_methods(pairs)
    equal = reduce(lambda a, b: a + b, (
        F.when(t.same_value(left + c, right + c), 1).otherwise(0) for c in QUALITY_COLUMNS))
    return pairs.select(*keys, equal.alias("equal_fields"),
                        (equal / len(QUALITY_COLUMNS)).alias("field_accuracy"))


def compare_fields(pairs: DataFrame, keys: list[str], left: str = "t_", right: str = "p_") -> DataFrame:
    """Accuracy per field over matched pairs."""
    flags = small_methods(pairs).select(*keys, *[t.same_value(left + c, right + c).alias(c) for c in QUALITY_COLUMNS])
    return (flags.unpivot(keys, QUALITY_COLUMNS, "field", "equal").groupBy("field")
            .agg(F.count("*").alias("pairs"), F.count_if("equal").alias("equal"))
            .withColumn("accuracy", F.round(F.col("equal") / F.col("pairs"), 6)))


def field_fill_rates(df: DataFrame, fields: list[str] = FILL_RATE_COLUMNS,
                     keys: list[str] | None = None) -> DataFrame:
    """Per field: filled rows, all rows and the whole percent."""
    keys = keys or []
    counts = df.groupBy(*keys).agg(
        F.count("*").alias("total"),
        *[F.count_if(t.is_present(F.coalesce(F.col(c), F.lit("")))).alias(c) for c in fields])
    return (counts.unpivot([*keys, "total"], fields, "field", "filled")
            .withColumn("percent", F.expr("100 * filled div greatest(total, 1)")))


def mean_completeness(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"),
                  F.coalesce(F.round(F.avg(completeness()), 6), F.lit(0.0)).alias("avg_completeness"))


def profile_schema(df: DataFrame) -> DataFrame:
    """One row per record column: position, defaults and fill counts."""
    filled = df.agg(*[F.count_if(t.is_present(F.coalesce(F.col(c), F.lit("")))).alias(c)
                      for c in RECORD_COLUMNS], F.count("*").alias("rows"))
    position = F.create_map(*[x for i, c in enumerate(RECORD_COLUMNS) for x in (F.lit(c), F.lit(i))])
    optional = F.col("field").isin(FUSION_ABSENT_DEFAULTS)
    return (filled.unpivot(["rows"], RECORD_COLUMNS, "field", "filled")
            .withColumn("position", position[F.col("field")]).withColumn("optional", optional))


def distinct_records(df: DataFrame, key_choices: list[list[str]], order: list[Column]) -> DataFrame:
    """One record per identity, the most complete one.

    The identity is the first choice of columns that are all present; rows without any stay.
    """
    values = [(choice, reduce(lambda a, b: a & b, (
        t.is_present(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in choice)))
        for choice in key_choices]
    identity = F.coalesce(*[
        F.when(present, F.concat_ws("\x1f", F.lit(i), *[F.col(c).cast("string") for c in choice]))
        for i, (choice, present) in enumerate(values)])
    rows = df.withColumn("_identity", identity)
    kept = (rows.filter(F.col("_identity").isNotNull()).groupBy("_identity")
            .agg(F.min_by(F.struct(*df.columns), F.struct((-completeness()).alias("n"), *order)).alias("r"))
            .select("r.*"))
    return kept.unionByName(rows.filter(F.col("_identity").isNull()).drop("_identity"))
