"""User-supplied readers over tables: batching, one load per worker, faults as a column."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any, Protocol

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tagweave.schema import BOX_COLUMNS

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class FieldReader(Protocol):
    """Reads fields of one crop. ``load`` runs once per task before the first row."""

    def load(self) -> None: ...

    def extract_fields(self, row: dict[str, Any]) -> dict[str, str]: ...


def read_fields(crops: DataFrame, keys: list[str], make_reader: Callable[[], FieldReader],
                fields: list[str]) -> DataFrame:
    """Fields of every crop by a user's reader; a failing crop gets empty fields and its error."""
    kinds = {f.name: f.dataType.simpleString() for f in crops.schema.fields}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make_reader()
        reader.load()
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    found, error = reader.extract_fields(row) or {}, ""
                except Exception as exc:  # noqa: BLE001 - a bad crop must not end the job
                    found, error = {}, f"{type(exc).__name__}: {exc}"
                out.append([row[k] for k in keys] + [str(found.get(f) or "") for f in fields] + [error])
            yield pd.DataFrame(out, columns=[*keys, *fields, "error"])

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], *[f"{f} string" for f in fields], "error string"])
    return crops.mapInPandas(read, schema)


def find_regions(crops: DataFrame, keys: list[str],
                 make_finder: Callable[[], Callable[[dict[str, Any]], dict[str, tuple]]]) -> DataFrame:
    """Named regions of every crop by a user's finder, one row per region found."""
    kinds = {f.name: f.dataType.simpleString() for f in crops.schema.fields}

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = make_finder()
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    regions, error = finder(row), ""
                except Exception as exc:  # noqa: BLE001
                    regions, error = {"": (None,) * 4}, f"{type(exc).__name__}: {exc}"
                out += [[*(row[k] for k in keys), name, *box, error] for name, box in regions.items() if box is not None]
            yield pd.DataFrame(out, columns=[*keys, "zone", *BOX_COLUMNS, "error"])

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "zone string", *[f"{c} double" for c in BOX_COLUMNS], "error string"])
    return crops.mapInPandas(find, schema)


def run_steps(column: Column, steps: list[Callable[[Column], Column]]) -> Column:
    """Apply a list of named column steps in order."""
    return reduce(lambda value, step: step(value), steps, column)


def run_table_steps(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    return reduce(lambda table, step: table.transform(step), steps, df)


def first_readings(fields: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """How many crops were read, failed, and had each field filled."""
    return fields.agg(F.count("*").alias("crops"), F.count_if(F.col("error") != "").alias("failed"),
                      *[F.count_if(F.col(n) != "").alias(n) for n in names])
