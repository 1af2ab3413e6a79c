"""Lines are shuffled once and as they are; run files are compressed."""

import os

from tagweave.operators import evidence as ev
from tagweave.sources import writers


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_best_crop_rules_shuffle_the_lines_once(spark):
    # Beside such a word the joined text gives no price, a pair of lines by itself does.
    rows = [("a", 0, "код", 0.9, "x"), ("a", 1, "125", 0.9, "x"), ("a", 2, "  ", 0.9, "x"), ("a", 3, "50", 0.9, "x"), ("a", 4, "50", 0.5, "x"),
            ("b", 2000, "99", 0.9, "x"), ("b", 9, "17", 0.9, "x"), (None, 0, "код", 0.9, "x"), (None, 1, "125", 0.9, "x"), (None, 2, "50", 0.9, "x"),
            ("c", 3, "код", 0.9, "x"), ("c", None, "125", 0.9, "x"), ("c", 2, "50", 0.9, "x")]
    lines = spark.createDataFrame(rows, "crop_id string, line_no int, text string, confidence double, zone string")
    for together in (True, False):
        best = ev.extract_best_crop(ev.distinct_words(lines, ["crop_id"], together=together), None, ["crop_id"])
        assert plan_of(best).count("Exchange") == 2 - together
        assert {r.crop_id: r.price_default for r in best.collect()} == {"a": "125.50", "b": "17.99", None: "", "c": ""}


def test_distinct_lines_keep_columns_and_shuffle_rows_as_they_are(spark):
    rows = [("a", 3, "Сок", 0.5, "x"), ("a", 1, " сок ", 0.9, "y"), ("a", 2, "СОК", 0.9, "z"), ("a", 4, None, 0.9, "z"), ("a", 5, "", 0.1, "z")]
    lines = spark.createDataFrame(rows, "crop_id string, line_no int, text string, confidence double, zone string")
    for together in (True, False):
        found = ev.distinct_lines(lines, ["crop_id"], together=together)
        assert "Aggregate" not in plan_of(found).split("Exchange", 1)[1]
        assert found.columns == lines.columns and sorted(map(tuple, found.collect())) == [("a", 1, " сок ", 0.9, "y"), ("a", 5, "", 0.1, "z")]


def test_run_files_are_compressed(spark, tmp_path):
    rows = spark.createDataFrame([("v", "a", "u")], "filename string, product_name string, _crop_url string")
    writers.write_run_files(rows, str(tmp_path))
    for name in ("output.csv", "debug.json"):
        parts = [p for p in os.listdir(tmp_path / name) if p.startswith("part-")]
        assert parts and all(p.endswith(".gz") for p in parts)
    assert spark.read.schema(rows.schema).json(str(tmp_path / "debug.json")).collect() == rows.collect()
