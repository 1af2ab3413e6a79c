"""Small writers, provider helpers and debug tables."""

import os

from pyspark.sql import functions as F

from tagweave.functions.quality import colour_candidate_confidence
from tagweave.operators import voting
from tagweave.plans import providers, recognition
from tagweave.schema import VOTED_COLUMNS
from tagweave.sources import writers


def test_colour_confidence(spark):
    rows = spark.createDataFrame([(0.1,), (0.18,), (0.9,)], "fill double")
    assert [r[0] for r in rows.select(F.round(colour_candidate_confidence(F.col("fill")), 6)).collect()] == [None, 0.349, 0.68]


def test_steps(spark):
    rows = spark.createDataFrame([(" a ",), ("b",)], "v string")
    column = providers.run_steps(F.col("v"), [F.trim, F.upper])
    assert [r[0] for r in rows.select(column).collect()] == ["A", "B"]
    table = providers.run_table_steps(rows, [lambda d: d.filter("v <> 'b'"), lambda d: d.withColumn("n", F.length("v"))])
    assert [tuple(r) for r in table.collect()] == [(" a ", 3)]


def test_admitted_votes(spark):
    rows = spark.createDataFrame([
        (1, "product_name", " Вино ", True, 1.7), (2, "barcode", "12", True, 0.5), (3, "barcode", "46000001", True, 0.5),
        (4, "barcode", "нет", True, 0.9), (5, "product_name", "", True, 0.5), (6, "barcode", "4670025474665", False, 0.5)],
        "seq int, field string, value string, validator_passed boolean, confidence double")
    got = {r.seq: (r.value, r.validator_passed, r.confidence) for r in voting.admit(rows).collect()}
    # Clamped, broken codes out, absent ones at a twentieth, empty ones out, a failed check keeps a strict field out.
    assert got == {1: ("Вино", True, 1.0), 3: ("46000001", True, 0.5), 4: ("нет", True, 0.05)}


def test_report_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x")], "n int, s string")
    writers.write_report(rows, str(tmp_path / "report"))
    writers.write_manifest(rows, str(tmp_path / "manifest"))
    writers.write_nested(rows.select(F.struct("n", "s").alias("o")), str(tmp_path / "nested"))
    assert spark.read.json(str(tmp_path / "report")).collect() == [(1, "x")]
    assert spark.read.option("header", True).csv(str(tmp_path / "manifest")).collect() == [("1", "x")]
    assert spark.read.json(str(tmp_path / "nested")).select("o.n", "o.s").collect() == [(1, "x")]
    assert len([p for p in os.listdir(tmp_path / "report") if p.startswith("part-")]) == 1


def test_label_files(spark, tmp_path):
    rows = spark.createDataFrame([("d", "f1", 2, "b"), ("d", "f1", 1, "a"), ("d", "f2", 1, "c")], "folder string, file string, line_no int, line string")
    writers.write_label_tree(rows, str(tmp_path / "tree"), "folder", file="file")
    for name, want in (("f1", ["a", "b"]), ("f2", ["c"])):
        parts = [p for p in os.listdir(tmp_path / f"tree/folder=d/file={name}") if p.startswith("part-")]
        assert len(parts) == 1
        assert [r.value for r in spark.read.text(str(tmp_path / f"tree/folder=d/file={name}")).collect()] == want
    writers.write_label_lines(rows.selectExpr("'train' AS split", "file AS image", "line_no", "line"), str(tmp_path / "set"), class_names=["price_tag"])
    assert spark.read.option("header", True).csv(str(tmp_path / "set.classes")).collect() == [("0", "price_tag")]
    assert spark.read.parquet(str(tmp_path / "set")).count() == 3


def test_debug_tracks_and_output_order(spark):
    fields = ["product_name", "barcode"]
    rows = [(1, 0, 1, n, 2.0, "yolo", 0.9, name, code) for n, (name, code) in enumerate([("Вино", "46000001"), ("Вино", ""), ("Сок", "46000001")])]
    kinds = "video_id int, part bigint, track_no bigint, seq bigint, score double, source string, confidence double, product_name string, barcode string"
    seen = spark.createDataFrame(rows, kinds).withColumns({c: F.lit("") for c in VOTED_COLUMNS if c not in fields})
    seen = seen.withColumns({"frame_order": F.col("seq"), "ts_ms": F.col("seq") * 40, "sharpness": F.lit(50.0), "track_id": F.lit(7).cast("bigint"),
                             **{c: F.lit(1.0) for c in ("x_min", "y_min", "x_max", "y_max")}})
    found = recognition.debug_tracks(seen, ["video_id", "part", "track_no"]).first()
    assert found.fields["product_name"].winner == "Вино" and found.fields["product_name"].candidate_count == 3
    assert found.fields["barcode"].top_values == ["46000001:2"]
    records = spark.createDataFrame([(2, 0, 1.0, 1.0), (1, 80, 1.0, 1.0), (1, 40, 9.0, 1.0), (1, 40, 1.0, 5.0), (1, 40, 1.0, 2.0)],
                                    "video_id int, best_ts bigint, best_y double, best_x double")
    assert [tuple(r) for r in recognition.output_order(records).collect()] == [
        (1, 40, 1.0, 2.0), (1, 40, 1.0, 5.0), (1, 40, 9.0, 1.0), (1, 80, 1.0, 1.0), (2, 0, 1.0, 1.0)]
