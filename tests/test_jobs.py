"""The recognition jobs on a small scene, expected records worked by hand.

One video of four frames. Tag 1 is seen in crops a, b and d (d is blurred), tag 2 in crop c, crop e has no track.
"""

import pytest
from pyspark.sql import functions as F

from tagweave.operators import evidence as ev, payloads as pl
from tagweave.plans import recognition as jobs

BOX = "x_min double, y_min double, x_max double, y_max double"
WINE = {"product_name": "Вино красное Массандра", "barcode": "4670025474665", "discount_amount": "-48%", "price_discount": "нет"}


@pytest.fixture(scope="module")
def scene(spark):
    frames = spark.createDataFrame(
        [(1, i, i * 40, 25.0, 160, 120, 80.0) for i in range(4)],
        "video_id int, frame_index bigint, ts_ms bigint, fps double, width int, height int, sharpness double")
    boxes = spark.createDataFrame([
        ("a", 1, 0, 0, 10.0, 10.0, 50.0, 40.0, 0.9, "yolo", "price_tag", 1, 400.0, 1.0, 0.5, 80.0, None),
        ("b", 1, 1, 40, 12.0, 10.0, 52.0, 40.0, 0.9, "yolo", "price_tag", 1, 2000.0, 1.0, 0.9, 80.0, None),
        ("c", 1, 2, 80, 90.0, 60.0, 130.0, 100.0, 0.8, "yolo", "red", 2, 2000.0, 1.0, 0.9, 80.0, None),
        ("d", 1, 3, 120, 14.0, 10.0, 54.0, 40.0, 0.9, "yolo", "price_tag", 1, 1.0, 9.0, 0.0, 80.0, None),
        ("e", 1, 3, 120, 60.0, 10.0, 99.0, 40.0, 0.9, "yolo", "price_tag", None, 2000.0, 1.0, 0.9, 80.0, None)],
        f"crop_id string, video_id int, frame_index bigint, ts_ms bigint, {BOX}, confidence double, source string, label string, "
        "track_id bigint, laplacian double, block_artifact double, high_frequency double, sharpness double, phash bigint")
    texts = {"a": ["Не то"], "b": ["Вино красное Массандра", "252,63", "129 99", "4670025474665", "-48 %"], "c": ["Сок яблочный", "99.50"]}
    lines = spark.createDataFrame(
        [(c, n, 0.9, "full", "paddleocr", (n + 1) / 10, text) for c, rows in texts.items() for n, text in enumerate(rows)],
        "crop_id string, line_no int, confidence double, zone string, source string, y_rel double, text string")
    payloads = spark.createDataFrame([("c", 0, "b=4600000000017&p1=100.5&p4=", 1)], "crop_id string, payload_no int, raw string, in_region int")
    replies = spark.createDataFrame([("c", '{"product_name": "Сок Добрый", "price_card": null}')], "crop_id string, raw string")
    return frames, boxes, jobs.Evidence(lines, payloads, replies, None)


def check(row, **want):
    assert {k: row[k] for k in want} == want


def test_best_crop_job(scene):
    frames, boxes, evidence = scene
    rows = {r._track_id: r for r in jobs.recognize_tracks(frames, boxes, evidence, [F.col("frame_index")]).collect()}
    assert set(rows) == {"1", "2"}
    # The sharpest crop of tag 1 is b; prices are the larger and the smaller one.
    check(rows["1"], **WINE, crop_id="b", price_default="252.63", price_card="129.99", frame_timestamp="40", x_min="12", _quality="0.800")
    # The reply names the product of tag 2, its code gives the first price.
    check(rows["2"], crop_id="c", product_name="Сок Добрый", price_default="99.50", qr_code_barcode="4600000000017", price1_qr="100.5")


def test_labelled_job(spark, scene):
    frames, boxes, evidence = scene
    labels = boxes.select("crop_id", "video_id", F.col("ts_ms").alias("frame_timestamp"), *[c.split()[0] for c in BOX.split(", ")])
    far = spark.createDataFrame([("z", 1, 99_999, 1.0, 1.0, 9.0, 9.0)], labels.schema)
    got = jobs.recognize_labeled(labels.unionByName(far), frames.select("video_id", "ts_ms", "sharpness"), boxes, evidence, reach=2)
    rows = {r.crop_id: r for r in got.collect()}
    assert set(rows) == set("abcdez")
    check(rows["a"], product_name="Не то", price_default="", weak=False, unreadable=False)
    check(rows["b"], **WINE, price_default="252.63", price_card="129.99", weak=False)
    check(rows["d"], product_name="", weak=True, unreadable=False)
    check(rows["z"], product_name="", filename="", unreadable=True)  # no frame near its time


def test_fusion_job(scene):
    frames, boxes, evidence = scene
    got = jobs.fuse_observations(frames, boxes.filter("track_id IS NOT NULL"), boxes.filter("track_id IS NULL"), evidence,
                                 [F.col("crop_id")], jobs.FusionRules(sample_fps=25.0))
    rows = {r.product_name: r for r in got.collect()}
    assert set(rows) == {"Вино красное Массандра", "Сок яблочный"}
    # The deferred read of b scores best, so it gives time and place; prices keep the comma.
    check(rows["Вино красное Массандра"], **WINE, price_default="252,63", price_card="129,99", frame_timestamp="40", x_min="12")
    # The code's price takes part and is the larger one; the discount follows from both prices.
    check(rows["Сок яблочный"], price_default="100,50", price_card="99,50", discount_amount="-1%", color="red",
          barcode="4600000000017", qr_code_barcode="4600000000017", price1_qr="100,50")


def test_fusion_job_inside_the_rail_band(spark, scene):
    frames, boxes, evidence = scene
    inside = boxes.filter("crop_id = 'c'").withColumns({"y_min": F.col("y_min") - 50, "y_max": F.col("y_max") - 50,
                                                        "roi_x": F.lit(0.0), "roi_y": F.lit(50.0)})
    got = jobs.fuse_observations(frames, boxes.filter("track_id IS NOT NULL"), None, evidence, [F.col("crop_id")],
                                 jobs.FusionRules(sample_fps=25.0), inside=inside)
    row = {r.product_name: r for r in got.collect()}["Сок яблочный"]
    check(row, y_min="60", y_max="100")  # moved back to the frame


def test_extraction(spark, scene):
    _frames, _boxes, evidence = scene
    hints = spark.createDataFrame([("b", "1", "red"), ("c", "1", "")], "crop_id string, filename string, color_hint string")
    parsed = pl.parse_payloads(pl.distinct_payloads(evidence.payloads, ["crop_id"], "payload_no"), ["crop_id", "payload_no"])
    merged = pl.merge_payload_fields(parsed, ["crop_id"], "payload_no", "first")
    fused = {r.crop_id: r for r in ev.extract_fusion(ev.distinct_lines(evidence.lines, ["crop_id"]), merged, ["crop_id"], hints).collect()}
    check(fused["b"], **WINE, price_default="252,63", price_card="129,99", color="red", filename="1")
    check(fused["c"], product_name="Сок яблочный", price_default="100,50", price_card="99,50", barcode="4600000000017")
    best = {r.crop_id: r for r in ev.extract_best_crop(ev.distinct_words(evidence.lines, ["crop_id"]), None, ["crop_id"]).collect()}
    check(best["b"], **WINE, price_default="252.63", price_card="129.99")
    check(best["c"], product_name="Сок яблочный", price_default="99.50", barcode="")


def test_large_sequence_numbers_survive_the_late_walk(spark):
    from tagweave.operators import tracking
    base = 1 << 60
    rows = [(1, 1, 0, None, 1.0, 0.0, 0.0, 40.0, 30.0, "46000001", False), (1, base + 1, 0, None, 2.0, 0.0, 0.0, 40.0, 30.0, "46000001", True),
            (1, base + 3, 0, None, 2.0, 900.0, 0.0, 940.0, 30.0, "46000001", True)]
    df = spark.createDataFrame(rows, f"video_id int, seq bigint, frame_order bigint, track_id bigint, score double, {BOX}, barcode string, is_late boolean")
    got = tracking.assign_tracks(df, "video_id", "seq", late="is_late").collect()
    assert sorted(r.seq for r in got) == [1, base + 1, base + 3] and len({(r.part, r.track_no) for r in got}) == 1


def training_tables(spark):
    labels = spark.createDataFrame(
        [(1, 1000, 1, 10.0, 10.0, 50.0, 40.0), (1, 1000, 2, 10.0, 10.0, 50.0, 40.0), (1, 1000, 3, 60.0, 10.0, 61.0, 40.0),
         (1, 5000, 4, 20.0, 20.0, 60.0, 60.0), (1, 5000, 5, 20.0, None, 60.0, 60.0), (1, 9000, 6, 0.0, 0.0, 1.0, 1.0), (2, 1000, 7, 10.0, 10.0, 50.0, 40.0)],
        f"video_id int, frame_timestamp bigint, pos bigint, {BOX}")
    frames = spark.createDataFrame([(1, t, 160, 120) for t in (1010, 4990, 9000)], "video_id int, ts_ms bigint, width int, height int")
    moved = [(1, 1000, d, s, 1, 10.0 + d * s, 10.0, 50.0 + d * s, 40.0, 0.9) for d in (-1, 1) for s in (1, 2)]
    moved += [(1, 5000, 1, 1, 4, 20.0, 20.0, 60.0, 60.0, 0.9), (1, 5000, 1, 2, 4, 20.0, 20.0, 60.0, 60.0, 0.1),  # score too low
              (1, 5000, -1, 1, 4, -90.0, 20.0, -50.0, 60.0, 0.9), (1, 5000, -1, 2, 4, 20.0, 20.0, 60.0, 60.0, 0.9)]  # out of the frame
    return labels, frames, spark.createDataFrame(
        moved, f"video_id int, frame_timestamp bigint, direction int, step int, pos bigint, {BOX}, score double")


def test_training_set(spark):
    from tagweave.plans import datasets
    lines, report = datasets.build_training_set(*training_tables(spark), "pos", 2, 50.0, val_ratio=0.5)
    # Equal lines count once; thin boxes, boxes with a missing corner and labels without a frame drop out.
    got = sorted((r.frame_timestamp, r.offset, r.pos) for r in lines.collect())
    assert got == [(1000, -2, 1), (1000, -1, 1), (1000, 0, 1), (1000, 1, 1), (1000, 2, 1), (5000, 0, 4), (5000, 1, 4)]
    assert {r.line for r in lines.filter("frame_timestamp = 1000 AND offset = 0").collect()} == {"0 0.187500 0.208333 0.250000 0.250000"}
    # Frames 0 to 6 in order of video, time and step; every second one validates.
    check(report.first(), train_images=3, val_images=4, labels=7, instances=7, base_frames=2, propagated_frames=5,
          rejected_propagations=2, empty_labels=0)


def test_training_set_with_neighbours_in_train(spark):
    from tagweave.plans import datasets
    lines, report = datasets.build_training_set(*training_tables(spark), "pos", 2, 50.0, val_ratio=0.5, neighbours="train")
    assert {(r.frame_timestamp, r.split) for r in lines.filter("offset = 0").collect()} == {(1000, "val"), (5000, "train")}
    assert {r.split for r in lines.filter("offset <> 0").collect()} == {"train"}
    check(report.first(), train_images=6, val_images=1, propagated_frames=5)
