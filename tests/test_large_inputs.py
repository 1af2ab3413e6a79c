"""What a job must not do when its tables grow: read them twice, shuffle pairs, list the same place again."""

import random

from pyspark.sql import Column, functions as F

from tagweave.operators import labels, records, spatial, timejoin, tracking, voting
from tagweave.operators.membership import maybe_among
from tagweave.plans import datasets, recognition
from tagweave.schema import BOX_COLUMNS


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_times_are_not_shuffled(spark):
    labels = spark.createDataFrame([(1, 100), (1, 100), (1, 500), (None, 100), (2, None)], "video_id int, at_ms bigint")
    frames = spark.createDataFrame([(1, 60, 5.0), (1, 140, 5.0), (1, 200, None), (1, 201, 9.0), (None, 100, 1.0), (1, 600, None)],
                                   "video_id int, ts_ms bigint, sharpness double")
    near = timejoin.frame_at(labels, frames, ["video_id"], "at_ms", "ts_ms", 100.0)
    best = timejoin.sharpest_frame(labels, frames, ["video_id"], "at_ms", "ts_ms", "sharpness", 50.0, 2)
    assert {tuple(r) for r in near.collect()} == {(1, 100, 60), (1, 500, 600)}
    assert {tuple(r) for r in best.collect()} == {(1, 100, 60, 5.0), (1, 500, 600, None)}
    for df in (near, best):
        plan = plan_of(df)
        assert "min_by(" not in plan and "max_by(" not in plan


def test_places_are_listed_once_per_id(spark, monkeypatch):
    rows = spark.createDataFrame([(1, i, i, i % 5, 0.9, i % 5 * 50_000.0, 0.0, i % 5 * 50_000.0 + 10, 10.0) for i in range(1000)],
                                 "video_id int, seq bigint, frame_order bigint, track_id bigint, score double, x_min double, "
                                 "y_min double, x_max double, y_max double")
    linked = tracking.link_values(rows).withColumn("part", F.lit(0))
    fold = linked.select("part", *tracking._fold_columns(linked, "video_id", "frame_order", "seq"))
    written, cut = [], tracking.cut_lineage
    monkeypatch.setattr(tracking, "cut_lineage", lambda df: (written.append((kept := cut(df)).count()), kept)[1])
    groups = tracking.meeting_groups(fold, tracking.TrackRules())
    assert groups.count() == 1000 and groups.select("group").distinct().count() == 5
    assert max(written) <= 5 * 9


OBSERVED = "g int, seq bigint, source string, score double, product_name string, price_default string"


def observed(spark):
    return spark.createDataFrame([(1, 1, "qr", 6.0, " a ", "5.0"), (1, 2, "", 6.0, "b", "x"), (1, 3, "regex", 6.0, "b", "7.50"),
                                  (2, 4, None, None, "нет", None), (None, 5, "qr", 1.0, "c", "")], OBSERVED)


def test_summary_of_votes_reads_once(spark):
    votes = voting.field_candidates(observed(spark), ["g"], fields=["product_name", "price_default"])
    summary = voting.vote_summary(votes, ["g"])
    assert plan_of(summary).count("Generate stack(") == 1
    got = {(r.g, r.field): (r.winner, r.candidate_count, list(r.top_values)) for r in summary.collect()}
    assert got == {(1, "product_name"): ("a", 3, ["b:2", "a:1"]), (1, "price_default"): ("5,00", 2, ["5,00:1", "7,50:1"]),
                   (2, "product_name"): ("нет", 1, ["нет:1"])}


def test_rules_stand_once_per_kind(spark):
    prices = ["price_default", "price_card", "price_discount", "price1_qr"]
    df = spark.createDataFrame([(1, "5.0", " 7,5 ", "x", None)], "k int, " + ", ".join(f"{c} string" for c in prices))
    checked = records.validate_fields(df, ["k"], prices)
    rows = {r.field: (r.value, r.normalized, r.valid) for r in checked.collect()}
    assert rows == {"price_default": ("5", "5,00", True), "price_card": ("7,5", "7,50", True), "price_discount": ("x", "", False),
                    "price1_qr": ("", "", False)}
    one = records.validate_fields(df, ["k"], prices[:1])
    assert plan_of(checked).count("regexp_") == plan_of(one).count("regexp_")


def test_overlaps_are_measured_outside_the_walk(spark):
    boxes = "g int, t bigint, " + ", ".join(f"{c} double" for c in BOX_COLUMNS)
    t = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.0, 0.0, 10.0, 9.0), (1, 3, 50.0, 0.0, 60.0, 10.0)], boxes)
    p = t.withColumnRenamed("t", "p")
    found = spatial.match_boxes(t, p, ["g"], "t", "p")
    assert {(r.t, r.p) for r in found.collect()} == {(1, 1), (2, 2), (3, 3)}
    assert "posexplode(ps" in plan_of(found)


def test_only_evidence_that_may_be_read_is_shuffled(spark):
    lines = spark.range(20_000).selectExpr("concat('c', id) AS crop_id", "id AS line_no").unionByName(
        spark.createDataFrame([(None, 1)], "crop_id string, line_no long"))
    crops = spark.range(0, 20_000, 100).selectExpr("concat('c', id) AS crop_id").unionByName(spark.createDataFrame([(None,)], "crop_id string"))
    passed = {r.line_no for r in maybe_among(lines.filter("crop_id is not null"), crops, "crop_id").collect()}
    assert set(range(0, 20_000, 100)) <= passed and len(passed) < 220
    mine = recognition.Evidence(lines).of(crops, few=True).lines
    assert "bitmap" in plan_of(mine) and mine.columns == lines.columns
    assert sorted(r.line_no for r in mine.collect()) == list(range(0, 20_000, 100))


def greedy(rows, threshold):
    """Plain walk of (order, box) rows."""
    kept = []
    for i, b in sorted(rows):
        def share(k):
            both = max(0.0, min(b[2], k[2]) - max(b[0], k[0])) * max(0.0, min(b[3], k[3]) - max(b[1], k[1]))
            return both / ((b[2] - b[0]) * (b[3] - b[1]) + (k[2] - k[0]) * (k[3] - k[1]) - both)
        if not any(share(k) > threshold for _, k in kept):
            kept.append((i, b))
    return [i for i, _ in kept]


def test_groups_are_walked_in_streams(spark):
    """Groups end anywhere in a batch, or span several; groups with few and with many rows, and those without a key."""
    rng = random.Random(3)
    groups = {g: [(i, (x := rng.randrange(12) * 1.0, y := rng.randrange(5) * 1.0, x + rng.randrange(4, 9), y + 6.0)) for i in range(n)]
              for g, n in ((1, 1), (2, 90), (3, 5), (4, 32), (5, 33), (None, 20), (7, 2))}
    rows = [(g, i, *b) for g, members in groups.items() for i, b in members]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, i int, " + ", ".join(f"{c} double" for c in BOX_COLUMNS))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "7")
        for cap in (None, 3, F.when(F.max("i") > 40, 4).otherwise(2)):
            found = spatial.suppress_overlaps(df, ["g"], [F.col("i")], 0.3, cap)
            assert "collect_list" not in plan_of(found)
            got = {g: [r.i for r in sorted(rs, key=lambda r: r.kept_rank)] for g in groups if (rs := [r for r in found.collect() if r.g == g])}
            for g, members in groups.items():
                limit = cap if not isinstance(cap, Column) else 4 if len(members) > 41 else 2
                assert got[g] == greedy(members, 0.3)[:limit]
    finally:
        spark.conf.set(name, before)


def test_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([(1, 1, " 0 0.5  0.5 0.2 0.2"), (1, 2, "0 0.5 0.5 0.2 0.2"), (1, 3, "  "), (2, 4, None), (2, 5, "x")],
                                  "image int, line_no int, line string")
    parsed = labels.parse_label_lines(lines)
    assert plan_of(parsed).count("regexp_replace(") == 1
    assert sorted((r.line_no, r.is_box, r.cx) for r in parsed.collect()) == [(1, True, 0.5), (2, True, 0.5), (5, False, None)]
    assert [r.line_no for r in labels.drop_near_equal(parsed, ["image"]).collect()] == [1]


def test_tiles_are_made_once(spark, monkeypatch):
    boxes = spark.createDataFrame([(1, 1, 10.0, 10.0, 100.0, 90.0), (1, 2, 10.0, 10.0, 100.0, 90.0), (1, 3, 500.0, 20.0, 700.0, 90.0)],
                                  "f int, pos bigint, " + ", ".join(f"{c} double" for c in BOX_COLUMNS))
    boxes = boxes.withColumns({"width": F.lit(1600), "height": F.lit(1200)})
    counted, count = [], spatial.oversized_groups
    for module in (spatial, datasets):
        monkeypatch.setattr(module, "oversized_groups", lambda df, *a: (counted.append(df), count(df, *a))[1])
    tiled = datasets.build_tiled(boxes, ["f"], "pos")
    assert len(counted) == 1 and "tile_no" not in counted[0].columns
    assert sorted((r.tile_no, r.line_no, r.line) for r in tiled.collect()) == [
        (0, 1, "0 0.085938 0.078125 0.140625 0.125000"), (0, 3, "0 0.890625 0.085938 0.218750 0.109375"),
        (1, 3, "0 0.146875 0.085938 0.293750 0.109375")]
