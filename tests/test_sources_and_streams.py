"""Files in and out, user readers, streams against batch, and plan shape."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tagweave.operators import fingerprints, labels as lb, tracking
from tagweave.plans import providers, recognition
from tagweave.queries import oracle_sql, queries, streams
from tagweave.queries.inputs import load
from tagweave.schema import RECORD_COLUMNS
from tagweave.sources import label_files, readers, writers
from tagweave.streaming import runs, stateful, tracks

SMALL = "/root/testdata/sf0.001"


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_record_csv_round_trip_with_mark(spark, tmp_path):
    put(str(tmp_path / "in" / "a.csv"), "\ufefffilename,product_name,price_default,wholesale_level_1_coun,extra\nv.mp4,\"Сок, \"\"А\"\" 1л\",\"252,63\",3.0,x\n")
    rows = readers.read_records_csv(spark, str(tmp_path / "in"))
    first = rows.first()
    assert (first.filename, first.product_name, first.price_default, first.wholesale_level_1_count) == ("v.mp4", 'Сок, "А" 1л', "252,63", "3")
    writers.write_records_csv(rows, str(tmp_path / "out"), files=1)
    part = next(p for p in os.listdir(tmp_path / "out") if p.endswith(".csv"))
    text = open(tmp_path / "out" / part, encoding="utf-8").read()
    assert text.startswith("\ufefffilename,product_name")
    assert readers.read_records_csv(spark, str(tmp_path / "out")).collect() == rows.collect()


def test_mixed_headers_report(spark, tmp_path):
    put(str(tmp_path / "a" / "a.csv"), "Timestamp,x1,y1,x2,y2\n0,1,2,3,4\n")
    put(str(tmp_path / "b" / "b.csv"), "frame_timestamp,left\n0,1\n")
    rows, report = readers.read_detection_csvs(spark, str(tmp_path / "*"))
    assert [r.x_min for r in rows.collect()] == ["1"]
    assert {os.path.basename(r.file): r.used for r in report.collect()} == {"a.csv": True, "b.csv": False}


def test_listings_and_pairs(spark, tmp_path):
    put(str(tmp_path / "s1" / "s1.csv"), "a\n1\n2\n")
    put(str(tmp_path / "s1" / "s1.mp4"), "x")
    put(str(tmp_path / "s1" / "big.mp4"), "xxxx")
    put(str(tmp_path / "s2" / "l.csv"), "a\n1\n")
    put(str(tmp_path / "s2" / "big.mp4"), "xxxx")
    put(str(tmp_path / "s2" / "c.mp4"), "x")
    put(str(tmp_path / "s3" / "z.csv"), "a\n")
    put(str(tmp_path / "s3" / "only.avi"), "x")
    name = lambda p: os.path.basename(p)
    assert {r.folder: name(r.video_path) for r in readers.discover_sequences(spark, str(tmp_path)).collect()} == {"s1": "s1.mp4", "s2": "big.mp4"}
    pairs = readers.pair_by_candidates(readers.list_files(spark, str(tmp_path))).collect()
    assert {name(r.csv_path): name(r.video_path) for r in pairs} == {"s1.csv": "s1.mp4", "z.csv": "only.avi"}
    sets = {r.folder: (name(r.video), r.has_labels, r.n_labels) for r in readers.list_datasets(spark, str(tmp_path)).collect()}
    assert sets == {"s1": ("big.mp4", True, 2), "s2": ("big.mp4", True, 1)}
    assert [r.name for r in readers.list_videos(spark, str(tmp_path / "s1")).orderBy("video_no").collect()] == ["big.mp4", "s1.mp4"]


def test_annotation_export_and_labels(spark, tmp_path):
    root = str(tmp_path / "obj_train_data")
    put(f"{root}/a.jpg", "i")
    put(f"{root}/b.PNG", "i")
    put(f"{root}/a.txt", "0 0.5 0.5 0.1 0.1\n\nbad\n0 0.5 0.5 0 0.1")
    put(str(tmp_path / "classes.txt"), "x\n")
    put(str(tmp_path / "obj.names"), "tag\n\n code \n")
    pairs = {os.path.basename(r.image_path): r.has_label for r in readers.collect_annotation_export(spark, str(tmp_path)).collect()}
    assert pairs == {"a.jpg": True, "b.PNG": False}
    assert [tuple(r) for r in readers.read_class_names(spark, str(tmp_path)).orderBy("class_id").collect()] == [(0, "tag"), (1, "code")]
    parsed = lb.parse_label_lines(readers.read_label_files(spark, root)).orderBy("line_no").collect()
    assert [(r.line_no, r.is_box, r.warning) for r in parsed] == [
        (1, True, None), (3, False, "expected 5 values, got 1"), (4, False, "non-positive box size")]
    assert [r.name for r in readers.list_images(spark, root).collect()] == ["a.jpg", "b.PNG"]


def test_run_files_and_trees(spark, tmp_path):
    rows = spark.createDataFrame([("v", "a", "0.5", "7", "u")], "filename string, product_name string, _quality string, _track_id string, _crop_url string")
    writers.write_run_files(rows, str(tmp_path / "run"))
    assert spark.read.option("header", True).csv(str(tmp_path / "run/output.csv")).columns == ["filename", "product_name", "_quality", "_track_id"]
    assert "_crop_url" in spark.read.json(str(tmp_path / "run/debug.json")).columns
    full = rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in RECORD_COLUMNS], "_quality", "_track_id")
    for first in (True, False):
        writers.append_results(full, str(tmp_path / "res"), first=first)
    assert spark.read.option("header", True).csv(str(tmp_path / "res")).count() == 2
    lines = spark.createDataFrame([("d1", 2, "b"), ("d1", 1, "a")], "folder string, line_no int, line string")
    writers.write_label_tree(lines, str(tmp_path / "tree"), "folder")
    assert [r.value for r in spark.read.text(str(tmp_path / "tree/folder=d1")).collect()] == ["a", "b"]


def test_label_files_by_name(spark, tmp_path):
    root = str(tmp_path / "out")
    tree = lambda: {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f)).read() for d, _, fs in os.walk(root) for f in fs if not f.endswith(".crc")}
    kinds = "file string, line_no int, line string, other int"
    rows = [(f"{k % 3}/deep {k}.txt", n, f"{k} {n} é", 1) for k in range(9) for n in range(5)] + [("none.txt", 0, None, 1)]
    want = {f"{k % 3}/deep {k}.txt": "".join(f"{k} {n} é\n" for n in range(5)) for k in range(9)} | {"none.txt": ""}
    label_files.write_label_files(spark.createDataFrame(rows[::-1], kinds), root, "file", ["line_no"])
    assert tree() == want
    put(f"{root}/notes.md", "kept")
    for bad in ("../outside.txt", "/abs.txt", "."):
        broken = spark.createDataFrame([("new.txt", 0, "x", 1), (bad, 0, "y", 1)], kinds)
        with pytest.raises(Exception):
            label_files.write_label_files(broken, root, "file", ["line_no"])
        assert tree() == want | {"notes.md": "kept"} and not [d for d in os.listdir(root) if d.startswith(".writing")]
    label_files.write_label_files(spark.createDataFrame([("0/deep 0.txt", 0, "a", 1)], kinds), f"file:{root}", "file", ["line_no"], mode="append")
    assert tree() == want | {"notes.md": "kept", "0/deep 0.txt": "a\n"}
    label_files.write_label_files(spark.createDataFrame([("b.txt", 0, "b", 1)], kinds), f"file://{root}", "file", ["line_no"])
    assert tree() == {"notes.md": "kept", "b.txt": "b\n"}


def test_user_reader_isolates_faults(spark):
    class Reader:
        def load(self):
            self.ready = True

        def extract_fields(self, row):
            assert self.ready
            if row["id"] == 2:
                raise ValueError("unreadable")
            return {"barcode": str(row["id"] * 10), "product_name": None}

    out = providers.read_fields(spark.range(1, 4), ["id"], Reader, ["barcode", "product_name"]).orderBy("id").collect()
    assert [tuple(r) for r in out] == [(1, "10", "", ""), (2, "", "", "ValueError: unreadable"), (3, "30", "", "")]
    zones = providers.find_regions(spark.range(1, 3), ["id"], lambda: lambda row: {"qr": (0.0, 0.0, 1.0, 1.0), "none": None})
    assert zones.filter("zone = 'qr'").count() == 2 and zones.count() == 2


def test_stream_of_tracks_equals_batch(spark):
    ob = load(spark, SMALL, "observations").withColumn("track_id", F.when(F.col("seq") % 3 == 0, F.col("track_no") % 20)).drop("track_no")
    live = spark.read.parquet(runs.replay(ob, "seq", tracks.stream_tracks, slices=3)).collect()
    batch = {r.seq: (r.video_id, r.part, r.track_no) for r in tracking.assign_tracks(ob, "video_id", "seq").collect()}
    pairs = {((r.video_id, r.track_no), batch[r.seq]) for r in live}
    assert len(live) == len(batch) and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


SIGHTING = ("seq bigint, video_id bigint, frame_order bigint, track_id bigint, score double, x_min double, y_min double, "
            "x_max double, y_max double, is_late boolean")


def sighting(seq, video, frame, track):
    x = track * 10_000.0
    return (seq, video, frame, track, 0.9, x, 0.0, x + 10, 10.0, False)


def state_of(spark, folder, name, operator=0):
    """Rows of one kind of state after the last batch of a replay that wrote to ``folder``."""
    reader = spark.read.format("statestore").option("path", f"{os.path.dirname(folder)}/state")
    return reader.option("operatorId", operator).option("stateVarName", name).load().collect()


def timed(rows):
    return rows.withColumn("seen_at", F.timestamp_seconds(F.col("frame_order") * 10 + 1_000_000))


def test_eviction_on_both_sides_of_the_limit(spark):
    rows = timed(spark.createDataFrame([
        sighting(0, 1, 0, 7), sighting(1, 2, 1, 7), sighting(2, 1, 100, 7), sighting(3, 2, 102, 7), sighting(4, 3, 150, 9),
        sighting(5, 3, 400, 9), sighting(6, 3, 401, 9)], SIGHTING))
    for after, forgotten in ((1000.0, True), (None, False)):
        folder = runs.replay(rows, "seq", lambda s: tracks.stream_tracks(s, time="seen_at", forget_after=after), slices=3)
        number = {r.seq: r.track_no for r in spark.read.parquet(folder).collect()}
        assert number[2] == number[0] and (number[3] != number[1]) == forgotten and (number[5] != number[4]) == forgotten
        # No row of videos 1 and 2 came after their limits, yet timers took their tags and ids away.
        for kind in ("near", "far", "ids", "due"):
            assert {r.key.video_id for r in state_of(spark, folder, kind)} <= ({3} if forgotten else {1, 2, 3})
        assert {r.key.video_id for r in state_of(spark, folder, "ids")} == ({3} if forgotten else {1, 2, 3})
    with pytest.raises(ValueError):
        tracks.stream_tracks(rows, forget_after=1.0)


def test_state_written_follows_the_rows_of_a_batch(spark):
    """500 tags are known; a batch of three rows writes few entries."""
    rows = spark.createDataFrame([sighting(i, 1, i * 10, i) for i in range(500)] + [
        sighting(500, 1, 5000, 3), sighting(501, 1, 5001, 9), sighting(502, 1, 5002, 7000)], SIGHTING)
    written = []

    def run(stream, folder):
        runs.keyed_state(spark)
        done = (stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
                .trigger(availableNow=True).start())
        done.awaitTermination()
        written.append(sum(p["stateOperators"][0]["numRowsUpdated"] for p in done.recentProgress))

    folder = runs.replay(rows.withColumn("slice", F.when(F.col("seq") < 500, 0).otherwise(1)), "slice", tracks.stream_tracks, run, 2)
    number = {r.seq: r.track_no for r in spark.read.parquet(folder).collect()}
    assert number[500] == number[3] and number[501] == number[9] and number[502] == 501
    assert written[0] >= 500 and written[1] <= 10


def test_late_reads_meet_the_tags_of_their_video(spark):
    """Chained bank and tracker against the batch walk with late rows, on tags linked by id, evidence and place."""
    ob = load(spark, SMALL, "observations").filter("seq < 600").withColumn(
        "track_id", F.when(F.col("seq") % 3 == 0, F.col("track_no") % 20)).drop("track_no", "seen_at")
    ob = ob.withColumn("seen_at", F.timestamp_seconds(F.col("frame_order") + 1_000_000))
    last = ob.limit(1).withColumns({"seq": F.lit(9999).cast("bigint"), "video_id": F.lit(99).cast("bigint"),
                                    "frame_order": F.lit(9999).cast("bigint"), "seen_at": F.timestamp_seconds(F.lit(1_009_999))})
    folder = runs.replay(ob.unionByName(last).repartition(3), "seq", lambda s: tracks.stream_tracks_with_late_reads(s, "seen_at", 2000.0), slices=3)
    live = {(r.seq, r.late_no): (r.video_id, r.track_no) for r in spark.read.parquet(folder).collect() if r.video_id != 99}
    banks = {}
    for r in sorted(ob.collect(), key=lambda r: (-r.score, r.seq)):
        banks.setdefault((r.video_id, "" if r.track_id is None else str(r.track_id)), []).append(r.seq)
    reads = {}
    for (video, _track), seqs in sorted(banks.items()):
        for seq in seqs[:5]:
            reads[seq] = sum(k[0] == video for k in reads.values()) + 1, video
            reads[seq] = (video, reads[seq][0])
    assert {k for k in live if k[1]} == {(seq, no) for seq, (_v, no) in reads.items()}
    order = spark.createDataFrame([(seq, 100_000 + no) for seq, (_v, no) in reads.items()], "seq bigint, late_seq bigint")
    late = ob.join(order, "seq").withColumn("seq", F.col("late_seq")).drop("late_seq").withColumn("is_late", F.lit(True))
    both = ob.withColumn("is_late", F.lit(False)).unionByName(late)
    batch = {(r.video_id, r.seq): (r.part, r.track_no) for r in tracking.assign_tracks(both, "video_id", "seq", late="is_late").collect()}
    assert len(live) == len(batch)
    pairs = {(tag, (tag[0], *batch[tag[0], seq if not no else 100_000 + no])) for (seq, no), tag in live.items()}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    # The recordings have ended: nothing of their tags is left but how many there were.
    for kind in ("near", "far", "ids"):
        assert {r.key.video_id for r in state_of(spark, folder, kind, 0)} <= {99}


def test_a_video_that_goes_on_after_its_end(spark):
    rows = timed(spark.createDataFrame([
        sighting(0, 1, 0, 7), sighting(1, 1, 1, 7), sighting(2, 1, 300, 7), sighting(3, 1, 301, 8), sighting(4, 2, 900, 7)], SIGHTING))
    for slices in (1, 5):
        folder = runs.replay(rows, "seq", lambda s: tracks.stream_tracks_with_late_reads(s, "seen_at", 1000.0, reads=1), slices=slices)
        got = sorted((r.video_id, r.seq, r.late_no, r.track_no) for r in spark.read.parquet(folder).collect())
        assert got == [(1, 0, 0, 1), (1, 0, 1, 1), (1, 1, 0, 1), (1, 2, 0, 2), (1, 2, 1, 2), (1, 3, 0, 3), (1, 3, 2, 3), (2, 4, 0, 1)]


@pytest.mark.parametrize("name", ["r1_tracks_by_id", "r5_late_reads"])
def test_queries_by_id_keep_every_id(spark, monkeypatch, name):
    rows = spark.createDataFrame([sighting(0, 1, 0, 7), sighting(1, 1, 50, 8), sighting(2, 1, 150_000, 8),
                                  sighting(3, 1, 150_001, 7)], SIGHTING)
    monkeypatch.setattr(streams, "far_observations", lambda spark, sf: rows)
    assert {r.seq: r.first_seq for r in queries()[name](spark, "").collect()} == {0: 0, 1: 1, 2: 1, 3: 0}


def test_stream_gate_equals_batch(spark):
    distance = 2
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(30)]
    rows = []
    for i in range(240):
        bits = rng.choice(base)
        for _ in range(rng.randrange(4)):
            bits ^= 1 << rng.randrange(64)
        rows.append((i % 2, i, None if i % 40 == 0 else bits - (1 << 64) if bits >> 63 else bits, rng.randrange(10) / 10))
    df = spark.createDataFrame(rows, "k int, i bigint, h bigint, s double")
    live = spark.read.parquet(runs.replay(df, "i", lambda x: stateful.stream_gate(x, ["k"], "i", "h", "s", distance), slices=2))
    want = fingerprints.gate_crops(df, ["k"], "i", "h", "s", distance)
    assert sorted((r.k, r.i) for r in live.collect()) == sorted((r.k, r.i) for r in want.collect())


def test_modes():
    assert recognition.Mode.named("cpu_safe") == recognition.Mode(replies=False, text=True)
    assert recognition.Mode.named("full", False) == recognition.Mode(replies=True, text=False)


def test_filters_and_columns_reach_the_scan(spark):
    df = queries()["p10_min_detections"](spark, SMALL)
    plan = df._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "l_extendedprice" not in scan.split("ReadSchema")[1]


def test_registry_is_complete():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 130
    assert json.dumps(sorted(queries()))


def test_many_layouts_and_quoted_breaks(spark, tmp_path):
    folder = tmp_path / "layouts"
    folder.mkdir()
    names = ["filename", "frame_timestamp", "x_min", "y_min", "x_max", "y_max"]
    for i in range(30):
        head = names[i % 6:] + names[:i % 6] + [f"extra_{i}"]
        values = {n: f"{n}{i}" for n in names} | {f"extra_{i}": '"two\nlines, and ""quotes"""'}
        (folder / f"{i}.csv").write_text("﻿" * (i % 2) + ",".join(head) + "\n" + ",".join(values[h] for h in head) + "\n", encoding="utf-8")
    (folder / "other.csv").write_text("a,b\n1,2\n")
    rows, report = readers.read_detection_csvs(spark, str(folder))
    assert report.filter("used").count() == 30 and report.count() == 31
    got = {r.filename: r for r in rows.collect()}
    assert len(got) == 30
    for i in range(30):
        row = got[f"filename{i}"]
        assert [row[n] for n in names] == [f"{n}{i}" for n in names] and row[f"extra_{i}"] == 'two\nlines, and "quotes"'
        assert row[f"extra_{(i + 1) % 30}"] is None
