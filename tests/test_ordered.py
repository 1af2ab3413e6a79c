"""Order-dependent operators against brute force, on the usual path and on the path for hot groups."""

import random

import pytest
from pyspark.sql import functions as F

from tagweave.operators import components, fingerprints, ordering, spatial, timejoin, tracking
from tagweave.schema import BOX_COLUMNS

BOX = "x_min double, y_min double, x_max double, y_max double"


def iou(a, b):
    w = max(0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def boxes(rng, n, size=60, copies=0.3):
    out = []
    for _ in range(n):
        if out and rng.random() < copies:
            out.append(rng.choice(out))
            continue
        x, y = rng.uniform(-20, size), rng.uniform(0, size)
        out.append((x, y, x + rng.uniform(2, 40), y + rng.uniform(2, 40)))
    return out


@pytest.mark.parametrize("threshold,cap,small_group", [
    (0.42, None, 2048), (0.75, 7, 2048), (0.92, None, 2048), (0.42, None, 10), (0.75, 7, 10)])
def test_suppression(spark, threshold, cap, small_group):
    rng = random.Random(5)
    rows = [(g, i, rng.randrange(10) / 10, *b) for g, n in (("a", 60), ("b", 6)) for i, b in enumerate(boxes(rng, n))]
    want = {}
    for g in ("a", "b"):
        kept = []
        for row in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            if not any(iou(row[3:], k[3:]) > threshold for k in kept):
                kept.append(row)
        want[g] = [k[1] for k in kept][:cap]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"g string, i int, c double, {BOX}")
    kept = spatial.suppress_overlaps(df, ["g"], [-F.col("c"), F.col("i")], threshold, cap, small_group).collect()
    got = {g: [r.i for r in sorted((k for k in kept if k.g == g), key=lambda r: r.kept_rank)] for g in want}
    assert got == want


@pytest.mark.parametrize("small_group", [2048, 10])
def test_matching(spark, small_group):
    rng = random.Random(7)
    truth = [(g, i, *b) for g, n in (("a", 40), ("b", 4)) for i, b in enumerate(boxes(rng, n))]
    pred = [(g, i, *[v + rng.choice([0, 0, 1, 3]) for v in t[2:4]], *t[4:]) for g in ("a", "b")
            for i, t in enumerate(t for t in truth if t[0] == g for _ in range(rng.choice([0, 1, 2])))]
    want = set()
    for g in ("a", "b"):
        used = set()
        for row in (r for r in truth if r[0] == g):
            best = max(((iou(row[2:], p[2:]), -p[1]) for p in pred if p[0] == g and p[1] not in used), default=(0, 0))
            if best[0] >= 0.15:
                used.add(-best[1])
                want.add((g, row[1], -best[1]))
    t = spark.createDataFrame(truth, f"g string, t int, {BOX}")
    p = spark.createDataFrame(pred, f"g string, p int, {BOX}")
    got = spatial.match_boxes(t, p, ["g"], "t", "p", 0.15, small_group).collect()
    assert {(r.g, r.t, r.p) for r in got} == want


@pytest.mark.parametrize("long_walk", [spatial.LONG_WALK, 5])
def test_suppression_of_components(spark, monkeypatch, long_walk):
    monkeypatch.setattr(spatial, "LONG_WALK", long_walk)
    test_suppression(spark, 0.42, None, 10)
    test_suppression(spark, 0.75, 7, 10)


def test_jobs_do_not_grow_with_a_chain(spark):
    """Boxes in a row of falling confidence, each over half of the next: every second one stays."""
    jobs = []
    for n in (40, 2000):
        df = spark.range(n).selectExpr("'g' AS g", "id AS i", "id * 5.0D AS x_min", "0.0D AS y_min", "id * 5.0D + 20 AS x_max", "9.0D AS y_max")
        spark.sparkContext.setJobGroup(f"chain{n}", "")
        kept = spatial.suppress_overlaps(df, ["g"], [F.col("i")], 0.42, None, 10).select("i", "kept_rank").collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain{n}")))
        assert sorted((r.i, r.kept_rank) for r in kept) == [(2 * k, k + 1) for k in range(n // 2)]
    assert jobs[1] <= 1.5 * jobs[0], jobs


ODD_BOXES = [  # zero area twice, missing corners twice, an ordinary box twice, one that lies in a large one
    (5.0, 5.0, 5.0, 9.0), (5.0, 5.0, 5.0, 9.0), (1.0, None, 9.0, 9.0), (1.0, None, 9.0, 9.0), (0.0, 0.0, 8.0, 8.0), (0.0, 0.0, 8.0, 8.0),
    (1.0, 1.0, 3.0, 3.0), (100.0, 0.0, 160.0, 60.0), (110.0, 10.0, 112.0, 12.0)]


@pytest.mark.parametrize("threshold, kept", [(0.5, [0, 1, 2, 3, 4, 6, 7, 8]), (0.03, [0, 1, 2, 3, 4, 7, 8]), (0.0, [0, 1, 2, 3, 4, 7])])
@pytest.mark.parametrize("small_group", [2048, 1])
def test_odd_boxes_on_both_paths(spark, threshold, kept, small_group):
    df = spark.createDataFrame([("g", i, *b) for i, b in enumerate(ODD_BOXES)], f"g string, i int, {BOX}")
    got = spatial.suppress_overlaps(df, ["g"], [F.col("i")], threshold, None, small_group).orderBy("kept_rank").collect()
    assert [r.i for r in got] == kept and [r.kept_rank for r in got] == list(range(1, len(kept) + 1))


@pytest.mark.parametrize("small_group", [2048, 1])
def test_matching_rows_that_repeat_their_order(spark, small_group):
    near, far = (0.0, 0.0, 10.0, 10.0), (50.0, 0.0, 60.0, 10.0)
    truth = spark.createDataFrame([("g", 1, *near), ("g", 1, *far), ("g", 1, *near), ("g", 2, 0.0, None, 10.0, 10.0), ("g", 3, 5.0, 5.0, 5.0, 5.0)],
                                  f"g string, t int, {BOX}")
    pred = spark.createDataFrame([("g", 7, *near), ("g", 7, *far), ("g", 8, *near), ("g", 9, 5.0, 5.0, 5.0, 5.0)], f"g string, p int, {BOX}")
    got = spatial.match_boxes(truth, pred, ["g"], "t", "p", 0.15, small_group).collect()
    assert sorted((r.t, r.p) for r in got) == [(1, 7), (1, 7), (1, 8)]


def test_a_missing_corner_makes_no_box(spark):
    df = spark.createDataFrame([(1, 10.0, 10.0, None, 30.0), (2, 10.0, 10.0, 40.0, 30.0), (3, None, None, None, None)], f"i int, {BOX}")
    assert [r.i for r in spatial.valid_boxes(df, F.lit(160), F.lit(120), swap=True).collect()] == [2]


def test_sessions_like_a_walk(spark):
    rng = random.Random(23)
    rows = [(k, p) for k in ("a", "b") for p in rng.sample(range(30_000), 900)] + [("c", p) for p in range(0, 20_000, 5)] + [("c", 90_000)] * 2
    want = {}
    for key in "abc":
        last = start = None
        for p in sorted({p for k, p in rows if k == key}):
            start = p if last is None or p - last > 40 else start
            want[key, p], last = start, p
    df = spark.createDataFrame(rows, "k string, p bigint")
    got = timejoin.gap_sessions(df, ["k"], "p", 40).collect()
    assert len(got) == len(rows) and {(r.k, r.p): r.session for r in got} == want


def test_anti_overlap_and_plan_without_cross_join(spark):
    rng = random.Random(9)
    a = [("f", i, *b) for i, b in enumerate(boxes(rng, 80, 200))]
    b = [("f", i, *b) for i, b in enumerate(boxes(rng, 80, 200))]
    left = spark.createDataFrame(a, f"f string, i int, {BOX}")
    out = spatial.without_overlap(left, spark.createDataFrame(b, f"f string, i int, {BOX}"), ["f"], 0.35)
    assert {r.i for r in out.collect()} == {r[1] for r in a if all(iou(r[2:], o[2:]) <= 0.35 for o in b)}
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def near(a, b, d):
    return ((a ^ b) & (2 ** 64 - 1)).bit_count() <= d


@pytest.mark.parametrize("small_group", [2048, 5])
def test_fingerprint_gate(spark, small_group):
    rng = random.Random(11)
    bases = [rng.getrandbits(63) for _ in range(6)]
    rows = [(k, i, rng.choice(bases) ^ sum(1 << rng.randrange(63) for _ in range(rng.choice([0, 0, 1, 2]))) if rng.random() > 0.05 else None,
             rng.randrange(20) / 20) for k in ("u", "v") for i in range(90)]
    want = set()
    for k in ("u", "v"):
        seen = {}
        for _, i, h, s in (r for r in rows if r[0] == k):
            if h is None or not any(near(h, o, 2) and v >= s for o, v in seen.items()):
                want.add((k, i))
                if h is not None:
                    seen[h] = s
    df = spark.createDataFrame(rows, "k string, i int, h bigint, s double")
    got = fingerprints.gate_crops(df, ["k"], "i", "h", "s", 2, small_group)
    assert {(r.k, r.i) for r in got.collect()} == want


TRACK_ROW = "seq frame_order track_id score x y barcode product_name price_card is_late tag".split()
# Scenes of one video each; boxes are 40 x 30 at (x, y), ``tag`` is the tag it must be, worked by hand.
SCENES = {
    "an id holds over any distance and silence": [
        (1, 0, 7, 1.0, 0, 0, "", "", "", False, "a"), (2, 1, 7, 1.0, 900, 500, "", "", "", False, "a"),
        (3, 99, 7, 1.0, 0, 0, "", "", "", False, "a"), (4, 99, 8, 1.0, 600, 0, "", "", "", False, "b")],
    "overlap links until the tag is lost": [
        (1, 0, None, 1.0, 0, 0, "", "", "", False, "a"), (2, 5, None, 1.0, 5, 0, "", "", "", False, "a"),
        (3, 11, None, 1.0, 5, 0, "", "", "", False, "b")],
    "nearness alone is not enough": [
        (1, 0, None, 1.0, 0, 0, "", "", "", False, "a"), (2, 1, None, 1.0, 100, 0, "", "", "", False, "b")],
    "a code links far tags, an absent one does not": [
        (1, 0, None, 1.0, 0, 0, "46000001", "", "", False, "a"), (2, 1, None, 1.0, 2000, 900, "46000001", "", "", False, "a"),
        (3, 1, None, 1.0, 4000, 900, "нет", "", "", False, "b"), (4, 2, None, 1.0, 6000, 900, "нет", "", "", False, "c")],
    "name and price together link, the name alone does not": [
        (1, 0, None, 1.0, 0, 0, "", "Вино", "10", False, "a"), (2, 1, None, 1.0, 2000, 0, "", "вино", "10", False, "a"),
        (3, 2, None, 1.0, 5000, 0, "", "Вино", "11", False, "b")],
    "of equal evidence the older tag": [
        (1, 0, 1, 1.0, 0, 0, "", "", "", False, "a"), (2, 0, 2, 1.0, 0, 0, "", "", "", False, "a"),
        (3, 0, 3, 1.0, 3000, 0, "46000001", "", "", False, "b"), (4, 1, None, 1.0, 9000, 0, "46000001", "", "", False, "b")],
    "the best sighting gives the box": [
        (1, 0, None, 1.0, 0, 0, "46000001", "", "", False, "a"), (2, 1, None, 5.0, 2000, 0, "46000001", "", "", False, "a"),
        (3, 2, None, 1.0, 2004, 0, "", "", "", False, "a"), (4, 3, None, 1.0, 0, 0, "", "", "", False, "b")],
    "the longer code stays": [
        (1, 0, None, 1.0, 0, 0, "4600", "", "", False, "a"), (2, 1, None, 1.0, 2, 0, "46000001", "", "", False, "a"),
        (3, 2, None, 1.0, 4, 0, "46", "", "", False, "a"), (4, 3, None, 1.0, 5000, 0, "46000001", "", "", False, "a"),
        (5, 3, None, 1.0, 8000, 0, "46", "", "", False, "b")],
    "late reads meet finished tags": [
        (1, 0, None, 1.0, 0, 0, "46000001", "", "", False, "a"), (2, 50, None, 1.0, 0, 0, "46000002", "", "", False, "b"),
        (3, 0, None, 9.0, 3000, 0, "46000001", "", "", True, "a"), (4, 50, None, 1.0, 3000, 900, "46000002", "", "", True, "b"),
        (5, 20, None, 1.0, 9000, 0, "46000003", "", "", True, "c")],
}


def scene_rows(spark):
    rows = [(video, *row) for video, scene in enumerate(SCENES.values()) for row in scene]
    random.Random(13).shuffle(rows)
    kinds = "video_id int, seq bigint, frame_order bigint, track_id bigint, score double, x double, y double, barcode string, " \
            "product_name string, price_card string, is_late boolean, tag string"
    assert [k.split()[0] for k in kinds.split(", ")][1:] == TRACK_ROW
    rows = [tuple(float(v) if i in (5, 6) else v for i, v in enumerate(r)) for r in rows]
    return spark.createDataFrame(rows, kinds).selectExpr("*", "x AS x_min", "y AS y_min", "x + 40 AS x_max", "y + 30 AS y_max")


def test_tracks_of_scenes(spark):
    got = tracking.assign_tracks(scene_rows(spark), "video_id", "seq", late="is_late").collect()
    assert len(got) == sum(map(len, SCENES.values()))
    for video, name in enumerate(SCENES):
        pairs = {((r.part, r.track_no), r.tag) for r in got if r.video_id == video}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}), name


def test_many_ids_take_linear_time():
    book = tracking.TrackBook(tracking.TrackRules())
    for i in range(30_000):
        book.forget(i)
        book.assign((i, i, 1.0, i % 7 * 400.0, 0.0, i % 7 * 400.0 + 40, 30.0, *[""] * 7))
    assert book.count == 30_000 and len(book.listed) < 100  # what is out of reach has left the index


def apart(spark, seed):
    """One unbroken video: clusters of sightings far from each other, some with ids or codes that join clusters late."""
    rng = random.Random(seed)
    rows = []
    for seq in range(400):
        cluster = rng.randrange(9)
        x, y = cluster * 3000 + rng.uniform(0, 500), rng.uniform(0, 400)
        code = rng.choice(["", "", "", "", f"46{cluster:06}", "46900000"]) if cluster < 7 else ""
        name = rng.choice(["", "", f"n{cluster}", "n7"])
        track = rng.choice([None, None, None, cluster * 10 + rng.randrange(3)]) if seq % 50 else 99
        rows.append((1, seq, seq // 3 + (40 if seq > 200 and cluster == 8 else 0), track, rng.random(), x, y, x + 40, y + 30, code, name,
                     rng.choice(["10", "11", ""]), seq % 11 == 0))
    rows += [(2, 1000 + i, i, None, 0.5, 0.0, None if i % 2 else 0.0, 9.0, 9.0, "", "", "", False) for i in range(4)]
    rows += [(3, 2000 + i, i, None, 0.5, 0.0, 0.0, 9e4 if i == 2 else 9.0, 9e4 if i == 2 else 9.0, "", "", "", False) for i in range(4)]
    return spark.createDataFrame(rows, "video_id int, seq bigint, frame_order bigint, track_id bigint, score double, x_min double, y_min double, "
                                       "x_max double, y_max double, barcode string, product_name string, price_card string, is_late boolean")


def test_split_walk_gives_the_same_numbers(spark):
    for rows in (scene_rows(spark), apart(spark, 1)):
        whole, split = ({(r.video_id, r.seq): (r.part, r.track_no) for r in tracking.assign_tracks(
            rows, "video_id", "seq", late="is_late", large=n).collect()} for n in (10**9, 0))
        assert len(whole) == rows.count() and split == whole


def test_an_unbroken_video_is_many_groups(spark):
    rows = spark.createDataFrame([(1, i, i, i % 50, 0.9, i % 50 * 10_000.0, 0.0, i % 50 * 10_000.0 + 10, 10.0) for i in range(1000)],
                                 "video_id int, seq bigint, frame_order bigint, track_id bigint, score double, x_min double, y_min double, "
                                 "x_max double, y_max double")
    fold = tracking.link_values(rows).withColumn("part", F.lit(0)).select("part", *tracking._fold_columns(
        tracking.link_values(rows).withColumn("part", F.lit(0)), "video_id", "frame_order", "seq"))
    groups = tracking.meeting_groups(fold, tracking.TrackRules())
    assert groups.count() == 1000 and groups.select("group").distinct().count() == 50


@pytest.mark.parametrize("few", [components.FEW, 0])
def test_components(spark, few):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100)] + [(1000 + rng.randrange(200), 1000 + rng.randrange(200)) for _ in range(120)] + [(5000, 5000)]
    links += [(7000, 7001 + i) for i in range(50)]
    root = {}

    def top(n):
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for a, b in links:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(links, "a bigint, b bigint"), few).collect()}
    assert got == {n: top(n) for n in root}


def test_two_level_orders(spark):
    rng = random.Random(17)
    rows = [(k, p, rng.choice([None, rng.randrange(100)])) for k in ("a", "b") for p in rng.sample(range(10_000), 300)]
    df = spark.createDataFrame(rows, "k string, p int, v int")
    ranked = ordering.rank_in_group(df, ["k"], [F.col("p")], F.floor(F.col("p") / 100)).collect()
    carried = ordering.carry_forward(df, ["k"], "p", F.col("v"), "held", 64).collect()
    following = ordering.next_in_group(df, ["k"], "p", "v", "nxt", 64).collect()
    for key in ("a", "b"):
        mine = sorted(r for r in rows if r[0] == key)
        rank = {r.p: r.rank for r in ranked if r.k == key}
        held = {r.p: r.held for r in carried if r.k == key}
        nxt = {r.p: r.nxt for r in following if r.k == key}
        last = None
        for i, (_, p, v) in enumerate(mine):
            last = v if v is not None else last
            assert (rank[p], held[p], nxt[p]) == (i + 1, last, mine[i + 1][2] if i + 1 < len(mine) else None)


def test_top_per_group_cuts_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS v")
    plan = ordering.top_per_group(df, ["k"], [F.desc("v")], 3)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("share", [1.0, 0.6])
def test_rail_carry_like_a_walk(spark, share):
    rng = random.Random(19)
    frames = [(v, i, rng.choice([0.01, 0.5, 0.2])) for v in (0, 1) for i in range(0, 400) if rng.random() < share and (v == 0 or i % 50)]
    df = spark.createDataFrame(frames, "v int, i int, s double")
    got = {(r.v, r.i): (r.roi_source, r.roi_score) for r in timejoin.carried_roi(df, "v", "i", "s", F.struct("i"), refresh=7).collect()}
    good, at = {}, {}
    for v, i, s in frames:
        if v in good and i - at[v] < 7:
            want = ("rail_roi", good[v])
        else:
            at[v] = i
            if s >= 0.08:
                good[v] = s
                want = ("rail_roi", s)
            else:
                want = ("cached_low_score", s) if v in good else ("full_frame", 0.0)
        assert got[v, i] == want
