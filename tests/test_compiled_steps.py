"""Steps that must not be left to the JVM's interpreter, or to Spark's, and what they give."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tagweave.functions import prices as x, text as t
from tagweave.operators import evidence as ev, payloads as pl, records, spatial, tracking
from tagweave.plans import datasets, recognition
from tagweave.schema import BOX_COLUMNS, QUALITY_COLUMNS, VOTED_COLUMNS

LIMIT = "spark.sql.codegen.hugeMethodLimit"


@pytest.fixture
def unset(spark):
    spark.conf.unset(LIMIT)
    yield spark
    spark.conf.unset(LIMIT)


def test_matching_runs_no_method_too_long_to_compile(unset):
    t_ = unset.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.0, 0.0, 10.0, 9.0), (None, 3, 0.0, 0.0, 10.0, 9.0)],
                               "g int, t bigint, " + ", ".join(f"{c} double" for c in BOX_COLUMNS))
    found = spatial.match_boxes(t_, t_.withColumnRenamed("t", "p"), ["g"], "t", "p")
    assert int(unset.conf.get(LIMIT)) <= 8000
    assert {(r.t, r.p) for r in found.collect()} == {(1, 1), (2, 2)}


@pytest.mark.parametrize("compare", [records.compare_records, records.compare_fields])
def test_comparing_runs_no_method_too_long_to_compile(unset, compare):
    values = {"t_product_name": " Сок ", "p_product_name": "сок", "t_barcode": None, "p_barcode": None, "t_code": None, "p_code": ""}
    pairs = unset.range(1).select("id", *[F.lit(values.get(p + c, "1")).cast("string").alias(p + c) for p in ("t_", "p_") for c in QUALITY_COLUMNS])
    rows = compare(pairs, ["id"]).collect()
    assert int(unset.conf.get(LIMIT)) <= 8000
    if compare is records.compare_records:
        assert [(r.equal_fields, r.field_accuracy) for r in rows] == [(17, 1.0)]
    else:
        assert {(r.pairs, r.equal) for r in rows} == {(1, 1)} and len(rows) == 17


def test_missing_values_meet_no_rule(unset):
    raw = [None, "", " ", "нет", " нет ", ". ", "5.0", "x", "-", "12,5"]
    rows = unset.createDataFrame([(i, *[v] * len(VOTED_COLUMNS)) for i, v in enumerate(raw)],
                                 "k int, " + ", ".join(f"{c} string" for c in VOTED_COLUMNS))
    checked = records.validate_fields(rows, ["k"])
    assert int(unset.conf.get(LIMIT)) <= 8000
    by_rule = {r.field: r for r in rows.filter("k >= 0").select(*[
        F.collect_list(F.struct("k", t.normalize_field(c, c).alias("n"), t.valid_field(c, c).alias("v"))).alias(c)
        for c in VOTED_COLUMNS]).unpivot([], VOTED_COLUMNS, "field", "found").collect()}
    got = {(r.field, r.k): (r.normalized, r.valid) for r in checked.collect()}
    assert got == {(f, e.k): (e.n, e.v) for f, r in by_rule.items() for e in r.found}
    plan = checked._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN ((value" in plan.split("Generate")[0]


def test_steps_without_array_functions_are_compiled(unset):
    lines = unset.createDataFrame([("a", 0, " Сок  яблочный ", 0.9), ("a", 1, "125", 0.9), ("a", 2, "90", 0.8), ("a", None, "x", 0.1),
                                   ("b", 0, None, 0.9), (None, 1, "125", 0.9), (None, 2, "90", 0.9)],
                                  "crop_id string, line_no int, text string, confidence double")
    best = ev.extract_best_crop(lines, None, ["crop_id"])
    assert int(unset.conf.get(LIMIT)) <= 8000
    assert {(r.crop_id, r.product_name, r.price_default) for r in best.collect()} == {("a", "Сок яблочный", "125.90"), ("b", "", ""), (None, "", "125.90")}
    # The rules on a line's text stand apart from the walk for prices, which Spark interprets.
    steps = [s for s in best._jdf.queryExecution().optimizedPlan().toString().split("Generate inline") if "руб|коп|цена" in s]
    assert steps and all("lambdafunction" not in s.split("\n")[0] for s in steps)


def test_price_rules_of_squeezed_texts(spark):
    texts = ["125,90", "12 50", "1 99", "4599", "99", "", None, "5 л 12.50", "1.5 руб", "код 123456", "12 . 34", "a1b2c3", "12/04", "  7   25 "]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, s string")
    got = rows.select(x.tag_prices(F.col("s")).alias("now"), t.let(t.squeeze(F.col("s")), x._prices_of).alias("plain")).collect()
    assert [r.now for r in got] == [r.plain for r in got]


def test_payloads_run_no_method_too_long_to_compile(unset):
    parsed = pl.parse_payloads(unset.createDataFrame([("a", "b=1&p1=2")], "k string, raw string"), ["k"])
    assert int(unset.conf.get(LIMIT)) <= 8000
    assert [(r.qr_code_barcode, r.price1_qr) for r in parsed.collect()] == [("1", "2")]


def test_check_digits_of_digits(spark):
    codes = ["4006381333931", "4006381333932", "12345678", "0000000000000", "46", ""]
    rows = spark.createDataFrame([(c,) for c in codes], "s string").select(t.valid_ean13("s").alias("a"), t.ean13_digits(F.col("s")).alias("b"),
                                                                             x.tag_barcode(F.concat(F.lit("n "), "s", F.lit(" x"))).alias("c")).collect()
    assert [(r.a, r.b, r.c) for r in rows] == [(v, v, c if v else "") for v, c in zip([True, False, False, True, False, False], codes)]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_boxes_are_shuffled_not_lines_of_tiles(spark):
    boxes = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 100.0, 100.0), (1, 1, 2, 0.0, 0.0, 100.0, 99.0), (1, 1, 3, 600.0, 0.0, 700.0, 100.0),
                                   (2, 1, 4, 0.0, 0.0, 2.0, 2.0), (None, 1, 5, 0.0, 0.0, 100.0, 100.0)],
                                  "v int, f int, pos int, " + ", ".join(f"{c} double" for c in BOX_COLUMNS)).withColumns(
        {"width": F.lit(1000), "height": F.lit(600), "unused": F.lit("x")})
    built = datasets.build_tiled(boxes, ["v", "f"], "pos")
    assert {(r.v, r.f, r.tile_no, r.line_no, r.line) for r in built.collect()} == {
        (1, 1, 0, 1, "0 0.078125 0.083333 0.156250 0.166667"), (1, 1, 0, 3, "0 0.968750 0.083333 0.062500 0.166667"),
        (1, 1, 1, 3, "0 0.453125 0.083333 0.156250 0.166667")}
    exchanges = [s for s in plan_of(built).split("\n") if "Exchange hashpartitioning" in s]
    assert exchanges and not any("tile_no" in s or "line" in s for s in exchanges)


def test_tracks_are_walked_once(spark):
    rows = spark.range(6).select(
        F.lit(1).cast("bigint").alias("video_id"), F.col("id").alias("seq"), F.col("id").alias("frame_order"), (F.col("id") * 40).alias("ts_ms"),
        (F.col("id") == 5).alias("late"), (F.col("id") % 2).alias("track_id"), F.lit("qr").alias("source"), F.col("id").cast("double").alias("score"),
        *[(F.col("id") % 2 * 5000 + w).cast("double").alias(c) for c, w in zip(BOX_COLUMNS, (0, 0, 10, 10))],
        *[F.lit(v).alias(c) for c, v in ((c, "сок" if c == "product_name" else "") for c in VOTED_COLUMNS)])
    fused = recognition.fuse_tracks(rows)
    assert "MapInPandas" not in plan_of(fused) and "PythonMap" not in plan_of(fused)
    assert {(r.best_ts, r.product_name) for r in fused.collect()} == {(160, "сок"), (200, "сок")}


def likeness_of(rules, tag, box, keys):
    """The likeness as the rules tell it."""
    sides = lambda k: [max(0.0, k[i + 2] - k[i]) for i in (0, 1)]
    centre = lambda k: (k[0] + sides(k)[0] / 2, k[1] + sides(k)[1] / 2)
    both = math.prod(max(0.0, min(tag.box[i + 2], box[i + 2]) - max(tag.box[i], box[i])) for i in (0, 1))
    union = math.prod(sides(tag.box)) + math.prod(sides(box)) - both
    common = both / union if union > 0 else 0.0
    apart = math.dist(centre(tag.box), centre(box))
    shared = sum(tracking.EVIDENCE[kind] for kind in {k[0] for k in keys & tag.keys})
    return (shared + (tracking.OVERLAP + common if common >= rules.min_iou else 0.0)
            + (tracking.NEARNESS - tracking.FADE * apart / max(1.0, rules.reach) if apart <= rules.reach else 0.0))


def test_most_alike_by_plain_rules():
    r, rules = random.Random(7), tracking.TrackRules(reach=30.0)
    book = tracking.TrackBook(rules)
    for i in range(400):
        x0, y0 = r.uniform(0, 200), r.uniform(0, 200)
        box = [x0, y0, x0 + r.uniform(-2, 60), y0 + r.uniform(-2, 50)]
        if r.random() < 0.05:
            box[r.randrange(4)] = r.choice([math.nan, math.inf, -math.inf])
        code = r.choice(["", "46%d" % r.randrange(30)])
        row = (i // 8, None, r.uniform(0, 9), *box, "", code, "", "", "", "", "")
        book.forget(row[0])
        seen, found = book._tag(row), book._most_alike(book._tag(row))
        keys, cells = tracking.evidence_keys(seen.texts), book._cells(seen.box, rules.reach)
        near = [t for t in book.tags.values() if seen.last_frame - t.last_frame <= rules.max_lost and (
            cells is None or {*keys, *cells, ("wide",)} & (t.keys | t.cells))]
        rated = [(likeness_of(rules, t, seen.box, keys), -t.number) for t in near]
        best = max(rated, default=(0.0, 0))
        assert (found.number if found else None) == (-best[1] if best[0] >= rules.accept else None)
        book.assign(row)
    assert 20 < book.count < 400
