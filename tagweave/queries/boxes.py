"""Frames, boxes, suppression, matching, zones, tiles and crop quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.functions import geometry as g, quality as q
from tagweave.functions.geometry import Box
from tagweave.operators import ordering, reports, spatial, timejoin
from tagweave.plans import datasets, recognition
from tagweave.queries.inputs import load
from tagweave.queries.records import sql_canonical
from tagweave.queries.registry import query
from tagweave.schema import BOX_COLUMNS, QUALITY_COLUMNS
from tagweave.sources import readers

FRAME = ["video_id", "frame_index"]


def order():
    return [F.col("o1"), F.col("o2"), F.col("o3")]


def sql_iou(a: str, b: str) -> str:
    side = lambda lo, hi: f"greatest(0.0, least({a}.{hi}, {b}.{hi}) - greatest({a}.{lo}, {b}.{lo}))"
    area = lambda k: f"greatest(0.0, {k}.x_max - {k}.x_min) * greatest(0.0, {k}.y_max - {k}.y_min)"
    inter = f"{side('x_min', 'x_max')} * {side('y_min', 'y_max')}"
    return (f"(CASE WHEN {area(a)} + {area(b)} - {inter} > 0 THEN {inter} / ({area(a)} + {area(b)} - {inter}) ELSE 0 END)")


def sql_nms(rows: str, keys: str, order_by: str, threshold: float, ident: str, cap: str = "1000000",
            extra: str = "") -> str:
    """Greedy walk over each group as a recursive query."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"o.{k} = w.{k}" for k in ks)
    return f"""
    WITH RECURSIVE src AS ({rows}),
    o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order_by}) AS rn FROM src),
    lim AS (SELECT {keys}, count(*) AS n, {cap} AS cap FROM src GROUP BY {keys}),
    walk AS (
      SELECT {keys}, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(x_min DOUBLE, y_min DOUBLE, x_max DOUBLE, y_max DOUBLE, id VARCHAR)[]) AS kept FROM lim
      UNION ALL
      SELECT {', '.join('w.' + k for k in ks)}, w.rn + 1,
        CASE WHEN len(list_filter(w.kept, lambda k: {sql_iou('k', 'o')} > {threshold})) > 0 THEN w.kept
             ELSE list_append(w.kept, {{'x_min': o.x_min, 'y_min': o.y_min, 'x_max': o.x_max, 'y_max': o.y_max, 'id': CAST(o.{ident} AS VARCHAR)}}) END
      FROM walk w JOIN o ON {on} AND o.rn = w.rn + 1),
    ends AS (SELECT w.*, l.cap FROM walk w JOIN lim l ON {' AND '.join(f'l.{k} = w.{k}' for k in ks)} AND l.n = w.rn),
    kept AS (SELECT {keys}, unnest(list_slice(list_transform(kept, lambda k: k.id), 1, cap)) AS id,
                    unnest(range(1, least(len(kept), cap) + 1)) AS kept_rank FROM ends)
    {extra or f'SELECT {keys}, id AS {ident}, kept_rank FROM kept'}"""


DET = "SELECT * FROM {detections}"
CONF = "confidence DESC, o1, o2, o3"


# ---- frames ---------------------------------------------------------------------------------

SAMPLED = "SELECT *, sharpness < 40 AS blurry FROM {frames} WHERE frame_index % CAST(greatest(1, round_even(fps / 10, 0)) AS BIGINT) = 0"


@query("p4_sample_frames", f"SELECT video_id, frame_index, blurry FROM ({SAMPLED})")
def sampled(spark, sf):
    return readers.sample_frames(load(spark, sf, "frames"), 10.0, 40.0).select("video_id", "frame_index", "blurry")


@query("p5_blur_log", f"SELECT video_id, count(*) AS frames, count(*) FILTER (blurry) AS skipped FROM ({SAMPLED}) GROUP BY video_id")
def blur_log(spark, sf):
    rows = readers.sample_frames(load(spark, sf, "frames"), 10.0, 40.0)
    return rows.groupBy("video_id").agg(F.count("*").alias("frames"), F.count_if("blurry").alias("skipped"))


@query("p6_frame_times", "SELECT video_id, frame_index, CAST(round_even(frame_index / fps * 1000, 0) AS BIGINT) AS ms FROM {frames}")
def frame_times(spark, sf):
    return load(spark, sf, "frames").select("video_id", "frame_index",
                                            readers.frame_time(F.col("frame_index"), F.col("fps")).alias("ms"))


@query("s14_durations", "SELECT video_id, frame_index, CAST(trunc(frame_count / fps * 1000) AS BIGINT) AS duration_ms FROM {frames}")
def durations(spark, sf):
    return readers.with_duration(load(spark, sf, "frames")).select("video_id", "frame_index", "duration_ms")


@query("o3_first_sharp_frames", f"""
    SELECT video_id, frame_index, rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) AS rank
    FROM ({SAMPLED}) WHERE NOT blurry) WHERE rank <= 100""")
def first_sharp(spark, sf):
    rows = readers.sample_frames(load(spark, sf, "frames"), 10.0, 40.0).filter(~F.col("blurry"))
    return ordering.top_per_group(rows, ["video_id"], [F.col("frame_index")], 100).select("video_id", "frame_index", "rank")


@query("w6_rail_carry", """
    WITH f AS (SELECT * FROM {frames}), a AS (SELECT video_id, min(frame_index) AS f0 FROM f WHERE rail_score >= 0.08 GROUP BY video_id),
    p AS (SELECT f.*, a.f0, CASE WHEN f.frame_index >= a.f0 THEN (f.frame_index - a.f0) // 50 END AS period FROM f LEFT JOIN a USING (video_id)),
    m AS (SELECT video_id, period, frame_index AS mf, rail_score AS ms, sharpness AS my FROM p WHERE period IS NOT NULL AND (frame_index - f0) % 50 = 0),
    c AS (SELECT p.*, m.ms AS try_score, g.my AS roi_y, g.ms AS good_score, row_number() OVER (PARTITION BY p.video_id, p.frame_index ORDER BY g.period DESC) AS rn
          FROM p LEFT JOIN m ON m.video_id = p.video_id AND m.period = p.period
                 LEFT JOIN m g ON g.video_id = p.video_id AND g.period <= p.period AND g.ms >= 0.08)
    SELECT video_id, frame_index, roi_y, CASE WHEN period IS NULL THEN 0 WHEN (frame_index - f0) % 50 = 0 AND try_score < 0.08 THEN try_score ELSE good_score END AS roi_score,
           CASE WHEN period IS NULL THEN 'full_frame' WHEN (frame_index - f0) % 50 = 0 AND try_score < 0.08 THEN 'cached_low_score' ELSE 'rail_roi' END AS roi_source
    FROM c WHERE rn = 1""")
def rail_carry(spark, sf):
    rows = timejoin.carried_roi(load(spark, sf, "frames"), "video_id", "frame_index", "rail_score",
                                F.struct(F.col("sharpness").alias("y")))
    return rows.select("video_id", "frame_index", F.col("roi.y").alias("roi_y"), "roi_score", "roi_source")


# ---- box expressions ------------------------------------------------------------------------

@query("g1_box_measures", """
    SELECT crop_id, x_max - x_min AS w, y_max - y_min AS h, (x_max - x_min) * (y_max - y_min) AS area,
           x_min + (x_max - x_min) / 2 AS cx, y_min + (y_max - y_min) / 2 AS cy FROM {detections}""")
def measures(spark, sf):
    b = Box.of()
    return load(spark, sf, "detections").select("crop_id", b.width.alias("w"), b.height.alias("h"), b.area.alias("area"),
                                                b.center[0].alias("cx"), b.center[1].alias("cy"))


@query("g3_expand_tag", """
    SELECT crop_id, greatest(0.0, least(159.0, x_min - 0.18 * (x_max - x_min))) AS x_min,
           greatest(0.0, least(119.0, y_min - 0.10 * (y_max - y_min))) AS y_min,
           greatest(0.0, least(160.0, x_max + 0.18 * (x_max - x_min))) AS x_max,
           greatest(0.0, least(120.0, y_max + 1.45 * (y_max - y_min))) AS y_max FROM {detections}""")
def expanded(spark, sf):
    box = g.expand_tag(Box.of(), F.lit(160), F.lit(120))
    return load(spark, sf, "detections").select("crop_id", *[F.round(c, 9).alias(n) for c, n in zip(
        (box.x_min, box.y_min, box.x_max, box.y_max), BOX_COLUMNS)])


@query("g5_near_border", """
    SELECT crop_id, x_min <= 160 * 0.015E0 OR y_min <= 120 * 0.015E0 OR x_max >= 160 - 160 * 0.015E0 OR y_max >= 120 - 120 * 0.015E0 AS near FROM {detections}""")
def border(spark, sf):
    return load(spark, sf, "detections").select("crop_id", g.near_border(Box.of(), F.lit(160), F.lit(120)).alias("near"))


@query("g6_label_lines", """
    WITH c AS (SELECT crop_id, class_id, x_min AS a, y_min AS b, least(160.0, x_max) AS c, least(120.0, y_max) AS d FROM {detections})
    SELECT crop_id, class_id || ' ' || printf('%.6f %.6f %.6f %.6f', (a + c) / 2.0 / 160, (b + d) / 2.0 / 120, (c - a) / 160, (d - b) / 120) AS line
    FROM c WHERE c - a >= 3 AND d - b >= 3""")
def label_lines(spark, sf):
    rows = load(spark, sf, "detections")
    line = g.normalized_line(Box.of(), F.lit(160), F.lit(120), F.col("class_id"))
    return rows.select("crop_id", line.alias("line")).filter(F.col("line").isNotNull())


@query("g7_rotate", """
    SELECT crop_id, CAST(trunc(y_min) AS BIGINT) AS x0, CAST(trunc(3839 - x_max) AS BIGINT) AS y0,
           CAST(trunc(y_max) AS BIGINT) AS x1, CAST(trunc(3839 - x_min) AS BIGINT) AS y1 FROM {detections}""")
def rotated(spark, sf):
    box = g.rotate_ccw(Box.of())
    return load(spark, sf, "detections").select("crop_id", *[c.cast("bigint").alias(n) for c, n in zip(
        (box.x_min, box.y_min, box.x_max, box.y_max), ("x0", "y0", "x1", "y1"))])


@query("g9_tiles", """
    WITH f AS (SELECT o_orderkey AS frame, 600 + o_custkey % 2000 AS w, 500 + o_orderkey % 900 AS h FROM orders),
    xs AS (SELECT frame, w, h, unnest(CASE WHEN w <= 640 THEN [0] ELSE list_distinct(list_append(range(0, w - 640 + 1, 512), w - 640)) END) AS x FROM f),
    xy AS (SELECT frame, w, h, x, unnest(CASE WHEN h <= 640 THEN [0] ELSE list_distinct(list_append(range(0, h - 640 + 1, 512), h - 640)) END) AS y FROM xs),
    n AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY y, x) - 1 AS tile_no FROM xy)
    SELECT frame, tile_no, x AS x_min, y AS y_min, least(w, x + 640) AS x_max, least(h, y + 640) AS y_max FROM n WHERE tile_no < 6""")
def tile_rows(spark, sf):
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("frame"), (600 + F.col("o_custkey") % 2000).alias("w"),
                                            (500 + F.col("o_orderkey") % 900).alias("h"))
    tiles = g.tiles(F.col("w"), F.col("h"), 640, 512, max_tiles=6)
    return (rows.select("frame", F.posexplode(tiles).alias("tile_no", "t"))
            .select("frame", F.col("tile_no").cast("bigint").alias("tile_no"), "t.*"))


ZONES = " UNION ALL ".join(
    f"SELECT crop_id, {i} AS zone_no, '{n}' AS zone, greatest(0.0, least(w - 1, round_even(w * {x0}E0, 0))) AS x_min, "
    f"greatest(0.0, least(h - 1, round_even(h * {y0}E0, 0))) AS y_min, greatest(0.0, least(w, round_even(w * {x1}E0, 0))) AS x_max, "
    f"greatest(0.0, least(h, round_even(h * {y1}E0, 0))) AS y_max FROM b"
    for i, (n, (x0, y0, x1, y1)) in enumerate(g.READING_ZONES.items()))


@query("g10_reading_zones", f"""
    WITH b AS (SELECT crop_id, x_max - x_min AS w, y_max - y_min AS h FROM {{detections}}), z AS ({ZONES}),
    s AS (SELECT *, row_number() OVER (PARTITION BY crop_id, CAST(x_max - x_min AS DOUBLE), CAST(y_max - y_min AS DOUBLE) ORDER BY zone_no) AS rn FROM z
          WHERE x_max - x_min >= 18 AND y_max - y_min >= 18)
    SELECT s.crop_id, zone, CAST(x_min AS DOUBLE) AS x_min, CAST(y_min AS DOUBLE) AS y_min, CAST(x_max AS DOUBLE) AS x_max, CAST(y_max AS DOUBLE) AS y_max
    FROM s JOIN b USING (crop_id) WHERE w >= 24 AND h >= 24 AND (rn = 1 OR zone = 'full')
    UNION ALL SELECT crop_id, 'full', 0, 0, w, h FROM b WHERE w < 24 OR h < 24""")
def zones(spark, sf):
    b = Box.of()
    rows = load(spark, sf, "detections").select("crop_id", b.width.alias("w"), b.height.alias("h"))
    return rows.select("crop_id", F.inline(g.reading_zones(F.col("w"), F.col("h")))).drop("zone_no")


@query("g11_code_seeds", """
    SELECT crop_id, greatest(0.0, least(159.0, x_min - 2.2E0 * (x_max - x_min))) AS x_min, greatest(0.0, least(119.0, y_min - 1.5E0 * (y_max - y_min))) AS y_min,
           greatest(0.0, least(160.0, x_max + 2.8E0 * (x_max - x_min))) AS x_max, greatest(0.0, least(120.0, y_max + 1.7E0 * (y_max - y_min))) AS y_max
    FROM {detections} WHERE source = 'qr_seed'""")
def seeds(spark, sf):
    box = g.grow_code_seed(Box.of(), F.lit(160), F.lit(120))
    return load(spark, sf, "detections").filter(F.col("source") == "qr_seed").select("crop_id", *[
        c.alias(n) for c, n in zip((box.x_min, box.y_min, box.x_max, box.y_max), BOX_COLUMNS)])


@query("p7_geometry_filter", """
    SELECT crop_id FROM {detections} WHERE (x_max - x_min) * (y_max - y_min) >= 1400 AND (x_max - x_min) * (y_max - y_min) <= 160 * 120 * 0.18E0
      AND x_max - x_min >= 45 AND y_max - y_min >= 25 AND (x_max - x_min) / greatest(1.0, y_max - y_min) BETWEEN 0.25 AND 8""")
def geometry_filter(spark, sf):
    return load(spark, sf, "detections").filter(g.passes_geometry(Box.of(), F.lit(160 * 120))).select("crop_id")


@query("p8_valid_boxes", """
    SELECT crop_id, least(a, c) AS x_min, least(b, d) AS y_min, greatest(a, c) AS x_max, greatest(b, d) AS y_max FROM (
      SELECT crop_id, least(60.0, CASE WHEN class_id = 3 THEN x_max ELSE x_min END) AS a, least(40.0, y_min) AS b,
             least(60.0, CASE WHEN class_id = 3 THEN x_min ELSE x_max END) AS c, least(40.0, y_max) AS d FROM {detections})
    WHERE abs(c - a) >= 3 AND abs(d - b) >= 3""")
def valid(spark, sf):
    swap = F.col("class_id") == 3
    rows = load(spark, sf, "detections").select(
        "crop_id", F.when(swap, F.col("x_max")).otherwise(F.col("x_min")).alias("x_min"), "y_min",
        F.when(swap, F.col("x_min")).otherwise(F.col("x_max")).alias("x_max"), "y_max")
    return spatial.valid_boxes(rows, F.lit(60), F.lit(40), swap=True)


@query("p10_min_detections", "SELECT video_id, frame_index, count(*) AS n FROM {detections} GROUP BY video_id, frame_index HAVING count(*) >= 4")
def min_detections(spark, sf):
    return load(spark, sf, "detections").groupBy(*FRAME).agg(F.count("*").alias("n")).filter(F.col("n") >= 4)


@query("p15_color_hint", """
    SELECT crop_id, CASE WHEN label = 'red' OR source LIKE '%red' THEN 'red' WHEN label = 'yellow' OR source LIKE '%yellow' THEN 'yellow'
      WHEN label = 'green' OR source LIKE '%green' THEN 'green' WHEN label = 'white' OR source LIKE '%white' THEN 'white' ELSE '' END AS hint FROM {detections}""")
def hints(spark, sf):
    return load(spark, sf, "detections").select("crop_id", q.color_hint(F.col("label"), F.col("source")).alias("hint"))


# ---- quality --------------------------------------------------------------------------------

@query("c1_fusion_score", """
    SELECT crop_id, round(0.30E0 * least(1.0, sharpness / 500) + 0.25E0 * least(1.0, (x_max - x_min) * (y_max - y_min) / 80000) + 0.20E0 * confidence
      + CASE WHEN flag = 'R' THEN 0.20E0 ELSE 0 END + CASE WHEN x_min <= 2 THEN 0 ELSE 0.05E0 END, 9) AS score FROM {detections}""")
def fusion_score(spark, sf):
    score = q.fusion_crop_score(F.col("sharpness"), Box.of().area, F.col("confidence"), F.col("flag") == "R", F.col("x_min") <= 2)
    return load(spark, sf, "detections").select("crop_id", F.round(score, 9).alias("score"))


BEST_SCORE = ("greatest(0.0, least(1.0, 0.4E0 * least(laplacian / 2000, 1.0) + 0.4E0 * least(high_frequency / 0.6E0, 1.0) "
              "- 0.2E0 * least(greatest(block_artifact - 1, 0.0) / 2, 1.0)))")


@query("c2_best_crop_score", f"SELECT crop_id, round({BEST_SCORE}, 6) AS quality FROM {{detections}}")
def best_score(spark, sf):
    return recognition.score_crops(load(spark, sf, "detections")).select("crop_id", F.round("quality", 6).alias("quality"))


@query("c4_mask_color", """
    SELECT event_id AS k, CASE WHEN greatest(r, y, g, w) < 0.08E0 THEN '' WHEN r = greatest(r, y, g, w) THEN 'red' WHEN y = greatest(r, y, g, w) THEN 'yellow'
      WHEN g = greatest(r, y, g, w) THEN 'green' ELSE 'white' END AS color
    FROM (SELECT event_id, event_id * 7 % 50 / 100.0E0 AS r, event_id * 11 % 50 / 100.0E0 AS y, event_id * 13 % 20 / 100.0E0 AS g, event_id * 3 % 9 / 100.0E0 AS w FROM events)""")
def mask_color(spark, sf):
    e = F.col("event_id")
    return load(spark, sf, "events").select(e.alias("k"), q.mask_color(
        e * 7 % 50 / 100.0, e * 11 % 50 / 100.0, e * 13 % 20 / 100.0, e * 3 % 9 / 100.0).alias("color"))


@query("c4_hue_color", """
    WITH h AS (SELECT vec_id, list_transform(embedding[1:18], lambda x: abs(CAST(x AS DOUBLE))) AS bins FROM embeddings),
    p AS (SELECT vec_id, bins, (list_position(bins, list_max(bins)) - 1) * 10 + 5 AS hue FROM h)
    SELECT vec_id, CASE WHEN bins[1] < 0.01 THEN 'white' WHEN hue < 15 OR hue >= 165 THEN 'red' WHEN hue < 38 THEN 'yellow' WHEN hue < 90 THEN 'green'
           WHEN hue < 135 THEN 'blue' ELSE 'purple' END AS color FROM p""")
def hue_color(spark, sf):
    bins = F.transform(F.slice("embedding", 1, 18), lambda x: F.abs(x.cast("double")))
    rows = load(spark, sf, "embeddings").select("vec_id", bins.alias("b"))
    return rows.select("vec_id", q.hue_color(F.col("b"), F.get("b", F.lit(0))).alias("color"))


BITS = """
    v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    m AS (SELECT vec_id, label, e, list_reduce(e[2:64], lambda a, x: a + x, CAST(0 AS DOUBLE)) / 63.0E0 AS mean FROM v),
    hashed AS (SELECT vec_id, label, array_to_string(list_transform(range(0, 16), lambda i: substr('0123456789abcdef', CAST(1
      + CASE WHEN e[i * 4 + 1] > mean THEN 8 ELSE 0 END + CASE WHEN e[i * 4 + 2] > mean THEN 4 ELSE 0 END
      + CASE WHEN e[i * 4 + 3] > mean THEN 2 ELSE 0 END + CASE WHEN e[i * 4 + 4] > mean THEN 1 ELSE 0 END AS INT), 1)), '') AS hash FROM m)"""


@query("c5_fingerprints", f"WITH {BITS} SELECT vec_id, hash FROM hashed")
def fingerprints(spark, sf):
    return load(spark, sf, "embeddings").select(
        "vec_id", q.fingerprint_hex(q.fingerprint_bits(F.col("embedding"))).alias("hash"))


@query("c6_rail_band", """
    WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS s FROM embeddings),
    p AS (SELECT vec_id, list_position(s, list_max(s)) - 1 AS peak, list_max(s) AS top, (list_sort(s)[32] + list_sort(s)[33]) / 2 + 1E-6 AS base FROM r),
    q AS (SELECT vec_id, greatest(0, peak - 7) AS y0, (top - base) / (base * 6) AS score FROM p)
    SELECT vec_id, CAST(greatest(0, least(64, y0 + 15) - 15) AS DOUBLE) AS y_min, CAST(least(64, y0 + 15) AS DOUBLE) AS y_max, round(greatest(0.0, least(1.0, score)), 6) AS score FROM q""")
def rail_band(spark, sf):
    scores = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    rows = load(spark, sf, "embeddings").select("vec_id", scores.alias("s"))
    band = q.rail_band(F.col("s"), F.lit(100), F.lit(64), F.lit(1.0))
    return rows.select("vec_id", band.alias("b")).select("vec_id", "b.y_min", "b.y_max", F.round("b.score", 6).alias("score"))


# ---- suppression, anti-overlap, matching ------------------------------------------------------

@query("j2_suppress_overlaps", sql_nms(DET, "video_id, frame_index", CONF, 0.42, "crop_id",
       "CASE WHEN bool_and(source LIKE 'color%') THEN 2 ELSE 3 END"))
def suppressed(spark, sf):
    cap = F.when(F.bool_and(F.col("source").startswith("color")), 2).otherwise(3)
    rows = load(spark, sf, "detections").select(*FRAME, "crop_id", "o1", "o2", "o3", "confidence", "source", *BOX_COLUMNS)
    kept = spatial.suppress_overlaps(rows, FRAME, [-F.col("confidence"), *order()], 0.42, cap)
    return kept.select(*FRAME, "crop_id", "kept_rank")


@query("j2_tracked_suppression", sql_nms(DET, "video_id, frame_index", CONF, 0.75, "crop_id"))
def tracked_suppression(spark, sf):
    rows = load(spark, sf, "detections").select(*FRAME, "crop_id", "o1", "o2", "o3", "confidence", *BOX_COLUMNS)
    kept = spatial.suppress_overlaps(rows, FRAME, [-F.col("confidence"), *order()], 0.75)
    return kept.select(*FRAME, "crop_id", "kept_rank")


@query("t1_o2_candidate_union", sql_nms(
    "SELECT *, CASE source WHEN 'yolo' THEN 0 WHEN 'qr_seed' THEN 1 ELSE 2 END AS so FROM {detections}",
    "video_id, frame_index", "confidence DESC, so, o1, o2, o3", 0.42, "crop_id",
    "CASE WHEN bool_and(source LIKE 'color%') THEN 32 ELSE 80 END"))
def candidate_union(spark, sf):
    d = load(spark, sf, "detections")
    parts = [d.filter(F.col("source") == "yolo"), d.filter(F.col("source") == "qr_seed"),
             d.filter(F.col("source").startswith("color_"))]
    return datasets.candidate_boxes(parts, FRAME, order()).select(*FRAME, "crop_id", "kept_rank")


@query("j5_fallback_boxes", f"""
    SELECT f.crop_id, f.source || ':fallback' AS source FROM {{detections}} f WHERE f.status = 'O' AND NOT EXISTS (
      SELECT 1 FROM {{detections}} t WHERE t.status = 'F' AND t.video_id = f.video_id AND t.frame_index = f.frame_index AND {sql_iou('t', 'f')} > 0.35)""")
def fallback_boxes(spark, sf):
    d = load(spark, sf, "detections", spread=True)
    free = spatial.without_overlap(d.filter("status = 'O'"), d.filter("status = 'F'"), FRAME, 0.35)
    return free.select("crop_id", F.concat("source", F.lit(":fallback")).alias("source"))


@query("j16_roi_candidates", """
    WITH d AS (SELECT * FROM {detections}), i AS (SELECT * FROM d WHERE flag = 'R')
    SELECT crop_id, x_min + 5 AS x_min, y_min + o3 % 7 AS y_min, source || ':rail_roi' AS source FROM i
    UNION ALL SELECT crop_id, x_min, y_min, source FROM d WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.video_id = d.video_id AND i.frame_index = d.frame_index)""")
def roi_candidates(spark, sf):
    d = load(spark, sf, "detections")
    inside = d.filter("flag = 'R'").withColumns({"roi_x": F.lit(5), "roi_y": F.col("o3") % 7})
    return datasets.roi_candidates(inside, d, FRAME).select("crop_id", "x_min", "y_min", "source")


PAIR_KEYS = "video_id, frame_index"
MATCHES = f"""
    t AS (SELECT *, row_number() OVER (PARTITION BY {PAIR_KEYS} ORDER BY row_no) AS rn FROM {{truth}}),
    p AS (SELECT {PAIR_KEYS}, list({{'id': row_no, 'x_min': x_min, 'y_min': y_min, 'x_max': x_max, 'y_max': y_max}}) AS ps FROM {{predicted}} GROUP BY {PAIR_KEYS}),
    walk AS (
      SELECT {PAIR_KEYS}, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(t BIGINT, p BIGINT, iou DOUBLE)[]) AS done FROM p
      UNION ALL
      SELECT w.video_id, w.frame_index, w.rn + 1, CASE WHEN b IS NULL THEN w.done ELSE list_append(w.done, {{'t': w.tr, 'p': b.id, 'iou': -b.n}}) END
      FROM (SELECT w.video_id, w.frame_index, w.rn, w.done, t.row_no AS tr,
              list_sort(list_filter(list_transform(p.ps, lambda c: {{'n': -{sql_iou('c', 't')}, 'id': c.id}}),
                lambda c: -c.n >= 0.15 AND -c.n > 0 AND NOT list_contains(list_transform(w.done, lambda d: d.p), c.id)))[1] AS b
            FROM walk w JOIN t ON t.video_id = w.video_id AND t.frame_index = w.frame_index AND t.rn = w.rn + 1
                 JOIN p ON p.video_id = w.video_id AND p.frame_index = w.frame_index) w),
    ends AS (SELECT video_id, frame_index, arg_max(done, rn) AS done FROM walk GROUP BY {PAIR_KEYS}),
    matches AS (SELECT video_id, frame_index, unnest(done) AS m FROM ends)"""


@query("j1_match_boxes", f"""
    WITH RECURSIVE {MATCHES} SELECT video_id, frame_index, m.t AS t_row, m.p AS p_row, round(m.iou, 6) AS iou FROM matches""")
def matched(spark, sf):
    t = load(spark, sf, "truth").withColumnRenamed("row_no", "t_row")
    p = load(spark, sf, "predicted").withColumnRenamed("row_no", "p_row")
    return spatial.match_boxes(t, p, FRAME, "t_row", "p_row").withColumn("iou", F.round("iou", 6))


EQUAL = " + ".join(f"CASE WHEN {sql_canonical('t.' + c)} = {sql_canonical('p.' + c)} THEN 1 ELSE 0 END" for c in QUALITY_COLUMNS)
EVAL = f"""
    WITH RECURSIVE {MATCHES},
    s AS (SELECT t.video_id, m.iou AS iou, ({EQUAL}) / 17.0E0 AS acc FROM matches JOIN t ON t.video_id = matches.video_id AND t.frame_index = matches.frame_index AND t.row_no = m.t
          JOIN {{predicted}} p ON p.video_id = matches.video_id AND p.frame_index = matches.frame_index AND p.row_no = m.p),
    a AS (SELECT video_id, count(*) AS matched, count(*) FILTER (acc >= 0.8E0) AS good, avg(iou) AS ai, avg(acc) AS aa FROM s GROUP BY video_id),
    n AS (SELECT video_id, count(*) AS tn FROM t GROUP BY video_id), k AS (SELECT video_id, count(*) AS pn FROM {{predicted}} GROUP BY video_id),
    e AS (SELECT n.video_id, tn AS truth_rows, pn AS predicted_rows, matched AS matched_rows, good AS quality_rows_at_80pct, round(good / tn, 6) AS proxy_score,
      greatest(0, pn - matched) AS duplicate_rows, round(ai, 6) AS avg_iou, round(aa, 6) AS avg_field_accuracy
      FROM n JOIN k USING (video_id) JOIN a USING (video_id))"""


@query("a8_e4_evaluate", EVAL + " SELECT * FROM e")
def evaluation(spark, sf):
    t = load(spark, sf, "truth").withColumnRenamed("row_no", "t_row")
    p = load(spark, sf, "predicted").withColumnRenamed("row_no", "p_row")
    return reports.evaluate(t, p, ["video_id"], "t_row", "p_row", match_keys=FRAME)


@query("a9_mean_proxy", EVAL + " SELECT count(*) AS sequences, round(avg(proxy_score), 6) AS mean_proxy_score FROM e")
def mean_proxy(spark, sf):
    return reports.mean_proxy_score(evaluation(spark, sf))


@query("f9_field_accuracy", f"""
    WITH RECURSIVE {MATCHES},
    s AS (SELECT {", ".join(f"{sql_canonical('t.' + c)} = {sql_canonical('p.' + c)} AS {c}" for c in QUALITY_COLUMNS)}
          FROM matches JOIN t ON t.video_id = matches.video_id AND t.frame_index = matches.frame_index AND t.row_no = m.t
          JOIN {{predicted}} p ON p.video_id = matches.video_id AND p.frame_index = matches.frame_index AND p.row_no = m.p)
    {" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS pairs, count(*) FILTER ({c}) AS equal, round(count(*) FILTER ({c}) / count(*), 6) AS accuracy FROM s" for c in QUALITY_COLUMNS)}""")
def field_accuracy(spark, sf):
    from tagweave.operators.records import compare_fields
    t = load(spark, sf, "truth").withColumnRenamed("row_no", "t_row")
    p = load(spark, sf, "predicted").withColumnRenamed("row_no", "p_row")
    pairs = spatial.match_boxes(t, p, FRAME, "t_row", "p_row")
    left = t.select(*FRAME, "t_row", *[F.col(c).alias(f"t_{c}") for c in QUALITY_COLUMNS])
    right = p.select(*FRAME, "p_row", *[F.col(c).alias(f"p_{c}") for c in QUALITY_COLUMNS])
    return compare_fields(pairs.join(left, [*FRAME, "t_row"]).join(right, [*FRAME, "p_row"]), ["t_row"])


TILE_CUT = """
    WITH d AS (SELECT crop_id, x_min * 10 AS a, y_min * 10 AS b, x_max * 10 AS c, y_max * 10 AS e FROM {detections}),
    x AS (SELECT *, unnest([0, 512, 960]) AS tx FROM d), t AS (SELECT *, unnest([0, 512, 560]) AS ty FROM x),
    n AS (SELECT *, CASE ty WHEN 0 THEN 0 WHEN 512 THEN 3 ELSE 6 END + CASE tx WHEN 0 THEN 0 WHEN 512 THEN 1 ELSE 2 END AS tile_no,
      greatest(a, tx) AS p, greatest(b, ty) AS q, least(c, tx + 640) AS r, least(e, ty + 640) AS s FROM t)"""


@query("j7_p14_tile_boxes", TILE_CUT + """
    SELECT crop_id, tile_no, round((r - p) * (s - q) / greatest((c - a) * (e - b), 1.0), 9) AS visibility,
      printf('0 %.6f %.6f %.6f %.6f', (p - tx + r - tx) / 2.0 / 640, (q - ty + s - ty) / 2.0 / 640, (r - p) / 640, (s - q) / 640) AS line
    FROM n WHERE r - p >= 3 AND s - q >= 3 AND (r - p) * (s - q) / greatest((c - a) * (e - b), 1.0) >= 0.25""")
def tile_boxes(spark, sf):
    rows = load(spark, sf, "detections", spread=True).select("crop_id", *[(F.col(c) * 10).alias(c) for c in BOX_COLUMNS])
    cut = spatial.cut_into_tiles(rows, F.lit(1600), F.lit(1200))
    return cut.select("crop_id", F.col("tile_no").cast("bigint").alias("tile_no"), F.round("visibility", 9).alias("visibility"), "line")


@query("j15_class_names", """
    SELECT d.crop_id, coalesce(n.n_name, CAST(d.k AS VARCHAR)) AS class_name FROM (SELECT crop_id, class_id * 3 AS k FROM {detections}) d
    LEFT JOIN nation n ON n.n_nationkey = d.k""")
def class_names(spark, sf):
    d = load(spark, sf, "detections").select("crop_id", (F.col("class_id") * 3).alias("class_id"))
    names = load(spark, sf, "nation").select(F.col("n_nationkey").alias("class_id"), F.col("n_name").alias("name"))
    return datasets.name_classes(d, names).select("crop_id", "class_name")


@query("w13_regions", """
    WITH d AS (SELECT CAST(video_id AS VARCHAR) || ':' || CAST(frame_index AS VARCHAR) AS crop_id, CASE WHEN class_id % 3 = 0 THEN 'qr_code' WHEN class_id % 3 = 1 THEN 'barcode' ELSE 'code' END AS zone,
      x_min, confidence, o1, o2, o3 FROM {detections}), c AS (SELECT DISTINCT crop_id FROM d),
    f AS (SELECT crop_id, zone, x_min, row_number() OVER (PARTITION BY crop_id, zone ORDER BY confidence DESC, o1, o2, o3) AS rn FROM d),
    z AS (SELECT crop_id, 'qr_code' AS zone, 96.0 AS x FROM c UNION ALL SELECT crop_id, 'barcode', 0.0 FROM c)
    SELECT coalesce(b.crop_id, z.crop_id) AS crop_id, coalesce(b.zone, z.zone) AS zone, CAST(coalesce(b.x_min, z.x) AS DOUBLE) AS x_min,
      CASE WHEN b.crop_id IS NULL THEN 'fixed' ELSE 'detected' END AS origin
    FROM (SELECT * FROM f WHERE rn = 1) b FULL JOIN z ON b.crop_id = z.crop_id AND b.zone = z.zone""")
def regions(spark, sf):
    d = load(spark, sf, "detections")
    kind = F.col("class_id") % 3
    d = d.withColumns({"crop_id": F.concat_ws(":", "video_id", "frame_index"), "class_name":
                       F.when(kind == 0, "qr_code").when(kind == 1, "barcode").otherwise("code")})
    crops = d.select("crop_id").distinct()
    rows = datasets.regions_by_class(d, crops, g.code_zones(F.lit(160), F.lit(120)), order())
    return rows.select("crop_id", "zone", F.col("box.x_min").alias("x_min"), "origin")
