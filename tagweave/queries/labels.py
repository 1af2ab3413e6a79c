"""Label sets, splits, manifests, reviews and experiment reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.functions.quality import colour_candidate_confidence
from tagweave.operators import labels as lb, reports
from tagweave.operators.spatial import SMALL_GROUP, oversized_groups
from tagweave.plans import datasets
from tagweave.queries.boxes import FRAME, order, sql_nms
from tagweave.queries.inputs import load
from tagweave.queries.registry import query
from tagweave.schema import BOX_COLUMNS
from tagweave.session import run_folder
from tagweave.sources import label_files as files, readers, writers

NUM = "'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$'"
PARSED = f"""
    SELECT image, line_no, p, len(p) AS n, CASE WHEN len(p) < 5 THEN 'expected 5 values, got ' || len(p)
        WHEN len(list_filter(p[1:5], lambda x: NOT regexp_matches(x, {NUM}))) > 0 THEN 'cannot parse numbers'
        WHEN CAST(p[4] AS DOUBLE) <= 0 OR CAST(p[5] AS DOUBLE) <= 0 THEN 'non-positive box size'
        WHEN len(list_filter(p[2:5], lambda x: CAST(x AS DOUBLE) NOT BETWEEN 0 AND 1)) > 0 THEN 'values are outside [0, 1]' END AS warning
    FROM (SELECT image, line_no, string_split(trim(regexp_replace(line, '\\s+', ' ', 'g')), ' ') AS p FROM {{label_lines}}) WHERE p[1] <> ''"""
BOXES = f"""SELECT image, line_no, n, CAST(TRY_CAST(p[1] AS DOUBLE) AS INT) AS class_id, warning, TRY_CAST(p[2] AS DOUBLE) - TRY_CAST(p[4] AS DOUBLE) / 2.0 AS x_min,
    TRY_CAST(p[3] AS DOUBLE) - TRY_CAST(p[5] AS DOUBLE) / 2.0 AS y_min, TRY_CAST(p[2] AS DOUBLE) + TRY_CAST(p[4] AS DOUBLE) / 2.0 AS x_max,
    TRY_CAST(p[3] AS DOUBLE) + TRY_CAST(p[5] AS DOUBLE) / 2.0 AS y_max, warning IS NULL OR warning LIKE 'values%' AS is_box FROM ({PARSED})"""


@query("s8_label_lines", f"SELECT image, line_no, warning, is_box, CASE WHEN is_box THEN class_id END AS class_id, CASE WHEN is_box THEN round(x_min, 9) END AS x_min FROM ({BOXES})")
def label_lines(spark, sf):
    rows = lb.parse_label_lines(load(spark, sf, "label_lines"))
    box = lambda c: F.when(F.col("is_box"), c)
    return rows.select("image", "line_no", "warning", "is_box", box(F.col("class_id")).alias("class_id"),
                       box(F.round("x_min", 9)).alias("x_min"))


CHECKED = f"""SELECT o.o_orderkey AS image, CAST(coalesce(b.boxes, 0) AS BIGINT) AS boxes, CAST(coalesce(b.warnings, 1) AS BIGINT) AS warnings FROM orders o
    LEFT JOIN (SELECT image, count(*) FILTER (is_box) AS boxes, count(warning) AS warnings FROM ({BOXES}) GROUP BY image) b ON b.image = o.o_orderkey"""


def checked_labels(spark, sf):
    lines = load(spark, sf, "label_lines")
    images = load(spark, sf, "orders").select(F.col("o_orderkey").alias("image"), F.lit(False).alias("has_label"))
    return datasets.qa_labels(images, lines, ["image"])


@query("j11_e8_check_labels", CHECKED)
def check_labels(spark, sf):
    return checked_labels(spark, sf)[0].drop("has_label")


@query("a15_label_totals", f"SELECT count(*) AS images, CAST(sum(boxes) AS BIGINT) AS boxes, count(*) FILTER (warnings > 0) AS images_with_warnings FROM ({CHECKED})")
def label_totals(spark, sf):
    return checked_labels(spark, sf)[1]


@query("p13_review_items", f"SELECT * FROM ({CHECKED}) WHERE image >= 700 AND boxes > 0")
def review_items(spark, sf):
    return lb.review_items(checked_labels(spark, sf)[0].drop("has_label"), "image", False, 700)


FIVE = f"SELECT * FROM ({BOXES}) WHERE n = 5 AND x_min IS NOT NULL"
CLASSED = FIVE + " AND class_id IS NOT NULL"
SUPPRESSED = sql_nms(CLASSED, "image", "class_id, line_no", 0.5, "line_no")


@query("j3_suppress_labels", SUPPRESSED.replace("SELECT image, id AS line_no, kept_rank", "SELECT image, CAST(id AS BIGINT) AS line_no, kept_rank"))
def suppress_labels(spark, sf):
    return datasets.dedupe_labels(load(spark, sf, "label_lines"), ["image"], 0.5).select("image", "line_no", "kept_rank")


@query("a14_e7_dedupe_totals", sql_nms(CLASSED, "image", "class_id, line_no", 0.5, "line_no", extra="""
    SELECT (SELECT count(*) FROM {label_lines}) AS labels_in, count(*) AS labels_out, (SELECT count(*) FROM {label_lines}) - count(*) AS removed FROM kept"""))
def dedupe_totals(spark, sf):
    lines = load(spark, sf, "label_lines")
    return datasets.dedupe_totals(lines, datasets.dedupe_labels(lines, ["image"], 0.5))


@query("j4_near_equal_labels", sql_nms(FIVE, "image", "line_no", 0.92, "line_no").replace(
    "SELECT image, id AS line_no, kept_rank", "SELECT image, CAST(id AS BIGINT) AS line_no, kept_rank"))
def near_equal(spark, sf):
    lines = load(spark, sf, "label_lines")
    rows = lb.parse_label_lines(lines).select("image", "line_no", "values", "cx", *BOX_COLUMNS)
    hot = oversized_groups(lines, ["image"], SMALL_GROUP)
    return lb.drop_near_equal(rows, ["image"], hot=hot).select("image", "line_no", "kept_rank")


@query("w11_equal_labels", "SELECT image, line, min(line_no) AS line_no FROM {label_lines} GROUP BY ALL")
def equal_labels(spark, sf):
    return lb.first_of_equal(load(spark, sf, "label_lines"), ["image"], "line", "line_no")


# ---- splits -----------------------------------------------------------------------------------

@query("t6_exact_split", """
    SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) <= greatest(1, floor(n * 0.2)) THEN 'val' ELSE 'train' END AS split
    FROM documents, (SELECT count(*) AS n FROM documents)""")
def exact_split(spark, sf):
    return lb.exact_split(load(spark, sf, "documents").select("doc_id"), F.col("doc_id"))


@query("t7_hash_split", """
    SELECT video_id, ts_ms, CASE WHEN CAST('0x' || substr(md5(CAST(video_id AS VARCHAR) || ':' || CAST(ts_ms AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295.0E0 < 0.2 THEN 'val' ELSE 'train' END AS split FROM {frames}""")
def hash_split(spark, sf):
    return load(spark, sf, "frames").select("video_id", "ts_ms", lb.hash_split(F.col("video_id"), F.col("ts_ms"), 0.2).alias("split"))


@query("t8_modulo_split", "SELECT o_orderkey AS frame_id, CASE WHEN o_orderkey % 3 = 0 THEN 'val' ELSE 'train' END AS split FROM orders")
def modulo_split(spark, sf):
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("frame_id"), lb.modulo_split(F.col("o_orderkey"), 0.3).alias("split"))


@query("o5_seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 200")
def seeded_sample(spark, sf):
    return lb.seeded_sample(load(spark, sf, "documents"), F.col("doc_id"), 200, 7).select("doc_id")


@query("o6_limit_per_split", """
    SELECT flag, crop_id FROM (SELECT flag, crop_id, row_number() OVER (PARTITION BY flag ORDER BY crop_id) AS rn FROM {detections}) WHERE rn <= 500""")
def limit_per_split(spark, sf):
    from tagweave.operators.ordering import top_per_group
    return top_per_group(load(spark, sf, "detections"), ["flag"], [F.col("crop_id")], 500).select("flag", "crop_id")


# ---- manifests and builds ---------------------------------------------------------------------

@query("k7_e6_frame_manifest", """
    SELECT 'train' AS split, video_id AS video, frame_index AS frame, '' AS track_id, CAST(video_id AS VARCHAR) || '_f' || lpad(CAST(frame_index AS VARCHAR), 7, '0') || '.jpg' AS image,
      count(*) AS detections FROM {detections} WHERE frame_index % 3 = 0 GROUP BY video_id, frame_index HAVING count(*) >= 2""")
def frame_manifest(spark, sf):
    d = load(spark, sf, "detections")
    return datasets.pseudo_label(d, "video_id", "frame_index", F.lit(160), F.lit(120), order(), 3, 2)[0]


@query("e6_pseudo_labels", """
    WITH f AS (SELECT video_id, frame_index FROM {detections} WHERE frame_index % 3 = 0 GROUP BY ALL HAVING count(*) >= 2),
    c AS (SELECT d.crop_id, class_id, x_min AS a, y_min AS b, least(160.0, x_max) AS c, least(120.0, y_max) AS d FROM {detections} d JOIN f ON f.video_id = d.video_id AND f.frame_index = d.frame_index)
    SELECT crop_id, class_id || ' ' || printf('%.6f %.6f %.6f %.6f', (a + c) / 2.0 / 160, (b + d) / 2.0 / 120, (c - a) / 160, (d - b) / 120) AS line FROM c""")
def pseudo_labels(spark, sf):
    d = load(spark, sf, "detections")
    return datasets.pseudo_label(d, "video_id", "frame_index", F.lit(160), F.lit(120), order(), 3, 2)[1].select("crop_id", "line")


@query("j12_k7_first_sight_manifest", """
    WITH d AS (SELECT * FROM {detections} WHERE track_id IS NOT NULL), m AS (SELECT video_id, track_id, min(frame_index) AS f FROM d GROUP BY ALL)
    SELECT 'train' AS split, d.video_id AS video, d.frame_index AS frame, string_agg(CAST(d.track_id AS VARCHAR), ' ' ORDER BY d.track_id) AS track_id,
      CAST(d.video_id AS VARCHAR) || '_f' || lpad(CAST(d.frame_index AS VARCHAR), 7, '0') || '.jpg' AS image, count(*) AS detections
    FROM d JOIN m ON d.video_id = m.video_id AND d.track_id = m.track_id AND d.frame_index = m.f GROUP BY d.video_id, d.frame_index""")
def first_sight_manifest(spark, sf):
    return lb.first_sight_manifest(load(spark, sf, "detections"), "video_id", "frame_index", "track_id")


@query("k7_crop_manifest", """
    WITH r AS (SELECT CAST(video_id AS VARCHAR) || '_' || CAST(frame_index AS VARCHAR) AS image, *, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY confidence DESC, o1, o2, o3) - 1 AS crop_no FROM {detections})
    SELECT image, crop_no, printf('%.4f', confidence) AS conf, CAST(trunc(x_min) AS BIGINT) AS x1, CAST(trunc(y_min) AS BIGINT) AS y1,
      least(120, CAST(trunc(x_max) AS BIGINT)) AS x2, least(80, CAST(trunc(y_max) AS BIGINT)) AS y2, image || '_crop' || printf('%02d', crop_no) || '.jpg' AS filename
    FROM r WHERE least(120, trunc(x_max)) > trunc(x_min) AND least(80, trunc(y_max)) > trunc(y_min)""")
def crop_manifest(spark, sf):
    d = load(spark, sf, "detections").withColumn("image", F.concat_ws("_", "video_id", "frame_index"))
    return lb.crop_manifest(d, "image", F.lit(120), F.lit(80), [F.desc("confidence"), *order()],
                            F.floor(-F.col("confidence") * 1000))


def built(spark, sf, mode):
    d = load(spark, sf, "detections").withColumns({"width": F.lit(160), "height": F.lit(120), "frame_timestamp": F.col("ts_ms"),
                                                   "offset": F.lit(0), "pos": F.col("o1") * 100000000000 + F.col("o2") * 100000 + F.col("o3")})
    base = d.select("video_id", "frame_timestamp", "offset", "pos", "width", "height", *BOX_COLUMNS)
    moved = base.withColumns({"offset": F.when(F.col("pos") % 2 == 0, 1).otherwise(-1), "x_min": F.col("x_min") + 1, "x_max": F.col("x_max") + 1})
    return datasets.build_full_frame(base, moved, "pos", 0.2, mode)


BUILD = """
    WITH b AS (SELECT video_id, ts_ms AS frame_timestamp, 0 AS "offset", o1 * 100000000000 + o2 * 100000 + o3 AS pos, x_min AS a, y_min AS b, x_max AS c, y_max AS e FROM {detections}),
    u AS (SELECT * FROM b UNION ALL SELECT video_id, frame_timestamp, CASE WHEN pos % 2 = 0 THEN 1 ELSE -1 END, pos, a + 1, b, c + 1, e FROM b),
    l AS (SELECT video_id, frame_timestamp, "offset", pos, printf('0 %.6f %.6f %.6f %.6f', (a + least(160.0, c)) / 2.0 / 160, (b + least(120.0, e)) / 2.0 / 120, (least(160.0, c) - a) / 160, (least(120.0, e) - b) / 120) AS line FROM u),
    k AS (SELECT video_id, frame_timestamp, "offset", line, min(pos) AS pos FROM l GROUP BY ALL),
    f AS (SELECT video_id, frame_timestamp, "offset", row_number() OVER (ORDER BY video_id, frame_timestamp, "offset" > 0, abs("offset")) - 1 AS frame_id FROM (SELECT DISTINCT video_id, frame_timestamp, "offset" FROM k)),
    s AS (SELECT k.*, f.frame_id, CASE WHEN f.frame_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM k JOIN f ON f.video_id = k.video_id AND f.frame_timestamp = k.frame_timestamp AND f."offset" = k."offset")"""


@query("e5_t9_build_full_frame", BUILD.replace('abs("offset")', '"offset" <> 0') + ' SELECT video_id, frame_timestamp, "offset", line, pos, split FROM s')
def build_full_frame(spark, sf):
    return built(spark, sf, "frame_id").drop("frame_id")


@query("a13_k6_build_report", BUILD + """, g AS (SELECT video_id, frame_timestamp, "offset", split, count(*) AS n FROM s GROUP BY ALL)
    SELECT count(*) FILTER (split = 'train') AS train_images, count(*) FILTER (split = 'val') AS val_images, count(*) AS labels, CAST(sum(n) AS BIGINT) AS instances,
      count(*) FILTER ("offset" = 0) AS base_frames, count(*) FILTER ("offset" <> 0) AS propagated_frames, CAST(0 AS BIGINT) AS rejected_propagations, CAST(0 AS BIGINT) AS empty_labels FROM g""")
def build_report(spark, sf):
    return datasets.build_report(built(spark, sf, "frame_id"))


@query("e5_build_tiled")
def build_tiled(spark, sf):
    d = load(spark, sf, "detections").withColumns({c: F.col(c) * 10 for c in BOX_COLUMNS})
    d = d.withColumns({"width": F.lit(1600), "height": F.lit(1200), "pos": F.col("o1") * 100000000000 + F.col("o2") * 100000 + F.col("o3")})
    return datasets.build_tiled(d, FRAME, "pos")


@query("a12_boxes_per_time", "SELECT video_id, ts_ms, count(*) AS boxes FROM {detections} GROUP BY ALL")
def boxes_per_time(spark, sf):
    return load(spark, sf, "detections").groupBy("video_id", "ts_ms").agg(F.count("*").alias("boxes"))


@query("e10_import_annotations", """
    WITH p AS (SELECT d.doc_id, l.doc_id IS NOT NULL AS has_label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER () AS n FROM p)
    SELECT doc_id, has_label, NOT has_label AS background, CASE WHEN rn <= greatest(1, floor(n * 0.2)) THEN 'val' ELSE 'train' END AS split FROM r""")
def import_annotations(spark, sf):
    found = load(spark, sf, "labels").select("doc_id", F.lit(True).alias("has_label"))
    pairs = load(spark, sf, "documents").select("doc_id").join(found, "doc_id", "left").withColumn(
        "has_label", F.coalesce("has_label", F.lit(False)))
    return datasets.import_annotations(pairs, "doc_id")


# ---- reviews ----------------------------------------------------------------------------------

@query("t4_e9_apply_review", """
    WITH l AS (SELECT image, arg_max(decision, pass) AS decision FROM {reviews} GROUP BY image)
    SELECT doc_id AS image, source FROM documents WHERE doc_id NOT IN (SELECT image FROM l WHERE decision LIKE 'remove%')""")
def apply_review(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("image"), "source")
    return lb.apply_decisions(docs, load(spark, sf, "reviews"), "image", [F.col("pass")])


@query("a16_review_summary", """
    SELECT count(*) FILTER (decision = 'keep' OR decision LIKE 'remove%') AS reviewed, count(*) FILTER (decision = 'keep') AS kept,
      count(*) FILTER (decision LIKE 'remove%') AS removed, count(*) FILTER (decision = 'skip_unreadable') AS skipped FROM {reviews}""")
def review_summary(spark, sf):
    return lb.review_summary(load(spark, sf, "reviews"))


@query("s12_k9_review_log", "SELECT CAST(image AS VARCHAR) AS image_path, decision, CAST(pass AS INT) AS boxes FROM {reviews}")
def review_log(spark, sf):
    folder = run_folder(spark, "reviews")
    events = load(spark, sf, "reviews").select(F.lit("2026-01-01").alias("timestamp"), "decision", F.col("image").cast("string").alias("image_path"),
                                               F.col("pass").cast("int").alias("boxes"))
    for late in (0, 1):
        writers.append_review_events(events.filter(F.col("boxes") == late), folder)
    return readers.read_review_log(spark, folder).select("image_path", "decision", "boxes")


@query("s8_k5_label_files", "SELECT CAST(image AS VARCHAR) AS image, line_no, line FROM {label_lines}")
def label_files(spark, sf):
    folder = run_folder(spark, "labels")
    rows = load(spark, sf, "label_lines").withColumns({"image": F.col("image").cast("string"), "split": F.lit("train")})
    writers.write_label_lines(rows, folder)
    return spark.read.parquet(folder).select("image", "line_no", "line")


@query("g12_colour_confidence", """
    SELECT crop_id, CASE WHEN o2 % 100 >= 18 THEN round(least(0.68E0, 0.25E0 + o2 % 100 / 100.0E0 * 0.55E0), 9) END AS confidence FROM {detections}""")
def colour_confidence(spark, sf):
    fill = F.col("o2") % 100 / F.lit(100.0)
    return load(spark, sf, "detections").select("crop_id", F.round(colour_candidate_confidence(fill), 9).alias("confidence"))


@query("k8_label_tree", "SELECT CAST(image % 10 AS INT) AS folder, CAST(image % 100 AS INT) AS file, line FROM {label_lines} WHERE line <> ' '")
def label_tree(spark, sf):
    folder = run_folder(spark, "tree")
    rows = load(spark, sf, "label_lines").filter("line <> ' '").withColumns({"folder": F.col("image") % 10, "file": F.col("image") % 100})
    writers.write_label_tree(rows, folder, "folder", "line_no", "file")
    return spark.read.text(folder).select("folder", "file", F.col("value").alias("line"))


@query("k8_label_files", """
    SELECT CAST(image % 10 AS VARCHAR) || '/' || CAST(image % 100 AS VARCHAR) || '.txt' AS file,
           string_agg(line || chr(10), '' ORDER BY image, line_no, line) AS content FROM {label_lines} WHERE line <> ' ' GROUP BY ALL""")
def label_files(spark, sf):
    """One text file per source file at its relative path, read back whole."""
    folder = run_folder(spark, "files")
    name = F.concat_ws("", (F.col("image") % 10).cast("string"), F.lit("/"), (F.col("image") % 100).cast("string"), F.lit(".txt"))
    rows = load(spark, sf, "label_lines").filter("line <> ' '").withColumn("file", name)
    files.write_label_files(rows, folder, "file", ["image", "line_no", "line"])
    path = F.split("path", "/")
    read = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return read.select(F.concat_ws("/", F.element_at(path, -2), F.element_at(path, -1)).alias("file"), "content")


# ---- experiment -------------------------------------------------------------------------------

SUMMARY = """SELECT variant, count(*) FILTER (decoded) AS decoded_count, count(*) AS total, count(*) FILTER (reader_a <> '') AS reader_a_ok,
    count(*) FILTER (reader_b <> '') AS reader_b_ok, round(avg(lapvar), 6) AS avg_lapvar, round(avg(bar_contrast), 6) AS avg_bar_contrast,
    round(avg(edge_density), 6) AS avg_edge_density, CAST(round_even(count(*) FILTER (decoded) / count(*) * 100, 1) AS DOUBLE) AS decode_rate FROM {variant_metrics} GROUP BY variant"""


@query("a17_o12_variant_summary", SUMMARY)
def variant_summary(spark, sf):
    return reports.variant_summary(load(spark, sf, "variant_metrics")).orderBy(F.desc("decoded_count"), "variant")


@query("a24_variant_report", f"""
    WITH s AS ({SUMMARY}), b AS (SELECT * FROM s ORDER BY decoded_count DESC, decode_rate DESC, variant DESC LIMIT 1)
    SELECT (SELECT count(*) FROM s) AS variants, b.variant AS best_variant, b.decode_rate AS best_rate, r.decode_rate AS baseline_rate,
      round(b.decode_rate - r.decode_rate, 1) AS improvement FROM b, s r WHERE r.variant = 'view'""")
def variant_report(spark, sf):
    return datasets.variant_tables(load(spark, sf, "variant_metrics"), "view")[1]


BEST_VARIANT = """SELECT camera, variant, CASE WHEN decoded THEN 10000.0E0 ELSE 0 END + lapvar AS score,
    row_number() OVER (PARTITION BY camera ORDER BY CASE WHEN decoded THEN 10000.0E0 ELSE 0 END + lapvar DESC, crop) AS rn FROM {variant_metrics}"""


@query("w12_best_variant", f"SELECT camera, variant, score FROM ({BEST_VARIANT}) WHERE rn = 1")
def best_variant(spark, sf):
    return reports.best_variant_per_crop(load(spark, sf, "variant_metrics"), "camera", [F.col("crop")])


@query("o7_improvements", f"SELECT camera, variant, score FROM ({BEST_VARIANT}) WHERE rn = 1 ORDER BY score DESC, camera LIMIT 5")
def improvements(spark, sf):
    return reports.improvements(best_variant(spark, sf), 5, "camera")


@query("j13_u4_try_variants", """
    SELECT crop_id, line_no, v AS variant, CASE v WHEN 'lower' THEN lower(text) WHEN 'trim' THEN trim(text) ELSE CAST(TRY_CAST(text AS BIGINT) AS VARCHAR) END AS value,
      CASE WHEN v = 'number' AND TRY_CAST(text AS BIGINT) IS NULL THEN 'no number' ELSE '' END AS error FROM {tag_lines}, (SELECT unnest(['lower', 'trim', 'number']) AS v)""")
def try_variants(spark, sf):
    text = F.col("text")
    number = text.try_cast("bigint").cast("string")
    rows = reports.try_variants(load(spark, sf, "tag_lines").select("crop_id", "line_no", "text"), {
        "lower": {"value": F.lower(text), "error": F.lit("")}, "trim": {"value": F.trim(text), "error": F.lit("")},
        "number": {"value": number, "error": F.when(number.isNull(), "no number").otherwise("")}})
    return rows.select("crop_id", "line_no", "variant", "value", "error")


@query("a18_describe", """
    SELECT 'lapvar' AS metric, count(lapvar) AS count, round(avg(lapvar), 6) AS mean, round(stddev(lapvar), 6) AS std, min(lapvar) AS min, max(lapvar) AS max,
      round(quantile_cont(lapvar, 0.25), 6) AS p25, round(quantile_cont(lapvar, 0.5), 6) AS p50, round(quantile_cont(lapvar, 0.75), 6) AS p75 FROM {variant_metrics}
    UNION ALL SELECT 'edge_density', count(edge_density), round(avg(edge_density), 6), round(stddev(edge_density), 6), min(edge_density), max(edge_density),
      round(quantile_cont(edge_density, 0.25), 6), round(quantile_cont(edge_density, 0.5), 6), round(quantile_cont(edge_density, 0.75), 6) FROM {variant_metrics}""")
def describe(spark, sf):
    return reports.describe(load(spark, sf, "variant_metrics"), ["lapvar", "edge_density"])


@query("a19_angle_histogram", """
    SELECT variant, least(CAST(floor((angle + 90) / 2.5E0) AS BIGINT), 71) AS bin, count(*) AS n FROM {variant_metrics} WHERE angle BETWEEN -90 AND 90 GROUP BY ALL""")
def histogram(spark, sf):
    return reports.value_histogram(load(spark, sf, "variant_metrics"), ["variant"], "angle", -90.0, 90.0, 72)


@query("a19_histogram_peak", """
    WITH h AS (SELECT variant, least(CAST(floor((angle + 90) / 2.5E0) AS BIGINT), 71) AS bin, count(*) AS n FROM {variant_metrics} WHERE angle BETWEEN -90 AND 90 GROUP BY ALL)
    SELECT variant, n, bin, -90 + (bin + 0.5E0) * 2.5E0 AS center FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY n DESC, bin) AS rn FROM h) WHERE rn = 1""")
def histogram_peak(spark, sf):
    return reports.histogram_peak(histogram(spark, sf), ["variant"], -90.0, 90.0, 72)


@query("k10_experiment_tables", "SELECT variant, CAST(count(*) AS VARCHAR) AS total FROM {variant_metrics} GROUP BY variant")
def experiment_tables(spark, sf):
    folder = run_folder(spark, "experiment")
    metrics = load(spark, sf, "variant_metrics")
    writers.write_experiment(metrics, reports.variant_summary(metrics), folder)
    return spark.read.option("header", True).csv(f"{folder}/summary").select("variant", "total")
