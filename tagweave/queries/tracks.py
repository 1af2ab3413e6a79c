"""Tracks: best crops, banks, votes, merging, association, time joins and the recognition jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.functions import quality as q
from tagweave.operators import fingerprints, labels as lb, ordering, reports, timejoin, tracking, voting
from tagweave.plans import recognition
from tagweave.queries.boxes import BEST_SCORE, BITS, FRAME, order
from tagweave.queries.inputs import load
from tagweave.queries.records import RULES, nv, sql_completeness, sql_price, sql_price_value
from tagweave.queries.registry import query
from tagweave.schema import BOX_COLUMNS, STRICT_COLUMNS, VOTED_COLUMNS

VOTED = VOTED_COLUMNS
TRACK = ["video_id", "track_no"]
O = "o1, o2, o3, frame_index"  # noqa: E741

# ---- best crops and banks -----------------------------------------------------------------

TRACKED = f"SELECT *, {BEST_SCORE} AS quality FROM {{detections}} WHERE track_id IS NOT NULL"


@query("w1_top_crops", f"""
    SELECT video_id, track_id, crop_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY quality DESC, frame_index, {O}) AS rank
    FROM ({TRACKED})) WHERE rank <= 3""")
def top_crops(spark, sf):
    rows = recognition.score_crops(load(spark, sf, "detections").filter(F.col("track_id").isNotNull()))
    top = ordering.top_per_group(rows, ["video_id", "track_id"], [F.desc("quality"), "frame_index", *order()], 3)
    return top.select("video_id", "track_id", "crop_id", "rank")


BEST = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY quality DESC, frame_index, {O}) AS rn
    FROM ({TRACKED})) WHERE rn = 1 AND quality >= 0.2"""


@query("a7_p9_p12_best_crop", f"SELECT video_id, track_id, crop_id, round(quality, 6) AS quality FROM ({BEST})")
def best_crop(spark, sf):
    best = recognition.best_crops(load(spark, sf, "detections"), [F.col("frame_index"), *order()])
    return best.select("video_id", "track_id", "crop_id", F.round("quality", 6).alias("quality"))


@query("w2_w3_deferred_bank", f"""
    SELECT video_id, track_id, crop_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY laplacian DESC, frame_index, {O}) AS rank
    FROM {{detections}} WHERE track_id IS NOT NULL) WHERE rank <= 5""")
def deferred_bank(spark, sf):
    rows = load(spark, sf, "detections").filter(F.col("track_id").isNotNull())
    bank = ordering.top_per_group(rows, ["video_id", "track_id"], [F.desc("laplacian"), "frame_index", *order()], 5)
    return bank.select("video_id", "track_id", "crop_id", "rank")


@query("w4_j12_first_sight", """
    SELECT d.video_id, d.frame_index, d.crop_id, d.track_id FROM {detections} d JOIN (SELECT video_id, track_id, min(frame_index) AS f FROM {detections}
      WHERE track_id IS NOT NULL GROUP BY ALL) m ON d.video_id = m.video_id AND d.track_id = m.track_id AND d.frame_index = m.f""")
def first_sight(spark, sf):
    rows = load(spark, sf, "detections").filter(F.col("track_id").isNotNull())
    return timejoin.first_seen(rows, ["video_id", "track_id"], "frame_index").select(
        "video_id", "frame_index", "crop_id", "track_id")


@query("w5_gap_sessions", """
    WITH f AS (SELECT DISTINCT video_id, track_id, frame_index FROM {detections} WHERE track_id IS NOT NULL),
    g AS (SELECT *, CASE WHEN frame_index - lag(frame_index) OVER (PARTITION BY video_id, track_id ORDER BY frame_index) <= 5 THEN NULL ELSE frame_index END AS s FROM f),
    w AS (SELECT *, max(s) OVER (PARTITION BY video_id, track_id ORDER BY frame_index) AS session FROM g)
    SELECT d.crop_id, w.session FROM {detections} d JOIN w ON d.video_id = w.video_id AND d.track_id = w.track_id AND d.frame_index = w.frame_index""")
def gaps(spark, sf):
    rows = load(spark, sf, "detections").filter(F.col("track_id").isNotNull())
    return timejoin.gap_sessions(rows, ["video_id", "track_id"], "frame_index", 5).select("crop_id", "session")


# ---- votes ----------------------------------------------------------------------------------

WEIGHT = ("CASE source WHEN 'qr' THEN 1.0E0 WHEN 'zxingcpp' THEN 0.95E0 WHEN 'pyzbar' THEN 0.92E0 WHEN 'opencv_qr' THEN 0.88E0 WHEN 'paddleocr' THEN 0.78E0 "
          "WHEN 'tesseract' THEN 0.68E0 WHEN 'regex' THEN 0.62E0 WHEN 'derived' THEN 0.45E0 WHEN 'yolo' THEN 0.35E0 WHEN 'qr_seed' THEN 0.35E0 ELSE 0.5E0 END")
LONG = " UNION ALL ".join(
    f"SELECT video_id, track_no, seq, '{c}' AS field, {RULES[c][0](c)} AS value, {nv(c)} NOT IN ('', 'нет') AND {RULES[c][1](c)} AS ok, "
    f"{'''CASE WHEN source = 'derived' THEN source ELSE 'qr' END''' if c.endswith('_qr') or c.startswith(('qr_', 'wholesale')) else '''CASE source WHEN '' THEN 'regex' ELSE source END'''} AS source, "
    f"least(1.0, score / 12) AS share FROM ob" for c in VOTED)
VOTES = f"""
    WITH ob AS (SELECT * FROM {{observations}}), l AS ({LONG}),
    c AS (SELECT video_id, track_no, seq, field, value, source, value = 'нет' OR ok AS validator_passed,
            CASE WHEN value = 'нет' THEN 0.05E0 ELSE greatest(0.0, least(1.0, share * {WEIGHT})) END AS confidence
          FROM l WHERE value <> '' AND (ok OR value = 'нет' OR field NOT IN ({', '.join(repr(c) for c in STRICT_COLUMNS)}))),
    s AS (SELECT video_id, track_no, field, value, round(CAST(sum(CAST(confidence AS DECIMAL(18,15))) AS DOUBLE) + least(0.35E0, 0.08E0 * (count(*) - 1))
            + CASE WHEN bool_or(validator_passed) THEN 0.15E0 ELSE 0 END + max({WEIGHT}), 12) AS score, count(*) AS votes, bool_or(validator_passed) AS validator_passed,
            array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, min(seq) AS first_seq FROM c GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_no, field ORDER BY value = 'нет', score DESC, first_seq) AS rn FROM s),
    v AS (SELECT video_id, track_no, field, value, CASE WHEN value = 'нет' THEN 0.05E0 ELSE least(1.0, score / votes) END AS confidence, votes, validator_passed, sources FROM b WHERE rn = 1)"""


@query("a2_vote_candidates", VOTES + " SELECT video_id, track_no, seq, field, value, source, validator_passed, round(confidence, 9) AS confidence FROM c")
def candidates(spark, sf):
    rows = voting.field_candidates(load(spark, sf, "observations"), TRACK, fields=VOTED)
    return rows.select(*TRACK, "seq", "field", "value", "source", "validator_passed", F.round("confidence", 9).alias("confidence"))


@query("a1_field_votes", VOTES + " SELECT video_id, track_no, field, value, round(confidence, 8) AS confidence, votes, validator_passed, sources FROM v")
def votes(spark, sf):
    rows = voting.vote_fields(voting.field_candidates(load(spark, sf, "observations"), TRACK, fields=VOTED), TRACK)
    return rows.withColumns({"confidence": F.round("confidence", 8), "sources": F.array_join("sources", ",")})


@query("a4_vote_summary", VOTES + """,
    t AS (SELECT video_id, track_no, field, value, votes, row_number() OVER (PARTITION BY video_id, track_no, field ORDER BY votes DESC, first_seq) AS r FROM s)
    SELECT v.video_id, v.track_no, v.field, v.value AS winner, CAST((SELECT sum(votes) FROM s WHERE s.video_id = v.video_id AND s.track_no = v.track_no AND s.field = v.field) AS BIGINT) AS candidate_count,
      (SELECT string_agg(value || ':' || votes, ', ' ORDER BY r) FROM t WHERE t.video_id = v.video_id AND t.track_no = v.track_no AND t.field = v.field AND r <= 5) AS top_values FROM v""")
def vote_summary(spark, sf):
    rows = voting.vote_summary(voting.field_candidates(load(spark, sf, "observations"), TRACK, fields=VOTED), TRACK)
    return rows.select(*TRACK, "field", "winner", "candidate_count", F.array_join("top_values", ", ").alias("top_values"))


def _merged(c: str) -> str:
    present = f"{nv(c)} NOT IN ('', 'нет')"
    return (f"coalesce(arg_max({nv(c)}, {{'n': length({nv(c)}), 's': -seq}}) FILTER ({present}), "
            f"max(CASE WHEN {nv(c)} = 'нет' THEN 'нет' END), '') AS {c}")


MERGED = f"SELECT video_id, track_no, {', '.join(_merged(c) for c in VOTED)} FROM ob GROUP BY video_id, track_no"


@query("a5_merge_values", f"WITH ob AS (SELECT * FROM {{observations}}) {MERGED}")
def merged(spark, sf):
    return voting.merge_values(load(spark, sf, "observations"), TRACK, VOTED)


@query("a3_voted_records", VOTES + f", m AS ({MERGED}), w AS (SELECT video_id, track_no, "
       + ", ".join(f"max(value) FILTER (field = '{c}') AS {c}" for c in VOTED)
       + " FROM v GROUP BY ALL) SELECT m.video_id, m.track_no, "
       + ", ".join(f"coalesce(w.{c}, m.{c}) AS {c}" for c in VOTED)
       + " FROM m LEFT JOIN w ON m.video_id = w.video_id AND m.track_no = w.track_no")
def voted(spark, sf):
    ob = load(spark, sf, "observations")
    rows = voting.voted_records(ob.drop("filename"), voting.field_candidates(ob, TRACK, fields=VOTED), TRACK, fields=VOTED)
    return rows.select(*TRACK, *VOTED)


@query("a6_frequent_value", """
    WITH v AS (SELECT track_no, seq, trim(regexp_replace(coalesce(product_name, ''), '[[:space:]]+', ' ', 'g')) AS t FROM {observations}),
    c AS (SELECT track_no, t, count(*) AS n, min(seq) AS s FROM v WHERE t <> '' GROUP BY ALL)
    SELECT track_no, product_name FROM (SELECT track_no, t AS product_name, row_number() OVER (PARTITION BY track_no ORDER BY n DESC, t <> 'нет' DESC, length(t) DESC, s) AS rn FROM c) WHERE rn = 1""")
def frequent(spark, sf):
    return voting.frequent_value(load(spark, sf, "observations"), ["track_no"], "product_name", "seq")


@query("a20_distinct_sources", """
    SELECT video_id, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM {observations} GROUP BY video_id""")
def sources(spark, sf):
    return load(spark, sf, "observations").groupBy("video_id").agg(
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("a25_track_summary", """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_no ORDER BY score DESC, seq) AS rn, count(*) OVER (PARTITION BY video_id, track_no) AS n FROM {observations}),
    s AS (SELECT video_id, track_no, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM r GROUP BY ALL)
    SELECT r.video_id, r.track_no, n AS observations, ts_ms AS best_timestamp, round(score, 3) AS best_score, x_min AS best_x_min, y_min AS best_y_min, sources
    FROM r JOIN s ON r.video_id = s.video_id AND r.track_no = s.track_no WHERE rn = 1""")
def track_summary(spark, sf):
    return reports.track_summary(load(spark, sf, "observations"), TRACK)


@query("p11_min_observations", "SELECT video_id, track_no, count(*) AS n FROM {observations} GROUP BY ALL HAVING count(*) >= 70")
def min_observations(spark, sf):
    return load(spark, sf, "observations").groupBy(*TRACK).agg(F.count("*").alias("n")).filter(F.col("n") >= 70)


@query("c3_observation_score", f"""
    SELECT seq, round(confidence * 2 + ({sql_completeness()}) + sharpness / 500, 6) AS observation_score FROM {{observations}}""")
def observation_score(spark, sf):
    ob = load(spark, sf, "observations")
    return ob.select("seq", F.round(q.observation_score(F.col("confidence"), q.completeness(), F.col("sharpness")), 6).alias("observation_score"))


# ---- association ------------------------------------------------------------------------------

@query("j6_r1_assign_tracks")
def assign(spark, sf):
    """Order-dependent walk; its check is the brute-force tracker in the tests."""
    ob = load(spark, sf, "observations").withColumn("track_id", F.when(F.col("seq") % 3 == 0, F.col("track_no") % 20)).drop("track_no")
    return tracking.assign_tracks(ob, "video_id", "seq").select("video_id", "seq", "part", "track_no")


def far_observations(spark, sf):
    """Every sighting has an id, and tags are far apart and bare of texts, so that tracks are the ids."""
    return load(spark, sf, "observations").select(
        "seq", "video_id", "frame_order", "score", F.col("track_no").alias("track_id"), (F.col("seq") % 5 == 0).alias("is_late"),
        *[(F.col(c) + (F.col("track_no") * 10_000 if c.startswith("x") else 0)).alias(c) for c in BOX_COLUMNS])


@query("j6_tracks_by_id", """
    SELECT video_id, seq, min(seq) OVER (PARTITION BY video_id, track_no) AS first_seq FROM {observations}""")
def tracks_by_id(spark, sf):
    tracked = tracking.assign_tracks(far_observations(spark, sf), "video_id", "seq")
    firsts = tracked.groupBy("video_id", "part", "track_no").agg(F.min("seq").alias("first_seq"))
    return tracked.join(firsts, ["video_id", "part", "track_no"]).select("video_id", "seq", "first_seq")


@query("j14_fingerprint_gate", f"""
    WITH RECURSIVE {BITS}, r AS (SELECT label, vec_id, hash, (vec_id * 7919 % 101) / 100.0E0 AS score, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM hashed),
    walk AS (SELECT label, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(id BIGINT, h VARCHAR, s DOUBLE)[]) AS kept FROM (SELECT DISTINCT label FROM r)
      UNION ALL SELECT w.label, w.rn + 1, CASE WHEN len(list_filter(w.kept, lambda k: k.s >= r.score
          AND list_sum(list_transform(range(1, 17), lambda i: bit_count(xor(CAST(position(substr(k.h, CAST(i AS INT), 1) IN '0123456789abcdef') - 1 AS INT), CAST(position(substr(r.hash, CAST(i AS INT), 1) IN '0123456789abcdef') - 1 AS INT))))) <= 20)) > 0
          THEN w.kept ELSE list_append(w.kept, {{'id': r.vec_id, 'h': r.hash, 's': r.score}}) END
      FROM walk w JOIN r ON r.label = w.label AND r.rn = w.rn + 1)
    SELECT label, unnest(list_transform(kept, lambda k: k.id)) AS vec_id FROM (SELECT label, arg_max(kept, rn) AS kept FROM walk GROUP BY label)""")
def gate(spark, sf):
    rows = load(spark, sf, "embeddings").select(
        "label", "vec_id", q.fingerprint_bits(F.col("embedding")).alias("bits"), (F.col("vec_id") * 7919 % 101 / 100.0).alias("score"))
    return fingerprints.gate_crops(rows, ["label"], "vec_id", "bits", "score", distance=20).select("label", "vec_id")


@query("j14_near_counts", """
    WITH h AS (SELECT video_id, phash, count(*) AS copies FROM {detections} WHERE phash IS NOT NULL GROUP BY ALL)
    SELECT a.video_id, a.phash, a.copies, CAST(coalesce(sum(b.copies), 0) AS BIGINT) AS near FROM h a LEFT JOIN h b
      ON a.video_id = b.video_id AND a.phash <> b.phash AND bit_count(xor(a.phash, b.phash)) <= 2 GROUP BY a.video_id, a.phash, a.copies""")
def near_counts(spark, sf):
    rows = load(spark, sf, "detections").filter(F.col("phash").isNotNull())
    return fingerprints.near_duplicate_counts(rows, ["video_id"], "phash").withColumn("near", F.col("near").cast("bigint"))


# ---- time joins -------------------------------------------------------------------------------

LABEL_TIMES = "SELECT DISTINCT video_id, ts_ms + CAST(o2 % 37 AS BIGINT) AS at_ms FROM {detections}"


def label_times(spark, sf):
    return load(spark, sf, "detections").select("video_id", (F.col("ts_ms") + F.col("o2") % 37).alias("at_ms")).distinct()


@query("j8_sharpest_frame", f"""
    SELECT video_id, at_ms, ts_ms, sharpness FROM (SELECT l.video_id, at_ms, ts_ms, sharpness, row_number() OVER (PARTITION BY l.video_id, at_ms ORDER BY sharpness DESC, ts_ms) AS rn
    FROM ({LABEL_TIMES}) l JOIN {{frames}} f ON f.video_id = l.video_id AND f.ts_ms BETWEEN at_ms - 200 AND at_ms + 200) WHERE rn = 1""")
def sharpest(spark, sf):
    frames = load(spark, sf, "frames").select("video_id", "ts_ms", "sharpness")
    return timejoin.sharpest_frame(label_times(spark, sf), frames, ["video_id"], "at_ms", "ts_ms", "sharpness", 40.0, 5)


@query("j9_frame_at_time", f"""
    SELECT video_id, at_ms, ts_ms FROM (SELECT l.video_id, at_ms, ts_ms, row_number() OVER (PARTITION BY l.video_id, at_ms ORDER BY abs(ts_ms - at_ms), ts_ms) AS rn
    FROM ({LABEL_TIMES}) l JOIN {{frames}} f ON f.video_id = l.video_id AND f.ts_ms BETWEEN at_ms - 100 AND at_ms + 100) WHERE rn = 1""")
def frame_at(spark, sf):
    frames = load(spark, sf, "frames").select("video_id", "ts_ms")
    return timejoin.frame_at(label_times(spark, sf), frames, ["video_id"], "at_ms", "ts_ms", 100.0)


STEPS = """SELECT video_id, frame_index, crop_id, CASE WHEN n < 4 THEN -1 ELSE 1 END AS direction, n % 4 + 1 AS step,
    ((o2 * 31 + o3 * 17 + n * 13) % 100) / 100.0E0 AS score, (o2 + n) % 17 <> 0 AS box_ok FROM {detections} {each:0,1,2,3,4,5,6,7}"""


def steps(spark, sf):
    n = F.col("n")
    rows = load(spark, sf, "detections").select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("n"))
    return rows.select("video_id", "frame_index", "crop_id", F.when(n < 4, -1).otherwise(1).alias("direction"),
                       (n % 4 + 1).alias("step"), ((F.col("o2") * 31 + F.col("o3") * 17 + n * 13) % 100 / 100.0).alias("score"),
                       ((F.col("o2") + n) % 17 != 0).alias("box_ok"))


@query("j10_propagate_chain", f"""
    WITH s AS (SELECT video_id, frame_index, direction, step, min(score) AS quality, count(*) FILTER (box_ok) AS boxes FROM ({STEPS}) GROUP BY ALL)
    SELECT video_id, frame_index, direction, step, quality, boxes, min(CAST(boxes > 0 AND quality >= 0.1E0 AS INT)) OVER (PARTITION BY video_id, frame_index, direction ORDER BY step) = 1 AS reached FROM s""")
def propagate(spark, sf):
    return timejoin.propagate_chain(steps(spark, sf), FRAME, 0.1).drop("ok")


@query("j10_propagate_direct", f"SELECT crop_id, direction, step FROM ({STEPS}) WHERE score >= 0.42E0 AND abs(direction * step * 10) >= 20")
def propagate_direct(spark, sf):
    rows = steps(spark, sf).withColumn("t", F.col("direction") * F.col("step") * 10).withColumn("t0", F.lit(0))
    return timejoin.propagate_direct(rows, "t", "t0", 40.0, 0.42).select("crop_id", "direction", "step")


# ---- counters and order -------------------------------------------------------------------------

@query("a22_run_counters", f"""
    SELECT f.video_id, frames_seen, detections_seen, rows FROM (SELECT video_id, count(*) AS frames_seen FROM {{frames}} GROUP BY ALL) f
    JOIN (SELECT video_id, count(*) AS detections_seen FROM {{detections}} GROUP BY ALL) d ON d.video_id = f.video_id
    JOIN (SELECT video_id, count(*) AS rows FROM ({BEST}) GROUP BY ALL) r ON r.video_id = f.video_id""")
def counters(spark, sf):
    d = load(spark, sf, "detections")
    best = recognition.best_crops(d, [F.col("frame_index"), *order()])
    return reports.run_counters(load(spark, sf, "frames"), d, best, "video_id")


@query("w7_frame_ids", """
    SELECT video_id, frame_index, row_number() OVER (ORDER BY video_id, frame_index) - 1 AS frame_id FROM (SELECT DISTINCT video_id, frame_index FROM {detections})""")
def frame_ids(spark, sf):
    rows = load(spark, sf, "detections").select(*FRAME).distinct()
    return lb.number_frames(rows, [F.col("video_id"), F.col("frame_index")])


# ---- jobs ---------------------------------------------------------------------------------------

def evidence_of(spark, sf) -> recognition.Evidence:
    lines = load(spark, sf, "tag_lines")
    payloads = load(spark, sf, "payloads")
    replies = payloads.select("crop_id", F.concat(
        F.lit('{"product_name": "Товар '), F.col("o2").cast("string"), F.lit('", "price_card": null}')).alias("raw"))
    codes = payloads.filter(F.col("o2") % 4 == 0).select("crop_id", F.concat(F.lit("46"), F.lpad(F.col("o2").cast("string"), 11, "0")).alias("barcode"))
    return recognition.Evidence(lines, payloads, replies, codes)


@query("e2_recognize_tracks")
def recognize_tracks(spark, sf):
    return recognition.recognize_tracks(load(spark, sf, "frames"), load(spark, sf, "detections"), evidence_of(spark, sf),
                                        [F.col("frame_index"), *order()], sample_fps=10.0)


@query("e1_recognize_labeled")
def recognize_labeled(spark, sf):
    d = load(spark, sf, "detections")
    labels = d.select("crop_id", "video_id", F.col("ts_ms").alias("frame_timestamp"), *BOX_COLUMNS)
    frames = load(spark, sf, "frames").select("video_id", "ts_ms", "sharpness")
    return recognition.recognize_labeled(labels, frames, d, evidence_of(spark, sf), reach=5)


@query("e3_fuse_observations")
def fuse(spark, sf):
    d = load(spark, sf, "detections")
    tracked = d.filter(F.col("status") == "F").withColumn("source", F.lit("bytetrack:yolo"))
    extra = d.filter(F.col("status") == "O").withColumn("track_id", F.lit(None).cast("bigint"))
    frames = load(spark, sf, "frames")
    rules = recognition.FusionRules(sample_fps=10.0)
    keep = [c for c in d.columns if c not in ("ts_ms",)]
    tracked, extra = (x.select(*keep, "ts_ms") for x in (tracked, extra))
    return recognition.fuse_observations(frames, tracked, extra, evidence_of(spark, sf), order(), rules)


@query("min_slice_voted_price", f"""
    WITH b AS ({BEST}), p AS (SELECT d.video_id, d.track_id, {sql_price('r.price_default')} AS price, 0.5E0 AS w, least(1.0, d.confidence * 10 / 12) * 0.5E0 AS conf, d.frame_index * 10 + d.o1 AS seq
      FROM {{detections}} d JOIN {{raw_records}} r ON d.crop_id = r.crop_id WHERE d.track_id IS NOT NULL AND ({sql_price_value('r.price_default')}) > 0),
    s AS (SELECT video_id, track_id, price, round(CAST(sum(CAST(conf AS DECIMAL(18,15))) AS DOUBLE) + least(0.35E0, 0.08E0 * (count(*) - 1)) + 0.15E0 + 0.5E0, 12) AS score, min(seq) AS q FROM p GROUP BY ALL),
    v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY score DESC, q) AS rn FROM s) WHERE rn = 1)
    SELECT b.video_id, b.track_id, b.crop_id, round(b.quality, 6) AS quality, coalesce(v.price, '') AS price_default FROM b LEFT JOIN v ON b.video_id = v.video_id AND b.track_id = v.track_id""")
def voted_price(spark, sf):
    """Best crop per track with the voted price of all its sightings."""
    d = load(spark, sf, "detections").filter(F.col("track_id").isNotNull())
    best = recognition.best_crops(d, [F.col("frame_index"), *order()])
    prices = load(spark, sf, "raw_records").select("crop_id", "price_default")
    ob = d.join(prices, "crop_id").select(
        "video_id", "track_id", (F.col("frame_index") * 10 + F.col("o1")).alias("seq"), F.lit("bytetrack:yolo").alias("source"),
        (F.col("confidence") * 10).alias("score"), "price_default")
    keys = ["video_id", "track_id"]
    votes = voting.vote_fields(voting.field_candidates(ob, keys, fields=["price_default"]), keys).filter(F.col("value") != "нет")
    return best.select(*keys, "crop_id", F.round("quality", 6).alias("quality")).join(
        votes.select(*keys, F.col("value").alias("price_default")), keys, "left").withColumn(
        "price_default", F.coalesce("price_default", F.lit("")))
