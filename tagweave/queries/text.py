"""Text lines, payloads and model replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.functions import prices as x, text as t
from tagweave.operators import evidence as ev, payloads as pl
from tagweave.queries.inputs import load
from tagweave.plans.recognition import READ_COLUMNS
from tagweave.queries.registry import query
from tagweave.schema import FUSION_INFO_WORDS, PAYLOAD_COLUMNS, VOTED_COLUMNS

# ---- rules on whole texts -----------------------------------------------------------------

# Doubling every non-digit gives each number its own borders, which stand in for look-arounds.
APART = "regexp_replace(text, '([^0-9])', '\\1\\1', 'g')"


def first_number(low: int, high: int) -> str:
    return f"regexp_extract(text, '(?:^|[^0-9])([0-9]{{{low},{high}}})(?:[^0-9]|$)', 1)"


BARCODE = f"CASE WHEN {first_number(13, 13)} <> '' THEN {first_number(13, 13)} ELSE {first_number(8, 14)} END"


@query("x3_barcode_text", f"SELECT doc_id, {BARCODE} AS barcode FROM documents")
def barcode_text(spark, sf):
    return load(spark, sf, "documents").select("doc_id", x.fusion_barcode(F.col("text")).alias("barcode"))


@query("x4_sku_text", f"""
    WITH b AS (SELECT doc_id, text, {BARCODE} AS barcode FROM documents)
    SELECT doc_id, coalesce(list_filter(regexp_extract_all({APART}, '(?:^|[^0-9])([0-9]{{12}})(?:[^0-9]|$)', 1), lambda s: s <> barcode)[1], '') AS sku FROM b""")
def sku_text(spark, sf):
    rows = load(spark, sf, "documents").withColumn("b", x.fusion_barcode(F.col("text")))
    return rows.select("doc_id", x.fusion_sku(F.col("text"), F.col("b")).alias("sku"))


@query("x4_sku_best_crop", f"""
    WITH n AS (SELECT doc_id, regexp_extract_all({APART}, '(?:^|[^0-9])([0-9]{{9,13}})(?:[^0-9]|$)', 1) AS n FROM documents)
    SELECT doc_id, coalesce(list_filter(n, lambda s: length(s) >= 10 AND substr(s, 1, 1) IN ('2', '3'))[1], n[1], '') AS sku FROM n""")
def sku_best(spark, sf):
    return load(spark, sf, "documents").select("doc_id", x.tag_sku(F.col("text"), F.lit("")).alias("sku"))


@query("x5_times_and_codes", r"""
    SELECT doc_id, regexp_extract(text, '([0-9]{2}[./-][0-9]{2}[./-][0-9]{4}\s+[0-9]{1,2}:[0-9]{2})', 1) AS printed,
           regexp_extract(text, '([0-9]{2}[.][0-9]{2}[.][0-9]{4}\s+[0-9]{1,2}[:.][0-9]{2})', 1) AS dotted,
           replace(regexp_extract(text, '([0-9]{2}_[0-9]{6}\s*-\s*[0-9]{6})', 1), ' ', '') AS zone FROM documents""")
def times(spark, sf):
    text = F.col("text")
    return load(spark, sf, "documents").select(
        "doc_id", F.regexp_extract(text, x.TIME, 1).alias("printed"), F.regexp_extract(text, x.FUSION_TIME, 1).alias("dotted"),
        x.tag_zone_code(text).alias("zone"))


@query("x6_info_words", "SELECT crop_id, line_no, CASE " + " ".join(
    f"WHEN contains(lower(text), '{w}') THEN '{w[:1].upper() + w[1:]}'" for w in FUSION_INFO_WORDS) + " ELSE '' END AS info, "
    "concat_ws('; ', " + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in
                                   ["сухое", "полусухое", "полусладкое", "сладкое", "брют", "экстра"]) + ") AS best FROM {tag_lines}")
def info_words(spark, sf):
    return load(spark, sf, "tag_lines").select("crop_id", "line_no", x.fusion_info(F.col("text")).alias("info"),
                                               x.tag_info(F.col("text")).alias("best"))


@query("x7_symbols", """
    SELECT crop_id, line_no, upper(regexp_extract(replace(text, '|', ' '), '(?:^|\\s)([ШшКкЛл])(?:\\s|$)', 1)) AS symbol FROM {tag_lines}""")
def symbols(spark, sf):
    return load(spark, sf, "tag_lines").select("crop_id", "line_no", x.tag_symbol(F.col("text")).alias("symbol"))


@query("x10_discount_text", r"""
    WITH d AS (SELECT doc_id AS id, text FROM documents), f AS (SELECT id, replace(regexp_replace(regexp_extract(text, '[-−]?\s*[0-9]{1,3}\s*%'), '\s+', '', 'g'), '−', '-') AS m,
      regexp_extract(text, '[-−–]?\s*([0-9]{1,3})\s*%', 1) AS n FROM d)
    SELECT id, CASE WHEN m = '' OR starts_with(m, '-') THEN m ELSE '-' || m END AS fusion, CASE WHEN n = '' THEN '' ELSE '-' || n || '%' END AS best FROM f""")
def discounts(spark, sf):
    return load(spark, sf, "documents").select(F.col("doc_id").alias("id"), x.fusion_discount(F.col("text")).alias("fusion"),
                                               x.tag_discount(F.col("text")).alias("best"))


@query("x1_fusion_prices")
def fusion_prices(spark, sf):
    rows = load(spark, sf, "documents").withColumn("p", x.fusion_prices(F.col("text")))
    return rows.select("doc_id", F.size("p").alias("prices"), x.price_at(F.col("p"), True).alias("largest"),
                       x.price_at(F.col("p"), False).alias("smallest"))


@query("x2_tag_prices")
def tag_prices(spark, sf):
    return load(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_join(x.tag_prices(F.col("text")), " ").alias("prices"))


# Prices in tag lines, whose shapes are known: a price line, and for the tag rules numbers of four digits or more
# and the year and hour of a printed date, which read like a price with a blank.
WHOLE, CENTS = "CAST(10 + o2 % 900 AS VARCHAR)", "lpad(CAST(o2 % 100 AS VARCHAR), 2, '0')"
SPLIT = "CAST({0} // 100 AS VARCHAR) || '.' || lpad(CAST({0} % 100 AS VARCHAR), 2, '0')"


@query("x1_line_prices", f"SELECT crop_id, line_no, CASE WHEN line_no = 1 THEN {WHOLE} || ',' || {CENTS} ELSE '' END AS prices FROM {{tag_lines}}")
def fusion_line_prices(spark, sf):
    return load(spark, sf, "tag_lines").select("crop_id", "line_no", F.array_join(x.fusion_prices(F.col("text")), " ").alias("prices"))


@query("x2_line_prices", f"""
    SELECT crop_id, line_no, CASE WHEN line_no = 1 THEN {WHOLE} || '.' || {CENTS}
      WHEN line_no = 0 AND o2 % 3 = 0 AND o3 >= 1000 THEN {SPLIT.format('o3')}
      WHEN line_no = 2 AND o2 % 4 = 1 AND o3 % 24 >= 10 THEN '2026.' || CAST(o3 % 24 AS VARCHAR)
      WHEN line_no = 2 AND o2 % 4 = 3 AND o3 + 12 >= 1000 THEN {SPLIT.format('(o3 + 12)')} ELSE '' END AS prices FROM {{tag_lines}}""")
def tag_line_prices(spark, sf):
    return load(spark, sf, "tag_lines").select("crop_id", "line_no", F.array_join(x.tag_prices(F.col("text")), " ").alias("prices"))


@query("x8_product_lines", """
    SELECT crop_id, line_no, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' .,:;|-') AS clean FROM {tag_lines}""")
def product_lines(spark, sf):
    return load(spark, sf, "tag_lines").select("crop_id", "line_no", x.clean_product_line(F.col("text")).alias("clean"))


@query("x9_tag_product", """
    WITH l AS (SELECT crop_id, line_no, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM {tag_lines}),
    g AS (SELECT crop_id, line_no, s FROM l WHERE regexp_matches(s, '[а-яА-ЯёЁ]{3}') AND NOT contains(s, 'руб'))
    SELECT crop_id, string_agg(s, ' ' ORDER BY line_no) AS product_name FROM g GROUP BY crop_id""")
def tag_product(spark, sf):
    """Product name per crop from its first product lines (at most two of the four are)."""
    lines = load(spark, sf, "tag_lines").filter(x.is_product_line(F.col("text")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("line_no", t.squeeze(F.col("text")).alias("s")))), lambda r: r.s)
    return lines.groupBy("crop_id").agg(x.clean_tag_product(F.array_join(F.slice(rows, 1, 3), " ")).alias("product_name"))


# ---- lines ----------------------------------------------------------------------------------

@query("w9_distinct_lines", """
    SELECT crop_id, line_no, text FROM (SELECT *, row_number() OVER (PARTITION BY crop_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) ORDER BY confidence DESC, line_no) AS rn
    FROM {tag_lines}) WHERE rn = 1""")
def distinct_lines(spark, sf):
    return ev.distinct_lines(load(spark, sf, "tag_lines", spread=True).select(*READ_COLUMNS), ["crop_id"]).select("crop_id", "line_no", "text")


@query("w10_distinct_words", """
    SELECT crop_id, line_no, text FROM (SELECT *, regexp_replace(lower(text), '[^0-9a-zа-яё_]+', '', 'g') AS k, row_number() OVER (PARTITION BY crop_id,
      regexp_replace(lower(text), '[^0-9a-zа-яё_]+', '', 'g') ORDER BY confidence DESC, line_no) AS rn FROM {tag_lines}) WHERE rn = 1 AND k <> ''""")
def distinct_words(spark, sf):
    return ev.distinct_words(load(spark, sf, "tag_lines", spread=True).select(*READ_COLUMNS), ["crop_id"]).select("crop_id", "line_no", "text")


@query("w8_neighbour_prices", """
    WITH n AS (SELECT crop_id, line_no, text, lead(text) OVER (PARTITION BY crop_id ORDER BY line_no) AS nx FROM {tag_lines})
    SELECT crop_id, line_no, CAST(CAST(text AS BIGINT) AS VARCHAR) || '.' || nx AS price FROM n
    WHERE regexp_matches(text, '^[0-9]{1,5}$') AND regexp_matches(nx, '^[0-9]{2}$') AND CAST(text AS BIGINT) >= 2""")
def neighbour_prices(spark, sf):
    return ev.neighbour_prices(load(spark, sf, "tag_lines"), ["crop_id"])


@query("x13_zone_lines", """
    SELECT crop_id, line_no, round(confidence * CASE WHEN zone = 'full' THEN 1 ELSE 0.97E0 END, 6) AS confidence,
           source || CASE WHEN zone = 'full' THEN '' ELSE ':zone=' || zone END AS source FROM {tag_lines}""")
def zone_lines(spark, sf):
    rows = ev.tag_zone_lines(load(spark, sf, "tag_lines"))
    return rows.select("crop_id", "line_no", F.round("confidence", 6).alias("confidence"), "source")


@query("x14_flatten_reader_output", """
    SELECT crop_id, line_no, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, round(confidence, 2) AS confidence FROM {tag_lines}""")
def flatten_output(spark, sf):
    """Lines stored as either JSON layout of a text reader, read back as rows."""
    lines = load(spark, sf, "tag_lines").withColumn("c", F.round("confidence", 2))
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text", "c")))
    new = F.to_json(F.array(F.struct(F.transform(rows, lambda r: r.text).alias("rec_texts"),
                                     F.transform(rows, lambda r: r.c).alias("rec_scores"))))
    old = F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: F.concat(
        F.lit("[[[0,0],[1,1]],"), F.to_json(F.array(r.text, r.c.cast("string"))), F.lit("]"))), ","), F.lit("]"))
    kept = lines.groupBy("crop_id", "o2").agg(new.alias("new"), old.alias("old"))
    raw = kept.select("crop_id", F.when(F.col("o2") % 2 == 0, F.col("new")).otherwise(F.col("old")).alias("raw"))
    return ev.flatten_page_results(raw, ["crop_id"])


BANDS = "CASE WHEN y_rel < 0.35 THEN 'top' WHEN y_rel < 0.65 THEN 'mid' ELSE 'bottom' END"


@query("x15_text_bands", f"SELECT crop_id, line_no, {BANDS} AS band, text FROM {{tag_lines}} WHERE confidence >= 0.35")
def text_bands(spark, sf):
    return ev.text_bands(load(spark, sf, "tag_lines"), ["crop_id"]).select("crop_id", "line_no", "band", "text")


@query("o11_band_texts", f"""
    SELECT crop_id, {BANDS} AS band, string_agg(text, ' | ' ORDER BY y_rel, line_no) AS text FROM {{tag_lines}} WHERE confidence >= 0.35 GROUP BY ALL""")
def band_texts(spark, sf):
    return ev.band_texts(ev.text_bands(load(spark, sf, "tag_lines"), ["crop_id"]), ["crop_id"])


@query("f4_extract_fusion")
def extract_fusion(spark, sf):
    lines = ev.distinct_lines(load(spark, sf, "tag_lines", spread=True).select(*READ_COLUMNS), ["crop_id"], together=True)
    parsed = pl.parse_payloads(load(spark, sf, "payloads", spread=True), ["crop_id", "payload_no"])
    merged = pl.merge_payload_fields(parsed, ["crop_id"], "payload_no", "first")
    return ev.extract_fusion(lines, merged, ["crop_id"]).select("crop_id", *VOTED_COLUMNS)


@query("f4_extract_best_crop")
def extract_best_crop(spark, sf):
    lines = ev.distinct_words(load(spark, sf, "tag_lines", spread=True).select(*READ_COLUMNS), ["crop_id"], together=True)
    return ev.extract_best_crop(lines, None, ["crop_id"]).select("crop_id", *VOTED_COLUMNS)


# ---- payloads ---------------------------------------------------------------------------------

# Expected fields per kind of payload, worked out by hand from the rules.
CODE2, CODE3 = "CAST(4600000000000 + o2 AS VARCHAR)", "CAST(4600000000000 + o3 AS VARCHAR)"
LENIENT = f"""
    SELECT crop_id, payload_no, CASE o2 % 6 WHEN 3 THEN 'нет' WHEN 1 THEN {CODE3} WHEN 5 THEN CAST(o3 AS VARCHAR) ELSE {CODE2} END AS qr_code_barcode,
      CASE o2 % 6 WHEN 0 THEN CAST(100 + o3 % 400 AS VARCHAR) || '.5' WHEN 1 THEN CAST(o3 AS VARCHAR) || '%2C90' WHEN 2 THEN '252.5' WHEN 3 THEN CAST(o2 AS VARCHAR) WHEN 4 THEN 'нет' ELSE '3' END AS price1_qr,
      'нет' AS price2_qr, 'нет' AS price3_qr, CASE o2 % 6 WHEN 2 THEN '129.99' WHEN 3 THEN '129' ELSE 'нет' END AS price4_qr,
      'нет' AS wholesale_level_1_count, 'нет' AS wholesale_level_1_price, 'нет' AS wholesale_level_2_count, 'нет' AS wholesale_level_2_price, 'нет' AS action_price_qr,
      CASE o2 % 6 WHEN 1 THEN 'A+1' WHEN 3 THEN 'Z' || CAST(o3 % 7 AS VARCHAR) ELSE 'нет' END AS action_code_qr FROM {{payloads}}"""
STRICT = f"""
    SELECT crop_id, payload_no, CASE o2 % 6 WHEN 0 THEN {CODE2} WHEN 5 THEN CAST(o3 AS VARCHAR) ELSE '' END AS qr_code_barcode,
      CASE o2 % 6 WHEN 0 THEN CAST(100 + o3 % 400 AS VARCHAR) || '.5' WHEN 1 THEN CAST(o3 AS VARCHAR) || ',90' WHEN 5 THEN '3' ELSE '' END AS price1_qr,
      '' AS price2_qr, '' AS price3_qr, '' AS price4_qr, '' AS wholesale_level_1_count, '' AS wholesale_level_1_price, '' AS wholesale_level_2_count,
      '' AS wholesale_level_2_price, '' AS action_price_qr, CASE o2 % 6 WHEN 1 THEN 'A 1' ELSE '' END AS action_code_qr FROM {{payloads}}"""


@query("q1_q2_lenient_payloads", LENIENT)
def lenient(spark, sf):
    return pl.parse_payloads(load(spark, sf, "payloads", spread=True), ["crop_id", "payload_no"]).drop("raw")


@query("q3_strict_payloads", STRICT)
def strict(spark, sf):
    return pl.parse_payloads_strict(load(spark, sf, "payloads"), ["crop_id", "payload_no"]).drop("raw")


@query("q1_page_links", """
    SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), ''), '') AS page,
           coalesce(nullif(regexp_extract(url, '[?&]ref=([a-z]+)', 1), ''), '') AS ref FROM pages""")
def page_links(spark, sf):
    query_text = F.regexp_extract("url", r"\?([^#]*)", 1)
    rows = load(spark, sf, "pages").withColumn("p", pl.query_pairs(query_text, False))
    pick = lambda k: F.coalesce(F.get(F.filter("p", lambda e: e.k == k), F.lit(0)).v, F.lit(""))
    return rows.select("page_id", pick("page").alias("page"), pick("ref").alias("ref"))


def _per_frame(rows):
    """Payloads grouped by order, several per key."""
    return rows.withColumn("order_key", F.substring_index("crop_id", "-", 1))


MERGE_SQL = "SELECT order_key, {cols} FROM (SELECT split_part(crop_id, '-', 1) AS order_key, o2 * 100000 + o3 AS pos, * FROM ({src})) GROUP BY order_key"


def merge_sql(kind: str, base: str) -> str:
    rank = "payload_no * 100000000000 + pos"
    cols = []
    for c in PAYLOAD_COLUMNS:
        usable = f"{c} NOT IN ('', 'нет')" if kind == "first" else f"{c} <> ''"
        fn = "arg_max" if kind == "last" else "arg_min"
        cols.append(f"coalesce({fn}({c}, {rank}) FILTER ({usable}), '') AS {c}")
    return MERGE_SQL.format(cols=", ".join(cols), src=base.replace("SELECT crop_id, payload_no,", "SELECT crop_id, payload_no, o2, o3,"))


def merged(spark, sf, rule, strict_rules):
    rows = load(spark, sf, "payloads")
    parse = pl.parse_payloads_strict if strict_rules else pl.parse_payloads
    parsed = _per_frame(parse(rows, ["crop_id", "payload_no", "o2", "o3"]))
    parsed = parsed.withColumn("pos", F.col("payload_no") * 100000000000 + F.col("o2") * 100000 + F.col("o3"))
    return pl.merge_payload_fields(parsed, ["order_key"], "pos", rule)


@query("a21_first_present", merge_sql("first", LENIENT))
def merge_first(spark, sf):
    return merged(spark, sf, "first", False)


@query("a21_last_wins", merge_sql("last", STRICT))
def merge_last(spark, sf):
    return merged(spark, sf, "last", True)


@query("a21_fill_if_empty", merge_sql("fill", STRICT))
def merge_fill(spark, sf):
    return merged(spark, sf, "fill", True)


@query("w11_distinct_payloads", """
    SELECT split_part(crop_id, '-', 1) AS order_key, raw, min(payload_no) AS payload_no FROM {payloads} GROUP BY ALL""")
def distinct_payloads(spark, sf):
    return pl.distinct_payloads(_per_frame(load(spark, sf, "payloads")), ["order_key"], "payload_no")


@query("t2_region_or_whole", """
    WITH p AS (SELECT split_part(crop_id, '-', 1) AS order_key, raw, max(in_region) AS r FROM {payloads} GROUP BY ALL),
    m AS (SELECT *, max(r) OVER (PARTITION BY order_key) AS any_r FROM p) SELECT order_key, raw FROM m WHERE r = any_r""")
def region_or_whole(spark, sf):
    return pl.region_or_whole(_per_frame(load(spark, sf, "payloads")), ["order_key"])


# ---- replies ------------------------------------------------------------------------------------

REPLIES = """
    SELECT reply_id, CASE reply_id % 6 WHEN 2 THEN 'a } b' WHEN 3 THEN '' WHEN 4 THEN '' WHEN 5 THEN '' ELSE p_name END AS product_name,
      CASE reply_id % 6 WHEN 0 THEN CAST(p_size AS VARCHAR) || '.5' WHEN 4 THEN CAST(p_size AS VARCHAR) ELSE '' END AS price_card, '' AS price_default,
      CASE reply_id % 6 WHEN 2 THEN '-' || CAST(p_size AS VARCHAR) || '%' ELSE '' END AS discount_amount,
      CASE reply_id % 6 WHEN 1 THEN p_brand || '; new' ELSE '' END AS additional_info,
      CASE reply_id % 6 WHEN 3 THEN 'no_object' WHEN 5 THEN 'bad_json' ELSE 'ok' END AS status FROM {replies}"""


@query("q4_f6_parse_replies", REPLIES)
def replies(spark, sf):
    return ev.parse_replies(load(spark, sf, "replies"), ["reply_id"])


@query("f6_reply_status", f"SELECT status, count(*) AS replies FROM ({REPLIES}) GROUP BY status")
def reply_status(spark, sf):
    return ev.reply_status_counts(ev.parse_replies(load(spark, sf, "replies"), ["reply_id"]))


@query("n21_p17_assemble_rows", """
    WITH r AS (SELECT * FROM {detections}), p AS (SELECT crop_id, o2, o3 FROM r)
    SELECT r.crop_id, CASE WHEN o2 % 7 = 0 THEN 'reply' WHEN o2 % 2 = 0 THEN 'text' ELSE '' END AS product_name,
      CASE WHEN o3 % 3 = 0 THEN '4600000000017' WHEN o2 % 4 = 0 THEN '4600000000024' ELSE '' END AS barcode, 'нет' AS code,
      CASE WHEN o3 % 3 = 0 THEN '1.5' ELSE '' END AS price1_qr, printf('%.3f', confidence) AS _quality, CAST(x_min AS VARCHAR) AS x_min FROM r""")
def assemble(spark, sf):
    d = load(spark, sf, "detections")
    crops = d.select("crop_id", F.col("confidence").alias("quality"), "x_min")
    reply = d.filter(F.col("o2") % 7 == 0).select("crop_id", F.lit("reply").alias("product_name"))
    text = d.select("crop_id", F.when(F.col("o2") % 2 == 0, " text ").otherwise("").alias("product_name"),
                    F.when(F.col("o3") % 3 == 0, "4600000000017").otherwise("").alias("barcode"))
    fields = ev.merge_reply_and_text(reply, text, ["crop_id"])
    payload = d.filter(F.col("o3") % 3 == 0).select("crop_id", *[
        F.lit("1.5" if c == "price1_qr" else "").alias(c) for c in PAYLOAD_COLUMNS])
    codes = d.filter(F.col("o2") % 4 == 0).select("crop_id", F.lit("4600000000024").alias("barcode"))
    rows = ev.assemble_rows(crops, fields, payload, codes, ["crop_id"])
    return rows.select("crop_id", "product_name", "barcode", "code", "price1_qr", "_quality", "x_min")
