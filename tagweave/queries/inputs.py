"""Input tables of the jobs, derived from the given tables.

Each is one SELECT in the dialect Spark and DuckDB share, so that a query and its check read the
same rows. ``{name}`` stands for a given table or for another input.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

INPUTS = {
    # One row per sampled camera frame.
    "frames": """
        SELECT o_orderkey % 8 AS video_id, CAST(floor(o_orderkey / 8) AS BIGINT) AS frame_index,
               CAST(floor(o_orderkey / 8) AS BIGINT) * 40 AS ts_ms,
               CAST(20 + 5 * ((o_orderkey % 8) % 3) AS DOUBLE) AS fps, 160 AS width, 120 AS height,
               o_totalprice / 1000 AS sharpness, o_custkey AS frame_count,
               (o_custkey * 13 % 400) / 1000 AS rail_score
        FROM {orders}""",
    # One row per detected box.
    "detections": """
        SELECT l_orderkey % 8 AS video_id, CAST(floor(l_orderkey / 8) AS BIGINT) AS frame_index,
               CAST(floor(l_orderkey / 8) AS BIGINT) * 40 AS ts_ms,
               CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' ||
               CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' ||
               CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING) AS crop_id,
               CAST(l_linenumber AS BIGINT) AS o1, l_partkey AS o2, l_suppkey AS o3,
               CAST(l_partkey * 7919 % 97 AS DOUBLE) AS x_min,
               CAST(l_suppkey * 104729 % 61 AS DOUBLE) AS y_min,
               CAST(l_partkey * 7919 % 97 AS DOUBLE) + 20 + l_quantity AS x_max,
               CAST(l_suppkey * 104729 % 61 AS DOUBLE) + 15 + l_partkey % 40 AS y_max,
               0.05 + 9 * l_discount AS confidence,
               CASE l_partkey % 4 WHEN 0 THEN 'color_red' WHEN 1 THEN 'yolo' WHEN 2 THEN 'color_white'
                    ELSE 'qr_seed' END AS source,
               CASE l_suppkey % 5 WHEN 0 THEN 'yellow' WHEN 1 THEN 'red' ELSE 'price_tag' END AS label,
               CAST(l_partkey % 12 AS INT) AS class_id,
               CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_suppkey END AS track_id,
               l_extendedprice / 50 AS laplacian, 1 + l_tax * 10 AS block_artifact,
               l_quantity / 80 AS high_frequency, l_extendedprice / 200 AS sharpness,
               CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_partkey % 256 END AS phash,
               l_returnflag AS flag, l_linestatus AS status
        FROM {lineitem}""",
    # Text lines read on the crop of a box, four lines per crop.
    "tag_lines": """
        SELECT crop_id, n AS line_no, confidence,
               CASE WHEN n % 2 = 0 THEN 'full' ELSE 'lower' END AS zone, 'paddleocr' AS source,
               (n * 25 + o2 % 20) / 120.0E0 AS y_rel, o2, o3,
               CASE n WHEN 0 THEN CASE o2 % 3 WHEN 0 THEN 'Вино красное полусухое ' || CAST(o3 AS STRING)
                                       WHEN 1 THEN 'Сок яблочный  DOBRO' ELSE 'Milk and honey' END
                      WHEN 1 THEN CAST(10 + o2 % 900 AS STRING) || CASE o3 % 3 WHEN 0 THEN ',' WHEN 1 THEN '.'
                                  ELSE ' ' END || lpad(CAST(o2 % 100 AS STRING), 2, '0') || ' руб'
                      WHEN 2 THEN CASE o2 % 4 WHEN 0 THEN '-' || CAST(o3 % 60 AS STRING) || ' %'
                                  WHEN 1 THEN '03.04.2026 ' || CAST(o3 % 24 AS STRING) || ':0' || CAST(o3 % 10 AS STRING)
                                  WHEN 2 THEN 'сок яблочный dobro' ELSE CAST(12 + o3 AS STRING) END
                      ELSE CASE o3 % 4 WHEN 0 THEN CAST(4600000000000 + o2 * 977 + o3 AS STRING)
                           WHEN 1 THEN CAST(270000000000 + o2 AS STRING) WHEN 2 THEN '99'
                           ELSE CAST(o2 % 90 + 10 AS STRING) END END AS text
        FROM {detections} {each:0,1,2,3}""",
    # Code payloads of a crop: query string, link, JSON, loose text or bare digits.
    "payloads": """
        SELECT crop_id, o1 AS payload_no, o2, o3, CASE WHEN o2 % 3 = 0 THEN 0 ELSE 1 END AS in_region,
               CASE o2 % 6
                 WHEN 0 THEN 'b=' || CAST(4600000000000 + o2 AS STRING) || '&p1=' || CAST(100 + o3 % 400 AS STRING) || '.5&p4='
                 WHEN 1 THEN 'https://tag.example/q?barcode=' || CAST(4600000000000 + o3 AS STRING) || '&p1=' || CAST(o3 AS STRING) || '%2C90&aC=A+1'
                 WHEN 2 THEN '{"barCode": "' || CAST(4600000000000 + o2 AS STRING) || '", "P1": 252.5, "wL1C": null, "price4": "129,99"}'
                 WHEN 3 THEN 'price1: ' || CAST(o2 AS STRING) || ',63; p4: 129,99; actionCode=Z' || CAST(o3 % 7 AS STRING)
                 WHEN 4 THEN CAST(4600000000000 + o2 AS STRING)
                 ELSE 'p1=1&p1=2&price1=3&b=' || CAST(o3 AS STRING) END AS raw
        FROM {detections}""",
    # Replies of a vision model about a product.
    "replies": """
        SELECT p_partkey AS reply_id, p_name, p_size, p_brand,
               CASE p_partkey % 6
                 WHEN 0 THEN '```json' || chr(10) || '{"product_name": "' || p_name || '", "price_card": ' || CAST(p_size AS STRING) || '.5, }' || chr(10) || '```'
                 WHEN 1 THEN 'thinking {x}</think> {"product_name": " ' || p_name || ' ", "additional_info": ["' || p_brand || '", null, "new"], "price_default": null}'
                 WHEN 2 THEN 'Answer: {"product_name": "a } b", "discount_percent": "-' || CAST(p_size AS STRING) || '%"} done'
                 WHEN 3 THEN 'no object here'
                 WHEN 4 THEN '{"product_name": "None", "price_card": "' || CAST(p_size AS STRING) || '", "qr_code": true}'
                 ELSE '{"product_name": "' || p_name || '" "price_card": 3}' END AS raw
        FROM {part}""",
    # Observations of tags over time, from the event stream.
    "observations": """
        SELECT event_id AS seq, user_id % 16 AS video_id, user_id AS track_no, event_id AS frame_order,
               event_id * 40 AS ts_ms, 'cam' || CAST(user_id % 16 AS STRING) || '.mp4' AS filename,
               CASE event_type WHEN 'view' THEN 'bytetrack:yolo:deferred_ocr' WHEN 'click' THEN 'qr'
                    WHEN 'purchase' THEN 'paddleocr' WHEN 'error' THEN 'derived' ELSE '' END AS source,
               (event_id * 37 % 101) / 100.0E0 AS confidence, value AS sharpness,
               CAST(event_id * 29 % 13 AS DOUBLE) + 0.5 AS score,
               CAST(event_id * 31 % 90 AS DOUBLE) AS x_min, CAST(event_id * 17 % 60 AS DOUBLE) AS y_min,
               CAST(event_id * 31 % 90 AS DOUBLE) + 30 AS x_max, CAST(event_id * 17 % 60 AS DOUBLE) + 20 AS y_max,
               CASE WHEN event_id % 7 = 0 THEN 'нет' WHEN event_id % 7 = 1 THEN ''
                    ELSE 'Товар ' || CAST((user_id + event_id % 3) % 40 AS STRING) END AS product_name,
               CASE WHEN event_id % 5 = 0 THEN 'нет' WHEN event_id % 5 = 1 THEN CAST(user_id % 300 AS STRING) || '.5'
                    WHEN event_id % 5 = 2 THEN 'x' ELSE ' ' || CAST(user_id % 300 + event_id % 2 AS STRING) || ',50' END AS price_default,
               CASE WHEN event_id % 4 = 0 THEN '' ELSE CAST(user_id % 200 + 1 AS STRING) || '.0' END AS price_card,
               CASE WHEN event_id % 6 < 4 THEN CAST(4600000000000 + user_id * 10 + event_id % 2 AS STRING)
                    WHEN event_id % 6 = 4 THEN '12' ELSE NULL END AS barcode,
               CASE WHEN event_id % 3 = 0 THEN '-' || CAST(event_id % 120 AS STRING) || '%' ELSE 'нет' END AS discount_amount,
               CASE WHEN event_id % 3 = 0 THEN 'red' ELSE 'white' END AS color,
               CASE WHEN event_id % 8 = 0 THEN CAST(user_id + 100 AS STRING) || '.99' ELSE 'нет' END AS price1_qr,
               CASE event_id % 4 WHEN 0 THEN 'нет' WHEN 1 THEN 'цена' WHEN 2 THEN CAST(user_id % 50 + 1 AS STRING) || ',5' ELSE '' END AS price_discount,
               CASE event_id % 3 WHEN 0 THEN CAST(270000000000 + user_id AS STRING) WHEN 1 THEN '27' ELSE '' END AS id_sku,
               CASE event_id % 4 WHEN 0 THEN '03.04.2026 ' || CAST(user_id % 24 AS STRING) || '.05' WHEN 1 THEN 'вчера' WHEN 2 THEN 'нет'
                    ELSE lpad(CAST(1 + user_id % 28 AS STRING), 2, '0') || '.05.2026 7:' || lpad(CAST(event_id % 2 AS STRING), 2, '0') END AS print_datetime,
               CASE WHEN event_id % 2 = 0 THEN 'нет' ELSE '01_02501' || CAST(user_id % 10 AS STRING) END AS code,
               CASE event_id % 3 WHEN 0 THEN 'Сухое' WHEN 1 THEN 'Полусухое' ELSE '' END AS additional_info,
               CASE event_id % 4 WHEN 0 THEN 'шКк' WHEN 1 THEN 'нет' WHEN 2 THEN 'x' ELSE 'л' END AS special_symbols,
               CASE event_id % 3 WHEN 0 THEN '46-' || CAST(1000000 + user_id AS STRING) WHEN 1 THEN '46' ELSE 'нет' END AS qr_code_barcode,
               CASE WHEN event_id % 2 = 0 THEN CAST(user_id + 1 AS STRING) ELSE '' END AS price2_qr, 'нет' AS price3_qr,
               CASE event_id % 3 WHEN 0 THEN CAST(user_id + 2 AS STRING) || '.0' WHEN 1 THEN '0' ELSE 'нет' END AS price4_qr,
               CASE WHEN event_id % 2 = 0 THEN '3.0' ELSE 'нет' END AS wholesale_level_1_count,
               CASE WHEN event_id % 5 = 0 THEN CAST(user_id + 3 AS STRING) || ',1' ELSE 'нет' END AS wholesale_level_1_price,
               CASE WHEN event_id % 7 = 0 THEN '12' ELSE '' END AS wholesale_level_2_count, 'нет' AS wholesale_level_2_price,
               CASE WHEN event_id % 6 = 0 THEN '9999999,5' ELSE 'нет' END AS action_price_qr,
               CASE WHEN event_id % 3 = 0 THEN 'A ' || CAST(user_id % 7 AS STRING) ELSE '' END AS action_code_qr,
               CAST(ts AS TIMESTAMP) AS seen_at
        FROM {events}""",
    # Labelled records, wide, with raw texts as people type them.
    "raw_records": """
        SELECT crop_id, video_id, frame_index, o1, o2, o3, 'cam' || CAST(video_id AS STRING) || '.mp4 ' AS filename,
               CASE o2 % 4 WHEN 0 THEN ' Вино  красное ' WHEN 1 THEN 'Сок, 1л' WHEN 2 THEN '' ELSE 'нет' END AS product_name,
               CASE o2 % 5 WHEN 0 THEN CAST(o2 AS STRING) || '.5' WHEN 1 THEN '0' || CAST(o3 AS STRING) WHEN 2 THEN 'нет'
                    WHEN 3 THEN CAST(o2 % 900 AS STRING) || ',63 руб' ELSE 'цена' END AS price_default,
               CASE o3 % 3 WHEN 0 THEN CAST(o3 % 120 AS STRING) || ',99' WHEN 1 THEN '' ELSE CAST(o3 AS STRING) || '.0' END AS price_card,
               CASE o2 % 3 WHEN 0 THEN 'нет' ELSE '' END AS price_discount,
               CASE o2 % 4 WHEN 0 THEN CAST(4600000000000 + o2 * 977 + o3 AS STRING) WHEN 1 THEN CAST(80298000 + o3 AS STRING)
                    WHEN 2 THEN '12-34' ELSE '' END AS barcode,
               CASE o3 % 4 WHEN 0 THEN '− ' || CAST(o2 % 130 AS STRING) || ' %' WHEN 1 THEN CAST(o2 % 60 AS STRING) || '%'
                    WHEN 2 THEN 'нет' ELSE '' END AS discount_amount,
               CASE o3 % 3 WHEN 0 THEN CAST(270000000000 + o2 AS STRING) WHEN 1 THEN '27' ELSE '' END AS id_sku,
               CASE o2 % 5 WHEN 0 THEN lpad(CAST(1 + o2 % 31 AS STRING), 2, '0') || '.0' || CAST(1 + o3 % 9 AS STRING) || '.2026 ' || CAST(o3 % 26 AS STRING) || ':' || lpad(CAST(o2 % 70 AS STRING), 2, '0')
                    WHEN 1 THEN '03.04.2026  ' || CAST(o3 % 24 AS STRING) || '.05' WHEN 2 THEN '3.4.2026 3:08:11'
                    WHEN 3 THEN 'нет' ELSE 'вчера' END AS print_datetime,
               'нет' AS code, CASE o2 % 2 WHEN 0 THEN 'Сухое' ELSE '' END AS additional_info,
               CASE o3 % 2 WHEN 0 THEN 'red' ELSE 'yellow' END AS color,
               CASE o2 % 4 WHEN 0 THEN 'шКк' WHEN 1 THEN 'нет' WHEN 2 THEN 'x' ELSE '' END AS special_symbols,
               CAST(ts_ms AS STRING) AS frame_timestamp,
               CAST(CAST(x_min AS BIGINT) AS STRING) || ',5' AS x_min, CAST(CAST(y_min AS BIGINT) AS STRING) AS y_min,
               CAST(CAST(x_max AS BIGINT) AS STRING) || '.0' AS x_max, CAST(CAST(y_max AS BIGINT) AS STRING) || ',25' AS y_max,
               '' AS qr_code_barcode, CASE o2 % 3 WHEN 0 THEN '252.63' ELSE 'нет' END AS price1_qr, 'нет' AS price2_qr,
               'нет' AS price3_qr, CASE o3 % 3 WHEN 0 THEN '129.9' ELSE '' END AS price4_qr,
               CASE o2 % 2 WHEN 0 THEN '3.0' ELSE 'нет' END AS wholesale_level_1_coun, 'нет' AS wholesale_level_1_price,
               'нет' AS wholesale_level_2_count, 'нет' AS wholesale_level_2_price,
               'нет' AS action_price_qr, 'x1' AS action_code_qr, 'dropped' AS note,
               x_min AS n_x_min, y_min AS n_y_min, x_max AS n_x_max, y_max AS n_y_max
        FROM {detections}""",
    # Detector label lines, some of them broken; one image per order.
    "label_lines": """
        SELECT l_orderkey AS image, (l_linenumber * 100000000 + l_partkey) * 1000000 + l_suppkey AS line_no,
               CASE l_partkey % 23 WHEN 0 THEN '0 0.5 0.5' WHEN 1 THEN 'x 0.5 0.5 0.1 0.1' WHEN 2 THEN '0 0.5 0.5 0 0.1'
                    WHEN 3 THEN '1 1.25 0.5 0.25 0.25' WHEN 4 THEN ' ' WHEN 5 THEN '2 0.5 0.5 0.25 0.25 0.9'
                    ELSE CAST(l_partkey % 3 AS STRING) || ' 0.' || CAST(10 + l_suppkey % 30 AS STRING) || ' 0.' || CAST(20 + l_partkey % 20 AS STRING)
                         || '  0.' || CAST(25 + l_suppkey % 5 AS STRING) || ' 0.' || CAST(30 + l_partkey % 7 AS STRING) END AS line
        FROM {lineitem}""",
    # Measured variants of a crop (experiment).
    "variant_metrics": """
        SELECT event_id AS crop, CAST(user_id AS STRING) AS camera, event_type AS variant,
               CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS STRING) ELSE '' END AS reader_a,
               CASE WHEN event_id % 4 = 0 THEN CAST(event_id AS STRING) ELSE '' END AS reader_b,
               event_id % 3 = 0 OR event_id % 4 = 0 AS decoded, value AS lapvar, value * 2 AS bar_contrast,
               (event_id % 50) / 100.0E0 AS edge_density, (event_id * 37 % 1801) / 10.0E0 - 90 AS angle
        FROM {events}""",
    # Keep/remove decisions about documents, repeated for some.
    "reviews": """
        SELECT doc_id AS image, n AS pass, CASE WHEN (quality + n) % 2 = 1 THEN 'keep'
               WHEN toxic = 1 THEN 'remove_delete' WHEN doc_id % 9 = 0 THEN 'skip_unreadable'
               ELSE 'remove_move' END AS decision
        FROM (SELECT d.doc_id, l.quality, l.toxic FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id) d
             {each:0,1}
        WHERE n = 0 OR doc_id % 4 = 0""",
}

# Truth and predictions: predictions move the box a little, drop some rows and repeat others.
INPUTS["truth"] = """
    SELECT video_id, frame_index, o1 * 100000000000 + o2 * 100000 + o3 AS row_no, n_x_min AS x_min,
           n_y_min AS y_min, n_x_max AS x_max, n_y_max AS y_max, product_name, price_default, price_card,
           price_discount, barcode, discount_amount, id_sku, print_datetime, code, additional_info, color,
           special_symbols, qr_code_barcode, price1_qr, price2_qr, price3_qr, price4_qr
    FROM {raw_records}"""
INPUTS["predicted"] = """
    SELECT video_id, frame_index, row_no * 2 + n AS row_no, x_min + (row_no % 5) + n AS x_min,
           y_min + row_no % 3 AS y_min, x_max + row_no % 7 AS x_max, y_max AS y_max,
           CASE WHEN row_no % 2 = 0 THEN upper(product_name) ELSE 'иное' END AS product_name,
           CASE WHEN row_no % 3 = 0 THEN '1' ELSE price_default END AS price_default,
           CASE WHEN row_no % 3 = 0 THEN '2' ELSE price_card END AS price_card, price_discount,
           CASE WHEN row_no % 5 = 0 THEN '0' ELSE barcode END AS barcode,
           CASE WHEN row_no % 3 = 1 THEN '-1%' ELSE discount_amount END AS discount_amount,
           id_sku, print_datetime, code, additional_info,
           CASE WHEN row_no % 3 = 0 THEN 'blue' ELSE color END AS color, special_symbols,
           qr_code_barcode, price1_qr, price2_qr, price3_qr, price4_qr
    FROM {truth} t {each:0,1}
    WHERE (n = 0 OR row_no % 4 = 0) AND row_no % 7 <> 0"""


def expand(sql: str, table, each) -> str:
    """Fill in ``{name}`` (a given table, or the SELECT of an input in brackets) and ``{each:...}``
    (every row once per listed value ``n``)."""
    def put(match: re.Match) -> str:
        name, values = match.group(1), match.group(2)
        if values is not None:
            return each(values)
        if name in TABLES:
            return table(name)
        return f"({expand(INPUTS[name], table, each)})" if name in INPUTS else match.group(0)
    return re.sub(r"\{(\w+)(?::([\d,]+))?\}", put, sql)


def given(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """A given table, read as it lies; with ``spread``, one that lies in fewer pieces than there are cores is
    dealt out first."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def load(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """An input, or a given table, as a DataFrame over the parquet files of a folder. ``spread`` is for
    queries that compute much per row without a shuffle before."""
    if name in TABLES:
        return given(spark, folder, name, spread)

    def view(table: str) -> str:
        label = f"tagweave_{table}{'_spread' if spread else ''}"
        given(spark, folder, table, spread).createOrReplaceTempView(label)
        return label

    return spark.sql(expand(INPUTS[name], view, lambda values: f"LATERAL VIEW explode(array({values})) k AS n"))


def check_sql(sql: str) -> str:
    """SQL for DuckDB, inputs expanded over the registered views."""
    return expand(sql, lambda t: t, lambda values: f"CROSS JOIN (SELECT unnest([{values}]) AS n) k")
