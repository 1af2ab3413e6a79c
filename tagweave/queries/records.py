"""Record rules: normal form, validation, derived fields, completeness, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.functions import text as t
from tagweave.functions.quality import completeness
from tagweave.operators import records as rec
from tagweave.queries.inputs import load
from tagweave.queries.registry import query
from tagweave.schema import (
    BARCODE_COLUMNS, FUSION_ABSENT_DEFAULTS, PRICE_COLUMNS, QUALITY_COLUMNS, RECORD_COLUMNS, VOTED_COLUMNS,
)
from tagweave.session import run_folder
from tagweave.sources import readers, writers

# Pieces of check SQL. ``nv`` is the normal form of a value.
def nv(c: str) -> str:
    return (f"CASE WHEN regexp_matches(trim(coalesce({c}, ''), ' ' || chr(9) || chr(10)), '^[0-9]+[.]0$') "
            f"THEN regexp_extract(trim({c}, ' ' || chr(9) || chr(10)), '^([0-9]+)[.]0$', 1) "
            f"ELSE trim(coalesce({c}, ''), ' ' || chr(9) || chr(10)) END")


def sql_price(c: str) -> str:
    x = f"replace(replace({nv(c)}, ' ', ''), '.', ',')"
    whole, cents = (f"regexp_extract({x}, '([0-9]{{1,6}})(?:,([0-9]{{1,2}}))?', {i})" for i in (1, 2))
    return (f"CASE WHEN {x} IN ('', 'нет') THEN {x} WHEN {whole} = '' THEN '' ELSE "
            f"CAST(CAST({whole} AS BIGINT) AS VARCHAR) || ',' || rpad(CASE WHEN {cents} = '' THEN '00' ELSE {cents} END, 2, '0') END")


def sql_price_value(c: str) -> str:
    v = f"coalesce(TRY_CAST(replace({sql_price(c)}, ',', '.') AS DOUBLE), 0)"
    return f"CASE WHEN {v} > 0 AND {v} < 1000000 THEN {v} ELSE 0 END"


def sql_discount(c: str) -> str:
    x = f"replace(replace({nv(c)}, ' ', ''), '−', '-')"
    m = f"regexp_extract({x}, '-?[0-9]{{1,3}}%')"
    return (f"CASE WHEN {x} IN ('', 'нет') THEN {x} WHEN {m} = '' OR starts_with({m}, '-') THEN {m} "
            f"ELSE '-' || {m} END")


def sql_digits(c: str) -> str:
    return f"regexp_replace({nv(c)}, '[^0-9]+', '', 'g')"


def sql_time(c: str) -> str:
    x = (f"regexp_replace(regexp_replace(replace({nv(c)}, ',', '.'), '[[:space:]]+', ' ', 'g'), "
         f"'([0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}) +([0-9]{{1,2}})[.]([0-9]{{2}})', '\\1 \\2:\\3', 'g')")
    p = (f"coalesce(try_strptime({x}, '%d.%m.%Y %H:%M'), try_strptime({x}, '%d.%m.%Y %H.%M'), "
         f"try_strptime({x}, '%d.%m.%Y %H:%M:%S'))")
    exact = (f"strftime({p}, '%d.%m.%Y ') || CAST(date_part('hour', {p}) AS VARCHAR) || ':' || "
             f"lpad(CAST(date_part('minute', {p}) AS VARCHAR), 2, '0')")
    loose = f"regexp_extract({x}, '[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}} +[0-9]{{1,2}}:[0-9]{{2}}')"
    return f"CASE WHEN {nv(c)} IN ('', 'нет') THEN {nv(c)} WHEN {p} IS NOT NULL THEN {exact} ELSE {loose} END"


def sql_symbols(c: str) -> str:
    kept = f"regexp_replace(upper({nv(c)}), '[^ШЛК]', '', 'g')"
    part = [f"CASE WHEN position('{s}' IN {kept}) > 0 THEN [{{'p': position('{s}' IN {kept}), 's': '{s}'}}] ELSE [] END"
            for s in "ШЛК"]
    joined = f"list_sort({part[0]} || {part[1]} || {part[2]})"
    return (f"CASE WHEN {nv(c)} IN ('', 'нет') THEN {nv(c)} ELSE "
            f"array_to_string(list_transform({joined}, lambda q: q.s), '') END")


def sql_canonical(c: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(replace(lower({nv(c)}), ',', '.'), '[[:space:]]+', ' ', 'g'), "
            f"'[^0-9a-zа-яё.% -]+', '', 'g'))")


def sql_completeness(prefix: str = "") -> str:
    return " + ".join(
        f"CASE WHEN {nv(prefix + c)} NOT IN ('', 'нет') AND NOT regexp_matches({nv(prefix + c)}, '^[^[:alnum:]а-яА-Я]$') THEN 1 ELSE 0 END"
        for c in QUALITY_COLUMNS)


NORMAL = ", ".join(
    f"{nv('wholesale_level_1_coun' if c == 'wholesale_level_1_count' else c)} AS {c}" for c in RECORD_COLUMNS)


@query("p3_normalize_records", f"SELECT crop_id, {NORMAL} FROM {{raw_records}}")
def normalized(spark, sf):
    return rec.normalize_records(load(spark, sf, "raw_records", spread=True), ["crop_id"])


@query("p1_empty_record", "SELECT filename, " + ", ".join(
    f"'{'нет' if c in FUSION_ABSENT_DEFAULTS else ''}' AS {c}" for c in RECORD_COLUMNS if c != "filename")
    + ", count(*) AS crops FROM {raw_records} GROUP BY filename")
def empty_records(spark, sf):
    rows = load(spark, sf, "raw_records")
    return (rows.select(*rec.empty_record(F.col("filename"))).groupBy(*RECORD_COLUMNS)
            .agg(F.count("*").alias("crops")))


KINDS = {
    "price": (sql_price, lambda c: f"({sql_price_value(c)}) > 0"),
    "discount_amount": (sql_discount, lambda c: (
        f"coalesce(TRY_CAST(regexp_extract({sql_discount(c)}, '^-([0-9]{{1,3}})%$', 1) AS INT), 0) BETWEEN 1 AND 100")),
    "barcode": (lambda c: f"CASE WHEN {nv(c)} IN ('', 'нет') THEN {nv(c)} ELSE {sql_digits(c)} END",
                lambda c: f"length({sql_digits(c)}) BETWEEN 8 AND 14"),
    "id_sku": (lambda c: f"CASE WHEN {nv(c)} IN ('', 'нет') THEN {nv(c)} ELSE {sql_digits(c)} END",
               lambda c: f"length({sql_digits(c)}) = 12"),
    "print_datetime": (sql_time, lambda c: f"({sql_time(c)}) <> ''"),
    "special_symbols": (sql_symbols, lambda c: f"({sql_symbols(c)}) <> ''"),
    "text": (nv, lambda c: "true"),
}
RULES = {c: KINDS["price" if c in PRICE_COLUMNS else "barcode" if c in BARCODE_COLUMNS else c if c in KINDS else "text"]
         for c in VOTED_COLUMNS}
#: The header of one column is cut short in the records.
RECORDS = "r AS (SELECT *, wholesale_level_1_coun AS wholesale_level_1_count FROM {raw_records})"


def records(spark, sf):
    return load(spark, sf, "raw_records", spread=True).withColumnRenamed("wholesale_level_1_coun", "wholesale_level_1_count")


VALIDATED = " UNION ALL ".join(
    f"SELECT crop_id, '{f}' AS field, {nv(f)} AS value, {norm(f)} AS normalized, "
    f"{nv(f)} NOT IN ('', 'нет') AND {rule(f)} AS valid FROM r" for f, (norm, rule) in RULES.items())


@query("f2_validate_fields", f"WITH {RECORDS} {VALIDATED}")
def validated(spark, sf):
    return rec.validate_fields(records(spark, sf), ["crop_id"])


@query("f2_rejection_rates", f"""
    WITH {RECORDS}, v AS ({VALIDATED})
    SELECT field, count(*) FILTER (value NOT IN ('', 'нет')) AS given, count(*) FILTER (valid) AS valid,
           round(CASE WHEN count(*) FILTER (value NOT IN ('', 'нет')) > 0 THEN 1 - count(*) FILTER (valid) / count(*) FILTER (value NOT IN ('', 'нет')) ELSE 0 END, 6) AS rejected_share
    FROM v GROUP BY field""")
def rejections(spark, sf):
    return rec.rejection_rates(rec.validate_fields(records(spark, sf), ["crop_id"]))


@query("n7_ean13", """
    WITH d AS (SELECT part, code, list_transform(string_split(code, ''), lambda x: CAST(x AS INT)) AS g FROM (
        SELECT p_partkey AS part, CAST(4600000000000 + p_partkey * 977 AS VARCHAR) AS code FROM part))
    SELECT part, code, (10 - (g[1]+g[3]+g[5]+g[7]+g[9]+g[11] + 3*(g[2]+g[4]+g[6]+g[8]+g[10]+g[12])) % 10) % 10 = g[13] AS valid FROM d""")
def ean13(spark, sf):
    code = (F.lit(4600000000000) + F.col("p_partkey") * 977).cast("string")
    return load(spark, sf, "part").select(F.col("p_partkey").alias("part"), code.alias("code"),
                                          t.valid_ean13(code).alias("valid"))


@query("n11_unit", """
    SELECT o_orderkey AS k, CASE o_custkey % 6 WHEN 0 THEN 'piece' WHEN 1 THEN 'kg' WHEN 2 THEN '100g'
           WHEN 3 THEN 'weight' WHEN 4 THEN '' ELSE '' END AS unit FROM orders""")
def units(spark, sf):
    words = F.array(*[F.lit(w) for w in (" 1  ШТ.", "Кг.", "100 гр", "ВЕСОВОЙ", "литр", "")])
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), t.normalize_unit(words[(F.col("o_custkey") % 6).cast("int")]).alias("unit"))


@query("n19_format_coordinate", """
    SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice AS v,
           replace(regexp_replace(printf('%.1f', l_extendedprice), '[.]0$', ''), '.', ',') AS shown FROM lineitem""")
def coordinates(spark, sf):
    return load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("v"),
        t.format_coordinate(F.col("l_extendedprice")).alias("shown"))


@query("n18_numbers", """
    SELECT crop_id, coalesce(TRY_CAST(regexp_extract(replace(replace(price_default, ' ', ''), ',', '.'), '-?[0-9]+([.][0-9]+)?') AS DOUBLE), 0) AS loose,
           CASE WHEN regexp_matches(trim(x_min), '^[0-9]+([,.][0-9]*)?$') THEN CAST(replace(x_min, ',', '.') AS DOUBLE) ELSE 0 END AS coordinate
    FROM {raw_records}""")
def numbers(spark, sf):
    return load(spark, sf, "raw_records").select(
        "crop_id", t.loose_number("price_default").alias("loose"), t.decimal_number("x_min").alias("coordinate"))


@query("n20_file_names", """
    SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), ''), 'frame') AS name FROM pages""")
def file_names(spark, sf):
    return load(spark, sf, "pages").select("page_id", t.file_stem(F.col("url")).alias("name"))


@query("n13_canonical_text", f"SELECT doc_id, md5({sql_canonical('text')}) AS canonical FROM documents")
def canonical(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5(t.canonical_text("text")).alias("canonical"))


DERIVED_PERCENT = (f"CAST(CAST(round_even(({sql_price_value('price_default')} - {sql_price_value('price_card')}) / "
                   f"({sql_price_value('price_default')}) * 100, 0) AS BIGINT) AS VARCHAR)")


@query("f3_derive_fields", f"""
    SELECT crop_id, CASE WHEN {nv('discount_amount')} IN ('', 'нет') AND ({sql_price_value('price_default')}) > 0
      AND ({sql_price_value('price_card')}) > 0 AND ({sql_price_value('price_card')}) < ({sql_price_value('price_default')})
      THEN '-' || {DERIVED_PERCENT} || '%' ELSE {nv('discount_amount')} END AS discount_amount FROM {{raw_records}}""")
def derived(spark, sf):
    rows = rec.derive_fields(load(spark, sf, "raw_records").select(
        "crop_id", "price_default", "price_card", "discount_amount"))
    return rows.select("crop_id", "discount_amount")


@query("f3_copy_payload_fields", f"""
    WITH n AS (SELECT crop_id, {nv('qr_code_barcode')} AS q, {nv('barcode')} AS b, {nv('price1_qr')} AS p1,
                      {nv('price_default')} AS d, {nv('price4_qr')} AS p4, {nv('price_card')} AS c FROM {{raw_records}}),
    a AS (SELECT crop_id, b, d, c, CASE WHEN q IN ('', 'нет') AND b NOT IN ('', 'нет') THEN b ELSE q END AS q,
                 CASE WHEN p1 IN ('', 'нет') AND d NOT IN ('', 'нет') THEN d ELSE p1 END AS p1,
                 CASE WHEN p4 IN ('', 'нет') AND c NOT IN ('', 'нет') THEN c ELSE p4 END AS p4 FROM n)
    SELECT crop_id, q AS qr_code_barcode, p1 AS price1_qr, p4 AS price4_qr,
           CASE WHEN b IN ('', 'нет') AND q NOT IN ('', 'нет') THEN q ELSE b END AS barcode,
           CASE WHEN d IN ('', 'нет') AND p1 NOT IN ('', 'нет') THEN p1 ELSE d END AS price_default,
           CASE WHEN c IN ('', 'нет') AND p4 NOT IN ('', 'нет') THEN p4 ELSE c END AS price_card FROM a""")
def copied(spark, sf):
    rows = rec.derive_fields(rec.normalize_records(load(spark, sf, "raw_records", spread=True), ["crop_id"]), True)
    return rows.select("crop_id", "qr_code_barcode", "price1_qr", "price4_qr", "barcode", "price_default", "price_card")


@query("a23_completeness", f"SELECT crop_id, CAST({sql_completeness()} AS BIGINT) AS filled FROM {{raw_records}}")
def filled(spark, sf):
    return load(spark, sf, "raw_records").select("crop_id", completeness().cast("bigint").alias("filled"))


@query("a11_mean_completeness", f"""
    SELECT count(*) AS rows, round(avg({sql_completeness()}), 6) AS avg_completeness FROM {{raw_records}}""")
def mean_filled(spark, sf):
    return rec.mean_completeness(rec.normalize_records(load(spark, sf, "raw_records")))


FILL = " UNION ALL ".join(
    f"SELECT '{c}' AS field, count(*) AS total, count(*) FILTER ({nv(c)} NOT IN ('', 'нет')) AS filled, "
    f"100 * count(*) FILTER ({nv(c)} NOT IN ('', 'нет')) // greatest(count(*), 1) AS percent FROM {{raw_records}}"
    for c in ("product_name", "price_card", "price_default", "barcode", "print_datetime"))


@query("a10_fill_rates", FILL)
def fill_rates(spark, sf):
    return rec.field_fill_rates(rec.normalize_records(load(spark, sf, "raw_records")))


PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS field, count(*) AS rows, count(*) FILTER ({nv('wholesale_level_1_coun' if c == 'wholesale_level_1_count' else c)} NOT IN ('', 'нет')) AS filled, "
    f"{i} AS position, {'true' if c in FUSION_ABSENT_DEFAULTS else 'false'} AS optional FROM {{raw_records}}"
    for i, c in enumerate(RECORD_COLUMNS))


@query("e12_profile_records", PROFILE)
def profile(spark, sf):
    return rec.profile_schema(rec.normalize_records(load(spark, sf, "raw_records")))


@query("a26_distinct_records", f"""
    WITH k AS (SELECT *, CASE WHEN {nv('price1_qr')} NOT IN ('', 'нет') AND {nv('barcode')} NOT IN ('', 'нет')
                 THEN '0' || {nv('price1_qr')} || '|' || {nv('barcode')}
               WHEN {nv('barcode')} NOT IN ('', 'нет') THEN '1' || {nv('barcode')}
               WHEN {nv('id_sku')} NOT IN ('', 'нет') THEN '2' || {nv('id_sku')} END AS ident,
               {sql_completeness()} AS filled FROM {{raw_records}}),
    r AS (SELECT *, row_number() OVER (PARTITION BY ident ORDER BY filled DESC, crop_id) AS rn FROM k)
    SELECT crop_id, {nv('barcode')} AS barcode, {nv('id_sku')} AS id_sku FROM r WHERE ident IS NULL OR rn = 1""")
def distinct(spark, sf):
    rows = rec.normalize_records(load(spark, sf, "raw_records", spread=True), ["crop_id"])
    kept = rec.distinct_records(rows, [["price1_qr", "barcode"], ["barcode"], ["id_sku"]], [F.col("crop_id")])
    return kept.select("crop_id", "barcode", "id_sku")


@query("p2_detection_headers", """
    SELECT crop_id, ts_ms AS frame_timestamp, x_min, y_min, x_max, y_max FROM {detections}""")
def headers(spark, sf):
    odd = load(spark, sf, "detections").select(
        "crop_id", F.col("ts_ms").alias(" Timestamp "), F.col("x_min").alias("XMIN"), F.col("y_min").alias("top"),
        F.col("x_max").alias("Right"), F.col("y_max").alias("y2"))
    return rec.rename_detection_columns(odd)


@query("s1_k1_record_csv", f"SELECT {NORMAL} FROM {{raw_records}}")
def record_csv(spark, sf):
    folder = run_folder(spark, "records")
    writers.write_records_csv(load(spark, sf, "raw_records"), folder)
    return readers.read_records_csv(spark, folder)


@query("k2_append_results", f"SELECT {NORMAL} FROM {{raw_records}}")
def appended_results(spark, sf):
    """Two batches of videos appended to one folder, read back together."""
    folder = run_folder(spark, "results")
    rows = rec.normalize_records(load(spark, sf, "raw_records"), ["o2"])
    writers.append_results(rows.filter("o2 % 2 = 0"), folder, first=True)
    writers.append_results(rows.filter("o2 % 2 = 1"), folder)
    return readers.read_records_csv(spark, folder)


@query("k3_run_files", f"SELECT crop_id, {NORMAL} FROM {{raw_records}}")
def run_files(spark, sf):
    """The debug file, which keeps every column, read back."""
    folder = run_folder(spark, "run")
    rows = rec.normalize_records(load(spark, sf, "raw_records"), ["crop_id"])
    writers.write_run_files(rows, folder)
    return spark.read.schema(rows.schema).json(f"{folder}/debug.json").select("crop_id", *RECORD_COLUMNS)


@query("s2_typed_labels", """
    SELECT crop_id, CAST(replace(x_min, ',', '.') AS DOUBLE) AS x_min, CAST(replace(y_max, ',', '.') AS DOUBLE) AS y_max,
           CAST(frame_timestamp AS DOUBLE) AS frame_timestamp FROM {raw_records}""")
def typed_labels(spark, sf):
    folder = run_folder(spark, "typed")
    (load(spark, sf, "raw_records").select("crop_id", F.col("x_min").alias("x_min "), "y_min", "x_max", "y_max", "frame_timestamp")
     .write.option("header", True).csv(folder))
    return readers.read_typed_labels(spark, folder).select("crop_id", "x_min", "y_max", "frame_timestamp")


@query("s4_trimmed_labels", """
    SELECT crop_id, trim(product_name) AS product_name, trim(filename) AS filename FROM {raw_records}""")
def trimmed(spark, sf):
    folder = run_folder(spark, "trimmed")
    (load(spark, sf, "raw_records").select("crop_id", F.col("product_name").alias(" product_name"), "filename")
     .write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder))
    return readers.read_trimmed_csv(spark, folder)


@query("s3_detection_csvs", "SELECT crop_id, CAST(ts_ms AS VARCHAR) AS frame_timestamp, CAST(CAST(x_min AS BIGINT) AS VARCHAR) AS x_min FROM {detections} WHERE video_id < 7")
def detection_csvs(spark, sf):
    """Files of three layouts in one folder tree; one layout lacks the boxes and is skipped."""
    folder = run_folder(spark, "layouts")
    d = load(spark, sf, "detections").withColumns({c: F.col(c).cast("bigint") for c in ("x_min", "y_min", "x_max", "y_max")})
    layouts = [
        (F.col("video_id") < 4, ["crop_id", "ts_ms as timestamp", "x_min as x1", "y_min as y1", "x_max as x2", "y_max as y2"]),
        (F.col("video_id").between(4, 6), ["ts_ms as frame_timestamp", "x_max as Right", "x_min as LEFT", "y_min as top", "y_max as bottom", "crop_id"]),
        (F.col("video_id") == 7, ["crop_id", "ts_ms as timestamp"]),
    ]
    for i, (rows, names) in enumerate(layouts):
        d.filter(rows).selectExpr(*names).write.option("header", True).csv(f"{folder}/layout={i}")
    rows, _report = readers.read_detection_csvs(spark, f"{folder}/*")
    return rows.select("crop_id", "frame_timestamp", "x_min")
