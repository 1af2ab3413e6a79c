"""Record layout and the fixed rule tables every job shares."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: names, order, defaults and word lists that results depend on ---

ABSENT = "нет"

RECORD_COLUMNS = [
    "filename", "product_name", "price_default", "price_card", "price_discount", "barcode",
    "discount_amount", "id_sku", "print_datetime", "code", "additional_info", "color",
    "special_symbols", "frame_timestamp", "x_min", "y_min", "x_max", "y_max",
    "qr_code_barcode", "price1_qr", "price2_qr", "price3_qr", "price4_qr",
    "wholesale_level_1_count", "wholesale_level_1_price", "wholesale_level_2_count",
    "wholesale_level_2_price", "action_price_qr", "action_code_qr",
]

LEGACY_COLUMN_NAMES = {"wholesale_level_1_coun": "wholesale_level_1_count"}

DETECTION_COLUMN_NAMES = {
    "frame_timestamp_ms": "frame_timestamp", "timestamp": "frame_timestamp",
    "time_ms": "frame_timestamp", "xmin": "x_min", "x1": "x_min", "left": "x_min",
    "ymin": "y_min", "y1": "y_min", "top": "y_min", "xmax": "x_max", "x2": "x_max",
    "right": "x_max", "ymax": "y_max", "y2": "y_max", "bottom": "y_max",
}

BOX_COLUMNS = ["x_min", "y_min", "x_max", "y_max"]
DETECTION_REQUIRED = ["frame_timestamp", *BOX_COLUMNS]

# Columns that say "surely absent" unless evidence fills them (fusion rules).
FUSION_ABSENT_DEFAULTS = [
    "price_discount", "code", "additional_info", "special_symbols", "qr_code_barcode",
    "price1_qr", "price2_qr", "price3_qr", "price4_qr", "wholesale_level_1_count",
    "wholesale_level_1_price", "wholesale_level_2_count", "wholesale_level_2_price",
    "action_price_qr", "action_code_qr",
]

# The same idea under the best-crop rules.
BEST_CROP_ABSENT_DEFAULTS = [
    "price_discount", "discount_amount", "code", "additional_info", "special_symbols",
]

PAYLOAD_ALIASES = {
    "qr_code_barcode": ["barcode", "barCode", "b", "ean", "gtin"],
    "price1_qr": ["price1", "p1"],
    "price2_qr": ["price2", "p2"],
    "price3_qr": ["price3", "p3"],
    "price4_qr": ["price4", "p4"],
    "wholesale_level_1_count": ["wholesaleLevel1Count", "wL1C"],
    "wholesale_level_1_price": ["wholesaleLevel1Price", "wL1P"],
    "wholesale_level_2_count": ["wholesaleLevel2Count", "wL2C"],
    "wholesale_level_2_price": ["wholesaleLevel2Price", "wL2P"],
    "action_price_qr": ["actionPrice", "aP"],
    "action_code_qr": ["actionCode", "aC"],
}

# Strict query-string keys, weakest first: a later key overrides an earlier one.
STRICT_PAYLOAD_KEYS = {
    "qr_code_barcode": ["b", "barcode"],
    "price1_qr": ["p1", "price1"],
    "price2_qr": ["p2", "price2"],
    "price3_qr": ["p3", "price3"],
    "price4_qr": ["p4", "price4"],
    "wholesale_level_1_count": ["wL1C", "wholesaleLevel1Count"],
    "wholesale_level_1_price": ["wL1P", "wholesaleLevel1Price"],
    "wholesale_level_2_count": ["wL2C", "wholesaleLevel2Count"],
    "wholesale_level_2_price": ["wL2P", "wholesaleLevel2Price"],
    "action_price_qr": ["aP", "actionPrice"],
    "action_code_qr": ["aC", "actionCode"],
}

PAYLOAD_COLUMNS = list(PAYLOAD_ALIASES)

QUALITY_COLUMNS = [
    "product_name", "price_default", "price_card", "price_discount", "barcode",
    "discount_amount", "id_sku", "print_datetime", "code", "additional_info", "color",
    "special_symbols", "qr_code_barcode", "price1_qr", "price2_qr", "price3_qr", "price4_qr",
]

FILL_RATE_COLUMNS = ["product_name", "price_card", "price_default", "barcode", "print_datetime"]

PRICE_COLUMNS = [
    "price_default", "price_card", "price_discount", "price1_qr", "price2_qr", "price3_qr",
    "price4_qr", "action_price_qr", "wholesale_level_1_price", "wholesale_level_2_price",
]

BARCODE_COLUMNS = ["barcode", "qr_code_barcode"]

# A value that fails its rule never becomes a vote in these fields.
STRICT_COLUMNS = [
    "price_default", "price_card", "price_discount", "barcode", "qr_code_barcode", "id_sku",
    "print_datetime", "discount_amount",
]

SOURCE_WEIGHTS = {
    "qr": 1.0, "zxingcpp": 0.95, "pyzbar": 0.92, "opencv_qr": 0.88, "paddleocr": 0.78,
    "tesseract": 0.68, "regex": 0.62, "derived": 0.45, "yolo": 0.35, "qr_seed": 0.35,
}
DEFAULT_SOURCE_WEIGHT = 0.5

SPECIAL_SYMBOLS = ["Ш", "Л", "К"]

UNIT_ALIASES = {
    "1шт": "piece", "1 шт": "piece", "шт": "piece", "штука": "piece", "1кг": "kg",
    "1 кг": "kg", "кг": "kg", "100г": "100g", "100 г": "100g", "100 гр": "100g",
    "вес": "weight", "весовой": "weight",
}

FUSION_INFO_WORDS = [
    "сухое", "полусухое", "сладкое", "полусладкое", "без кнопки", "удачная упаковка",
]

BEST_CROP_INFO_WORDS = [
    "сухое", "полусухое", "полусладкое", "сладкое", "брют", "экстра", "удачная упаковка",
    "номер на весах", "цена за 1 кг", "цена за 100 г", "100г", "1кг", "1 кг",
]

REPLY_KEYS = {
    "product_name": "product_name", "price_card": "price_card",
    "price_default": "price_default", "discount_percent": "discount_amount",
    "additional_info": "additional_info",
}

COLOR_HINTS = ["red", "yellow", "green", "white"]

IMAGE_EXTENSIONS = ["jpg", "jpeg", "png"]

# --- Layouts derived from the lists above ---

META_COLUMNS = ["filename", "frame_timestamp", *BOX_COLUMNS]
VOTED_COLUMNS = [c for c in RECORD_COLUMNS if c not in META_COLUMNS]

RECORD_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RECORD_COLUMNS])

TEXT_LINE_SCHEMA = T.StructType([
    T.StructField("crop_id", T.LongType()),
    T.StructField("line_no", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("source", T.StringType()),
])

REVIEW_EVENT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("decision", T.StringType()),
    T.StructField("image_path", T.StringType()),
    T.StructField("label_path", T.StringType()),
    T.StructField("moved_image_path", T.StringType()),
    T.StructField("moved_label_path", T.StringType()),
    T.StructField("boxes", T.IntegerType()),
    T.StructField("warnings", T.ArrayType(T.StringType())),
])
