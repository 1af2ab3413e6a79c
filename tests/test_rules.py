"""Rule tables worked out by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tagweave.functions import prices as x, replies as r, text as t
from tagweave.operators.records import discount_from_prices, normalize_records
from tagweave.schema import RECORD_COLUMNS
from tagweave.sources.readers import sample_stride


def apply(spark, rule, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [row[0] for row in rows.orderBy("i").select(rule(F.col("v"))).collect()]


CASES = [
    (t.normalize_value, {" 12.0 ": "12", " a b\t": "a b", "1.50": "1.50", None: ""}),
    (t.normalize_price, {"252.6": "252,60", "0129": "129,00", "нет": "нет", "": "", "цена 5,9 руб": "5,90", "x": ""}),
    (t.valid_price, {"0": False, "0,01": True, "999999": True, "нет": False, "": False}),
    (t.normalize_discount, {"− 48 %": "-48%", "5%": "-5%", "много": "", "нет": "нет"}),
    (t.valid_discount, {"-0%": False, "-101%": False, "-48%": True, "100%": True}),
    (t.valid_ean13, {"4670025474665": True, "7804623056632": False, "123": False}),
    (t.valid_barcode, {"80298328": True, "1234567": False, "12345678901234": True}),
    (t.normalize_datetime, {
        "3.04.2026 3:08": "03.04.2026 3:08", "03.04.2026 03.08": "03.04.2026 3:08", "3.4.2026 3:08:11": "03.04.2026 3:08",
        "30.02.2026 3:08": "30.02.2026 3:08", "32.1.2026 3:08": "", "вчера": "", "нет": "нет", "x 03.04.2026 3:08 y": "03.04.2026 3:08",
        "03.04.2026 24:00": "03.04.2026 24:00", "2026-3-4 3:08": ""}),
    (t.normalize_symbols, {"шКк": "ШК", "нет": "нет", "abc": ""}),
    (t.normalize_unit, {" 1  ШТ.": "piece", "100 гр": "100g", "литр": ""}),
    (t.canonical_text, {" Сок,  1Л!": "сок. 1л", None: ""}),
    (t.is_noise, {"": True, "-": True, "a": False, "7": False, "--": False}),
    (t.loose_number, {"1 234,5 руб": 1234.5, "": 0.0, "-7": -7.0, "abc": 0.0}),
    (t.decimal_number, {"2063,1": 2063.1, "x": 0.0, "": 0.0, " 7 ": 7.0}),
    (x.tag_discount, {"скидка – 48 %": "-48%", "": ""}),
    (x.tag_zone_code, {"01_025019 - 026015": "01_025019-026015", "1_2": ""}),
    (x.fusion_info, {"вино полусухое": "Сухое", "хлеб": ""}),
    (x.tag_info, {"вино полусухое 100г": "сухое; полусухое; 100г"}),
    (x.canonical_absent, {" НЕТ ": "нет", "νετ": "нет", "a  b": "a b"}),
    (x.two_decimals, {"252,6": "252.60", "abc": "abc", "0.125": "0.12"}),
]


@pytest.mark.parametrize("rule,table", CASES, ids=[c[0].__name__ for c in CASES])
def test_rule_table(spark, rule, table):
    assert apply(spark, rule, list(table)) == list(table.values())


def test_first_value_and_derived_discount(spark):
    row = spark.range(1).select(
        t.first_value(F.lit(""), F.lit("нет"), F.lit("")).alias("a"), t.first_value(F.lit("нет"), F.lit("x")).alias("b"),
        discount_from_prices(F.lit("252,63"), F.lit("129,99")).alias("c"), discount_from_prices(F.lit("1"), F.lit("2")).alias("d"),
        sample_stride(F.lit(25.0), 10.0).alias("e")).first()
    assert tuple(row) == ("нет", "x", "-49%", "", 2)


@pytest.mark.parametrize("digits", [1, 6])
def test_fixed_decimals_like_python(spark, digits):
    values = [0.15, 0.25, 0.35, 2063.0, 2063.14, 0.6640625, 0.0000005, 1.0000015, 12345.65, 0.95, 0.05, 9.95, 99.9999995]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = [row[0] for row in rows.select(t.fixed_decimals(F.col("v"), digits)).collect()]
    assert got == [f"{v:.{digits}f}" for v in values]


def test_records_keep_order_and_defaults(spark):
    df = spark.createDataFrame([("a.mp4 ", "7.0", "x")], "filename string, wholesale_level_1_coun string, other string")
    row = normalize_records(df).first()
    assert row.__fields__ == RECORD_COLUMNS
    assert (row.filename, row.wholesale_level_1_count, row.code, row.barcode) == ("a.mp4", "7", "нет", "")


REPLIES = {
    '```json\n{"product_name": "a", }\n```': "a", 'x</think>{"product_name": "b"} tail': "b", "none": "",
    '{"product_name": "a } \\" { b"}': 'a } " { b', '{"product_name": ["x", null, " y "]}': "x; y", '{"product_name": null}': "",
    '{"product_name": 12.50}': "12.5", '{"product_name": true}': "True", '{"other": {"product_name": "n"}}': "",
    '\\{"a"} {"product_name": "c"}': "", '{"product_name": "NULL"}': "",
}


def test_reply_values(spark):
    got = apply(spark, lambda c: r.reply_value(r.parsed_reply(c), "product_name"), list(REPLIES))
    assert got == list(REPLIES.values())


# ---- prices, worked by hand -----------------------------------------------------------------

TAG_PRICES = {
    "129 99": ["129.99"], "12999": ["129.99"], "129 99 12999": ["129.99"], "12.99 ; 15 20": ["12.99", "15.20"], "12.99 15 20": ["12.99"],  # 99 15 is looked at first
    "12 , 50": ["12.50"], "4567": ["45.67"], "арт 12.50": ["12.50"], "378949": ["3789.49"],
    "0,5 л 12 50": [],  # a volume stands close by
    "цена 1.50 руб": ["1.50"], "цена 1.50": [],  # under two only with a currency
    "qr 12.50": [], "штрих 4567": [],  # a code stands close by
    "456": [], "0456": [], "123456789": [],  # three digits, a leading zero, too long
    "12:34 5678": [], "03.04.2026 4567": [],  # a time or a date stands close by
    "1 50": [], "": [],
}
FUSION_PRICES = {
    "129,99": ["129,99"], "129.99": ["129,99"], "12 50": ["12,50"], "0012,50": ["12,50"], "-48% 12,50": ["12,50"],
    "12,50 12.50 12 50": ["12,50"], "1,23.45": [], "03.04.2026 3:08": [], "12,50кг": [], "12,50 кг": ["12,50"],
    "123456,78": [], "": [],
}
PRICE_PARTS = ["12", "129", "99", "0", "1", ".", ",", " ", " ", "л", "кг", "руб", "код", "4567", "12999", "/", "-", ":", "5", "%"]


def random_texts(seed, count=300):
    rng = random.Random(seed)
    return ["".join(rng.choice(PRICE_PARTS) for _ in range(rng.randint(3, 18))) for _ in range(count)]


def test_tag_prices(spark):
    assert apply(spark, x.tag_prices, list(TAG_PRICES)) == list(TAG_PRICES.values())
    texts = random_texts(1)
    for text, prices in zip(texts, apply(spark, x.tag_prices, texts)):
        digits = re.sub(r"[\s.,]", "", text)
        assert len(set(prices)) == len(prices)
        for price in prices:
            assert re.fullmatch(r"\d+\.\d\d", price) and price.replace(".", "") in digits
            assert float(price) >= 2 or "руб" in text


def test_fusion_prices(spark):
    assert apply(spark, x.fusion_prices, list(FUSION_PRICES)) == list(FUSION_PRICES.values())
    texts = random_texts(2)
    for text, prices in zip(texts, apply(spark, x.fusion_prices, texts)):
        assert len(set(prices)) == len(prices)
        assert all(re.fullmatch(r"(0|[1-9]\d*),\d\d", p) and p.replace(",", "") in re.sub(r"[\s.,]", "", text) for p in prices)
