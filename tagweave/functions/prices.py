"""Prices, codes, dates and words inside recognised text, under both rule sets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tagweave.functions import text as t
from tagweave.schema import ABSENT, BEST_CROP_INFO_WORDS, FUSION_INFO_WORDS

# Patterns of the fusion rules.
FUSION_PRICE = r"\d{1,5}\s*[,.]\s*\d{2}"
FUSION_SPLIT_PRICE = r"\d{1,5}\s+\d{2}"
FUSION_PRICE_END = r"(?![\dA-Za-zЀ-ӿ])"
EAN = r"(?<!\d)(\d{13})(?!\d)"
BARCODE = r"(?<!\d)(\d{8,14})(?!\d)"
SKU = r"(?<!\d)(\d{12})(?!\d)"
FUSION_TIME = r"(\d{2}[.]\d{2}[.]\d{4}\s+\d{1,2}[:.]\d{2})"
FUSION_DISCOUNT = r"[-−]?\s*\d{1,3}\s*%"
FUSION_ZONE_CODE = r"(?U)(?<!\w)\d{2}_\d{5,6}(?!\w)"
FUSION_SPECIAL = r"(?U)(?<!\w)([ШЛКшлк])(?!\w)"
# Patterns of the best-crop rules.
PRICE = r"(?<![\d./-])\d{1,5}\s*[.,]\s*\d{2}(?![\d./-])"
PRICE_SPACED = r"(?<!\d)\d{1,5}\s+\d{2}(?!\d)"
PRICE_COMPACT = r"(?<!\d)\d{3,7}(?!\d)"
DISCOUNT = r"[-−–]?\s*(\d{1,3})\s*%"
TIME = r"(\d{2}[./-]\d{2}[./-]\d{4}\s+\d{1,2}:\d{2})"
ZONE_CODE = r"(\d{2}_\d{6}\s*-\s*\d{6})"
LONG_NUMBER = r"(?<!\d)(\d{9,13})(?!\d)"
SPECIAL = r"(?:^|\s)([ШшКкЛл])(?:\s|$)"
CYRILLIC = r"[А-Яа-яЁё]"
VOLUME_UNIT = r"(?iu)(?:л|l|литр|мл|ml|кг|kg|гр|г)(?![а-яa-z])"
CURRENCY = r"(?iu)(?:руб|₽|коп)"
NOT_A_PRICE = r"(?iu)(?:штрих|barcode|баркод|артикул|sku|id[_\s-]*sku|qr|код)"
NOT_A_PRODUCT = r"(?iu)(руб|коп|цена|скид|карте|штрих|артикул|qr|код|дата|печати|итого|%|₽)"
DATE_LIKE = r"\d{1,2}[./-]\d{1,2}|[:]"
#: What every price of the best-crop rules holds.
ANY_PRICE = r"\d\s*[.,]?\s*\d{2}"

MARK = "\x01"


def _all(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


# ---- fusion rules -------------------------------------------------------------------------

def _fusion_pass(text: Column, body: str) -> Column:
    """Price texts of one pattern; those touching a point are taken for a piece of a date."""
    pattern = (r"(?:(?<=(\.))|(?<!\.))(?<!\d)(?=(" + body + r"))" + body + FUSION_PRICE_END
               + r"(?=(\.?))")
    parts = F.arrays_zip(_all(text, pattern, 1).alias("before"), _all(text, pattern, 2).alias("price"),
                         _all(text, pattern, 3).alias("after"))
    kept = F.filter(parts, lambda p: (p["before"] == "") & (p["after"] == ""))
    return F.transform(kept, lambda p: F.concat_ws(
        ",", F.regexp_extract(p["price"], r"^(\d+)", 1).cast("bigint").cast("string"),
        F.regexp_extract(p["price"], r"(\d{2})$", 1)))


def fusion_prices(text: Column) -> Column:
    return plain_prices(without_discounts(text))


def without_discounts(text: Column) -> Column:
    return F.regexp_replace(text, FUSION_DISCOUNT, " ")


def plain_prices(plain: Column) -> Column:
    """The same of a text without discounts."""
    return F.array_distinct(F.concat(_fusion_pass(plain, FUSION_PRICE),
                                     _fusion_pass(plain, FUSION_SPLIT_PRICE)))


def price_at(prices: Column, largest: bool) -> Column:
    """Largest or smallest price by number, then text; empty without any above zero."""
    rows = F.filter(F.transform(prices, lambda p: F.struct(
        F.translate(p, ",", ".").try_cast("double").alias("n"), p.alias("p"))), lambda r: r.n > 0)
    pick = F.array_max(rows) if largest else F.array_min(rows)
    return F.coalesce(pick.p, F.lit(""))


def fusion_barcode(text: Column) -> Column:
    ean = F.regexp_extract(text, EAN, 1)
    return F.when(ean != "", ean).otherwise(F.regexp_extract(text, BARCODE, 1))


def fusion_sku(text: Column, barcode: Column) -> Column:
    return F.coalesce(F.get(F.filter(_all(text, SKU, 1), lambda s: s != barcode), F.lit(0)), F.lit(""))


def fusion_info(text: Column) -> Column:
    low = F.lower(text)
    hits = [F.when(low.contains(w), w[:1].upper() + w[1:]) for w in FUSION_INFO_WORDS]
    return F.coalesce(*hits, F.lit(""))


def fusion_symbols(text: Column) -> Column:
    found = F.transform(_all(text, FUSION_SPECIAL, 1), F.upper)
    return F.array_join(F.array_distinct(found), "")


def fusion_discount(text: Column) -> Column:
    found = F.translate(F.regexp_replace(F.regexp_extract(text, FUSION_DISCOUNT, 0), r"(?U)\s+", ""),
                        "−", "-")
    return F.when((found == "") | found.startswith("-"), found).otherwise(
        F.concat(F.lit("-"), found))


def count_class(c: Column, char_class: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{char_class}]", ""))


def product_line_score(value: Column) -> Column:
    """How much a line looks like a product name; below 2 it is not one. ``value`` is stripped already and
    read many times, so it should be a column that is settled."""
    priced = value.rlike(r"(?<!\d)" + FUSION_PRICE + FUSION_PRICE_END) | value.rlike(BARCODE) | value.rlike(SKU)
    other = value.rlike(FUSION_DISCOUNT) | value.rlike(FUSION_TIME)
    words = F.regexp_count(value, F.lit(r"(?U)\w+"))
    cyrillic = value.rlike("[Ѐ-ӿ]")
    score = (count_class(value, r"\p{L}") - count_class(value, r"\p{Nd}")
             + F.when(value.rlike(r"\p{Lu}"), 1).otherwise(0))
    return (F.when(F.length(value) < 6, -2).when(priced, -3).when(other, -2)
            .when(~cyrillic & (words <= 1), -2).otherwise(score))


def clean_product_line(c: Column) -> Column:
    value = F.trim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(" .,:;|-"))
    return t.strip(F.regexp_replace(value, r"(?iU)(?<!\w)QR(?!\w)", ""))


# ---- best-crop rules ----------------------------------------------------------------------

def spans(text: Column, pattern: str) -> Column:
    """All matches as (start, end, text) structs, found on the unchanged text."""
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK)
    empty = F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)")
    start = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("inside"), empty.alias("found"))

    def step(acc: Column, part: Column) -> Column:
        stop = acc["pos"] + F.length(part)
        row = F.struct(acc["pos"].alias("start"), stop.alias("end"), part.alias("text"))
        return F.struct(stop.alias("pos"), (~acc["inside"]).alias("inside"),
                        F.when(acc["inside"], F.array_append(acc["found"], row))
                        .otherwise(acc["found"]).alias("found"))

    return F.aggregate(parts, start, step)["found"]


def _around(text: Column, span: Column, before: int, after: int) -> Column:
    low = F.greatest(F.lit(0), span["start"] - before)
    return F.substring(text, low + 1, span["end"] + after - low)


def _overlaps(span: Column, taken: Column) -> Column:
    return F.exists(taken, lambda s: (span["end"] > s["start"]) & (span["start"] < s["end"]))


def _price_text(whole: Column, cents: Column, context: Column) -> Column:
    """``12.50``, or NULL where number or context rule the price out."""
    value = F.concat_ws(".", whole, cents).try_cast("double")
    bad = ((value < 2.0) & ~context.rlike(CURRENCY)) | (value > 999999) | context.rlike(NOT_A_PRICE)
    text = F.concat_ws(".", whole.try_cast("bigint").cast("string"), cents)
    return F.when((whole != "") & (cents != "") & ~bad, text)


def tag_prices(text: Column) -> Column:
    """Distinct prices of a text in the order found: dotted, spaced, then compact numbers."""
    return t.let(t.squeeze(text), squeezed_prices)


def squeezed_prices(text: Column) -> Column:
    """The same of a text that is squeezed already; most texts are told apart by one pattern."""
    none = F.expr("cast(array() as array<string>)")
    return F.when(~text.rlike(ANY_PRICE), none).otherwise(_prices_of(text))


def _priced(text: Column, pattern: str) -> Column:
    """Spans of numbers with cents: place, roubles, whether a unit of volume is near, and their price. Array functions are
    interpreted and repeat what they name twice, so each step is an array of its own."""
    def described(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.regexp_extract(s["text"], r"^(\d+)", 1).alias("whole"),
                        F.substring(s["text"], -2, 2).alias("cents"), _around(text, s, 18, 18).alias("context"),
                        _around(text, s, 4, 5).rlike(VOLUME_UNIT).alias("unit"))

    return F.transform(F.transform(spans(text, pattern), described), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["whole"].alias("whole"), s["unit"].alias("unit"),
        F.when(~s["unit"], _price_text(s["whole"], s["cents"], s["context"])).alias("price")))


def _prices_of(text: Column) -> Column:
    return t.let(_priced(text, PRICE), lambda dotted: _with_dotted(text, dotted))


def _with_dotted(text: Column, dotted: Column) -> Column:
    unit = lambda s: _around(text, s, 4, 5).rlike(VOLUME_UNIT)
    context = lambda s: _around(text, s, 18, 18)
    place = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))

    first = F.array_compact(F.transform(dotted, lambda s: s["price"]))
    state = F.struct(F.array_distinct(first).alias("prices"), F.transform(dotted, place).alias("taken"))

    def spaced_step(acc: Column, s: Column) -> Column:
        skip = _overlaps(s, dotted) | s["whole"].isin("0", "1")
        new = s["price"].isNotNull() & ~F.array_contains(acc["prices"], F.coalesce(s["price"], F.lit("")))
        return F.when(skip, acc).otherwise(F.struct(
            F.when(new, F.array_append(acc["prices"], s["price"])).otherwise(acc["prices"]).alias("prices"),
            F.when(new | s["unit"], F.array_append(acc["taken"], place(s))).otherwise(acc["taken"]).alias("taken")))

    state = F.aggregate(_priced(text, PRICE_SPACED), state, spaced_step)

    def compact_price(s: Column) -> Column:
        raw = s["text"]
        before = F.substring(text, s["start"], F.when(s["start"] > 0, 1).otherwise(0))
        after = F.substring(text, s["end"] + 1, F.lit(1))
        good = (F.length(raw).between(4, 7) & ~raw.startswith("0")
                & ~before.rlike(r"[.,/:;-]") & ~after.rlike(r"[.,/:;-]") & ~unit(s)
                & ~context(s).rlike(DATE_LIKE))
        size = F.length(raw)
        return F.when(good, _price_text(F.substring(raw, F.lit(1), size - 2),
                                        F.substring(raw, size - 1, F.lit(2)), context(s)))

    def finish(acc: Column) -> Column:
        compact = F.filter(spans(text, PRICE_COMPACT), lambda s: ~_overlaps(s, acc["taken"]))
        return F.array_distinct(F.concat(
            acc["prices"], F.array_compact(F.transform(compact, compact_price))))

    return t.let(state, finish)


def pair_price(left: Column, right: Column) -> Column:
    """Price split over two neighbouring lines, roubles above cents."""
    fits = left.rlike(r"^\d{1,5}$") & right.rlike(r"^\d{2}$")
    return F.when(fits, _price_text(left, right, F.concat_ws(" ", left, right)))


def tag_barcode(text: Column) -> Column:
    valid = F.filter(_all(text, BARCODE, 1), t.ean13_digits)
    return F.coalesce(F.get(valid, F.lit(0)), F.lit(""))


def tag_sku(text: Column, barcode: Column) -> Column:
    others = F.filter(_all(text, LONG_NUMBER, 1), lambda n: n != barcode)
    liked = F.filter(others, lambda n: (F.length(n) >= 10) & n.rlike("^[23]"))
    return F.coalesce(F.get(liked, F.lit(0)), F.get(others, F.lit(0)), F.lit(""))


def tag_discount(text: Column) -> Column:
    number = F.regexp_extract(text, DISCOUNT, 1)
    return F.when(number != "", F.concat(F.lit("-"), number, F.lit("%"))).otherwise("")


def tag_time(text: Column) -> Column:
    return F.translate(F.regexp_extract(text, TIME, 1), "-", ".")


def tag_zone_code(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text, ZONE_CODE, 1), " ", "")


def tag_symbol(text: Column) -> Column:
    return F.upper(F.regexp_extract(F.translate(text, "|", " "), SPECIAL, 1))


def tag_info(text: Column) -> Column:
    low = F.lower(text)
    return F.concat_ws("; ", *[F.when(low.contains(w), w) for w in BEST_CROP_INFO_WORDS])


def is_product_line(c: Column) -> Column:
    text = t.squeeze(c)
    return like_a_product(text) & without_prices(text)


def like_a_product(text: Column) -> Column:
    """The rules of a product line but the one on prices, for a squeezed text; they have no array functions, so that Spark
    can compile them."""
    digits, letters = count_class(text, r"\p{Nd}"), count_class(text, r"\p{L}")
    return ((F.length(text) >= 5) & text.rlike(CYRILLIC) & ~text.rlike(NOT_A_PRODUCT)
            & ~text.rlike(TIME) & ~text.rlike(ZONE_CODE) & (letters >= 3)
            & (digits <= F.greatest(F.lit(5), letters)))


def without_prices(text: Column) -> Column:
    return F.size(squeezed_prices(text)) == 0


def clean_tag_product(c: Column) -> Column:
    text = F.regexp_replace(t.squeeze(c), r"^[^A-Za-zА-Яа-яЁё]+", "")
    return F.trim(text, F.lit(" -;,.|_"))


def two_decimals(c: Column) -> Column:
    """Two decimals with a point; text that is no number passes through."""
    number = F.translate(t.strip(c), ",", ".")
    value = F.when(number.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), number.try_cast("double"))
    return F.when(value.isNull(), c).otherwise(t.fixed_decimals(value, 2))


def canonical_absent(c: Column) -> Column:
    return squeezed_absent(t.squeeze(c))


def squeezed_absent(text: Column) -> Column:
    return F.when(F.lower(text).isin(ABSENT, "νες", "νετ"), ABSENT).otherwise(text)
