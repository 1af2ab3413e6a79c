"""Text, number and date rules for record fields, as Column builders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tagweave.schema import (
    ABSENT, BARCODE_COLUMNS, DEFAULT_SOURCE_WEIGHT, PRICE_COLUMNS, SOURCE_WEIGHTS,
    SPECIAL_SYMBOLS, UNIT_ALIASES,
)

# Every character that counts as blank at the ends of a value.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Rule patterns.
PRICE_PART = r"(\d{1,6})(?:,(\d{1,2}))?"
DISCOUNT_PART = r"-?\d{1,3}%"
DOTTED_TIME = r"(\d{2}\.\d{2}\.\d{4})\s+(\d{1,2})\.(\d{2})"
PLAIN_TIME = r"\d{2}\.\d{2}\.\d{4}\s+\d{1,2}:\d{2}"
STRICT_TIME = (r"^(\d{1,2})\.(\d{1,2})\.(\d{4}) (?:0(?=\d))?(\d|1\d|2[0-3])"
               r"(?:\.([0-5]?\d)|:([0-5]?\d)(?::[0-5]?\d)?)$")
NOT_COMPARABLE = r"[^0-9a-zа-яё.% -]+"


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """Trim and turn every run of blanks into one space."""
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def normalize_value(c: Column | str) -> Column:
    raw = col_of(c)
    whole = F.regexp_replace(strip(raw), r"^(\d+)\.0$", "$1")  # only where it can match
    return F.coalesce(F.when(raw.contains(".0"), whole).otherwise(strip(raw)), F.lit(""))


def _clean(c: Column | str, ready: bool) -> Column:
    """The value itself where the caller already holds its normal form."""
    return col_of(c) if ready else normalize_value(c)


def is_missing(c: Column) -> Column:
    return (c == "") | (c == ABSENT)


def is_present(c: Column) -> Column:
    return (c != "") & (c != ABSENT)


def _unless_missing(text: Column, result: Column) -> Column:
    return F.when(is_missing(text), text).otherwise(result)


def normalize_price(c: Column | str, ready: bool = False) -> Column:
    text = F.translate(_clean(c, ready), ". ", ",")
    whole, cents = (F.regexp_extract(text, PRICE_PART, i) for i in (1, 2))
    price = F.concat(F.regexp_replace(whole, r"^0+(?=\d)", ""), F.lit(","), F.rpad(cents, 2, "0"))
    return _unless_missing(text, F.when(whole == "", "").otherwise(price))


def price_value(c: Column | str, ready: bool = False) -> Column:
    """Price as a double; 0 where the text holds no price. Six digits keep it below a million."""
    text = F.translate(_clean(c, ready), ". ", ",")
    found = F.translate(F.regexp_extract(text, PRICE_PART, 0), ",", ".")
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def valid_price(c: Column | str, ready: bool = False) -> Column:
    return price_value(c, ready) > 0


def normalize_discount(c: Column | str, ready: bool = False) -> Column:
    text = F.translate(_clean(c, ready), "\u2212 ", "-")
    found = F.regexp_extract(text, DISCOUNT_PART, 0)
    return _unless_missing(text, F.regexp_replace(found, r"^-?(.+)$", "-$1"))


def valid_discount(c: Column | str, ready: bool = False) -> Column:
    text = F.translate(_clean(c, ready), "\u2212 ", "-")
    number = F.regexp_extract(text, r"(\d{1,3})%", 1).try_cast("int")
    return F.coalesce(number.between(1, 100), F.lit(False))


def digits_only(c: Column | str, ready: bool = False) -> Column:
    return F.regexp_replace(_clean(c, ready), r"\D+", "")


def valid_barcode(c: Column | str, ready: bool = False) -> Column:
    return F.length(digits_only(c, ready)).between(8, 14)


def valid_ean13(c: Column | str) -> Column:
    """Thirteen digits whose last one is the check digit."""
    return ean13_digits(digits_only(c))


def ean13_digits(text: Column) -> Column:
    """The same of a text of digits only."""
    digit = lambda i: F.ascii(F.substring(text, i, 1)) - 48
    weighted = reduce(lambda a, b: a + b, (digit(i) * (1 if i % 2 else 3) for i in range(1, 13)))
    return (F.length(text) == 13) & ((10 - weighted % 10) % 10 == digit(13))


def valid_sku(c: Column | str, ready: bool = False) -> Column:
    return F.length(digits_only(c, ready)) == 12


def normalize_datetime(c: Column | str, ready: bool = False) -> Column:
    value = _clean(c, ready)
    text = F.regexp_replace(F.translate(value, ",", "."), r"(?U)\s+", " ")
    text = F.regexp_replace(text, DOTTED_TIME, "$1 $2:$3")
    day = F.try_to_date(F.regexp_replace(text, STRICT_TIME, "=$3-$2-$1"), "'='yyyy-M-d")
    clock = F.regexp_replace(F.regexp_replace(text, STRICT_TIME, "$4:0$5$6"), r":0(\d\d)$", ":$1")
    exact = F.concat(F.date_format(day, "dd.MM.y"), F.lit(" "), clock)
    return _unless_missing(value, F.coalesce(exact, F.regexp_extract(text, PLAIN_TIME, 0)))


def normalize_symbols(c: Column | str, ready: bool = False) -> Column:
    value = _clean(c, ready)
    letters = "".join(SPECIAL_SYMBOLS)
    kept = F.regexp_replace(F.upper(value), f"[^{letters}]", "")
    return _unless_missing(value, F.array_join(F.array_distinct(F.split(kept, "")), ""))


def normalize_unit(c: Column | str) -> Column:
    text = squeeze(F.regexp_replace(F.lower(normalize_value(c)), r"\.", ""))
    table = F.create_map(*[F.lit(x) for pair in UNIT_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, text), F.lit(""))


def normalize_field(field: str, c: Column | str, ready: bool = False) -> Column:
    """Normal form of one named field."""
    if field in PRICE_COLUMNS:
        return normalize_price(c, ready)
    if field in (*BARCODE_COLUMNS, "id_sku"):
        value = _clean(c, ready)
        return _unless_missing(value, digits_only(value, True))
    if field == "discount_amount":
        return normalize_discount(c, ready)
    if field == "print_datetime":
        return normalize_datetime(c, ready)
    if field == "special_symbols":
        return normalize_symbols(c, ready)
    return _clean(c, ready)


def valid_field(field: str, c: Column | str, ready: bool = False) -> Column:
    value = _clean(c, ready)
    if field in PRICE_COLUMNS:
        rule = valid_price(value, True)
    elif field in BARCODE_COLUMNS:
        rule = valid_barcode(value, True)
    elif field == "id_sku":
        rule = valid_sku(value, True)
    elif field == "print_datetime":
        rule = normalize_datetime(value, True) != ""
    elif field == "discount_amount":
        rule = valid_discount(value, True)
    elif field == "special_symbols":
        rule = value.rlike(f"(?iu)[{''.join(SPECIAL_SYMBOLS)}]")
    else:
        rule = F.lit(True)
    return is_present(value) & rule


def by_field(field: Column, rule, c: Column, fields: list[str]) -> Column:
    """Apply a per-field rule to the normalised value of a long (field, value) table."""
    groups: dict[str, list[str]] = {}
    for name in fields:
        kind = (
            "price_default" if name in PRICE_COLUMNS else
            "barcode" if name in BARCODE_COLUMNS else
            name if name in ("id_sku", "discount_amount", "print_datetime", "special_symbols")
            else "other"
        )
        groups.setdefault(kind, []).append(name)
    result = rule("other", c, True)
    for kind, names in groups.items():
        if kind != "other":
            result = F.when(field.isin(names), rule(kind, c, True)).otherwise(result)
    return result


def is_noise(c: Column) -> Column:
    text = strip(c)
    return (text == "") | text.rlike(r"^[^\p{L}\p{N}]$")


def canonical_text(c: Column | str) -> Column:
    text = F.translate(F.lower(normalize_value(c)), ",", ".")
    text = F.regexp_replace(text, r"(?U)\s+", " ")
    return strip(F.regexp_replace(text, NOT_COMPARABLE, ""))


def same_value(left: Column | str, right: Column | str) -> Column:
    """Equal canonical text; two empty sides count as equal."""
    a, b = col_of(left), col_of(right)
    return a.eqNullSafe(b) | (canonical_text(a) == canonical_text(b))


def same_present(left: Column | str, right: Column | str) -> Column:
    a, b = normalize_value(left), normalize_value(right)
    return is_present(a) & (a == b)


def first_value(*values: Column) -> Column:
    texts = [normalize_value(v) for v in values]
    present = [F.when(is_present(t), t) for t in texts]
    any_absent = reduce(lambda a, b: a | b, (t == ABSENT for t in texts))
    return F.coalesce(*present, F.when(any_absent, ABSENT).otherwise(""))


def decimal_number(c: Column | str) -> Column:
    """Number from a text with decimal comma; 0 where it is none."""
    text = F.translate(strip(col_of(c)), ",", ".")
    plain = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.coalesce(F.when(plain, text.try_cast("double")), F.lit(0.0))


def loose_number(c: Column | str, default: float = 0.0) -> Column:
    """First number inside a text, blanks and NBSP dropped, comma read as point."""
    text = F.translate(strip(col_of(c)), ",\u00a0 ", ".")
    found = F.regexp_extract(text, r"-?\d+(?:\.\d+)?", 0)
    return F.coalesce(found.try_cast("double"), F.lit(default))


def let(value: Column, use) -> Column:
    """Evaluate a value once and use it several times inside array functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scaled_half_even(size: Column, digits: int) -> Column:
    """``size * 10^digits`` as a whole number, rounded on the exact binary value, ties to even.

    The product is split into its double and the exact rounding error of that double; the error
    decides on which side of a tie the true product lies. ``size`` must not be negative.
    """
    scale = float(10 ** digits)

    def decide(s: Column) -> Column:
        rest = s["p"] - s["l"]
        up = (rest > 0.5) | ((rest == 0.5) & ((s["e"] > 0) | ((s["e"] == 0) & (s["l"] % 2 == 1))))
        return s["l"] + F.when(up, 1).otherwise(0)

    halves = lambda x: F.struct(x.alias("x"), (x * 134217729.0 - (x * 134217729.0 - x)).alias("h"))
    parts = lambda s: F.struct(
        (s["x"] * scale).alias("p"), F.floor(s["x"] * scale).alias("l"),
        ((s["h"] * scale - s["x"] * scale) + (s["x"] - s["h"]) * scale).alias("e"))
    return let(let(let(size, halves), parts), decide)


def fixed_decimals(c: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, ties decided on the exact binary value."""
    scale = 10 ** digits

    def exact(n: Column) -> Column:
        return F.concat(F.floor(n / scale).cast("string"), F.lit("."),
                        F.lpad((n % scale).cast("string"), digits, "0"))

    near_tie = F.abs(F.abs(c * scale) % 1 - 0.5) < 1e-4
    sign = F.when(c < 0, "-").otherwise("")
    return F.when(near_tie, F.concat(sign, let(_scaled_half_even(F.abs(c), digits), exact))).otherwise(
        F.format_string(f"%.{digits}f", c))


def format_coordinate(c: Column) -> Column:
    """One decimal with comma, no trailing zero decimal."""
    return F.translate(F.regexp_replace(fixed_decimals(c, 1), r"\.0$", ""), ".", ",")


def file_stem(c: Column, strip_dots: bool = False, empty: str = "frame") -> Column:
    """Name safe for files: other characters become one underscore."""
    text = F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_")
    text = F.trim(text, F.lit("_." if strip_dots else "_"))
    return F.when(text == "", empty).otherwise(text)


def source_weight(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SOURCE_WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, source), F.lit(DEFAULT_SOURCE_WEIGHT))


def inferred_source(field: Column, source: Column) -> Column:
    from_payload = field.endswith("_qr") | field.isin(
        "qr_code_barcode", "wholesale_level_1_count", "wholesale_level_1_price",
        "wholesale_level_2_count", "wholesale_level_2_price", "action_price_qr",
        "action_code_qr")
    return F.when(from_payload & (source != "derived"), "qr").otherwise(source)
