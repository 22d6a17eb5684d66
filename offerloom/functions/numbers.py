"""Number parsing and the rounding and tolerance rules of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS_CHARS, let, rx, squeeze

# What makes a table cell a fiscal-period label.
PERIOD = rx(
    r"(?i)(?:jan|feb|mar(?:ch)?|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\.?[, ]*\d{2,4}"
    r"|fy\s*'?\d{2,4}|20\d{2}\s*[-–]\s*\d{2,4}|\b20\d{2}\b|\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b"
)


def round2(c: Column) -> Column:
    """Two decimals, ties toward plus infinity."""
    return F.floor(c * 100 + F.lit(0.5)) / F.lit(100.0)


#: Most amounts are bare digits, which need no look at brackets and signs.
_PLAIN = r"^\d*\.?\d+$"


def _signed(text: Column, digits: str) -> Column:
    """'(x)' and '-x' are negative; anything not matching ``digits`` is null."""
    def value(t: Column) -> Column:
        minus = t.startswith("-") | (t.startswith("(") & t.endswith(")"))
        number = F.when(t.startswith("("), F.regexp_replace(t, r"^\((.*)\)$", "$1")).otherwise(t)

        def signed(n: Column) -> Column:
            amount = let(F.when(n.startswith("-"), F.substring(n, 2, 2147483647)).otherwise(n), lambda body: F.when(body.rlike(digits), body.try_cast("double")))
            return F.when(minus | n.startswith("-"), -amount).otherwise(amount)

        return F.when(t.rlike(_PLAIN), t.try_cast("double")).otherwise(let(number, signed))

    return let(text, value)


def parse_num(c: Column) -> Column:
    """Indian-format amount: strips ₹ , % and spaces."""
    return _signed(F.translate(c, "₹,%" + WS_CHARS, ""), r"^\d*\.?\d+$")


def parse_indian_num(c: Column) -> Column:
    """Like parse_num, with $ as well."""
    return _signed(F.translate(c, "₹,%$" + WS_CHARS, ""), r"^-?\d*\.?\d+$")


def leading_float(c: Column) -> Column:
    """Number at the start of the text ('12abc' → 12), else null."""
    t = F.regexp_extract(c, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+))", 1)
    return t.try_cast("double")


def parse_indian_number(c: Column) -> Column:
    return leading_float(F.regexp_replace(c, ",", ""))


def parse_shares(c: Column) -> Column:
    return let(F.trim(F.translate(c, "*^,", "")), lambda t: F.when(t.rlike(r"^\d+$"), t.try_cast("bigint")))


def _plain_number(c: Column) -> Column:
    """A cell that is wholly a number; blank counts as 0."""
    t = F.trim(c)
    return F.when(t == "", F.lit(0.0)).otherwise(F.when(t.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)$"), t.try_cast("double")))


def parse_price_range(c: Column) -> Column:
    """'Rs.326 to Rs.343' → struct(minimum, maximum); one positive price fills both."""
    clean = squeeze(F.regexp_replace(F.regexp_replace(c, r"(?i)Rs\.?", ""), ",", ""))
    parts = F.split(clean, r"(?i)\s+to\s+|\s*-\s*")
    pair = F.size(parts) == 2
    single = _plain_number(clean)
    single = F.when((clean != "") & (single > 0), single)
    low = F.when(pair, _plain_number(F.get(parts, F.lit(0)))).otherwise(single)
    high = F.when(pair, _plain_number(F.get(parts, F.lit(1)))).otherwise(single)
    blank = clean == ""
    return F.struct(
        F.when(~blank, low).alias("minimum"),
        F.when(~blank, high).alias("maximum"),
    )


def parse_price_band(c: Column) -> Column:
    """First two whole numbers of a price text."""
    nums = F.transform(
        F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d[\d,]*"), F.lit(0)),
        lambda n: F.regexp_replace(n, ",", "").try_cast("double"),
    )
    first = F.get(nums, F.lit(0))
    return F.struct(first.alias("minimum"), F.coalesce(F.get(nums, F.lit(1)), first).alias("maximum"))


def looks_like_period(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(PERIOD)


def _close(a: Column, b: Column, rel: float, absolute: float) -> Column:
    diff = F.abs(a - b)
    scale = F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))
    return (diff <= absolute) | (diff / scale <= rel)


def approx_equal(a: Column, b: Column, rel: float = 0.05, absolute: float = 0.5) -> Column:
    """Null when a side is missing."""
    return _close(a, b, rel, absolute)


def values_match(a: Column, b: Column, rel: float = 0.01, absolute: float = 0.05) -> Column:
    """False when a side is missing."""
    return F.coalesce(_close(a, b, rel, absolute), F.lit(False))


def clamp01(c: Column) -> Column:
    """Three decimals, held inside 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(c, 3)))
