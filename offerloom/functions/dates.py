"""Date parsing and guards. A date that does not exist in the calendar is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze

# Three-letter months in calendar order.
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC"


def _month_number(word: Column) -> Column:
    """1..12 from the first three letters of a month word, null otherwise."""
    head = F.upper(F.substring(word, 1, 3))
    pos = F.position(head, F.lit(MONTHS))
    return F.when((F.length(head) == 3) & (pos % 4 == 1), F.floor(pos / 4) + 1)


def _from_parts(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", year, month.cast("string"), day)
    return F.when(month.isNotNull(), F.try_to_date(text, "yyyy-M-d"))


def _worded(s: Column, pattern: str) -> Column:
    day = F.regexp_extract(s, pattern, 1)
    month = _month_number(F.regexp_extract(s, pattern, 2))
    return F.when(s.rlike(pattern), _from_parts(F.regexp_extract(s, pattern, 3), month, day))


def parse_date(c: Column) -> Column:
    """ISO, 25-MAY-2026, '05 Jun 2026', ISO date-times and 'June 5, 2026' to DATE."""
    s = squeeze(c)
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}(T.*| \d{2}:.*)?$"), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))
    dashed = _worded(s, r"^(\d{1,2})-([A-Za-z]{3,})-(\d{4})$")
    spaced = _worded(s, r"^(\d{1,2}) ([A-Za-z]{3,}),? (\d{4})$")
    american = r"^([A-Za-z]{3,}) (\d{1,2}),? (\d{4})$"
    month_first = F.when(
        s.rlike(american),
        _from_parts(
            F.regexp_extract(s, american, 3),
            _month_number(F.regexp_extract(s, american, 1)),
            F.regexp_extract(s, american, 2),
        ),
    )
    return F.coalesce(iso, dashed, spaced, month_first)


def strict_date(c: Column) -> Column:
    """Timeline dates: exactly ISO or D-Mon-YYYY; date-times and the rest are null."""
    s = squeeze(c)
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd"))
    return F.coalesce(iso, _worded(s, r"^(\d{1,2})-([A-Za-z]{3})-(\d{4})$"))


def format_iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def day_first_date(c: Column) -> Column:
    """DD-MM-YYYY to DATE."""
    return F.when(c.rlike(r"^\d{2}-\d{2}-\d{4}$"), F.try_to_date(c, "dd-MM-yyyy"))


def epoch_ms_date(c: Column) -> Column:
    """Epoch milliseconds to a UTC date; null and 0 are missing."""
    return F.to_date(F.timestamp_millis(F.nullif(c, F.lit(0).cast("bigint"))))


def within_days(a: Column, b: Column, days: int = 30) -> Column:
    return F.coalesce(F.abs(F.datediff(a, b)) <= days, F.lit(False))


def parse_day_range(c: Column) -> Column:
    """'05th – 09th Jun 2026' → struct(start, end); month and year close the text."""
    s = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)(\d+)(st|nd|rd|th)", "$1"))
    month_year = F.regexp_extract(s, r"([A-Za-z]{3,9})\s+(\d{4})", 0)
    days = F.regexp_extract_all(s, F.lit(r"\b(\d{1,2})\b"), F.lit(1))
    ranged = (month_year != "") & (F.size(days) > 0)

    def day(d: Column) -> Column:
        return parse_date(F.concat_ws(" ", d, month_year))

    single = parse_date(s)
    return F.struct(
        F.when(ranged, day(F.get(days, F.lit(0)))).otherwise(single).alias("start"),
        F.when(ranged, day(F.get(days, F.size(days) - 1))).otherwise(single).alias("end"),
    )


def infer_status(start: Column, end: Column, listing: Column, today: Column) -> Column:
    return (
        F.when(listing < today, "listed")
        .when(end < today, "closed")
        .when(start > today, "upcoming")
        .when((start <= today) & (today <= end), "open")
    )
