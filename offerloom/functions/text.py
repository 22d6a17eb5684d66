"""String normalisers, all native Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the source feeds understand it (wider than Java's \s).
WS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

# Runs of white space that are not one plain space already; nothing else needs replacing.
# Printable ASCII is told apart first: it is nearly every character.
WS_RUN = f"[ ][[^!-~]&&{WS}]+|[[^ -~]&&[" + WS[3:].join([r"\t\n\x0B\f\r", ""]) + f"]{WS}*"

# The same characters one by one, for trimming and translating without a pattern.
WS_CHARS = " \t\n\x0b\f\r" + "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))

# A word boundary over [A-Za-z0-9_] only: Java's own \\b also looks at accented letters.
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def rx(pattern: str) -> str:
    """Pattern with ASCII word boundaries.

    A boundary before a word or a group of words only needs to look back, one after a letter
    only needs to look ahead.
    """
    pattern = re.sub(r"(?<=[A-Za-z])(?<!\\[A-Za-z])\\b", lambda _: r"(?!\w)", pattern)
    pattern = re.sub(r"\\b(?=[A-Za-z0-9(]|\\d)", lambda _: r"(?<!\w)", pattern)
    return pattern.replace(r"\b", BOUNDARY)


# Words dropped when names are compared.
COMPANY_STOP_WORDS = rx(r"\b(limited|ltd\.?|corporation|corp\.?|company|co\.?|ipo|details)\b")
PREMIUM_STOP_WORDS = rx(r"\b(limited|ltd\.?|ipo)\b")
SLUG_STOP_WORDS = rx(r"\b(limited|ltd\.?|private|pvt\.?|ipo)\b")

# Wording that marks a captured phrase as something other than a party.
PARTY_LEAD_IN = rx(
    r"(?i)^(?:the\s+|sole\s+|book\s+running\s+|lead\s+managers?\b[,:]?\s*|registrar\b[,:]?\s*"
    r"|to\s+the\s+(?:issue|offer)\b[,]?\s*|in\s+this\s+case\s+)+"
)
NON_PARTY = rx(
    r"(?i)stock\s+exchange|national\s+stock|securities\s+and\s+exchange\s+board|\bsebi\b|\brta\b"
    r"|\bnsdl\b|\bcdsl\b|sponsor\s+bank|banker\s+to|escrow|depositor"
)

# Prose words that never occur in a person's name.
PERSON_STOP_WORDS = rx(
    r"(?i)\b(?:interested|regarded|director|extent|their|they|our|the|being|shall|may|company|also"
    r"|such|these|those|been|have|has|had|from|thereof|thereto|therein|herein|himself|herself|itself"
    r"|themselves|pursuant|accordance|relation|shareholding|dividend|entitlement|remuneration"
    r"|reimbursement|expenses|rendered|services|managerial|personnel|sitting|fees|commission|bonus"
    r"|profit|equity|loan|advance|deposit|property|taken|lease|rent|properties|encumbered|pledged"
    r"|insured|life|insurance|policy|policies|max|aditya|sun|birla|financial|security|nominees"
    r"|personal|accident|tata|aig|covering|accidental|death|disability|injury|group|entities"
    r"|transactions|entered)\b"
)


def blank_to_null(c: Column) -> Column:
    """Null and '' mean the same thing in every feed."""
    return F.nullif(c, F.lit(""))


def first_defined(*cols: Column) -> Column:
    """First value that is neither null nor ''; numbers pass through."""
    return F.coalesce(*cols)


def first_text(*cols: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols])


def trim_all(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def squeeze(c: Column) -> Column:
    """Collapse every run of white space to one space and trim; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), WS_RUN, " "))


def _letters_digits(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, "[^a-z0-9" + WS[1:], ""))


def normalize_company(c: Column) -> Column:
    return _letters_digits(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), COMPANY_STOP_WORDS, ""))


def normalize_premium_name(c: Column) -> Column:
    return _letters_digits(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), PREMIUM_STOP_WORDS, ""))


def normalize_symbol(c: Column) -> Column:
    upper = F.upper(F.coalesce(c, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(upper, r"-(BE|EQ)$", ""), r"\.(NS|BO)$", ""))


def slugify(c: Column, suffix: Column | None = None) -> Column:
    base = F.lower(F.coalesce(blank_to_null(c), F.lit("unknown")))
    base = F.regexp_replace(base, "&", " and ")
    base = F.regexp_replace(base, SLUG_STOP_WORDS, " ")
    base = F.regexp_replace(F.trim(F.regexp_replace(base, r"[^a-z0-9]+", " ")), r"\s+", "-")
    slug = F.when(base == "", F.lit("unknown-ipo")).otherwise(F.concat(base, F.lit("-ipo")))
    if suffix is None:
        return slug
    tail = F.regexp_replace(F.lower(F.coalesce(suffix, F.lit(""))), r"[^a-z0-9]+", "")
    return F.when(blank_to_null(suffix).isNull(), slug).otherwise(F.concat(slug, F.lit("-"), tail))


def artifact_key(symbol: Column, doc_type: Column, ext: str) -> Column:
    safe = F.regexp_replace(F.upper(symbol), r"[^A-Z0-9_-]", "_")
    return F.concat(F.lit("ipos/"), safe, F.lit("/"), doc_type, F.lit("." + ext))


def norm_url(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"/+$", "")


def page_hash(c: Column) -> Column:
    """SHA-256 of the text with white space squeezed."""
    return F.sha2(squeeze(c), 256)


def normalize_heading(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(c), r"[^\w\s]", " "))


def letters_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def clean_text(c: Column) -> Column:
    """Page-text clean-up: one newline style, no control characters, at most one blank line."""
    t = F.regexp_replace(c, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[^\x09\x0A\x20-\x7E\x{00A0}-\x{10FFFF}]", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"[ \t]+(?=\n|$)", "")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def trailing_path_id(c: Column) -> Column:
    """Numeric id closing a path such as /gmp/some-name/2199/."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"/(\d+)/?$", 1).try_cast("bigint")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trailing_page_number(c: Column, last: int | None = None) -> Column:
    """Page number closing a line after a space or a full stop; null above ``last``, if given."""
    n = F.regexp_extract(c, r"[\s.](\d{1,9})\s*$", 1).try_cast("int")
    return let(n, lambda v: F.when((v > 0) & (F.lit(True) if last is None else v <= last), v))


def clean_object_name(c: Column) -> Column:
    """Squeezed, without number in front, footnote marks and a bracketed number at the end."""
    def unmarked(t: Column) -> Column:
        marked = t.contains("*") | t.contains("#") | t.contains("^")
        return F.when(marked, F.regexp_replace(t, r"[*#^]+$", "")).otherwise(t)

    def unnumbered(t: Column) -> Column:
        return F.trim(F.when(t.contains(")"), F.regexp_replace(t, r"\s*\(\d+\)\s*$", "")).otherwise(t))

    front = F.regexp_replace(F.replace(squeeze(c), F.lit("\\"), F.lit("")), r"^\(?\d+\)?\.?\s*", "")
    return let(let(front, unmarked), unnumbered)


def clean_name(c: Column) -> Column:
    t = F.translate(squeeze(c), "•·*\"“”", "")
    return F.trim(F.regexp_replace(t, r"\s*,\s*$", ""))


def canon_name(c: Column) -> Column:
    """Drop the lead-in of a captured party name ('... being X', 'Lead Manager: X')."""
    n = F.regexp_replace(clean_name(c), rx(r"(?i)^.*?\bbeing\s+"), "")
    return F.trim(F.regexp_replace(n, PARTY_LEAD_IN, ""))


def clean_email(c: Column) -> Column:
    return F.trim(F.lower(blank_to_null(c)))


def clean_phone(c: Column) -> Column:
    return F.when(blank_to_null(c).isNotNull(), squeeze(F.regexp_replace(c, r"[^\d+]", " ")))


def looks_like_party(c: Column) -> Column:
    return (
        c.rlike(r"^[A-Z]")
        & c.rlike(rx(r"(?i)\b(?:Limited|Ltd\.?|LLP)\b"))
        & (F.length(c) >= 6)
        & ~c.rlike(rx(r"(?i)^(?:to|in|the|being|a|of)\b"))
        & ~c.rlike(NON_PARTY)
    )


def name_token(c: Column) -> Column:
    """First run of at least four letters, lower case."""
    return blank_to_null(F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), "[a-z]{4,}", 0))


def is_person_name(c: Column) -> Column:
    words = F.split(F.trim(c), r"\s+")
    return (
        c.rlike(r"^[A-Z][a-zA-Z\s.]+$")
        & ~c.rlike(PERSON_STOP_WORDS)
        & ((F.size(words) > 1) | (F.length(F.get(words, F.lit(0))) >= 5))
    )


def split_person_names(raw: Column) -> Column:
    """'A and B, Mr. C' → array of names, still with repeats."""
    def split(text: Column) -> Column:
        boilerplate = text.rlike(r"(?i)^(?:the\s+)?(?:issue|offer)\s*$")
        return F.when(boilerplate, F.array().cast("array<string>")).otherwise(_person_names(text))

    return let(squeeze(raw), split)


def _person_names(text: Column) -> Column:
    s = F.regexp_replace(text, r"\.$", "")
    s = F.regexp_replace(F.trim(s), r"(?i)\s+(?:and|&)\s*$", "")
    s = F.regexp_replace(s, r"(?i)\s+(?:and|&)\s+", ",")
    parts = F.transform(
        F.split(s, ","),
        lambda p: F.trim(F.regexp_replace(F.trim(p), r"(?i)^(?:mr|mrs|ms|shri|smt)[.\s]+", "")),
    )
    return F.filter(parts, lambda p: (F.length(p) >= 3) & is_person_name(p))


def distinct_names(names: Column) -> Column:
    """First spelling of each name, compared by letters only, order kept."""
    def firsts(held: Column) -> Column:
        return let(F.transform(held, letters_key), lambda keys: F.filter(held, lambda _, i: F.array_position(keys, F.get(keys, i)) == i + 1))

    return let(names, firsts)
