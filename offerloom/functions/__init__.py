"""Column functions: text, dates, numbers and similarity."""

from .dates import (  # noqa: F401
    day_first_date,
    epoch_ms_date,
    format_iso,
    infer_status,
    parse_date,
    parse_day_range,
    strict_date,
    within_days,
)
from .numbers import (  # noqa: F401
    approx_equal,
    clamp01,
    leading_float,
    looks_like_period,
    parse_indian_num,
    parse_indian_number,
    parse_num,
    parse_price_band,
    parse_price_range,
    parse_shares,
    round2,
    values_match,
)
from .similarity import jaro_winkler, name_groups, score_pairs  # noqa: F401
from .text import (  # noqa: F401
    WS,
    artifact_key,
    blank_to_null,
    canon_name,
    clean_email,
    clean_name,
    clean_object_name,
    clean_phone,
    clean_text,
    distinct_names,
    first_defined,
    first_text,
    is_person_name,
    let,
    letters_key,
    looks_like_party,
    name_token,
    norm_url,
    normalize_company,
    normalize_heading,
    normalize_premium_name,
    normalize_symbol,
    page_hash,
    rx,
    slugify,
    split_person_names,
    squeeze,
    trim_all,
    trailing_page_number,
    trailing_path_id,
)
