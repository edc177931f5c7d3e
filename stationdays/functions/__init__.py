from stationdays.functions.columns import (
    clean_text,
    decode_flags,
    flag_as_boolean,
    parse_date,
    parse_number,
    percent,
    ratio,
    scan_price,
    stripped,
    tail_code,
    to_celsius,
    undefined_as_null,
    is_measured,
    without_sentinel,
)

__all__ = [
    "clean_text",
    "decode_flags",
    "flag_as_boolean",
    "parse_date",
    "parse_number",
    "percent",
    "ratio",
    "scan_price",
    "stripped",
    "tail_code",
    "to_celsius",
    "is_measured",
    "undefined_as_null",
    "without_sentinel",
]
