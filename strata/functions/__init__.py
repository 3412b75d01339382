from strata.functions.expr import (
    arith_hash, arith_hash_sql, band, clamp_decrement, clamp_increment, compare, flip_binary,
    fmt_fixed, indicator, is_missing, nan_to_null, nan_to_num, recode, row_hash, safe_div,
    threshold_label, today_iso,
)

__all__ = [
    "arith_hash", "arith_hash_sql", "band", "clamp_decrement", "clamp_increment", "compare",
    "flip_binary", "fmt_fixed", "indicator", "is_missing", "nan_to_null", "nan_to_num", "recode",
    "row_hash", "safe_div", "threshold_label", "today_iso",
]
