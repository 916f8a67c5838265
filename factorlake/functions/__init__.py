from factorlake.functions.missing import clean, drop_any_nan, finite, nan_to, null_if_nan, present
from factorlake.functions.scalars import (
    bucket, fmt_day, join_errors, metadata_to_json, parse_day, round_half_up, shift_days,
    to_naive_day, to_prefix_code,
)
from factorlake.functions.stats import avg_if, safe_corr, win_rate

__all__ = [
    "avg_if", "bucket", "clean", "drop_any_nan", "finite", "fmt_day", "join_errors",
    "metadata_to_json", "nan_to", "null_if_nan", "parse_day", "present", "round_half_up",
    "safe_corr", "shift_days", "to_naive_day", "to_prefix_code", "win_rate",
]
