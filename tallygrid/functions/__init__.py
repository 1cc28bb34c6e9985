"""Column-level functions."""

from tallygrid.functions.conditions import compare_alert, compare_exact
from tallygrid.functions.jsonprops import json_property
from tallygrid.functions.texts import number_text, split_steps
from tallygrid.functions.times import at, day_of, literal_time, parse_time, window_bounds

__all__ = [
    "at", "compare_alert", "compare_exact", "day_of", "json_property", "literal_time",
    "number_text", "parse_time", "split_steps", "window_bounds",
]
