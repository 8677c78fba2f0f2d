"""Column expressions: everything here runs inside generated JVM code."""

from .numbers import (
    band,
    bit_flags,
    bits_clear,
    dec2,
    idiv,
    int_avg,
    percent,
    row_max,
    usage_flag,
)
from .temporal import clock_text, elapsed_seconds
from .text import (
    account,
    index_ddl,
    parse_kb,
    split_object_name,
    statement_text,
    temp_table_name,
    text_bytes,
)
from .xmlplan import dealt, index_hints, is_well_formed, plan_exists, plan_values

__all__ = [
    "account", "band", "bit_flags", "bits_clear", "clock_text", "dealt", "dec2", "elapsed_seconds",
    "idiv", "index_ddl", "index_hints", "int_avg", "is_well_formed", "parse_kb", "percent", "plan_exists",
    "plan_values", "row_max", "split_object_name", "statement_text", "temp_table_name",
    "text_bytes", "usage_flag",
]
