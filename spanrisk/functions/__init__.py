"""Column-level helpers (null-safe clip, zero-pad, lookups, rounding)."""

from spanrisk.functions.columns import (  # noqa: F401
    bool_to_int, clip, cond_to_risk, map_lookup, round_half_even, strip_ws,
    to_double, to_int, zpad,
)
