"""Schemas and names of the data model: order events, observations, episodes, pairs, codebooks."""

from __future__ import annotations

from pyspark.sql import DataFrame

FEATURE_VERSION = 2
DEPTH = 10
HISTORY, HORIZON = 256, 128

MBO_SCHEMA = (
    "session_id string, source_row bigint, ts_recv bigint, ts_event bigint, action string, side string, price double, "
    "size double, order_id bigint, flags int, sequence bigint, publisher_id int, instrument_id bigint"
)
LEVELS = "array<struct<price: double, qty: double, orders: bigint>>"
OBS_SCHEMA = f"session_id string, row_id bigint, segment bigint, ts_recv bigint, ts_event bigint, source_row bigint, mid double, bids {LEVELS}, asks {LEVELS}, x array<double>"
EPISODE_SCHEMA = "session_id string, anchor bigint, x array<array<float>>, y array<double>"
PAIR_SCHEMA = "pair_id bigint, s1 string, a1 bigint, s2 string, a2 bigint, d_raw double, d double"
CODEBOOK_SCHEMA = "code int, prototype array<float>"
STATE_FUTURE_SCHEMA = "code int, step int, n bigint, mean double, var double"


def feature_names(depth: int = DEPTH) -> list[str]:
    """8 * depth + 6 names: levels of either side, then what describes the whole book and its clock."""
    # Names and their order are the data model's.
    fields = ("price_ticks", "quantity", "orders", "present")
    levels = [f"{side}_{level}_{field}" for side in ("bid", "ask") for level in range(1, depth + 1) for field in fields]
    return [*levels, "spread_ticks", "time_delta_seconds", "mid_return", "initial", "tod_sin", "tod_cos"]


def require_columns(df: DataFrame, names: list[str], version: int | None = FEATURE_VERSION) -> DataFrame:
    """The same frame, if it has exactly these columns in order and no other schema version."""
    if version not in (None, FEATURE_VERSION):
        raise ValueError(f"schema version {version}, not {FEATURE_VERSION}")
    if df.columns != list(names):
        raise ValueError(f"columns {df.columns} are not {list(names)}")
    return df
