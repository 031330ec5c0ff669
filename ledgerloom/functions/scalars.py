"""Column expressions: clocks, returns, features, vectors, scales, checks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.schema import DEPTH, feature_names

DAY_NS = 86_400_000_000_000


# --- clocks ---


def seconds_since_midnight(ns: Column, clock: str = "receive", zone: str = "America/Chicago") -> Column:
    """Seconds of the local day. `receive` follows the zone's civil time, `simulation` cuts the count into days."""
    if clock == "simulation":
        return F.pmod(ns, F.lit(DAY_NS)) / 1e9
    if clock != "receive":
        raise ValueError(f"clock {clock!r} is neither 'receive' nor 'simulation'")
    local = F.from_utc_timestamp(F.timestamp_micros(F.call_function("div", ns, F.lit(1000))), zone)
    return F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local) + F.pmod(ns, F.lit(1_000_000_000)) / 1e9


def time_of_day_pair(seconds: Column) -> tuple[Column, Column]:
    angle = seconds * F.lit(2 * math.pi / 86_400)
    return F.sin(angle), F.cos(angle)


# --- prices ---


def mid_price(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def log_return(value: Column, base: Column) -> Column:
    return F.log(value / base)


def log_path(mids: Column, mid: Column) -> Column:
    """Log returns of each later mid on this one."""
    return F.transform(mids, lambda m: F.log(m / mid))


# --- features of a book ---


def level_features(levels: Column, mid: Column, tick: float, depth: int = DEPTH) -> Column:
    """Four numbers a level: distance from the mid in ticks, quantity, orders, 1; zeros where there is no level."""

    def one(i: Column) -> Column:
        level = F.get(levels, i)
        real = F.array((level["price"] - mid) / F.lit(tick), level["qty"].cast("double"), level["orders"].cast("double"), F.lit(1.0))
        return F.when(level.isNull(), F.array(*[F.lit(0.0)] * 4)).otherwise(real)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), one))


def feature_row(bids: Column, asks: Column, mid: Column, tick: float, ns: Column, before_mid: Column, before_ns: Column, depth: int = DEPTH, clock: str = "simulation") -> Column:
    """The feature array of a book; before_mid and before_ns are null at the first row of a run.

    Fails the query on an empty or crossed book, a nonpositive mid or tick, a clock that runs back, or an empty level.
    """
    if tick <= 0:
        raise ValueError("tick must be positive")
    best_bid, best_ask = F.get(bids, F.lit(0))["price"], F.get(asks, F.lit(0))["price"]
    sane = (F.size(bids) > 0) & (F.size(asks) > 0) & (best_bid <= best_ask) & (mid > 0) & (ns >= 0) & (before_ns.isNull() | (ns >= before_ns))
    sane = sane & F.forall(F.concat(bids, asks), lambda x: (x["qty"] > 0) & (x["orders"] > 0))
    sin, cos = time_of_day_pair(seconds_since_midnight(ns, clock))
    first = before_mid.isNull()
    rest = F.array(
        (best_ask - best_bid) / F.lit(tick),
        F.when(first, 0.0).otherwise((ns - before_ns) / 1e9),
        F.when(first, 0.0).otherwise(F.log(mid / before_mid)),
        first.cast("double"),
        sin,
        cos,
    )
    row = F.concat(level_features(bids, mid, tick, depth), level_features(asks, mid, tick, depth), rest)
    return F.when(sane, row).otherwise(F.raise_error(F.lit("not a valid book state")).cast("array<double>"))


def protected(name: str) -> bool:
    """Features that keep mean 0 and scale 1."""
    return name.endswith("_present") or name == "initial" or name.startswith("tod_")


def prepared(x: Column, tau: float, depth: int = DEPTH) -> list[tuple[str, Column, Column]]:
    """(name, prepared value, validity) of each feature of the array x: counts and gaps on a log scale."""
    if tau <= 0:
        raise ValueError("tau must be positive")
    out = []
    for i, name in enumerate(feature_names(depth)):
        value = x[i]
        if name.endswith(("_quantity", "_orders")) or name == "time_delta_seconds":
            value = require(value >= 0, value, "double", f"{name} is negative")
            value = F.log1p(value / F.lit(tau) if name == "time_delta_seconds" else value)
        side_level = i // 4 * 4 + 3
        valid = x[side_level] > 0 if i < 8 * depth and not name.endswith("_present") else F.lit(True)
        out.append((name, value, valid))
    return out


def standardised(value: Column, valid: Column, mean: Column, scale: Column) -> Column:
    return F.when(valid, (value - mean) / scale).otherwise(0.0)


# --- vectors ---


def flat(history: Column) -> Column:
    return F.flatten(history)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def latent_l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def future_path_rms(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b) / F.size(a))


def scaled_target(distance: Column, scale: float) -> Column:
    if scale <= 0:
        raise ValueError("scale must be positive")
    return F.when(distance >= 0, distance / F.lit(scale)).otherwise(F.raise_error(F.lit("negative distance")).cast("double"))


def unscaled_target(distance: Column, scale: float) -> Column:
    return F.when(distance >= 0, distance * F.lit(scale)).otherwise(F.raise_error(F.lit("negative distance")).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


# --- identity ---


def session_seed(seed: Column, date: Column) -> Column:
    """First four bytes of sha256('seed:date') as a number, modulo 2**32 - 1."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", seed.cast("string"), date.cast("string")), 256), 1, 8), 16, 10).cast("bigint") % F.lit(4294967295)


def hash_priority(key: Column, seed: int) -> Column:
    """60 bits of the md5 of 'key:seed', which Spark and SQL engines compute alike; orders rows for reproducible sampling."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


# --- checks ---


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def finite_array(values: Column, size: int | None = None) -> Column:
    ok = values.isNotNull() & F.forall(values, lambda v: finite(v.cast("double")))
    return ok if size is None else ok & (F.size(values) == size)


def require(ok: Column, value: Column, kind: str, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast(kind))


def codes_in_range(code: Column, states: int) -> Column:
    """The code, if it is a whole number in 0 .. states - 1; else the query fails."""
    return require(code.isNotNull() & (code.cast("double") == F.floor(code.cast("double"))) & (code >= 0) & (code < states), code.cast("int"), "int", "a code out of range")


def plain_count(value, name: str) -> int:
    """A positive whole number that isn't a boolean; else a ValueError."""
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{name} must be a positive whole number, not {value!r}")
    return value
