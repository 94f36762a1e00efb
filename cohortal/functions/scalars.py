"""Scalar expressions: casts, recency, hashing, cyclic time."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

DAY_SECONDS = 86_400
NEVER_DAYS = 9_999
DECAY_DAYS = 30.0


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str, fill: float | None = 0.0) -> Column:
    """Double value of anything castable; other values become ``fill`` (null keeps null)."""
    value = col_of(c).try_cast("double")
    return value if fill is None else F.coalesce(value, F.lit(float(fill)))


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days from ``earlier`` to ``later``."""
    return (_micros(later) - _micros(earlier)) / F.lit(DAY_SECONDS * 1_000_000.0)


def days_ago(ts: Column, reference: Column) -> Column:
    """Whole days, rounded down (so a later hour of the same day is -1); null -> 9999."""
    return F.coalesce(F.floor(days_between(reference, ts)).cast("bigint"), F.lit(NEVER_DAYS).cast("bigint"))


def recency_weight(days: Column) -> Column:
    """exp(-days / 30): an e-folding time of 30 days."""
    return F.exp(-days.cast("double") / F.lit(DECAY_DAYS))


def recency_days(ts: Column, reference: Column, fill: float = 999.0) -> Column:
    """Fractional days against a clock column, ``fill`` when never."""
    return F.coalesce(days_between(reference, ts), F.lit(fill))


def elapsed(now: Column, then: Column | None) -> Column:
    """max(0, now - then) on numeric clocks; 0 if there is no such column, null if never."""
    if then is None:
        return F.lit(0).cast("bigint")
    return F.when(then > now, F.lit(0).cast("bigint")).otherwise(now - then)


def os_major(version: Column | str) -> Column:
    """Integer before the first dot, -1 if there is none."""
    head = F.trim(F.split(col_of(version), r"\.")[0])
    return F.coalesce(head.try_cast("int"), F.lit(-1))


def hash_category(c: Column | str, portable: bool = False) -> Column:
    """Stable 64-bit code of a category; null is a category of its own."""
    text = F.coalesce(col_of(c).cast("string"), F.lit("__missing__"))
    if portable:
        return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    return F.xxhash64(text)


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    """(sin, cos) of a position on a cycle."""
    angle = F.lit(2 * math.pi) * value / F.lit(period)
    return F.sin(angle), F.cos(angle)


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a number; null stays null."""
    out = value
    if low is not None:
        out = F.when(out < F.lit(low), F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(out > F.lit(high), F.lit(float(high))).otherwise(out)
    return out


def _count_edges(edges: list[float], reached) -> Column:
    """How many sorted edges a value has reached, as a balanced tree of comparisons."""

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high + 1) // 2
        return F.when(reached(F.lit(float(edges[mid - 1]))), pick(mid, high)).otherwise(pick(low, mid - 1))

    return pick(0, len(edges))


def bin_right_open(value: Column, edges: list[float]) -> Column:
    """Number of edges <= value: 1 is the first bin, len(edges) means at or past the last edge."""
    return _count_edges(edges, lambda e: value >= e)


def bin_right_closed(value: Column, edges: list[float]) -> Column:
    """0-based index of the bin (edge, next edge]; the first edge belongs to bin 0."""
    return F.greatest(_count_edges(edges, lambda e: value > e) - 1, F.lit(0))
