"""Exposure periods and per-trimester durations (M4-M8) as native column
expressions (the study used row-at-a-time Python UDFs).

``s`` and ``e`` are the order start and end in days from LMP, ``ga`` the
gestational age in days. ``mode="reference"`` reproduces the study's branch
tables exactly, including their off-by-one and sign quirks; ``mode="clipped"``
is the plain overlap of [s, e] with each period, in whole days.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRE, T1, T2, T3, POST = -180, 0, 84, 189, 320
# The study's second-trimester "inside" branch starts at day 91, not 84.
T2_INNER_START = 91


def exposure_period(d: Column) -> Column:
    """M4: -1 before day -180, 0 in [-180, 0), 1 in [0, 84), 2 in [84, 189),
    3 in [189, 320], 4 after 320; NULL stays NULL."""
    return (F.when(d < PRE, -1).when(d < T1, 0).when(d < T2, 1).when(d < T3, 2)
             .when(d <= POST, 3).when(d > POST, 4))


def _between(x: Column, lo: int | Column | None, hi: int | Column | None,
             hi_inclusive: bool = False) -> Column:
    c = None
    if lo is not None:
        c = x >= lo
    if hi is not None:
        h = (x <= hi) if hi_inclusive else (x < hi)
        c = h if c is None else (c & h)
    return c


def exposure0_duration(s: Column, e: Column, mode: str = "reference") -> Column:
    """M5: days exposed in the 180 days before LMP."""
    if mode == "clipped":
        return _clip(s, e, F.lit(PRE), F.lit(T1 - 1))
    s_pre, s_in, s_post = s < PRE, _between(s, PRE, T1), s >= T1
    e_pre, e_in, e_post = e < PRE, _between(e, PRE, T1), e >= T1
    return (F.when(s_pre & e_pre, 0)
             .when(s_pre & e_in, e - 180 + 1)
             .when(s_pre & e_post, 180)
             .when(s_in & e_in, e - s + 1)
             .when(s_in & e_post, 0 - s + 1)
             .when(s_post & e_post, 0)
             .otherwise(F.lit(None))).cast("int")


def exposure1_duration(s: Column, e: Column, mode: str = "reference") -> Column:
    """M6: days exposed in [0, 84)."""
    if mode == "clipped":
        return _clip(s, e, F.lit(T1), F.lit(T2 - 1))
    s_bef, s_in, s_aft = s < T1, _between(s, T1, T2), s >= T2
    e_bef, e_in, e_aft = e < T1, _between(e, T1, T2), e >= T2
    return (F.when(s_bef & e_bef, 0)
             .when(s_bef & e_in, e + 1)
             .when(s_bef & e_aft, 84)
             .when(s_in & e_in, e - s + 1)
             .when(s_in & e_aft, 84 - s + 1)
             .when(s_aft & e_aft, 0)
             .otherwise(0)).cast("int")


def exposure2_duration(s: Column, e: Column, mode: str = "reference") -> Column:
    """M7: days exposed in [84, 189)."""
    if mode == "clipped":
        return _clip(s, e, F.lit(T2), F.lit(T3 - 1))
    e_in = _between(e, T2, T3)
    return (F.when((s < T2) & (e < T2), 0)
             .when((s < T2) & e_in, e - 84 + 1)
             .when(_between(s, T2_INNER_START, T3) & e_in, e - s + 1)
             .when((s < T2) & (e >= T3), 189 - 84)
             .when(_between(s, T2, T3) & (e >= T3), 189 - s + 1)
             .when((s >= T3) & (e >= T3), 0)
             .otherwise(0)).cast("int")


def exposure3_duration(s: Column, e: Column, ga: Column, mode: str = "reference") -> Column:
    """M8: days exposed from day 189 to delivery (``ga``)."""
    if mode == "clipped":
        return _clip(s, e, F.lit(T3), ga)
    return (F.when((s < T3) & (e < T3), 0)
             .when((s < T3) & (e >= T3) & (e <= ga), e - 189 + 1)
             .when((s < T3) & (ga >= T3) & (ga <= e), ga - 189 + 1)
             .when((s >= T3) & (s <= ga) & (e >= T3) & (e <= ga), e - s + 1)
             .when((s >= T3) & (s <= ga) & (e >= ga), ga - s + 1)
             .otherwise(0)).cast("int")


def _clip(s: Column, e: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e, hi) - F.greatest(s, lo) + 1).cast("int")


def status(duration: Column) -> Column:
    """1 if the duration is positive, else 0 (NULL gives 0)."""
    return F.when(duration > 0, 1).otherwise(0)
