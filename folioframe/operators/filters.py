"""Cleaning of returns: trimming, price and bounce-back exclusion, winsorising with and without look-ahead."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.operators.quantiles import expanding_percentiles, pool_percentiles
from folioframe.operators.signals import by_id
from folioframe.spec import RATINGS, FilterSpec


def _outside(x: Column, level: float | tuple[float, float], high: bool) -> Column:
    """Beyond the bounds, or beyond the one bound on its side. Null is not outside."""
    if isinstance(level, tuple):
        out = (x > level[1]) | (x < level[0])
    else:
        out = x > level if high else x < level
    return F.coalesce(out, F.lit(False))


def _watched(f: FilterSpec) -> Column:
    return F.col({"trim": "ret", "price": "PRICE", "bounce": "bounce"}[f.adj])


def _high(f: FilterSpec, match: bool = False) -> bool:
    """Whether a single level bounds from above; universe matching is strict at the price threshold."""
    if isinstance(f.level, tuple):
        return True
    if f.adj == "price":
        return f.level > f.price_threshold if match else f.level >= f.price_threshold
    return f.level >= 0


def passes(f: FilterSpec) -> Column:
    """Whether the row has a return that trimming, price or bounce-back exclusion leaves."""
    return F.col("ret").isNotNull() & ~_outside(_watched(f), f.level, _high(f))


def truths(f: FilterSpec, there: np.ndarray, x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`passes` and :func:`in_universe` of many rows at once: ``there`` tells who has a return, ``x`` is what the
    filter watches, ``known`` where it is not null. NaN is above all numbers, as in Spark."""
    low, high = f.level if isinstance(f.level, tuple) else (f.level, f.level)
    above, below = known & ~(x <= high), known & (x < low)
    sides = {"pair": above | below, "high": above, "low": below}
    side = lambda match: sides["pair" if isinstance(f.level, tuple) else "high" if _high(f, match) else "low"]
    return there & ~side(False), np.ones(len(x), bool) if f.level == 0 else known & ~side(True)


@dataclass(frozen=True)
class Bounds:
    """Winsorising bounds of several levels: one row for each date, and a number each for the whole sample."""

    dated: DataFrame  # date, and a column for each level
    full: dict[str, float | None]


def _level(x: float) -> str:
    return f"_b{x:g}".replace(".", "_")


def find_bounds(pool: DataFrame, filters: Iterable[FilterSpec]) -> Bounds:
    """Bounds of all winsorising ``filters`` at once. Runs here and now: two passes over the returns of ``pool``,
    whatever the number of filters, which are written first; only dates x levels numbers come back."""
    filters = [f for f in filters if f.adj == "wins"]
    ends = {_level(x): x / 100 for f in filters for x in (100 - f.level, f.level)}
    own = {_level(x): x / 100 for f in filters if f.thresholds is None for x in (100 - f.level, f.level)}
    dated, full = pool_percentiles(pool, "ret", own, ends)
    if dated is None:
        return Bounds(pool.sparkSession.createDataFrame([], "date date"), full)
    # Collected once, instead of being found again in each frame that the filter feeds.
    return Bounds(pool.sparkSession.createDataFrame(dated.collect(), dated.schema), full)


def add_bounce(panel: DataFrame) -> DataFrame:
    """The panel with ``bounce``, the return times the one of the ID's row before."""
    return panel.withColumn("bounce", F.col("ret") * F.lag("ret").over(by_id()))


def with_bounds(panel: DataFrame, filters: Iterable[FilterSpec], bounds: Bounds | None) -> DataFrame:
    """The panel with the dated bounds that ``filters`` need, once for all of them."""
    return panel.join(F.broadcast(bounds.dated), "date", "left") if any(f.adj == "wins" and f.thresholds is None for f in filters) else panel


def add_filtered(
    panel: DataFrame, f: FilterSpec, pool: DataFrame | None = None, bounds: Bounds | None = None, ready: bool = False
) -> DataFrame:
    """The panel with ``ret_adj`` (no look-ahead), ``ret_adj_ep`` (with it) and ``out``.

    Rows that trimming, price or bounce-back exclusion take out have a null ``ret_adj``; ``out`` tells
    them, or, for winsorising, the rows that sit at a full-sample bound. Winsorising takes ``bounds``, or
    has them found (at once) in ``pool``, a frame of the same returns that is cheaper to read, or ``panel``.
    ``ready`` tells that the panel has what several filters share already: :func:`add_bounce`, :func:`with_bounds`.
    """
    if f.adj == "bounce" and not ready:
        panel = add_bounce(panel)
    if f.adj != "wins":
        kept = F.when(~_outside(_watched(f), f.level, _high(f)), F.col("ret"))
        out = F.col("ret").isNotNull() & _outside(_watched(f), f.level, _high(f))
        return panel.withColumns({"ret_adj": kept, "ret_adj_ep": kept, "out": out})
    low, high = 100 - f.level, f.level
    bounds = bounds or find_bounds(panel if pool is None else pool, [f])
    if f.thresholds is not None:
        both = panel.join(F.broadcast(given_bounds(f.thresholds, low, high)), "date", "left")
    elif ready:
        both = panel.withColumns({"_lo": F.col(_level(low)), "_hi": F.col(_level(high))})
    else:
        both = panel.join(F.broadcast(bounds.dated.select("date", F.col(_level(low)).alias("_lo"), F.col(_level(high)).alias("_hi"))), "date", "left")
    both = both.withColumns({n: F.lit(bounds.full[_level(x)]).cast("double") for n, x in (("_lo_ep", low), ("_hi_ep", high))})
    both = both.withColumns(
        {"ret_adj": _clipped(f.location, "_lo", "_hi"), "ret_adj_ep": _clipped(f.location, "_lo_ep", "_hi_ep")}
    )
    at = {"right": ["_hi_ep"], "left": ["_lo_ep"], "both": ["_lo_ep", "_hi_ep"]}[f.location]
    out = F.coalesce(F.col("ret_adj_ep").isin(*[F.col(c) for c in at]), F.lit(False))
    return both.withColumn("out", out).drop("_lo", "_hi", "_lo_ep", "_hi_ep")


def full_bounds(f: FilterSpec, bounds: Bounds) -> tuple[float | None, float | None]:
    """Full-sample bounds (low, high) of winsorising: none on a side that is left as it is."""
    low, high = bounds.full[_level(100 - f.level)], bounds.full[_level(f.level)]
    return low if f.location in ("left", "both") else None, high if f.location in ("right", "both") else None


def _clipped(location: str | None, lo: str, hi: str) -> Column:
    x = F.col("ret")
    if location in ("right", "both"):
        x = F.when(F.col("ret") > F.col(hi), F.col(hi)).otherwise(x)
    if location in ("left", "both"):
        x = F.when(F.col("ret") < F.col(lo), F.col(lo)).otherwise(x)
    return F.when(F.col("ret").isNotNull(), x)


def given_bounds(thresholds: DataFrame, low: float, high: float) -> DataFrame:
    """(date, _lo, _hi) from rows (date, level, value)."""
    at = lambda x: F.max(F.when(F.abs(F.col("level") - x) < 1e-9, F.col("value")))
    return thresholds.groupBy("date").agg(at(low).alias("_lo"), at(high).alias("_hi"))


def expanding_bounds(panel: DataFrame, low: float, high: float) -> DataFrame:
    """(date, _lo, _hi): percentiles of all returns dated strictly before; null on the first date."""
    return expanding_percentiles(panel, "ret", {"_lo": low / 100, "_hi": high / 100})


def in_universe(f: FilterSpec | None) -> Column:
    """At formation: the row itself passes the filter. Null fails; winsorising and level 0 let all pass."""
    if f is None or f.adj == "wins" or f.level == 0:
        return F.lit(True)
    x = _watched(f)
    if isinstance(f.level, tuple):
        ok = (x <= f.level[1]) & (x >= f.level[0])
    else:
        ok = x <= f.level if _high(f, match=True) else x >= f.level
    return F.coalesce(ok, F.lit(False))


def in_rating(rating: str | None) -> Column:
    """IG is 1 to 10, NIG above 10 to 22; without a rating all rows count, rated or not."""
    r = F.col("RATING_NUM")
    if rating is None:
        return F.lit(True)
    low, high = RATINGS[rating]
    ok = (r > low - 1) & (r <= high) if rating == "NIG" else (r >= low) & (r <= high)
    return F.coalesce(ok, F.lit(False))
