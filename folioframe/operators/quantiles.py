"""Breakpoints of cross-sections, bins, and exact percentiles of expanding pools."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.sources.files import written

#: Ranges of values that an expanding pool is counted in: COARSE groups of FINE.
COARSE, FINE = 32, 32


def inner_edges(x: str, n: int) -> Column:
    """Aggregate: the n - 1 inner breakpoints of n portfolios, interpolated linearly."""
    return F.percentile(x, F.array(*[F.lit(i / n) for i in range(1, n)]))


def bin_of(x: Column, edges: Column) -> Column:
    """1 + number of inner edges below x: bin p holds what is above edge p-1 and at most edge p."""
    return F.size(F.filter(edges, lambda e: e < x)) + 1


#: So many groups' breakpoints are sent to every executor; more are joined by shuffling.
FEW_GROUPS = 1_000_000
#: Groups of more rows than this are not gathered into one aggregate each: their order statistics are found by counting.
LARGE_GROUP = 5_000_000


def add_bin(
    df: DataFrame, keys: Sequence[str], x: str, n: int, name: str, groups: int | None = None, largest: int = 0
) -> DataFrame:
    """``df`` with the bin of ``x`` among n, by the breakpoints of its group.

    The breakpoints are one short row for each group. ``groups`` is their number at most, if known: a
    few are broadcast, so that the rows stay where they are instead of meeting by date, of which there
    are far fewer than tasks. ``largest`` is the number of rows of a group at most, if known.
    """
    edges = counted_edges(df, keys, x, n) if largest > LARGE_GROUP else df.groupBy(*keys).agg(inner_edges(x, n).alias("_edges"))
    if groups is not None and groups * n <= FEW_GROUPS:
        edges = F.broadcast(edges)
    return df.join(edges, list(keys)).withColumn(name, bin_of(F.col(x), F.col("_edges"))).drop("_edges")


def range_marks(rows: DataFrame) -> DataFrame:
    """One row ``_m``: the ends of ranges that hold about equally many of the values ``x``."""
    n = COARSE * FINE
    return rows.agg(F.percentile_approx("x", [i / n for i in range(1, n)], 8 * n).alias("_m"))


def in_ranges(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows`` with the number of the ``range`` that ``x`` falls into: how many of the ``marks`` are below it.

    The marks (one row of a thousand numbers) are read here and now, and searched for a batch of values at a time.
    """
    ends = np.array(marks.first()[0] or [], np.float64)  # none, if there were no values to make them of

    @F.pandas_udf("int")
    def number(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, x.to_numpy(np.float64)).astype(np.int32))

    # Not said to be deterministic: a filter on its result would have it worked out twice.
    return rows.withColumn("range", number.asNondeterministic()("x"))


def _wanted(pool: DataFrame, keys: Sequence[str], levels: dict[str, float]) -> DataFrame:
    """Where the order statistics on both sides of each percentile lie: ``keys, name, part, side, range, nth``.

    ``pool`` has the rows k of each group and range and their running sum ``upto``.
    """
    size = pool.groupBy(*keys).agg(F.sum("k").alias("size")).where("size > 0")
    names = F.map_from_arrays(F.array(*map(F.lit, levels)), F.array(*map(F.lit, levels.values())))
    at = size.select(*keys, F.explode(names).alias("name", "q"), "size").withColumn("at", F.col("q") * (F.col("size") - 1))
    orders = at.select(
        *keys, "name", (F.col("at") - F.floor("at")).alias("part"), F.floor("at").alias("low"),
        F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("order"),
    )
    hit = orders.join(pool, list(keys)).where((F.col("upto") > F.col("order")) & (F.col("upto") - F.col("k") <= F.col("order")))
    return hit.select(
        *keys, "name", "part", "range", (F.col("order") - F.col("low")).alias("side"),
        (F.col("order") - F.col("upto") + F.col("k") + 1).alias("nth"),
    )


def _values(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, name, value`` from the values of the ranges hit, each with its rows ``c`` and what is wanted of it."""
    place = Window.partitionBy(*keys, "name", "side").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    found = counted.withColumn("_i", F.sum("c").over(place)).where((F.col("_i") >= F.col("nth")) & (F.col("_i") - F.col("c") < F.col("nth")))
    end = lambda side: F.max(F.when(F.col("side") == side, F.col("x")))
    ends = found.groupBy(*keys, "name").agg(F.max("part").alias("part"), end(0).alias("a"), end(1).alias("b"))
    value = F.col("a") + F.coalesce(F.col("b") - F.col("a"), F.lit(0.0)) * F.col("part")
    return ends.select(*keys, "name", value.alias("value"))


def counted_percentiles(df: DataFrame, keys: Sequence[str], x: str, levels: dict[str, float], kept: bool = False) -> DataFrame:
    """``keys, name, value``: exact percentiles of each group, without gathering a group in one place.

    Values are counted by group and range; the counts tell in which range, and where in it, each order
    statistic lies. Only the values of these ranges are counted one by one and sorted, so that a value
    which many rows share is one row. The values are written first, unless ``df`` is ``kept`` in storage
    already, and read twice.
    """
    rows = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("x"))
    rows = rows if kept else written(rows, "values")
    rows = in_ranges(rows, range_marks(rows))
    return _placed_percentiles(rows, written(rows.groupBy(*keys, "range").agg(F.count(F.lit(1)).alias("k")), "range-counts"), keys, levels)


def _placed_percentiles(rows: DataFrame, counts: DataFrame, keys: Sequence[str], levels: dict[str, float]) -> DataFrame:
    """:func:`counted_percentiles` of ``rows`` (keys, x, range) with their ``counts`` (keys, range, k)."""
    up = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    hits = written(_wanted(counts.withColumn("upto", F.sum("k").over(up)), keys, levels), "hits")
    values = rows.join(hits.select(*keys, "range").distinct(), [*keys, "range"]).groupBy(*keys, "range", "x").agg(F.count(F.lit(1)).alias("c"))
    return _values(values.join(hits, [*keys, "range"]), keys)


def counted_edges(df: DataFrame, keys: Sequence[str], x: str, n: int) -> DataFrame:
    """``keys, _edges``: the same breakpoints as :func:`inner_edges`, by :func:`counted_percentiles`."""
    values = counted_percentiles(df, keys, x, {f"{i:06d}": i / n for i in range(1, n)})
    listed = values.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("_v"))
    return listed.select(*keys, F.transform("_v", lambda v: v["value"]).alias("_edges"))


def full_percentiles(df: DataFrame, x: str, levels: dict[str, float]) -> dict[str, float | None]:
    """Exact percentiles of all rows, by name; a few numbers for the driver."""
    return _by_name(counted_percentiles(df.withColumn("_all", F.lit(0)), ["_all"], x, levels), levels)


def _by_name(percentiles: DataFrame, levels: dict[str, float]) -> dict[str, float | None]:
    return dict.fromkeys(levels) | {r["name"]: r["value"] for r in percentiles.collect()}


def expanding_percentiles(panel: DataFrame, x: str, levels: dict[str, float]) -> DataFrame:
    """``date`` and, for each name, a percentile of all non-null ``x`` dated strictly before.

    Exact: every value is put into one of a thousand ranges; running counts by date and range tell in
    which range, and where in it, the order statistics of each date lie; only values of these ranges
    are then compared, each with the number of its rows. Work is a small multiple of the rows, not rows
    times dates. The dates and values are written here and now, and read three times.
    """
    return pool_percentiles(panel, x, levels, {})[0]


def pool_percentiles(
    panel: DataFrame, x: str, levels: dict[str, float], full: dict[str, float]
) -> tuple[DataFrame | None, dict[str, float | None]]:
    """:func:`expanding_percentiles` at ``levels`` (none for no levels) and :func:`full_percentiles` at ``full``, from the same counts."""
    stored = written(panel.select("date", F.col(x).cast("double").alias("x")), "values")
    there = stored.where("x IS NOT NULL")
    ranged = in_ranges(there, range_marks(there))
    counts = written(ranged.groupBy("date", "range").agg(F.count(F.lit(1)).alias("k")), "range-counts")
    whole: dict[str, float | None] = {}
    if full:
        total = counts.groupBy(F.lit(0).alias("_all"), "range").agg(F.sum("k").alias("k"))
        whole = _by_name(_placed_percentiles(ranged.withColumn("_all", F.lit(0)), total, ["_all"], full), full)
    if not levels:
        return None, whole

    def read(ranges: set[int]) -> DataFrame:
        return ranged.where(F.col("range").isin(sorted(ranges))).groupBy("range", "date", "x").agg(F.count(F.lit(1)).alias("c"))

    return ranged_percentiles(counts, read, stored.select("date").distinct(), levels), whole


def ranged_percentiles(
    counts: DataFrame, values: DataFrame | Callable[[set[int]], DataFrame], dates: DataFrame, levels: dict[str, float]
) -> DataFrame:
    """As :func:`expanding_percentiles` for each of ``dates``, from ``counts`` (date, range, k) and ``values`` (range, date, x, c).

    ``values`` can be a function of the ranges that are needed, which are then found here and now (at
    most levels x dates numbers). Counts are at most dates x ranges rows; the pool of each date is a
    running sum over them.
    """
    asked = dates.select("date", F.lit(True).alias("_asked"))
    every = counts.select("date").distinct().join(F.broadcast(asked), "date", "full")
    # A cross join of dates and ranges: both are bounded, and small beside the rows they were counted from.
    grid = every.join(F.broadcast(counts.select("range").distinct())).join(counts, ["date", "range"], "left")
    before = Window.partitionBy("range").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy("date").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    pool = grid.withColumn("k", F.coalesce(F.sum("k").over(before), F.lit(0))).where("_asked").withColumn("upto", F.sum("k").over(up))
    hits = written(_wanted(pool.select("date", "range", "k", "upto"), ["date"], levels).withColumnRenamed("date", "on"), "hits")
    if callable(values):
        values = values({r[0] for r in hits.select("range").distinct().collect()})
    else:
        values = values.join(hits.select("range").distinct(), "range")
    dated = values.join(hits, "range").where("date < on").groupBy("on", "name", "side", "nth", "part", "x").agg(F.sum("c").alias("c"))
    found = _values(dated, ["on"])
    return found.groupBy(F.col("on").alias("date")).agg(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in levels])
