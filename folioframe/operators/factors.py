"""Factor series from panels and sorts."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.operators.signals import by_id
from folioframe.operators.strategy import Strategy
from folioframe.sources.files import written


def market_ew(panel: DataFrame) -> DataFrame:
    """(date, value): mean return of each date."""
    return panel.groupBy("date").agg(F.avg("ret").alias("value"))


def market_vw(panel: DataFrame) -> DataFrame:
    """(date, value): returns weighted by the ID's previous row's weight, rows without either dropped."""
    rows = panel.withColumn("_w", F.lag("VW").over(by_id())).dropna(subset=["_w", "ret"])
    return rows.groupBy("date").agg(F.try_divide(F.sum(F.col("ret") * F.col("_w")), F.sum("_w")).alias("value"))


def excess(series: DataFrame, riskless: DataFrame, value: str = "value", rate: str = "rf") -> DataFrame:
    """The series less the riskless rate of its date; dates without one are dropped."""
    both = series.join(F.broadcast(riskless.select("date", rate)), "date")
    return both.withColumn(value, F.col(value) - F.col(rate)).drop(rate)


def _across(table: DataFrame, n1: int, n2: int, weighting: str, rows: bool, joined: Callable[[Column, Column], Column]) -> DataFrame:
    """(date, value): the two extreme portfolios of each column (``rows``) or row of a double sort put together, and the
    mean of that over the columns or rows that have both."""
    i, j = F.floor((F.col("ptf") - 1) / n2), (F.col("ptf") - 1) % n2
    at, other, n = (i, j, n1) if rows else (j, i, n2)
    side = lambda k: F.max(F.when(at == k, F.col(weighting)))
    each = table.groupBy("date", other.alias("_o")).agg(joined(side(n - 1), side(0)).alias("d"))
    return each.groupBy("date").agg(F.avg("d").alias("value"))


def column_factor(returns: DataFrame, n2: int, weighting: str = "vw") -> DataFrame:
    """(date, value): high less low of the second signal, averaged over the first signal's bins.

    Bins that lack a side are left out of the mean.
    """
    return _across(returns, 0, n2, weighting, False, lambda high, low: high - low)


def row_factor(returns: DataFrame, n1: int, n2: int, weighting: str = "vw") -> DataFrame:
    """(date, value): high less low of the first signal, averaged over the second signal's bins."""
    return _across(returns, n1, n2, weighting, True, lambda high, low: high - low)


def column_turnover(turnover: DataFrame, n2: int, weighting: str = "vw") -> DataFrame:
    """(date, turnover): mean turnover of the corners that :func:`column_factor` is made of."""
    return _across(turnover, 0, n2, weighting, False, lambda high, low: (high + low) / 2).withColumnRenamed("value", "turnover")


def row_turnover(turnover: DataFrame, n1: int, n2: int, weighting: str = "vw") -> DataFrame:
    """(date, turnover): mean turnover of the corners that :func:`row_factor` is made of."""
    return _across(turnover, n1, n2, weighting, True, lambda high, low: (high + low) / 2).withColumnRenamed("value", "turnover")


def corner_factors(sorts: Mapping[str, Strategy], first: str, cost: float = 19 / 10000) -> DataFrame:
    """(factor, date, gross, net): factors of double sorts by one first signal and the named second ones, before and after costs.

    Each second signal gives a factor from the columns of its sort; ``first`` is the mean over all sorts of
    the factor from their rows. What a factor pays is the turnover of its corners at the date before.
    """
    named = {}
    rows, rows_turnover = [], []
    for name, s in sorts.items():
        n1, n2 = s.spec.nport, s.spec.nport2
        s = s.stored()  # the panel is sorted and banded once: returns, and weights on both sides of the turnover, read its members
        # Read twice each: two small tables instead of two more plans of the sort.
        returns, turnover = written(s.get_ptf(), "corner-returns"), written(s.get_ptf_turnover(), "corner-turnover")
        named[name] = net_of_cost(column_factor(returns, n2), column_turnover(turnover, n2), cost)
        rows.append(row_factor(returns, n1, n2))
        rows_turnover.append(row_turnover(turnover, n1, n2).withColumnRenamed("turnover", "value"))
    named[first] = net_of_cost(mean_of(*rows), mean_of(*rows_turnover).withColumnRenamed("value", "turnover"), cost)
    parts = [df.select(F.lit(name).alias("factor"), "date", "gross", "net") for name, df in named.items()]
    return reduce(DataFrame.unionByName, parts)


def mean_of(*series: DataFrame) -> DataFrame:
    """(date, value): mean of several series by date, nulls and missing dates left out."""
    both = series[0].select("date", "value")
    for s in series[1:]:
        both = both.unionByName(s.select("date", "value"))
    return both.groupBy("date").agg(F.avg("value").alias("value"))


def composite(*series: DataFrame) -> DataFrame:
    """(date, value): mean of several series on the dates for which all have a value."""
    both = series[0].select("date", "value")
    for s in series[1:]:
        both = both.unionByName(s.select("date", "value"))
    return both.groupBy("date").agg(F.when(F.count("value") == len(series), F.avg("value")).alias("value"))


def leg_turnover(turnover: DataFrame, low: int, high: int, weighting: str = "vw") -> DataFrame:
    """(date, turnover): mean of the two legs' turnover, null if one is."""
    legs = turnover.where(F.col("ptf").isin(low, high))
    return legs.groupBy("date").agg(F.when(F.count(weighting) == 2, F.avg(weighting)).alias("turnover"))


def net_of_cost(gross: DataFrame, turnover: DataFrame, cost: float = 19 / 10000) -> DataFrame:
    """(date, gross, net): less the previous date's turnover at ``cost`` for buying and for selling."""
    both = gross.select("date", F.col("value").alias("gross")).join(turnover, "date", "left")
    before = F.lag("turnover").over(Window.partitionBy(F.lit(1)).orderBy("date"))  # one row for each date
    return both.withColumn("_before", before).select("date", "gross", (F.col("gross") - F.col("_before") * cost * 2).alias("net"))


def joined(series: dict[str, DataFrame]) -> DataFrame:
    """``date`` and one column for each series, on the dates for which all have a value."""
    out = None
    for name, s in series.items():
        part = s.select("date", F.col("value").alias(name))
        out = part if out is None else out.join(part, "date", "right")
    return out.dropna()


def common_sample(series: DataFrame, other: DataFrame) -> DataFrame:
    """The rows of ``series`` within the first and last date of ``other``."""
    ends = other.agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    return series.join(F.broadcast(ends), F.col("date").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")
