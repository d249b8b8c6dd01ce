"""Summary tables of a strategy: tests of all its series, mean turnover and characteristics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.operators.inference import hac_mean, with_normal_p
from folioframe.operators.strategy import Strategy


def series(strategy: Strategy) -> DataFrame:
    """(series, regime, weighting, date, value): long-short, legs and every portfolio."""
    weightings = F.explode(
        F.array(*[F.struct(F.lit(w).alias("weighting"), F.col(w).alias("value")) for w in ("ew", "vw")])
    )
    parts = [
        strategy.long_short.withColumn("series", F.lit("long_short")),
        strategy._legs.withColumn("series", F.col("leg")),
        strategy.returns.withColumn("series", F.concat(F.lit("ptf_"), F.col("ptf").cast("string"))),
    ]
    long = [p.select("series", "regime", "date", weightings.alias("_x")).select("series", "regime", "_x.weighting", "date", "_x.value") for p in parts]
    return long[0].unionByName(long[1]).unionByName(long[2])


def summary(strategy: Strategy, lag: int = 0) -> DataFrame:
    """Mean (in percent), standard error, t and p of every series, and each portfolio's mean turnover (in percent)
    and mean characteristics (``char_<name>``), for both regimes and weightings.

    Works with and without turnover, characteristics, and a filter. The strategy's members are written when
    this is called, and all columns come from them.
    """
    strategy = strategy.stored()
    tests = with_normal_p(hac_mean(series(strategy), ["series", "regime", "weighting"], lag))
    tests = tests.withColumns({"mean": F.col("mean") * 100, "se": F.col("se") * 100})
    name = F.concat(F.lit("ptf_"), F.col("ptf").cast("string"))
    if strategy.spec.turnover:
        tests = tests.join(mean_turnover(strategy).withColumn("series", name).drop("ptf"), ["series", "regime", "weighting"], "left")
    else:
        tests = tests.withColumn("turnover", F.lit(None).cast("double"))
    if strategy.spec.chars:
        both = F.explode(F.array(*[F.struct(F.lit(w).alias("weighting"), F.col(w).alias("x")) for w in ("ew", "vw")]))
        rows = mean_chars(strategy).select(name.alias("series"), "regime", "char", both.alias("_x")).select("series", "regime", "char", "_x.*")
        wide = rows.groupBy("series", "regime", "weighting").agg(*[F.max(F.when(F.col("char") == c, F.col("x"))).alias(f"char_{c}") for c in strategy.spec.chars])
        tests = tests.join(wide, ["series", "regime", "weighting"], "left")
    return tests


def mean_turnover(strategy: Strategy, last: bool = True) -> DataFrame:
    """(ptf, regime, weighting, turnover): mean over dates, in percent.

    Nothing is held any more on the last date, whose turnover is the exit alone, about one: it can be left out.
    """
    both = F.explode(F.array(*[F.struct(F.lit(w).alias("weighting"), F.col(w).alias("x")) for w in ("ew", "vw")]))
    turnover = strategy.turnover if last else strategy.turnover.where(F.col("date") < F.lit(max(strategy._dates)[0]))
    rows = turnover.select("ptf", "regime", both.alias("_x")).select("ptf", "regime", "_x.*")
    return rows.groupBy("ptf", "regime", "weighting").agg((F.avg("x") * 100).alias("turnover"))


def mean_chars(strategy: Strategy) -> DataFrame:
    """(ptf, regime, char, ew, vw): mean over dates."""
    return strategy.characteristics.groupBy("ptf", "regime", "char").agg(F.avg("ew").alias("ew"), F.avg("vw").alias("vw"))
