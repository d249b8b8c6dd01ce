"""Banding: an asset stays in an extreme portfolio until its rank leaves a band around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("cohort", "ID")


def band(ranked: DataFrame, n: int, width: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """``ranked`` (``keys``, step, ptf, ...) with sticky extremes in ``ptf``.

    At each step: n stays n while the rank is at least n - width, 1 stays 1 while it is at most
    1 + width; who was absent from the cohort's step before has no memory. Steps count from 0 without
    gaps in each cohort.
    """
    return _closed(ranked, n, width, keys) if width <= n - 2 else _folded(ranked, n, width, keys)


def _closed(ranked: DataFrame, n: int, width: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bands that do not reach the other end need only the latest entry and the latest break."""
    steps = Window.partitionBy(*keys).orderBy("step")
    so_far = steps.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.coalesce(F.lag("step").over(steps), F.lit(-2)) != F.col("step") - 1
    out = ranked.withColumn("_gap", F.when(gap, F.col("step") - 1))
    latest = lambda c: F.coalesce(F.max(c).over(so_far), F.lit(-3))
    broken = lambda c: F.greatest(latest(F.col("_gap")), latest(F.when(c, F.col("step"))))
    high = latest(F.when(F.col("ptf") == n, F.col("step"))) > broken(F.col("ptf") < n - width)
    low = latest(F.when(F.col("ptf") == 1, F.col("step"))) > broken(F.col("ptf") > 1 + width)
    out = out.withColumns({"_high": high, "_low": low})
    return out.withColumn("ptf", F.when(F.col("_high"), F.lit(n)).when(F.col("_low"), F.lit(1)).otherwise(F.col("ptf"))).drop("_gap", "_high", "_low")


def _folded(ranked: DataFrame, n: int, width: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Wider bands: the recursion itself, along the ordered steps of one asset in one cohort (as many as periods)."""
    others = [c for c in ranked.columns if c not in (*keys, "step", "ptf")]
    rows = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("step", "ptf", *others))).alias("_rows"))
    # After each step: the portfolios so far, the last one, and its step.
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("before"), F.lit(-2).cast("long").alias("at"))

    def turn(state: Column, row: Column) -> Column:
        before = F.when(state["at"] == row["step"] - 1, state["before"])  # who was absent has no memory
        now = F.when((before == n) & (row["ptf"] >= n - width), F.lit(n)).when((before == 1) & (row["ptf"] <= 1 + width), F.lit(1)).otherwise(row["ptf"])
        return F.struct(F.concat(state["out"], F.array(now.cast("int"))).alias("out"), now.cast("int").alias("before"), row["step"].cast("long").alias("at"))

    folded = rows.withColumn("_out", F.aggregate("_rows", start, turn, lambda state: state["out"]))
    each = folded.select(*keys, F.explode(F.arrays_zip("_rows", "_out")).alias("_x"))
    fields = {"ptf": F.col("_x._out")} | {c: F.col("_x._rows")[c] for c in ("step", *others)}
    return each.select(*[F.col(c) if c in keys else fields[c].alias(c) for c in ranked.columns])
