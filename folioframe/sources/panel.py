"""From raw tables to canonical panels: ``ID, date, ret, RATING_NUM, VW`` and what a sort asks for."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED = ("date", "ID", "ret", "RATING_NUM")
NUMBERS = ("float", "double")


def clean_nan(panel: DataFrame) -> DataFrame:
    """NaN to null in every floating column: Spark orders NaN above all numbers."""
    return panel.withColumns(
        {c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).cast("double") for c, t in panel.dtypes if t in NUMBERS}
    )


def canonical(panel: DataFrame, names: Mapping[str, str] | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """Rename columns (theirs -> ours), parse dates, default weights to 1, and keep what is asked for.

    A column that a renamed one would hide is dropped. Missing required columns raise ``ValueError``.
    """
    for theirs, ours in (names or {}).items():
        if theirs != ours:
            panel = panel.drop(ours).withColumnRenamed(theirs, ours)
    missing = sorted({*REQUIRED, *keep} - {*panel.columns})
    if missing:
        raise ValueError(f"the panel lacks columns {missing}")
    if "VW" not in panel.columns:
        panel = panel.withColumn("VW", F.lit(1.0))
    columns = list(dict.fromkeys(["ID", "date", "ret", "RATING_NUM", "VW", *keep]))
    return clean_nan(panel.select(*[F.to_date("date").alias(c) if c == "date" else c for c in columns]))


def require_unique(panel: DataFrame) -> DataFrame:
    """The panel, after a check that (ID, date) is a key."""
    if not panel.groupBy("ID", "date").count().where("count > 1").isEmpty():
        raise ValueError("the panel has more than one row for an ID and date")
    return panel


def vendor_panel(raw: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Names in upper case, absolute amount and price, ``VW = price * amount / 1000``, a range of dates."""
    up = raw.toDF(*[c.upper() for c in raw.columns]).withColumns(
        {"AMOUNT_OUTSTANDING": F.abs("AMOUNT_OUTSTANDING"), "PRICE_L5M": F.abs("PRICE_L5M")}
    )
    up = up.withColumn("VW", F.col("PRICE_L5M") * F.col("AMOUNT_OUTSTANDING") / 1000)
    if start:
        up = up.where(F.col("DATE") >= F.lit(start).cast("date"))
    return up.where(F.col("DATE") <= F.lit(end).cast("date")) if end else up


def equity_market_cap(prc: Column, cfacpr: Column, shrout: Column, cfacshr: Column) -> Column:
    """Market capitalisation in millions: adjusted absolute price times adjusted shares outstanding."""
    return F.try_divide(F.abs(prc), cfacpr) * (shrout * cfacshr * 1e3) / 1e6


def fill_equity(panel: DataFrame) -> DataFrame:
    """Missing returns as 0, and a constant rating, as a panel without ratings needs."""
    return panel.fillna(0.0, subset=["ret"]).withColumn("RATING_NUM", F.lit(1.0))


def active(panel: DataFrame, trades_col: str, least: int = 5) -> DataFrame:
    return panel.where(F.col(trades_col) >= least)


def merge_panels(left: DataFrame, right: DataFrame, on: tuple[str, ...] = ("ID", "date")) -> DataFrame:
    """Rows that both panels have; columns of the left win."""
    extra = [c for c in right.columns if c in on or c not in left.columns]
    return left.join(right.select(*extra), list(on))


def valid_rows(facts: DataFrame, history: DataFrame, key: str, date: str, start: str, end: str, period: int = 366, parts: int | None = None) -> DataFrame:
    """Facts with the rows of ``history`` that are valid on their date, first and last day included.

    Intervals are cut into periods of so many days and meet the facts of their key and period alone, so
    that a key with a long history and many facts is many groups, not one. Intervals are clipped to the
    dates that the facts span, found in a pass of their own. A null date, start or end matches nothing.
    With ``parts`` both sides are dealt into so many partitions, instead of the session's number.
    """
    number = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / period)
    span = facts.agg(F.min(date).alias("_first"), F.max(date).alias("_last"))  # one row
    pieces = history.withColumnRenamed(key, "_key").join(F.broadcast(span))
    opens, closes = F.greatest(F.col(start), F.col("_first")), F.least(F.col(end), F.col("_last"))
    pieces = pieces.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (opens <= closes)).withColumn("_period", F.explode(F.sequence(number(opens), number(closes)))).drop("_first", "_last")
    dated = facts.withColumn("_at", number(F.col(date)))
    if parts is not None:
        pieces, dated = pieces.repartition(parts, "_key", "_period"), dated.repartition(parts, key, "_at")
    valid = (pieces[start] <= dated[date]) & (dated[date] <= pieces[end])
    return dated.join(pieces, (dated[key] == pieces["_key"]) & (dated["_at"] == pieces["_period"]) & valid).drop("_key", "_at", "_period")


def facts(panel: DataFrame) -> DataFrame:
    """One row: number of IDs, first and last date, number of dates, rows."""
    return panel.agg(
        F.countDistinct("ID").alias("n_ids"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.countDistinct("date").alias("n_dates"),
        F.count(F.lit(1)).alias("n_rows"),
    )
