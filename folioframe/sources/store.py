"""Panels and their quantiles kept in storage and carried on month by month.

A :class:`PanelStore` is bucketed by ID and partitioned by date: windows over an ID's rows need no
exchange, a date is read alone, and a month that comes in (again) is written alone. A
:class:`QuantileState` has what exact percentiles of all earlier values need without reading them all:
counts by date and value range, and the values themselves by range.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators.quantiles import FINE, in_ranges, range_marks, ranged_percentiles


class PanelStore:
    """A panel in a folder that driver and executors share, as a bucketed table.

    ``path`` can be opened again by another session with the same ``schema`` and number of ``buckets``;
    the table's name lives in the session's catalog only. Rows are those of whole dates; a row without a
    date can't be stored.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int, new: bool = False) -> None:
        self.spark, self.path, self.schema, self.buckets = spark, path, schema, buckets
        self.name = f"panel_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} ({schema}) USING parquet PARTITIONED BY (date)"
            f" CLUSTERED BY (ID) SORTED BY (ID) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        if not new:
            spark.catalog.recoverPartitions(self.name)  # those of an earlier session

    @classmethod
    def create(cls, panel: DataFrame, path: str, buckets: int = 64) -> PanelStore:
        """Write ``panel``. So many ``buckets`` that the rows of one, over all dates, suit a task: windows have one task for each."""
        columns = [f"`{c}` {t}" for c, t in panel.dtypes if c != "date"] + ["date date"]
        store = cls(panel.sparkSession, path, ", ".join(columns), buckets, new=True)
        store.append(panel)
        return store

    def append(self, rows: DataFrame) -> None:
        """Put the dates of ``rows`` into the store; a date that is there already is replaced as a whole.

        A job that is run again after a failure, or with late corrections, leaves every date once. No
        other date is read or written.
        """
        columns = [f.name for f in self.spark.table(self.name).schema]
        # One task for each bucket, so that a date has one file a bucket.
        dealt = rows.where("date IS NOT NULL").select(*[f"`{c}`" for c in columns]).repartition(self.buckets, "ID")
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")  # a table takes it from the session alone
        try:
            dealt.write.insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set(mode, before)
        self.spark.catalog.refreshTable(self.name)

    @property
    def panel(self) -> DataFrame:
        return self.spark.table(self.name)

    def dates(self) -> list[date]:
        """The dates in the store, from the names of its folders."""
        return sorted(r[0] for r in self.panel.select("date").distinct().collect())

    def close(self) -> None:
        """Take the name out of the catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


class QuantileState:
    """Exact percentiles of all values dated before a date, kept up by reading new dates alone.

    Under ``path`` lie the ends of the value ranges (``marks``), the number of values by date and range
    (``counts``), and the distinct values of each date with their number, ordered by range (``values``).
    The counts of different dates, and of parts of a date, add up; so do those of
    different states with the same marks. The ends come from the first values and stay: values that
    drift away from them make some ranges large, which costs time and no exactness.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, values: DataFrame, path: str, x: str = "ret") -> QuantileState:
        """Start from ``values`` (``date`` and ``x``; nulls take no part)."""
        state = cls(values.sparkSession, path)
        range_marks(values.select(F.col(x).cast("double").alias("x"))).write.parquet(f"{state.path}/marks")
        state.append(values, x)
        return state

    def append(self, values: DataFrame, x: str = "ret") -> None:
        """Put the dates of ``values`` into the state; dates that are there already are replaced. Nothing else is read.

        A date whose values are all null leaves nothing, and replaces nothing.
        """
        rows = values.where(F.col(x).isNotNull() & F.col("date").isNotNull()).select("date", F.col(x).cast("double").alias("x"))
        placed = in_ranges(rows, self.spark.read.parquet(f"{self.path}/marks"))
        dynamic = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date")
        each = placed.groupBy("date", "range", "x").agg(F.count(F.lit(1)).alias("c"))
        # Ranges lie together in a date's files, so that a filter on them passes over most row groups.
        dealt = each.repartition("date", F.floor(F.col("range") / FINE)).sortWithinPartitions("date", "range", "x")
        dynamic(dealt).parquet(f"{self.path}/values")
        dynamic(placed.groupBy("date", "range").agg(F.count(F.lit(1)).alias("k")).repartition("date")).parquet(f"{self.path}/counts")

    @property
    def values(self) -> DataFrame:
        return self.spark.read.schema("range int, x double, c long, date date").parquet(f"{self.path}/values")

    @property
    def counts(self) -> DataFrame:
        """(date, range, k): at most 1,024 rows a date."""
        return self.spark.read.schema("range int, k long, date date").parquet(f"{self.path}/counts")

    def percentiles(self, levels: dict[str, float], dates: Sequence[date] | None = None) -> DataFrame:
        """``date`` and, for each name, the percentile of all values dated strictly before: of ``dates``, or of all in the state.

        Which ranges the order statistics lie in is found here and now from the counts; of the values
        only those ranges are read. A date without earlier values is left out.
        """
        counts = self.counts
        asked = counts.select("date").distinct() if dates is None else self.spark.createDataFrame([(d,) for d in dates], "date date")

        def read(ranges: Iterable[int]) -> DataFrame:
            return self.values.where(F.col("range").isin(sorted(ranges)))

        return ranged_percentiles(counts, read, asked, levels)

    def thresholds(self, levels: Iterable[float], dates: Sequence[date] | None = None) -> DataFrame:
        """(date, level, value), levels in percent: what a winsorising filter takes as its ``thresholds``."""
        names = {f"p{i}": level for i, level in enumerate(levels)}
        wide = self.percentiles({n: level / 100 for n, level in names.items()}, dates)
        rows = F.explode(F.array(*[F.struct(F.lit(float(level)).alias("level"), F.col(n).alias("value")) for n, level in names.items()]))
        return wide.select("date", rows.alias("_x")).select("date", "_x.*")

