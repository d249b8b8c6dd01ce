"""Readers and writers: panels, percentile tables, factors, strategy tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    In local mode a temporary folder will do; anywhere else a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/folioframe/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder now, and read back: what several plans read is worked out once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_panel_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_panel_jdbc(
    spark: SparkSession, url: str, query: str, partition_column: str, bounds: tuple[str, str], parts: int, **options: str
) -> DataFrame:
    """A panel from a database, read in ``parts`` ranges of a column at once."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=f"({query}) AS panel", partitionColumn=partition_column, **options)
        .options(lowerBound=bounds[0], upperBound=bounds[1], numPartitions=str(parts))
        .load()
    )


def read_percentiles(spark: SparkSession, path: str, levels: Sequence[str]) -> DataFrame:
    """(date, level, value) from a CSV with a date and one column for each percentile level."""
    wide = spark.read.csv(path, header=True)
    first = wide.columns[0]
    wide = wide.select(F.to_date(F.col(f"`{first}`")).alias("date"), *[F.col(f"`{x}`").cast("double") for x in levels])
    return wide.unpivot("date", [f"`{x}`" for x in levels], "level", "value").select(
        "date", F.regexp_replace("level", "`", "").cast("double").alias("level"), "value"
    )


def read_factor_csv(spark: SparkSession, path: str, names: Sequence[str], drop: Sequence[str] = ("RF",)) -> DataFrame:
    """Monthly factors from a CSV with text above and below: rows that start with a YYYYMM date.

    Percent become fractions, dates month ends, cells that aren't numbers null.
    """
    cell = F.split("value", ",")
    rows = spark.read.text(path).where(F.trim(cell[0]).rlike("^[0-9]{6}$"))
    return rows.select(
        F.last_day(F.to_date(F.trim(cell[0]), "yyyyMM")).alias("date"),
        *[
            (F.expr(f"try_cast(trim(try_element_at(split(value, ','), {i})) AS double)") / 100).alias(n)
            for i, n in enumerate(names, 2)
            if n not in drop
        ],
    )


def read_factors(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Small factor table: ``date`` and one column for each name."""
    schema = ", ".join(["date date", *[f"`{n}` double" for n in names]])
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def wide(long: DataFrame, names: Sequence[str], name_col: str = "spec", value_col: str = "value") -> DataFrame:
    """One row for each date, one column for each of the known names."""
    return long.groupBy("date").pivot(name_col, list(names)).agg(F.first(value_col))


def write_strategies(long: DataFrame, path: str, by: Sequence[str] = ("spec", "weighting")) -> None:
    """Strategy series (``spec, weighting, date, value``) in long form, a folder for each spec and weighting.

    What is there of the same specs and weightings is replaced, all else stays: a study can be written
    spec by spec, and a part of it again after a failure.
    """
    long.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_strategies(spark: SparkSession, path: str) -> DataFrame:
    """``date, value, spec, weighting`` of all that :func:`write_strategies` has put there; names stay text."""
    return spark.read.schema("date date, value double, spec string, weighting string").parquet(path)
