"""Panels derived from the order lines: suppliers (nearly dense) and parts (sparse).

Prices come from whole cents and whole quantities, so that every engine gets the same bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = {"supplier": "l_suppkey", "part": "l_partkey"}


#: Rows that a task holds at once, about: more rows are more partitions, so that its memory does not grow with the table.
TASK_ROWS = 1_000_000


def parts_for(rows: DataFrame) -> int:
    """As many partitions as the session has for a shuffle, or more for a large table. Counts the rows, from the files' footers."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))


def load(spark: SparkSession, sf_dir: str, kind: str = "supplier") -> DataFrame:
    """``ID, date, ret, RATING_NUM, VW, PRICE, disc, lines, qty``; one row for each ID and month."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = lines.select(F.col(KEYS[kind]).alias("ID"), "l_shipdate", "l_extendedprice", "l_quantity", "l_discount")
    if kind == "part":
        # Parts have hardly more than a line a month: dealt once as they are, for the months and all windows after them.
        lines = lines.repartition(parts_for(lines), "ID")
    months = lines.groupBy("ID", F.trunc("l_shipdate", "month").alias("date")).agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"),
        F.sum(F.col("l_quantity").cast("long")).alias("units"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("discs"),
        F.count(F.lit(1)).alias("n"),
    )
    month = (F.year("date") - 1995) * 12 + F.month("date") - 1
    price = F.col("cents").cast("double") / F.col("units") / 2000.0
    panel = months.select(
        "ID",
        "date",
        price.alias("PRICE"),
        (1 + (F.col("ID") * 7 + F.floor(month / 6)) % 22).cast("double").alias("RATING_NUM"),
        F.when((F.col("ID") + month) % 17 != 0, F.col("cents").cast("double")).alias("VW"),
        (F.col("discs").cast("double") / F.col("n")).alias("disc"),
        F.col("n").cast("double").alias("lines"),
        F.col("units").cast("double").alias("qty"),
    )
    before = F.lag("PRICE").over(Window.partitionBy("ID").orderBy("date"))
    return panel.withColumn("ret", F.col("PRICE") / before - 1)


def sql(kind: str = "supplier", name: str = "panel") -> str:
    """The same panel as a common table expression."""
    return f"""
    {name}_m AS (
        SELECT {KEYS[kind]} AS "ID", CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
               CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS cents,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS units,
               CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS discs, count(*) AS n
        FROM lineitem GROUP BY 1, 2
    ), {name}_p AS (
        SELECT *, cents / units / 2000.0::DOUBLE AS "PRICE", (year(date) - 1995) * 12 + month(date) - 1 AS mi FROM {name}_m
    ), {name} AS (
        SELECT "ID", date, "PRICE", CAST(1 + ("ID" * 7 + mi // 6) % 22 AS DOUBLE) AS "RATING_NUM",
               CASE WHEN ("ID" + mi) % 17 <> 0 THEN cents END AS "VW", discs / n AS disc, CAST(n AS DOUBLE) AS lines,
               units AS qty, "PRICE" / lag("PRICE") OVER (PARTITION BY "ID" ORDER BY date) - 1 AS ret,
               dense_rank() OVER (ORDER BY date) - 1 AS t
        FROM {name}_p
    )"""
