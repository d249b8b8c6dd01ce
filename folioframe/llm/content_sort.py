"""Exact dedup by content sort, DataFrame functions only.

Rows are range-partitioned by the first characters of their normalised text (Spark samples the
splitters), sorted by the whole normalised text inside each partition, and every text is compared in
full with its left neighbour, so that equal texts form runs. A prefix that holds more than its share
of the rows (one text copied very often, or a common opening) is dealt over several salted ranges;
the heads of such runs, one for each salt and text, are merged by the SHA-256 of the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stash, text_or_empty

#: The characters that normalising deletes.
_BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: Characters of the normalised text that range partitioning looks at.
PREFIX = 32
#: A prefix with more than rows / (partitions * HOT) rows is salted.
HOT = 16


def normalise(text: Column) -> Column:
    for c in _BLANKS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _prefix(text: Column) -> Column:
    """First characters of the normalised text; normalises the whole text only where it must."""
    start = normalise(F.substring(text, 1, 8 * PREFIX))
    return F.when(F.char_length(start) >= PREFIX, F.substring(start, 1, PREFIX)).otherwise(
        F.substring(normalise(text), 1, PREFIX)
    )


def _runs(docs: DataFrame, carry: list[str], id_col: str, text_col: str) -> DataFrame:
    """One row per document with its run: ``_sha, _salt, _hot, _points, _id, _rn, _size``, ``_text`` as it is, and ``_row``.

    ``_row`` has the columns of ``carry``; the text travels once.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    text = text_or_empty(text_col)
    keyed = docs.select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("_row"),
        F.col(id_col).alias("_id"),
        F.col(text_col).alias("_text"),
        _prefix(text).alias("_prefix"),
    )
    share = max(1, docs.count() // (parts * HOT))
    # Fewer than parts * HOT prefixes can hold that many rows, so this side has a proven bound.
    hot = (
        docs.select(_prefix(text).alias("_prefix"))
        .groupBy("_prefix")
        .count()
        .where(F.col("count") > share)
        .select("_prefix", F.ceil(F.col("count") / share).alias("_salts"))
    )
    keyed = keyed.join(F.broadcast(hot), "_prefix", "left").withColumn(
        "_salt",
        F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.monotonically_increasing_id(), F.col("_salts"))
        ).cast("int"),
    )
    dealt = keyed.repartitionByRange(parts, "_prefix", "_salt").select(
        "_row",
        "_id",
        "_text",
        "_prefix",
        "_salt",
        F.col("_salts").isNotNull().alias("_hot"),
        F.char_length(text_or_empty("_text")).alias("_points"),
        normalise(text_or_empty("_text")).alias("_norm"),
    )
    order = Window.partitionBy("_prefix", "_salt").orderBy("_norm", F.desc("_points"), "_id")
    before = F.lag("_norm").over(order)
    runs = (
        dealt.withColumn("_new", (before.isNull() | (before != F.col("_norm"))).cast("int"))
        .withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_sha", F.sha2(F.col("_norm"), 256))
        .drop("_norm", "_new")
    )
    run = Window.partitionBy("_prefix", "_salt", "_run")
    return runs.withColumns(
        {
            "_rn": F.row_number().over(run.orderBy(F.desc("_points"), "_id")),
            "_head": F.first("_id").over(run.orderBy(F.desc("_points"), "_id")),
            "_size": F.count(F.lit(1)).over(run),
        }
    ).drop("_prefix", "_run")


def _merged(runs: DataFrame) -> DataFrame:
    """For each text of a salted prefix: the row that stays and the number of copies."""
    heads = runs.where(F.col("_hot") & (F.col("_rn") == 1))
    return heads.groupBy("_sha").agg(
        F.min(F.struct((-F.col("_points")).alias("points"), F.col("_id").alias("id"), F.col("_salt").alias("salt"))).alias("_best"),
        F.sum("_size").alias("_all"),
    )


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal if identical after deleting every blank. Of equal texts the one with most code
    points in the original, then the smallest id, stays. Null text counts as empty; a null id sorts
    first; of rows repeated with the same id and text exactly one has ``kept``. An empty table gives
    no rows. Other columns of ``docs`` are not looked at.
    """
    runs = stash(
        _runs(docs.select(id_col, text_col), [], id_col, text_col).drop("_row", "_text"), "content-sort"
    )
    # Keyed by (text, salt): a salted group of copies never meets in one task.
    best = (
        runs.where(F.col("_hot") & (F.col("_rn") == 1))
        .select("_sha", "_salt")
        .join(_merged(runs), "_sha")
    )
    joined = runs.join(best, ["_sha", "_salt"], "left")
    merged = F.col("_best").isNotNull()
    return joined.select(
        F.col("_id").alias(id_col),
        F.when(merged, F.col("_best.id")).otherwise(F.col("_head")).alias("keep_id"),
        F.when(merged, F.col("_all")).otherwise(F.col("_size")).alias("group_size"),
        ((F.col("_rn") == 1) & (~merged | (F.col("_best.salt") == F.col("_salt")))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its copies, all columns kept; the same row stays as in :func:`mark_copies`."""
    others = [c for c in docs.columns if c != text_col]
    heads = stash(
        _runs(docs, others, id_col, text_col)
        .where(F.col("_rn") == 1)
        .select("_row", "_text", "_sha", "_salt", "_hot", "_points", "_id", "_rn", "_size"),
        "content-sort-rows",
    )
    winners = _merged(heads).select("_sha", F.col("_best.salt").alias("_salt"))
    columns = [F.col("_text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns]
    kept = heads.where(~F.col("_hot")).select(*columns)
    return kept.unionByName(heads.where("_hot").join(winners, ["_sha", "_salt"], "left_semi").select(*columns))
