"""Exact top-k inner products over a vector-approximation file.

The file has one byte for each component: the number of its cell among cells of equal width. A scan over
the cells alone, in blocks of queries and vectors, gives an upper and a lower bound of each score by one
product of small numbers: every component is within half a cell of the cell's middle. Some blocks come
first and give each query a bound that its k best reach in any case; of the other blocks only what can
reach it comes out, which is less and less than one vector a block. Of those that are left exact
vectors are read from the best bound on; when the k-th exact score is known, only those whose bound
reaches it are read, too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, stash

#: Cells of a component.
CELLS = 256
#: Vectors and queries in a block, on average.
BLOCK, QUERY_BLOCK = 16_384, 8_192
#: Blocks of vectors that are scanned first, for a bound of each query.
FIRST_BLOCKS = 64
_STEP = 1 << 21  # bounds held at once
_MAX = (1 << 63) - 1


def scaled(embedding: Column, factor: int = 64) -> Column:
    """floor(factor * x) of each component; null unless all components are finite numbers."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(embedding, lambda x: F.floor(x.cast("double") * factor).cast("long")))


@dataclass(frozen=True)
class Grid:
    """Cells from ``low`` on, each ``width`` whole numbers wide."""

    low: int
    width: int

    @classmethod
    def over(cls, low: int, high: int) -> Grid:
        return cls(low, max(1, -(-(high - low + 1) // CELLS)))

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        # unsigned: the difference of two 64-bit numbers fits
        return ((vectors.astype(np.uint64) - np.uint64(self.low % (1 << 64))) // np.uint64(self.width)).astype(np.uint8)

    def bounds(self, queries: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of the scores of queries (rows) and approximated vectors (columns)."""
        q = queries.astype(np.float64)
        total, size = q.sum(axis=1, keepdims=True), np.abs(q).sum(axis=1, keepdims=True)
        middle = self.low + (self.width - 1) / 2
        score = self.width * (queries.astype(np.float32) @ cells.astype(np.float32).T).astype(np.float64) + middle * total
        slack = (self.width - 1) / 2 * size
        if float(size.max(initial=0)) * CELLS >= 1 << 24:  # beyond this the product of small numbers is rounded
            slack = slack + 4e-7 * len(cells.T) * CELLS * self.width * size
        slack = slack + 1e-9 * (np.abs(score) + abs(middle) * size)
        return score + slack, score - slack


def approximate(vectors: DataFrame) -> tuple[Grid, DataFrame]:
    """The grid of ``vectors`` (vec_id, vn, v) and the file: ``vec_id, vn, d, cells``, written to the shared folder."""
    low, high = vectors.where(F.size("v") > 0).agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    grid = Grid.over(low or 0, high or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = grid.cells(batch.column(1).flatten().to_numpy())
            ends = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())]).tolist()
            cells = [flat[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            sizes = np.diff(ends).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes), pa.array(cells, pa.binary())], ["vec_id", "vn", "d", "cells"])

    return grid, stash(in_batches(vectors.select("vec_id", "v", "vn"), run, "vec_id long, vn int, d int, cells binary"), "cells")


def scan_block(
    grid: Grid, q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, cells: np.ndarray, k: int, floor: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """Places of query and vector, upper and lower bound of the pairs that may be among the block's k best and reach ``floor``
    (a number for each query); own rows left out."""
    parts = []
    step = max(1, _STEP // max(1, len(ids)))
    for at in range(0, len(q_ids), step):
        upper, lower = grid.bounds(queries[at : at + step], cells)
        own = q_ids[at : at + step, None] == ids[None, :]
        lower = np.where(own, -np.inf, lower)
        sure = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(lower), -np.inf)
        if floor is not None:
            sure = np.maximum(sure, floor[at : at + step])
        i, j = np.nonzero((upper >= sure[:, None]) & ~own)
        parts.append((at + i, j, upper[i, j], lower[i, j]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def inner_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whole-number inner products of rows; beyond 64 bits they stop at its ends."""
    if not left.size:
        return np.zeros(len(left), np.int64)
    bound = (np.abs(left.astype(float)) * np.abs(right.astype(float))).sum(axis=1)
    out = (left * right).sum(axis=1)
    for i in np.flatnonzero(bound > 1 << 62).tolist():
        out[i] = max(-_MAX - 1, min(_MAX, sum(map(int.__mul__, left[i].tolist(), right[i].tolist()))))
    return out


def _scored(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """``query_id, vec_id, score`` of pairs, from exact vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            score = np.zeros(batch.num_rows, np.int64)
            q, v = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                at = starts[rows, None] + np.arange(d)
                score[rows] = inner_products(q[at], v[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score)], ["query_id", "vec_id", "score"])

    joined = pairs.select("query_id", "qn", "vec_id", "vn").join(vectors, ["vec_id", "vn"]).join(queries, ["query_id", "qn"])
    joined = joined.select("query_id", "vec_id", "q", "v")
    return in_batches(joined, run, "query_id long, vec_id long, score long")


def _kth(rows: DataFrame, by: str, k: int, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """``keys, kth``: each query's k-th largest ``by``; none for a query with fewer rows."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by)))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= k).where(F.col("_nth") == k).select(*keys, F.col(by).alias("kth"))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, block: int = BLOCK, query_block: int = QUERY_BLOCK, first_blocks: int = FIRST_BLOCKS
) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows of ``vectors`` (``vec_id, v``) that are queries.

    Candidates are all rows but those with the query's id; ties go to the smaller id. Vectors or ids
    that are null take no part; vectors are compared with those of their own length; rows repeated with
    id and vector count once, different vectors of an id each. Fewer candidates than ``k`` all come out; no
    vectors give no rows. Queries and cells meet in blocks whose number follows the rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.coalesce(is_query, F.lit(False)).alias("q")).where("vec_id IS NOT NULL AND v IS NOT NULL").distinct()
    # Different vectors of one id are told apart by a number.
    rows = stash(rows.withColumn("vn", F.row_number().over(Window.partitionBy("vec_id").orderBy("v"))), "vectors")
    grid, file = approximate(rows)
    queries = rows.where("q").select(F.col("vec_id").alias("query_id"), F.col("vn").alias("qn"), F.col("v").alias("q"), F.size("v").alias("d"))
    n, n_q = file.count(), queries.count()
    blocks, q_blocks = max(1, -(-n // block)), max(1, -(-n_q // query_block))
    every = lambda first, end: F.explode(F.sequence(F.lit(first), F.lit(end - 1)))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    found = file.select("vec_id", "vn", "cells", "d", dealt("vec_id", blocks).alias("cb"))
    left = queries.select("query_id", "qn", "q", "d", dealt("query_id", q_blocks).alias("qb"))

    def scan(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(found):
            return pd.DataFrame(columns=["query_id", "qn", "vec_id", "vn", "upper", "lower"])
        d = int(queries["d"].iloc[0])
        q = np.array([*queries["q"]], np.int64).reshape(len(queries), d)
        cells = np.frombuffer(b"".join(found["cells"]), np.uint8).reshape(len(found), d)
        floor = queries["floor"].fillna(-np.inf).to_numpy(np.float64)
        i, j, upper, lower = scan_block(grid, queries["query_id"].to_numpy(np.int64), q, found["vec_id"].to_numpy(np.int64), cells, k, floor)
        pairs = {c: queries[c].to_numpy()[i] for c in ("query_id", "qn")} | {c: found[c].to_numpy()[j] for c in ("vec_id", "vn")}
        return pd.DataFrame(pairs | {"upper": upper, "lower": lower})

    def scanned(left: DataFrame, first: int, end: int) -> DataFrame:
        """Pairs from blocks first to end - 1, for queries with a ``floor``."""
        some = found if (first, end) == (0, blocks) else found.where((F.col("cb") >= first) & (F.col("cb") < end))
        sides = [left.select("*", every(first, end).alias("cb")), some.select("*", every(0, q_blocks).alias("qb"))]
        keys = ["d", "qb", "cb"]
        pairs = sides[0].groupBy(*keys).cogroup(sides[1].groupBy(*keys)).applyInPandas(
            scan, "query_id long, qn int, vec_id long, vn int, upper double, lower double"
        )
        return stash(pairs, "near")

    near = scanned(left.withColumn("floor", F.lit(None).cast("double")), 0, min(blocks, first_blocks))
    if blocks > first_blocks:
        # The k-th best of these can only be beaten by vectors whose upper bound reaches it.
        floors = _kth(near, "lower", k, ["query_id", "qn"]).withColumnRenamed("kth", "floor")
        near = near.unionByName(scanned(left.join(floors, ["query_id", "qn"], "left"), first_blocks, blocks))
    sure = _kth(near, "lower", k)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id", "vn"))
    near = near.join(sure, "query_id", "left").where("kth IS NULL OR upper >= kth").drop("kth", "lower").withColumn("place", place)
    near = stash(near, "near-all")
    exact = rows.select("vec_id", "vn", "v")
    first = stash(_scored(near.where(F.col("place") <= 2 * k), queries.drop("d"), exact), "exact-first")
    # As a double the k-th score may have been rounded up by less than the bounds' allowance.
    rest = near.where(F.col("place") > 2 * k).join(_kth(first, "score", k), "query_id").where("upper >= kth")
    best = first.unionByName(_scored(rest, queries.drop("d"), exact))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
