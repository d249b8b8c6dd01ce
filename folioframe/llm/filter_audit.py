"""What text filters take from each other: counts of every filter at every place of every order.

A document fails a filter or not whatever the order, so one number of five bits tells all about it.
Four bits come from the text alone. The fifth, a copy of an earlier document's text, is found by an
existential self-join: a left semi join on the text's hash, the exact text and a smaller id. Its rows
are put together with the other failures, and the documents of each part are counted by combination of
bits. All orders are then worked out from these counts, at most 128 numbers a part.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, in_batches, stash, text_or_empty

FILTERS = "ABCDE"
#: Fixed values of the filters: words at least, part of them that differ, capitals at most (both in percent), characters that none may have.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, REFUSED = 200, 50, 2, b"#$%&*|"
COPY = 1 << FILTERS.index("E")
_NOT_CAPITALS = bytes(b for b in range(256) if not 0x41 <= b <= 0x5A)
_BLANK = re.compile(rb"[ \t-\r]")
_CHUNK = 1 << 20


def _pieces(data: bytes) -> Iterator[bytes]:
    """``data`` cut at blanks into pieces of about a million bytes, so that few words exist at once."""
    at = 0
    while len(data) - at > _CHUNK and (cut := _BLANK.search(data, at + _CHUNK)):
        yield data[at : cut.start()]
        at = cut.start()
    yield data[at:]


def failures(text: str) -> int:
    """Bits of the filters A to D that a text fails.

    Words are what six ASCII blanks leave between them. A: fewer than 200 words; B: fewer than half of
    the words are distinct; C: more than 2 % of the characters are A to Z; D: one of ``#$%&*|``. An
    empty text fails A alone.
    """
    data = text.encode()
    words, distinct = 0, set()
    for piece in _pieces(data):
        found = piece.split()  # bytes: only the six ASCII blanks count
        words += len(found)
        distinct.update(found)
    capitals = len(data.translate(None, _NOT_CAPITALS))
    return (
        (words < LEAST_WORDS)
        | (100 * len(distinct) < LEAST_DISTINCT * words) << 1
        | (100 * capitals > MOST_CAPITALS * len(text)) << 2
        | any(c in data for c in REFUSED) << 3
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``id, part, digest, hash, text`` of each row; rows alike in the first three are counted together."""
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), F.xxhash64(text).alias("hash"), text.alias("text"),
    )


def copies(rows: DataFrame) -> DataFrame:
    """The ``rows`` (id, part, digest, hash, text) whose text a row with a smaller id has, too, without their text.

    Texts travel once, to where their hash is, and only those whose hash has several ids come further.
    A null id is neither smaller than others nor larger.
    """
    several = rows.groupBy("hash").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    met = stash(apart(rows, "hash").join(apart(several.select("hash"), "hash"), "_hash", "left_semi"), "same-hash")
    # A row for each text: a group of copies, however large, meets one.
    first = met.groupBy("_hash", "text").agg(F.min("id").alias("least")).select(F.bitwise_not("_hash").alias("h"), F.col("text").alias("t"), "least")
    left = met.withColumn("h", F.bitwise_not("_hash"))
    found = left.join(first, (left["h"] == first["h"]) & (left["text"] == first["t"]) & (first["least"] < left["id"]), "left_semi")
    return found.select("id", "part", "digest")


def failed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``id, part, digest, bits, n``: the filters (A is bit 0) that the ``n`` rows alike in id, part and text fail.

    Null texts count as empty, null parts as the empty string; rows without id are no copies.
    """
    rows = _keyed(docs, id_col, text_col, part_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = pa.array([failures(x.as_py()) for x in batch.column(3)], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], bits], ["id", "part", "digest", "bits"])

    own = in_batches(rows.select("id", "part", "digest", "text"), run, f"id {kind}, part string, digest binary, bits int").withColumn("n", F.lit(1))
    again = copies(rows).withColumns({"bits": F.lit(COPY), "n": F.lit(0)})
    return own.unionByName(again).groupBy("id", "part", "digest").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))


def _total(counts: str, fits: Callable[[Column], Column]) -> Column:
    """Sum of the counts of the combinations that fit."""
    every = F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))
    return F.aggregate(every, F.lit(0).cast("long"), lambda sum_, i: sum_ + F.when(fits(i), F.element_at(counts, i + 1)).otherwise(0))


def audit(failed: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    Rows for each part, each of the 120 orders of the filters and each step of it. Of the part's
    documents: ``kept`` pass this and all earlier filters, ``removed`` go here, ``redundant`` fail here
    but went earlier, ``unique_fails`` fail this filter alone; ``good_lost`` and ``toxic_lost`` are those
    removed here that ``labels`` (``id_col, quality, toxic``) call good or toxic; ``shapley`` is how many
    this filter removes in all orders together, at any step. An id labelled several times is what any of
    its labels says. Parts come from the documents; an empty table gives no rows.
    """
    if labels is None:
        marked = failed.withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    else:
        says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
        known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(says("quality"), says("toxic"))
        known = known.select("id", F.col("quality").alias("good"), "toxic")
        marked = failed.join(known, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    combinations = marked.groupBy("part", "bits").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])
    every = range(1 << len(FILTERS))
    lists = [F.array(*[F.coalesce(F.max(F.when(F.col("bits") == i, F.col(c))), F.lit(0)).cast("long") for i in every]).alias(c) for c in ("n", "good", "toxic")]
    parts = combinations.groupBy("part").agg(*lists)
    orders = F.array(*[F.lit("".join(o)) for o in itertools.permutations(FILTERS)])
    steps = parts.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit_at = lambda step: F.expr(f"shiftleft(1, instr('{FILTERS}', substring(filter_order, {step}, 1)) - 1)")
    before = sum((F.when(F.col("step") > k, bit_at(k)).otherwise(0) for k in range(1, len(FILTERS))), F.lit(0))
    placed = steps.withColumns({"bit": bit_at("step"), "before": before})
    fails, went = lambda i: i.bitwiseAND(F.col("bit")) != 0, lambda i: i.bitwiseAND(F.col("before")) != 0
    here = lambda i: fails(i) & ~went(i)
    # Of the orders of all filters, those in which a document goes by this one: the first of those it fails.
    share = F.aggregate(
        F.sequence(F.lit(1), F.lit((1 << len(FILTERS)) - 1)), F.lit(0).cast("long"),
        lambda sum_, i: sum_ + F.when(fails(i), F.element_at("n", i + 1) * (F.lit(math.factorial(len(FILTERS))) / F.bit_count(i)).cast("long")).otherwise(0),
    )
    return placed.select(
        "part", "filter_order", "step", _total("n", lambda i: ~fails(i) & ~went(i)).alias("kept"), _total("n", here).alias("removed"),
        _total("n", lambda i: fails(i) & went(i)).alias("redundant"), F.element_at("n", F.col("bit") + 1).alias("unique_fails"),
        _total("good", here).alias("good_lost"), _total("toxic", here).alias("toxic_lost"), share.alias("shapley"),
    )
