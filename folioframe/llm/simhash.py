"""Near-duplicates by SimHash, linked through tables of distances to reference fingerprints.

A first table has the distances to zero and to one mask for each block of bits. By the triangle
inequality the distances of two linked fingerprints to any reference differ by at most the radius; for
these references the bound sharpens to the sum over all blocks, since distance to zero and to a block's
mask together tell how many bits of the block are set. A fingerprint therefore meets only those whose
rows of this table lie within that sum. A second table has the distances to many random references:
pairs that meet are discarded if their rows differ by more than the radius in any coordinate, and every
pair that is left is compared in full.

Texts that only resemble each other differ in more bits than such a table can tell apart. They are
found by bands of min-hashes and compared shingle by shingle; see :func:`similar_groups`. Near copies
(:func:`drop_near_copies`) are linked by both.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, discard, in_batches, larger, shuffle_partitions, stash, text_or_empty
from .components import components

BITS = 64
SEED = 42
_CHUNK = 1 << 15
#: References of the second table.
PIVOTS = 8
_pivots = np.random.Generator(np.random.PCG64(23)).integers(0, 1 << 63, PIVOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Rows at home in a cell that one task compares with the cell's others; a cell of more is split.
CELL_ROWS = 4_096


def _digests(text: str | None, words: int) -> Iterator[bytes]:
    """XXH64 of a text's word shingles, big-endian and joined, some thousand at a time."""
    tokens = (text or "").encode().lower().split()  # bytes: only A-Z and the six ASCII blanks count
    if not tokens:
        return
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        starts, ends = [0], [len(joined)]
    else:
        lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
        stop = np.cumsum(lens + 1) - 1
        starts, ends = (stop - lens)[: len(tokens) - words + 1].tolist(), stop[words - 1 :].tolist()
    digest = xxhash.xxh64_digest
    for at in range(0, len(starts), _CHUNK):
        yield b"".join([digest(joined[i:j], SEED) for i, j in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])])


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of a text's word shingles as a signed 64-bit integer; no words give 0."""
    counts, n = np.zeros(BITS, np.int64), 0
    for part in _digests(text, words):
        bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint16)
        n += len(bits)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fp)`` for each row; null text counts as empty."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fingerprint(x.as_py(), words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], ["_id", "fp"])

    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    return in_batches(rows, run, f"_id {kind.simpleString()}, fp long").withColumnRenamed("_id", id_col)


def block_masks(blocks: int, bits: int = BITS) -> list[int]:
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    return [(1 << hi) - (1 << lo) for lo, hi in itertools.pairwise(edges)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def blocks_for(n: int) -> int:
    """References beside zero: more for larger tables, so that a cell's rows stay few."""
    return 6 if n < 5_000_000 else 8 if n < 500_000_000 else 10


def _offsets(blocks: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of table rows to visit: absolute sum within the radius, one of each +/- pair."""
    found = []

    def grow(head: tuple[int, ...], left: int) -> None:
        if len(head) == blocks:
            if head > (0,) * blocks:
                found.append(head)
            return
        for x in range(-left, left + 1):
            grow((*head, x), left - abs(x))

    grow((), radius)
    return found


def _visits(rows: DataFrame, value: str, bits: int, blocks: int, radius: int) -> DataFrame:
    """``rows`` once at home and once in each cell to visit: ``cell, visitor`` and their columns.

    A cell is a row of distances from the references: zero, and a mask for each block.
    """
    width = 54 // blocks  # bits of the cell number for each block
    zero = F.bit_count(F.col(value))
    cell = F.lit(0).cast("long")
    for j, mask in enumerate(block_masks(blocks, bits)):
        apart = F.bit_count(F.col(value).bitwiseXOR(F.lit(_signed(mask)).cast("long")))
        # distance to zero and to the mask: how many bits of the block are set
        inside = F.shiftright(F.lit(mask.bit_count()) + F.col("_zero") - apart, 1)
        cell = cell + F.shiftleft((inside + radius + 1).cast("long"), j * width)
    deltas = [sum(o << (j * width) for j, o in enumerate(head)) for head in _offsets(blocks, radius)]
    names = [F.col(c) for c in rows.columns]
    tabled = rows.withColumn("_zero", zero).select(*names, cell.alias("_cell"))
    moved = tabled.select(*names, F.explode(F.array(*[F.lit(d).cast("long") for d in [0, *deltas]])).alias("_delta"), "_cell")
    return moved.select((F.col("_cell") + F.col("_delta")).alias("cell"), (F.col("_delta") != 0).alias("visitor"), *names)


class _Forest:
    """Union-find over the nodes that a task has linked."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def distances(values: np.ndarray) -> np.ndarray:
    """Table of Hamming distances to the random references: a row for each value."""
    return np.bitwise_count(values[:, None] ^ _pivots[None, :])


def _linked(home: np.ndarray, other: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs within the radius, block by block, by the table of distances and then in full."""
    step = max(1, (1 << 20) // max(1, len(other)))
    here, there = distances(home).astype(np.int8), distances(other).astype(np.int8)
    for at in range(0, len(home), step):
        near = np.ones((len(here[at : at + step]), len(other)), bool)
        for p in range(PIVOTS):  # maximum coordinate difference
            near &= np.abs(here[at : at + step, p, None] - there[None, :, p]) <= radius
        i, j = np.nonzero(near)
        close = np.bitwise_count(home[i + at] ^ other[j]) <= radius
        yield i[close] + at, j[close]


def _split_cells(visits: DataFrame, rows: int) -> DataFrame:
    """``visits`` (cell, visitor, fp) with ``part`` and ``guest``: each row once in every part of its cell that it meets.

    The rows at home in a cell are dealt over parts of about ``rows``; a row is at home in its own part
    and a guest in those before it, a visitor is a guest in all.
    """
    homes = visits.where("NOT visitor").groupBy("cell").count().where(F.col("count") > rows)
    # No more than one cell for each `rows` fingerprints: a proven bound.
    large = homes.select("cell", F.ceil(F.col("count") / rows).cast("int").alias("_parts"))
    dealt = visits.join(F.broadcast(large), "cell", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("_parts")).cast("int")
    last = F.when(F.col("visitor"), F.col("_parts") - 1).otherwise(own)
    met = dealt.select("cell", "visitor", "fp", own.alias("_own"), F.explode(F.sequence(F.lit(0), last)).alias("part"))
    return met.select("cell", "part", (F.col("visitor") | (F.col("part") != F.col("_own"))).alias("guest"), "fp")


def _forests(visits: DataFrame, radius: int, rows: int = CELL_ROWS) -> DataFrame:
    """Edges ``(a, b)`` between fingerprints that meet in a cell, at most ``radius`` bits apart.

    ``visits``: ``cell, visitor, fp``. Of a cell's part a task holds the rows at home, guests pass by.
    Every task gives a spanning forest of the links it finds, so all links are there as paths while a
    large group of near copies gives no square of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        here: tuple[int, int] | None = None
        home = np.empty(0, np.uint64)

        def met(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
            for i, j in _linked(left, right, radius):
                for x, y in zip(left[i].view(np.int64).tolist(), right[j].view(np.int64).tolist()):
                    if x != y and forest.join(x, y):
                        yield x, y

        for batch in larger(batches):
            cell, part, guest, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            # unsigned: numpy counts the bits of a negative number's absolute value
            fp, found = fp.astype(np.uint64), []
            turn = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1
            for s, e in itertools.pairwise([0, *turn.tolist(), len(cell)]):
                if (cell[s], part[s]) != here:
                    here, home = (cell[s], part[s]), np.empty(0, np.uint64)
                h = s + int(np.searchsorted(guest[s:e], True))
                if h > s:  # some more at home
                    found += [x for pair in (met(home, fp[s:h]), met(fp[s:h], fp[s:h])) for x in pair]
                    home = np.concatenate([home, fp[s:h]])
                if e > h and len(home):
                    found += met(home, fp[h:e])
            ends = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    parts = shuffle_partitions(visits.sparkSession)
    dealt = _split_cells(visits, rows).repartition(parts, "cell", "part").sortWithinPartitions("cell", "part", "guest")
    return in_batches(dealt, run, "a long, b long")


def links(fps: DataFrame, radius: int = 2, blocks: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges ``(a, b)``: paths between all fingerprints of column ``fp`` at most ``radius`` bits apart.

    Null fingerprints take no part. A cell with more than ``cell_rows`` fingerprints is compared by
    several tasks.
    """
    fps = fps.select("fp").where("fp IS NOT NULL").distinct()
    fps = stash(fps, "distinct-fingerprints")
    visits = _visits(fps, "fp", BITS, blocks or blocks_for(fps.count()), radius)
    return _forests(visits, radius, cell_rows)


def near_groups(
    docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, fp, component_id)``: the smallest id that links of at most ``radius`` bits reach.

    Rows of equal fingerprint are linked without being paired. Empty and null texts share fingerprint
    zero and are linked like any others. A null id is never a ``component_id`` unless all ids of the
    component are null. Repeated rows each come out; an empty table gives no rows.
    """
    fps = stash(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min(id_col).alias("_least"))
    rooted = components(links(fps, radius))
    classes = classes.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "_root", F.coalesce("root", "fp")
    )
    classes = stash(classes, "classes")
    least = apart(classes.groupBy("_root").agg(F.min("_least").alias("component_id")), "_root")
    by_fp = apart(classes, "_root").join(least, "__root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(id_col, "fp", "component_id")


#: Search for similar texts: so many bands, each one number made of so many min-hashes.
BANDS, BAND_ROWS = 32, 6
_STEP = 512  # shingles whose min-hashes are made at once
_factors = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64)
_MULTIPLY, _ADD = _factors[0] * np.uint64(2) + np.uint64(1), _factors[1] * np.uint64(2)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    parts = [np.frombuffer(x, ">u8").astype(np.uint64) for x in _digests(text, words)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _number(found: np.ndarray) -> int:
    """One number for a set of shingles."""
    return int.from_bytes(xxhash.xxh64_digest(found.tobytes(), SEED), "big", signed=True)


def band_values(found: np.ndarray) -> np.ndarray:
    """A number for each band: sets share it if they agree in all of the band's min-hashes."""
    low = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _STEP):
        np.minimum(low, (found[at : at + _STEP, None] * _MULTIPLY + _ADD).min(axis=0), out=low)
    value = np.arange(BANDS, dtype=np.uint64)
    for part in low.reshape(BANDS, BAND_ROWS).T:
        value = (value ^ part) * np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(32)
    return value.view(np.int64)


def _marks(docs: DataFrame, words: int, id_col: str, text_col: str, prints: bool) -> DataFrame:
    """``(id, key, fp, node, size, bands)`` of each row with an id; equal sets of shingles are one node, ``key`` is the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, node, size, bands = [], [], [], []
            for x in batch.column(2):
                text = x.as_py()
                found = shingles(text, words)
                fp.append(fingerprint(text) if prints else None)
                node.append(_number(found))
                size.append(len(found))
                bands.append(band_values(found))
            flat = pa.array(np.concatenate([np.empty(0, np.int64), *bands]), pa.int64())
            lists = pa.FixedSizeListArray.from_arrays(flat, BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *[pa.array(x, pa.int64()) for x in (fp, node, size)], lists], ["id", "key", "fp", "node", "size", "bands"]
            )

    text = text_or_empty(text_col)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("_text"))
    return in_batches(rows, run, "id long, key long, fp long, node long, size long, bands array<long>")


def _sets(docs: DataFrame, ids: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``(node, found)``: the shingles, as bytes, of the rows with these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [shingles(x.as_py(), words) for x in batch.column(1).slice(at, 256)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_number(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["node", "found"]
                )

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("_text"))
    wanted = rows.join(ids, "id", "left_semi").select("id", "_text")
    return in_batches(wanted, run, "node long, found binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose sets share at least this part of all their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    both = pairs.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b")
    return in_batches(both.select("a", "b", "left", "right"), run, "a long, b long")


def _apart(meets: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows of cells that hold several groups, with ``root``, ``home``, the cell's largest group, and its ``rows``."""
    rows = meets.join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = rows.groupBy("cell", "root").agg(F.count("*").alias("n"))
    homes = parts.groupBy("cell").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root"))["root"].alias("home"), F.sum("n").alias("rows"))
    homes = apart(homes.where("roots > 1").select("cell", "home", "rows"), "cell")
    return apart(rows, "cell").join(homes, "_cell").withColumn("cell", F.bitwise_not("_cell")).drop("_cell")


#: Cells of more rows than this are not paired row by row: their rows meet by prefixes of their shingles.
CROWD = 32


#: Numbers of 64 bits in a sketch of a set.
SKETCH = 8


def sketch(found: np.ndarray) -> np.ndarray:
    """A bit for each of 512 classes of shingles: whether the set has an odd number of them.

    Two sets differ in at least as many shingles as their sketches in bits.
    """
    odd = np.bincount((found & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _exploded(rows: DataFrame) -> DataFrame:
    """``node, root, few, m, s0, ..., x``: each of the m shingles x of each row, with the row's sketch."""
    names = [f"s{i}" for i in range(SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, found in enumerate(batch.column(3)):
                x = np.frombuffer(found.as_buffer(), np.uint64)
                same = [pa.repeat(c[i], len(x)) for c in batch.columns[:3]]
                same += [pa.array(np.full(len(x), v, np.int64)) for v in (len(x), *sketch(x).tolist())]
                yield pa.RecordBatch.from_arrays([*same, pa.array(x.view(np.int64))], ["node", "root", "few", "m", *names, "x"])

    longs = ", ".join(f"{c} long" for c in ("m", *names, "x"))
    return in_batches(rows.select("node", "root", "few", "found"), run, f"node long, root long, few boolean, {longs}")


def prefix_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` of rows (``node, root, few, found``) of different roots, one at least with ``few``, that can be similar.

    With every set's shingles in one order, rare ones first, two sets of the similarity share one among
    the first of each, as what is left after it would not do: of m shingles the longer set needs
    m - similarity * m, the shorter m - 2 * similarity / (1 + similarity) * m. So sets that have one common
    passage and something of their own around it don't meet by the passage. Of sets that meet, sketches
    tell most of those that differ too much.
    """
    t = similarity
    every = stash(_exploded(rows), "shingles")
    known = every.groupBy("x").agg(F.count(F.lit(1)).alias("c")).where("c > 1")  # others can't be shared: they come first
    shared = apart(every, "x").join(apart(known, "x"), "_x")
    of = Window.partitionBy("node")
    place = F.col("m") - F.count(F.lit(1)).over(of) + F.row_number().over(of.orderBy("c", "_x")) - 1
    first = shared.withColumn("at", place).where(F.col("at") <= F.col("m") - F.ceil(t * F.col("m") - 1e-9))
    columns = ["node", "root", "few", "m", "at", *[f"s{i}" for i in range(SKETCH)]]
    first = stash(first.select("_x", *columns), "prefixes")
    short = first.where(F.col("at") <= F.col("m") - F.ceil(2 * t / (1 + t) * F.col("m") - 1e-9)).toDF("_x", "b", *[f"{c}_b" for c in columns[1:]])
    need = t / (1 + t) * (F.col("m") + F.col("m_b")) - 1e-9
    near = (F.col("m_b") < F.col("m")) | ((F.col("m_b") == F.col("m")) & (F.col("b") < F.col("node")))
    near &= (F.col("m_b") >= t * F.col("m") - 1e-9) & (F.least(F.col("m") - F.col("at"), F.col("m_b") - F.col("at_b")) >= need)
    differ = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(1, SKETCH)), F.bit_count(F.col("s0").bitwiseXOR(F.col("s0_b"))))
    near &= F.col("m") + F.col("m_b") - differ >= 2 * need
    apart_ = (F.col("root") != F.col("root_b")) & (F.col("few") | F.col("few_b"))
    pairs = stash(first.join(short, "_x").where(near & apart_).select(F.col("node").alias("a"), "b").distinct(), "prefix-pairs")
    discard(every, first)
    return pairs


def _candidates(meets: DataFrame, rooted: DataFrame | None, sets: DataFrame, turn: int, similarity: float, made: list[DataFrame]) -> DataFrame:
    """Pairs ``(a, b)`` of one cell to compare in this turn, see :func:`similar_groups`."""
    if rooted is None:
        return meets.groupBy(F.col("node").alias("a")).agg(F.min("low").alias("b"))
    rows = stash(_apart(meets, rooted), "apart")
    made.append(rows)
    if turn == 1:
        rows = rows.join(rooted.toDF("low", "other"), "low", "left").where("root <> coalesce(other, low)")
        return rows.select(F.col("node").alias("a"), F.col("low").alias("b"))
    some = rows.where(F.col("rows") <= CROWD)
    few = some.where("root <> home").select("cell", F.col("node").alias("a"), F.col("root").alias("other"), F.col("size").alias("m"))
    crowd = rows.where(F.col("rows") > CROWD).groupBy("node").agg(F.first("root").alias("root"), F.max(F.col("root") != F.col("home")).alias("few"))
    crowded = prefix_pairs(crowd.join(sets, "node"), similarity)
    made.append(crowded)
    alike = F.least("m", "size") >= similarity * F.greatest("m", "size")
    return few.join(some, "cell").where((F.col("root") != F.col("other")) & alike).select("a", F.col("node").alias("b")).union(crowded)


def _close(marks: DataFrame, radius: int) -> DataFrame:
    """Edges ``(a, b)`` between the nodes whose texts have fingerprints that :func:`links` connects, or the same one."""
    prints = stash(marks.select("fp", "node").distinct(), "prints")
    homes = prints.groupBy("fp").agg(F.min("node").alias("home"))
    same = apart(prints, "fp").join(apart(homes, "fp"), "_fp").select(F.col("node").alias("a"), F.col("home").alias("b"))
    near = links(prints, radius).join(homes.toDF("a", "x"), "a").join(homes.toDF("b", "y"), "b")
    close = stash(same.union(near.select("x", "y")).where("a <> b").distinct(), "close")
    discard(prints)
    return close


def _grouped(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str, radius: int | None = None) -> DataFrame:
    """``(id, key, first)``: each row's id, its text's hash, and the same two of the first row of its group.

    Groups of texts whose sets of word shingles are similar.

    Texts that agree in a band of min-hashes meet in a cell, and a pair is linked only if its shingles,
    compared in full, have the similarity: none below it is. A pair at 0.8 meets with a chance of
    0.99994, and more similar ones nearly always. A family of m copies makes no square of pairs: each
    text is compared with one representative, then with those of its cells, and at last the pairs of a
    cell that are still in different groups; in a cell of more than ``CROWD`` rows those of them that
    :func:`prefix_pairs` can't exclude.

    With a ``radius`` texts whose fingerprints are linked at so many bits are in one group, too, as in
    :func:`near_groups`; chains go through links of both kinds.

    Texts without words are alike. Rows without an id take no part.
    """
    marks = stash(_marks(docs, words, id_col, text_col, radius is not None), "marks")
    nodes = marks.groupBy("node").agg(F.min(F.struct("id", "key")).alias("least"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = stash(nodes, "nodes")
    cells = nodes.select("node", "size", F.explode("bands").alias("cell"))
    shared = cells.groupBy("cell").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    meets = apart(cells, "cell").join(apart(shared.select("cell", "low"), "cell"), "_cell")
    meets = stash(meets.select(F.bitwise_not("_cell").alias("cell"), "node", "size", "low"), "meets")
    met = nodes.join(meets, "node", "left_semi").select(F.col("least.id").alias("id"))
    sets = stash(_sets(docs, met, words, id_col, text_col), "sets")
    sizes = nodes.select("node", "size")
    tried = rooted = None
    edges = None if radius is None else _close(marks, radius)
    made: list[DataFrame] = [meets, sets, *([] if edges is None else [edges])]
    for turn in range(3):
        pairs = _candidates(meets, rooted, sets, turn, similarity, made).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = pairs.join(sizes.toDF("a", "m"), "a").join(sizes.toDF("b", "n"), "b")
        pairs = stash(pairs.where(F.least("m", "n") >= similarity * F.greatest("m", "n")).select("a", "b"), "pairs")
        found = stash(_verified(pairs, sets, similarity), "links")
        tried = pairs if tried is None else tried.union(pairs)
        edges = found if edges is None else edges.union(found)
        rooted = stash(components(edges), "groups")
        made += [pairs, found, rooted]
    classes = nodes.select("node", "least").join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = stash(classes, "classes")
    discard(*made, nodes)
    least = apart(classes.groupBy("root").agg(F.min("least").alias("first")), "root")
    known = apart(classes, "root").join(least, "_root").select("node", "first")
    return marks.select("id", "key", "node").join(known, "node").select("id", "key", "first")


def similar_groups(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, component_id)``: groups of texts whose sets of word shingles are similar, by their smallest id.

    Pairs are found by bands of min-hashes and compared in full. Texts without words are alike. Rows
    without an id take no part; repeated rows each come out; an empty table gives no rows.
    """
    groups = _grouped(docs, words, similarity, id_col, text_col)
    return groups.select(F.col("id").alias(id_col), F.col("first.id").alias("component_id"))


def drop_near_copies(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", radius: int = 2
) -> DataFrame:
    """``docs`` with only the first row of each group of near copies, by smallest id, all columns kept.

    Near copies are texts whose fingerprints are linked through the tables of distances at ``radius`` or
    fewer bits, as in :func:`near_groups`, and texts too far apart for them whose shingles have the
    ``similarity``; groups are the components of all these links.

    Rows are told apart by id and text: of an id with several texts only those go that are like an
    earlier one. Rows alike in both stay or go together. A row without id stays.
    """
    groups = _grouped(docs, words, similarity, id_col, text_col, radius)
    lost = groups.where(F.struct("id", "key") != F.col("first")).select("id", "key").distinct()
    same = (docs[id_col] == lost["id"]) & (F.xxhash64(text_or_empty(text_col)) == lost["key"])
    return docs.join(lost, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
