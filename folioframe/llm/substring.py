"""Removal of repeated passages over a compacted de Bruijn graph of token windows.

Every window of ``words`` tokens is an edge of the graph. Inside a text, consecutive windows that share
the k-mer with the smallest hash (their anchor) form a path, a row of its own: about one row for eight
windows. Joins compact the graph further:

1. Paths meet by anchor. An anchor that occurs once has no repeated window and goes.
2. The paths that repeat are the nodes of a graph of their own, with an arc for each pair of neighbours
   in a text. A node's out-degree is one if all its occurrences are followed by the same node, its
   in-degree likewise. Where a nonbranching end meets a nonbranching start, a join compacts the two, and
   so on along the text of the first occurrence: whole repeated passages become one path.
3. At anchors that different paths run through, the first occurrence of each path is opened into single
   windows, which meet by their hashes.

Each repeated span knows the coordinates (document, place) of its first occurrence. At both coordinates
the words are read from the source texts and compared by a 128-bit digest. If one pair differs, two
different spans had equal hashes, and all is done again with other hash functions.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, discard, fresh_path, in_batches, shuffle_partitions, stash, text_or_empty

WORDS = 20
#: Tokens of a k-mer that can be an anchor.
ANCHOR = 6
#: Other hash functions are tried so many times if spans with equal hashes differ.
ATTEMPTS = 5
_CHUNK = 1 << 19  # bytes of text hashed at once
_TAG = 40  # places have a mark of their text above so many bits: rows may share an id
_BLANKS = b" \t-\r"
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = {"byte": 0x9E3779B97F4A7C15, "word": 0xC2B2AE3D27D4EB4F, "other": 0xD1B54A32D192ED03}
_tables: dict[object, np.ndarray] = {}


def _mix_table(seed: int) -> np.ndarray:
    """An odd number for each byte."""
    if seed not in _tables:
        rng = np.random.Generator(np.random.PCG64(7 + seed))
        _tables[seed] = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    return _tables[seed]


def _powers(kind: str, n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0 to n of an odd base modulo 2**64, kept between calls."""
    name = kind + "-" * inverse
    have = _tables.get(name)
    if have is None or len(have) <= n:
        base = pow(_BASE[kind], -1, 1 << 64) if inverse else _BASE[kind]
        fill = np.full(max(n, 1 << 12) + 1, base, np.uint64)
        fill[0] = 1
        have = _tables[name] = np.cumprod(fill, dtype=np.uint64)
    return have


def _mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Tokens:
    """Word hashes of some texts side by side, and hashes of any stretch of words.

    ``seed`` names the hash function; ``bits`` narrows its values (for tests).
    """

    def __init__(self, texts: list[bytes], seed: int = 0, bits: int = 64) -> None:
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        blank = _BLANK[data]
        edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=np.int8(1)))
        start, end = edge[::2], edge[1::2]
        size = end - start
        inside = np.flatnonzero(~blank)
        within = inside - np.repeat(start, size)
        terms = _mix_table(seed)[data[inside]] * _powers("byte", int(size.max(initial=0)))[within]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        at = np.concatenate([[0], np.cumsum(size)])
        self._hashes = _mixed(sums[at[1:]] - sums[at[:-1]])
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        #: First word of each text, and one past the last word of all.
        self.first = np.searchsorted(start, offsets)
        self.n = len(start)
        self._sums: dict[str, np.ndarray] = {}
        self._mask = np.uint64((1 << bits) - 1)

    def stretch(self, start: np.ndarray, words: np.ndarray | int, kind: str = "word") -> np.ndarray:
        """Hashes of stretches; those of kind ``other`` are independent of the rest."""
        if kind not in self._sums:
            hashes = self._hashes if kind == "word" else _mixed(self._hashes ^ np.uint64(_BASE[kind]))
            terms = hashes * _powers(kind, self.n)[: self.n]
            self._sums[kind] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        sums = self._sums[kind]
        h = (sums[start + words] - sums[start]) * _powers(kind, self.n, True)[start]
        return _mixed(h + np.asarray(words).astype(np.uint64)) & self._mask

    def paths(self, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Compacted paths: anchor hash, text number, first window, number of windows."""
        windows = self.n - words + 1
        if windows <= 0:
            return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
        anchor = min(ANCHOR, words)
        low = self.stretch(np.arange(self.n - anchor + 1), anchor)
        place = np.arange(len(low))
        span, have = words - anchor + 1, 1
        while have < span:  # smallest over `span` neighbours by doubling, the leftmost of equal ones
            step = min(have, span - have)
            right = low[step:] < low[:-step]
            low, place = np.where(right, low[step:], low[:-step]), np.where(right, place[step:], place[:-step])
            have += step
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        of = text[:windows]
        whole = of == text[words - 1 :]
        new = np.ones(windows, bool)
        new[1:] = (place[1:] != place[:-1]) | ~whole[:-1]
        start = np.flatnonzero(new & whole)
        upto = np.concatenate([[0], np.cumsum(whole)])
        count = upto[np.append(start[1:], windows)] - upto[start]
        return low[start], of[start], start - self.first[of[start]], count


def _segments(text: bytes, words: int) -> Iterator[tuple[bytes, int]]:
    """Pieces of about ``_CHUNK`` bytes of a text, each with the number of its first word.

    A piece goes on for ``words`` - 1 words into the next, so that every window is in just one.
    """
    more = re.compile(rb"(?:[%b]*[^%b]+){0,%d}" % (_BLANKS, _BLANKS, words - 1))
    blank = re.compile(rb"[%b]" % _BLANKS)
    at = word = 0
    while len(text) - at > 2 * _CHUNK and (found := blank.search(text, at + _CHUNK)):
        cut = found.start()
        yield text[at : more.match(text, cut).end()], word
        word += len(text[at:cut].split())
        at = cut
    yield text[at:], word


def _parts(texts: list[bytes], words: int) -> Iterator[tuple[slice, list[tuple[bytes, int]]]]:
    """Slices of texts of about ``_CHUNK`` bytes with their pieces; a long text is alone, in pieces of its own."""
    at = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > _CHUNK:
            yield slice(at, i), [(x, 0) for x in texts[at:i]]
            at, total = i, 0
        if len(t) > 2 * _CHUNK:
            yield slice(i, i + 1), [*_segments(t, words)]
            at = i + 1
        else:
            total += len(t)
    if at < len(texts):
        yield slice(at, len(texts)), [(x, 0) for x in texts[at:]]


def _copies(*keys: np.ndarray) -> np.ndarray:
    """How often each row's key occurs at its first place, 0 at later ones."""
    h = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        h = _mixed(h * np.uint64(3) + k.astype(np.uint64))
    _, first, count = np.unique(h, return_index=True, return_counts=True)
    out = np.zeros(len(h), np.int64)
    out[first] = count
    return out


def _mark(text: bytes) -> int:
    """Tells rows that share an id apart, above the bits of a place."""
    return (zlib.crc32(text) & 0xFFFF) << _TAG


_PATH = "a long, s long, doc long, start long, meta long"  # meta: windows * 4 + min(copies, 3)


def _rows(names: str, *cols: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in cols]
    return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in names.split(", ")])


def _paths(docs: DataFrame, words: int, seed: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            texts = [x.as_py() for x in batch.column(1)]
            marks = np.array([_mark(t) for t in texts], np.int64)
            for part, pieces in _parts(texts, words):
                found = []
                groups = [pieces] if part.stop - part.start == len(pieces) else [[x] for x in pieces]
                for group in groups:
                    tokens = Tokens([x for x, _ in group], seed, bits)
                    anchor, of, start, count = tokens.paths(words)
                    path = tokens.stretch(tokens.first[of] + start, count + words - 1)
                    found.append((anchor, path, of, start + np.array([w for _, w in group], np.int64)[of], count))
                anchor, path, of, start, count = (np.concatenate(x) for x in zip(*found))
                meta = count * 4 + np.minimum(_copies(anchor, path, of), 3)
                yield _rows(_PATH, anchor, path, ids[part][of], start + marks[part][of], meta)

    return in_batches(docs.select("_doc", F.col("_text").cast("binary")), run, _PATH)


_WINDOW = "w long, v long, doc long, start long, copies long"


def _opened(texts: DataFrame, words: int, seed: int, bits: int) -> DataFrame:
    """Single windows of the ranges listed with each text; later copies in a text have copies 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids = batch.column(0).to_numpy()
            texts = [unzip(z.as_py()) for z in batch.column(1)]
            marks = np.array([_mark(t) for t in texts], np.int64)
            starts = [_spread(_wanted(ranges, text)) for ranges, text in zip(batch.column(2), texts)]
            for part, pieces in _parts(texts, words):
                if part.stop - part.start == len(pieces):
                    tokens = Tokens([x for x, _ in pieces], seed, bits)
                    of = np.repeat(np.arange(len(pieces)), [len(x) for x in starts[part]])
                    start = np.concatenate(starts[part])
                    at = start + tokens.first[of]
                    w, v = tokens.stretch(at, words), tokens.stretch(at, words, "other")
                else:  # one long text
                    found = []
                    for piece, first in pieces:
                        tokens = Tokens([piece], seed, bits)
                        start = starts[part.start]
                        start = start[(start >= first) & (start + words <= first + tokens.n)]
                        found.append((tokens.stretch(start - first, words), tokens.stretch(start - first, words, "other"), start))
                    w, v, start = (np.concatenate(x) for x in zip(*found))
                    of = np.zeros(len(start), np.int64)
                yield _rows(_WINDOW, w, v, ids[part][of], start + marks[part][of], _copies(w, v, of))

    return in_batches(texts, run, _WINDOW)


def _spread(ranges: np.ndarray) -> np.ndarray:
    """Every place of (place, windows) ranges, in order."""
    at, n = ranges.T
    ends = np.cumsum(n)
    return np.unique(np.repeat(at - ends + n, n) + np.arange(ends[-1] if len(ends) else 0))


def _wanted(ranges: pa.Scalar, text: bytes) -> np.ndarray:
    """(place, windows) of the ranges that are of this text, not of another row with its id."""
    pairs = ranges.values.flatten()
    at, n = pairs[0].to_numpy(), pairs[1].to_numpy()
    mine = at - _mark(text)
    ok = (mine >= 0) & (mine < 1 << _TAG)
    return np.stack([mine[ok], n[ok].astype(np.int64)], axis=1)


_DIGEST = "doc long, start long, n long, x long, y long"


def _digests(texts: DataFrame, words: int) -> DataFrame:
    """128 bits of the words at each listed range of n windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids, out = batch.column(0).to_numpy(), []
            for i, (z, ranges) in enumerate(zip(batch.column(1), batch.column(2))):
                text = unzip(z.as_py())
                (begins, ends), mark = _edges(text), _mark(text)
                for at, n in _wanted(ranges, text).tolist():
                    if at + n + words - 1 <= len(begins):
                        span = b" ".join(text[begins[at] : ends[at + n + words - 2]].split())
                        out.append((ids[i], at + mark, n, *np.frombuffer(hashlib.blake2b(span, digest_size=16).digest(), "<i8")))
            yield _rows(_DIGEST, *np.array(out, np.int64).reshape(-1, 5).T)

    return in_batches(texts, run, _DIGEST)


def _key(id_col: str) -> Column:
    """The id; a null one sorts first."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))


def _zipped(docs: DataFrame) -> DataFrame:
    """Texts compressed, with what they carry, in a table bucketed by document: the joins that bring something to the
    texts leave them where they are."""
    schema = T.StructType([T.StructField("_doc", T.LongType()), T.StructField("_z", T.BinaryType()), docs.schema["_rest"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            z = pa.array([zip_(x.as_py()) for x in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), z, batch.column(2)], ["_doc", "_z", "_rest"])

    spark = docs.sparkSession
    zipped = in_batches(docs.select("_doc", F.col("_text").cast("binary"), "_rest"), run, schema)
    buckets, name = shuffle_partitions(spark), f"folioframe_texts_{uuid.uuid4().hex}"
    path = fresh_path(spark, "texts")
    zipped.repartition(buckets, "_doc").write.format("parquet").bucketBy(buckets, "_doc").option("path", path).saveAsTable(name)
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and what was read of the table is known
    return texts


def _chains(occurrences: DataFrame, made: list[DataFrame]) -> DataFrame:
    """Compacted paths: ``u, d0, p0, n`` of the first node of each, with the windows of all.

    ``occurrences`` of nodes: ``u, doc, start, n, copies, d0``. Nodes whose occurrences all have the same
    neighbour are nonbranching on that side; a join pairs such sides, and what hangs together along the
    first occurrence is one path. ``made`` gets what is written on the way.
    """
    order = Window.partitionBy("doc").orderBy("start")
    after = F.when(F.lead("start").over(order) == F.col("start") + F.col("n"), F.lead("u").over(order))
    before = F.when(F.lag("start").over(order) + F.lag("n").over(order) == F.col("start"), F.lag("u").over(order))
    beside = occurrences.select("u", "doc", "start", "n", "copies", after.alias("after"), before.alias("before"))
    first = F.col("copies") > 0
    one = lambda c: F.when((F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)), F.min(c))
    nodes = beside.groupBy("u").agg(
        F.min("doc").alias("d0"),
        F.min_by(F.when(first, F.col("start")), F.when(first, F.col("doc"))).alias("p0"),
        F.min("n").alias("n"), one("after").alias("after"), one("before").alias("before"),
    )
    nodes = stash(nodes, "nodes")
    made.append(nodes)
    heads = nodes.where("after IS NOT NULL").select(F.col("u").alias("from"), F.col("after").alias("u"), F.col("d0").alias("d"), (F.col("p0") + F.col("n")).alias("p"))
    joined = nodes.where("before IS NOT NULL").join(heads, "u").where("before = from AND d0 = d AND p0 = p").select("u", F.lit(True).alias("inner"))
    nodes = nodes.join(joined, "u", "left").select("u", "d0", "p0", "n", F.col("inner").isNull().alias("head"))
    along = Window.partitionBy("d0").orderBy("p0", F.desc("head")).rowsBetween(Window.unboundedPreceding, 0)
    runs = nodes.withColumn("run", F.sum(F.col("head").cast("int")).over(along))
    return runs.groupBy("d0", "run").agg(F.min_by("u", F.when(F.col("head"), F.lit(0)).otherwise(1)).alias("u"), F.min("p0").alias("p0"), F.sum("n").alias("n")).drop("run")


def _spans(docs: DataFrame, texts: DataFrame, words: int, seed: int, bits: int) -> DataFrame:
    """``doc, start, n, d0, p0``: n windows of a document that also start at the earlier place p0 of d0, by their hashes."""
    paths = _paths(docs, words, seed, bits)
    copies = F.col("meta").bitwiseAND(F.lit(3))
    anchors = stash(
        paths.groupBy("a")
        .agg(F.sum(copies).alias("_n"), F.min("s").alias("s0"), F.max("s").alias("s1"))
        .where("_n > 1")
        .select("a", (F.col("s0") != F.col("s1")).alias("branching")),
        "anchors",
    )
    repeated = stash(
        paths.join(anchors, "a").select("a", "s", "doc", "start", F.shiftright("meta", 2).cast("int").alias("n"), copies.cast("int").alias("copies"), "branching"),
        "paths",
    )
    units = repeated.groupBy("a", "s").agg(F.sum("copies").alias("_n"), F.min("doc").alias("d0")).where("_n > 1").drop("_n")
    told = apart(repeated, "a").join(apart(units, "a"), ["_a", "s"], "left")
    told = stash(told.select(F.xxhash64("_a", "s").alias("u"), "doc", "start", "n", "copies", "branching", "d0"), "told")
    discard(anchors, repeated)
    made = [told]
    nodes = told.where("d0 IS NOT NULL")
    later = nodes.where("copies = 0 OR doc > d0").select("u", "doc", "start")
    spans = later.join(_chains(nodes, made), "u").select("doc", "start", "n", "d0", "p0")

    ranges = told.where("branching AND copies > 0 AND (d0 IS NULL OR doc = d0)").groupBy("doc").agg(F.collect_set(F.struct("start", "n")).alias("ranges"))
    opened = stash(_opened(_beside(texts, ranges), words, seed, bits), "windows")
    first = F.col("copies") > 0
    firsts = (
        opened.groupBy("w", "v")
        .agg(F.sum("copies").alias("_n"), F.min("doc").alias("d0"), F.min_by(F.when(first, F.col("start")), F.when(first, F.col("doc"))).alias("p0"))
        .where("_n > 1")
        .drop("_n")
    )
    windows = apart(opened, "w").join(apart(firsts, "w"), ["_w", "v"]).where("copies = 0 OR doc > d0")
    merged = stash(_merged(spans.unionByName(windows.select("doc", "start", F.lit(1).cast("long").alias("n"), "d0", "p0"))), "spans")
    discard(*made, opened)
    return merged


def _merged(spans: DataFrame) -> DataFrame:
    """``spans`` with those put together that go on where another ends, in both places."""
    order = Window.partitionBy("doc").orderBy("start")
    last = lambda c: F.lag(c).over(order)
    spans = spans.withColumns({"_s": last("start"), "_n": last("n"), "_d": last("d0"), "_p": last("p0")}).where("_s IS NULL OR _s <> start")
    goes_on = (F.col("start") == F.col("_s") + F.col("_n")) & (F.col("d0") == F.col("_d")) & (F.col("p0") == F.col("_p") + F.col("_n"))
    fresh = F.when(goes_on, 0).otherwise(1)
    runs = spans.withColumn("run", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc", "run").agg(F.min("start").alias("start"), F.sum("n").alias("n"), F.min("d0").alias("d0"), F.min("p0").alias("p0")).drop("run")


def _beside(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """The texts that have ``ranges`` (doc, ranges), with them."""
    return texts.join(ranges, texts["_doc"] == ranges["doc"]).select("_doc", "_z", "ranges")


def _differ(spans: DataFrame, texts: DataFrame, words: int) -> bool:
    """Whether the words of a span, read at its coordinates, are not those at the coordinates of the first occurrence."""
    asked = spans.select("doc", "start", "n").union(spans.select("d0", "p0", "n")).distinct()
    ranges = asked.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    made = stash(_digests(_beside(texts, ranges), words), "digests")
    digests = made.distinct()
    both = spans.join(digests, ["doc", "start", "n"], "left").join(digests.toDF("d0", "p0", "n", "x0", "y0"), ["d0", "p0", "n"], "left")
    differ = not both.where("NOT (x <=> x0 AND y <=> y0) OR x IS NULL").isEmpty()
    discard(made)
    return differ


def kept_words(
    docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None, bits: int = 64
) -> DataFrame:
    """``(_doc, n_words, n_removed, kept, text, _rest)``: a row for each row of ``docs``.

    A word goes if a window of ``words`` consecutive words covers it whose word sequence also starts
    earlier: in a smaller id, or earlier in the same text; windows are judged on the input. ``kept``
    has the words that stay, joined by one space; it is null where none goes and ``carry`` is given,
    and ``text`` has the original then. ``_rest`` is ``carry`` of the row. Ids are integers; a null
    id comes before all others; null text has no words. Repeated rows with the same id are each
    others' equals: neither is earlier, and both get the same result; rows with the same id and
    different texts are told apart by their words. An empty table gives no rows. Very long texts are
    hashed in pieces. ``bits`` narrows the first attempt's hashes, as a test of what follows.
    """
    docs = docs.select(
        _key(id_col).alias("_doc"),
        text_or_empty(text_col).alias("_text"),
        (F.lit(True) if carry is None else carry).alias("_rest"),
    )
    texts = _zipped(docs)
    for seed in range(ATTEMPTS):
        spans = _spans(docs, texts, words, seed, 64 if seed else bits)
        if not _differ(spans, texts, words):
            break
    else:
        raise ValueError(f"spans of equal hashes differ under each of {ATTEMPTS} hash functions")
    gone = spans.groupBy("doc").agg(F.collect_set(F.struct("start", "n")).alias("gone"))
    return _cut(texts.join(gone, texts["_doc"] == gone["doc"], "left").select("_doc", "_z", "gone", "_rest"), words, carry is not None)


def _edges(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and one past its last."""
    edge = np.flatnonzero(np.diff(_BLANK[np.frombuffer(text + b" ", np.uint8)].view(np.int8), prepend=np.int8(1)))
    return edge[::2], edge[1::2]


def _stay(text: bytes, spans: np.ndarray | None, words: int, originals: bool) -> tuple[int, int, bytes | None]:
    """Words, words in ``spans``, and the others joined by one space; None for those if none is in a span and ``originals``."""
    begins, ends = _edges(text)
    n = len(begins)
    if spans is None or not len(spans):
        return n, 0, None if originals else b" ".join(text.split())  # of bytes: the six ASCII blanks
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, spans[:, 0], 1)
    np.add.at(depth, np.minimum(spans.sum(axis=1) + words - 1, n), -1)  # k windows cover k + words - 1 words
    stay = np.cumsum(depth)[:-1] == 0
    turn = np.flatnonzero(np.diff(stay.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    parts = [b" ".join(text[begins[i] : ends[j - 1]].split()) for i, j in zip(turn[::2].tolist(), turn[1::2].tolist())]
    return n, n - int(stay.sum()), b" ".join(parts)


def _cut(texts: DataFrame, words: int, originals: bool) -> DataFrame:
    schema = T.StructType(
        [T.StructField("_doc", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("text", T.StringType()), texts.schema["_rest"]]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            total, removed, kept, texts = [], [], [], []
            for z, gone in zip(batch.column(1), batch.column(2)):
                text = unzip(z.as_py())
                n, lost, stay = _stay(text, _wanted(gone, text) if gone.is_valid else None, words, originals)
                total.append(n)
                removed.append(lost)
                texts.append(text if stay is None else None)
                kept.append(stay)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), _strings(kept), _strings(texts), batch.column(3)],
                ["_doc", "n_words", "n_removed", "kept", "text", "_rest"],
            )

    return in_batches(texts, run, schema)


def _strings(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def drop_repeats(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages taken out of the text column, all rows and columns kept.

    A text from which nothing is removed stays as it was (null becomes empty); another becomes its
    kept words joined by one space.
    """
    others = [c for c in docs.columns if c != text_col]
    done = kept_words(docs, words, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in others]))
    text = F.coalesce("kept", "text").alias(text_col)
    return done.select(*[text if c == text_col else F.col("_rest")[c].alias(c) for c in docs.columns])
