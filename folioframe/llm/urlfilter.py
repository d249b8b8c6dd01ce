"""URL rules, looked up in a cascade of Bloom filters.

The first filter holds the listed keys; the second those keys of the corpus that pass the first
without being listed; the third the listed keys that pass the second, and so on until a level has no
false positive among the keys of the whole corpus. For every key of the corpus membership is then
exact, by a few bit tests and no join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, in_batches, larger, stash, text_or_empty

#: A filter goes to every executor. Lists that would need more bits than this (256 MB) are joined by key instead.
MAX_BITS = 1 << 31
#: Tries to find hashes that no listed key shares with another.
MOST_SEEDS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    action: str  # allow or block

    @property
    def key(self) -> str:
        return self.host + self.path


def host_and_path(url_col: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    url = text_or_empty(url_col)
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def candidate_keys(host: Column, path: Column, lengths: Sequence[int], labels: int) -> Column:
    """Every host suffix of up to ``labels`` labels with every path prefix of one of ``lengths``; longest first.

    Ties go to the longer host.
    """
    hosts = F.array_distinct(F.array(*[F.substring_index(host, ".", -i) for i in range(1, labels + 1)]))
    prefixes = F.filter(
        F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n) if n else F.lit("")) for n in sorted(lengths, reverse=True)]),
        lambda p: p.isNotNull(),
    )
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.struct((-F.char_length(h) - F.char_length(p)).alias("n"), (-F.char_length(h)).alias("h"), F.concat(h, p).alias("key")))))
    return F.transform(F.array_sort(pairs), lambda x: x["key"])


def _hashes(key: Column, seed: int, bits: int = 64) -> tuple[Column, Column]:
    """Two hashes of a key, neither a function of the other: the number in front is the seed of what comes after it.

    The second is odd: it is the step from one bit of a filter to the next.
    """
    cut = lambda h: h if bits == 64 else h.bitwiseAND((1 << bits) - 1)
    return cut(F.xxhash64(F.lit(2 * seed), key)), cut(F.xxhash64(F.lit(2 * seed + 1), key)).bitwiseOR(F.lit(1).cast("long"))


@dataclass(frozen=True)
class Level:
    bits: np.ndarray  # uint64 words
    size: int
    probes: int
    salt: int

    def positions(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
        a = _mixed(_mixed(h1 ^ np.uint64(self.salt)) ^ h2)  # of both: one probe has to tell any two keys apart
        for i in range(self.probes):
            yield (a + np.uint64(i) * h2) % np.uint64(self.size)

    def test(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        hit = np.ones(len(h1), bool)
        for at in self.positions(h1, h2):
            hit &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return hit


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...] = field(default=())
    seed: int = 0  # of the keys' hashes
    hash_bits: int = 64

    def hashes(self, key: Column) -> tuple[Column, Column]:
        return _hashes(key, self.seed, self.hash_bits)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Membership of keys given by their two hashes; exact for the keys it was built over."""
        member = np.zeros(len(h1), bool)
        alive = np.ones(len(h1), bool)
        for i, level in enumerate(self.levels):
            alive[alive] = level.test(h1[alive], h2[alive])
            if i % 2 == 0:
                member |= alive  # passes a level of listed keys: listed, unless a later level says not
            else:
                member &= ~alive
        return member


def _mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _u64(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _size(n: int, false_positives: float) -> tuple[float, int]:
    """Bits for each key, and of a filter of n keys."""
    per_key = max(1.0, -np.log2(false_positives)) / np.log(2)
    return per_key, max(64, int(-(-n * per_key // 64)) * 64)


def _level(keys: DataFrame, n: int, false_positives: float, salt: int) -> Level:
    """A Bloom filter of the hashed ``keys`` (h1, h2). Words of bits are merged in Spark."""
    per_key, size = _size(n, false_positives)
    empty = Level(np.zeros(0, np.uint64), size, max(1, round(per_key * np.log(2))), salt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in larger(batches):
            at = np.concatenate([*empty.positions(_u64(batch.column(0)), _u64(batch.column(1))), np.empty(0, np.uint64)])
            word = (at >> np.uint64(6)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(word), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bits"]
            )

    words = in_batches(keys.select("h1", "h2"), run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bits = np.zeros(size // 64, np.uint64)
    for batch in words.toArrow().to_batches():  # at most size / 64 rows
        bits[batch.column(0).to_numpy()] = _u64(batch.column(1))
    return Level(bits, size, empty.probes, salt)


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in larger(batches):
            yield batch.filter(pa.array(shared.value.test(_u64(batch.column(0)), _u64(batch.column(1)))))

    return stash(in_batches(keys.select("h1", "h2", "key"), run, "h1 long, h2 long, key string"), "bloom-pass")


def build_cascade(
    listed: DataFrame, universe: DataFrame, key_col: str = "key", max_bits: int | None = None, hash_bits: int = 64
) -> Cascade | None:
    """Cascade for the keys of ``listed``, exact over all keys of ``universe`` and ``listed``; None if a filter
    would have more than ``max_bits`` bits (``MAX_BITS``).

    Null keys are ignored, repeated ones count once. No listed keys give a cascade that has nothing.
    Filters see two hashes of a key, of ``hash_bits`` bits each. A key of the universe that shares both
    with a listed one would pass as listed: keys that pass the first filter are compared with the list
    as they are, and if there is such a key, all are hashed anew with other seeds.
    """
    most = MAX_BITS if max_bits is None else max_bits
    for seed in range(MOST_SEEDS):
        h1, h2 = _hashes(F.col(key_col), seed, hash_bits)
        hashed = lambda df: df.where(F.col(key_col).isNotNull()).select(h1.alias("h1"), h2.alias("h2"), F.col(key_col).alias("key")).distinct()  # noqa: B023, E731
        inside = stash(hashed(listed), "listed-keys")
        n_in = inside.count()
        if not n_in:
            return Cascade()
        every = stash(hashed(universe), "universe-keys")
        # Shuffled hash tables are not needed: a first filter leaves few keys to compare with the list.
        rate = min(0.5, n_in / max(1, every.count()))
        if _size(n_in, rate)[1] > most:
            return None
        levels = [_level(inside, n_in, rate, 0)]
        passing = _passing(every, levels[0])
        outside = stash(passing.join(inside.select("key"), "key", "left_anti").select("h1", "h2", "key"), "bloom-false")
        discard(every, passing)
        if outside.join(inside.select("h1", "h2"), ["h1", "h2"], "left_semi").isEmpty():
            break
        discard(inside, outside)
    else:
        raise ValueError(f"keys share hashes of {hash_bits} bits under {MOST_SEEDS} seeds")
    made = [inside, outside]
    while n := outside.count():
        if _size(n, 0.5)[1] > most:
            discard(*made)
            return None
        levels.append(_level(outside, n, 0.5, len(levels)))
        inside, outside = outside, _passing(inside, levels[-1])
        made.append(outside)
    discard(*made)
    return Cascade(tuple(levels), seed, hash_bits)


def judge(
    pages: DataFrame, rules: DataFrame, path_lengths: Sequence[int], url_col: str = "url", default: str = "allow",
    max_bits: int | None = None,
) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``.

    ``rules`` has columns ``key`` (host and path) and ``action`` (allow or block); ``path_lengths``
    are the lengths of the rules' paths. A rule fits its host and all subdomains, if the URL's path
    starts with the rule's; the longest that fits decides. Where none fits, none of the URL's keys is
    listed, so no cascade blocks it: ``default``. A null URL, or one without ``://``, has an empty
    host and path. Columns of these names in ``pages`` are replaced; repeated rows each come out. A list
    too long for filters is joined by key. Hosts of any length have as many keys as the rules' labels need.
    """
    host, path = host_and_path(url_col)
    labels = rules.agg(F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\.")))).first()[0] or 1
    keys = candidate_keys(F.col("host"), F.col("path"), path_lengths, labels)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_all"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_keys", keys)
    universe = rows.select(F.explode("_keys").alias("key"))
    listed = build_cascade(rules.select("key"), universe, max_bits=max_bits)
    blocked = build_cascade(rules.where("action = 'block'").select("key"), rules.select("key"), max_bits=max_bits)
    if listed is None or blocked is None:
        return _joined(rows, rules, default)
    shared = pages.sparkSession.sparkContext.broadcast((listed, blocked))
    schema = T.StructType([rows.schema["_all"], *[T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has, blocks = shared.value
        for batch in batches:
            keys, (h1, h2, b1, b2) = batch.column(3), [_u64(c.flatten()) for c in batch.columns[4:]]
            sizes = np.asarray(keys.value_lengths())
            ends = np.cumsum(sizes)
            hits = np.flatnonzero(has.has(h1, h2))
            first = np.searchsorted(hits, ends - sizes)  # the first hit is the longest key
            at = np.append(hits, len(h1))[first]
            found = at < ends
            rule = keys.flatten().take(pa.array(np.where(found, at, 0), mask=~found))
            stop = np.zeros(len(at), bool)
            stop[found] = blocks.has(b1[at[found]], b2[at[found]])
            verdict = np.where(found, np.where(stop, "block", "allow"), default)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], rule, pa.array(verdict.tolist(), pa.string())], ["_all", "host", "path", "rule", "verdict"]
            )

    each = lambda c, i: F.transform("_keys", lambda k: c.hashes(k)[i])
    hashed = [each(c, i) for c in (listed, blocked) for i in (0, 1)]
    out = in_batches(rows.select("_all", "host", "path", "_keys", *[h.alias(f"_h{i}") for i, h in enumerate(hashed)]), run, schema)
    return out.select("_all.*", "host", "path", "rule", "verdict")


def _joined(rows: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by a join on the keys, for lists of any length."""
    rows = stash(rows.withColumn("_n", F.monotonically_increasing_id()), "url-keys")
    keys = rows.select("_n", F.posexplode("_keys").alias("_at", "key"))
    hits = keys.join(rules.where("key IS NOT NULL").select("key", "action").distinct(), "key")
    first = hits.groupBy("_n").agg(F.min(F.struct("_at", "key", "action")).alias("_hit"))
    out = rows.join(first, "_n", "left")
    return out.select("_all.*", "host", "path", F.col("_hit.key").alias("rule"), F.coalesce("_hit.action", F.lit(default)).alias("verdict"))
