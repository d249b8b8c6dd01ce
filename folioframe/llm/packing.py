"""Best-fit packing of documents' token ids into sequences of several permitted lengths.

Documents become token ids and are packed where they are read: a task takes up a shard of some million
tokens, packs it by best fit decreasing, and goes on. Nothing is shuffled. Where no open bin fits, the
next one opens at the length that costs least for each token that it can still be given, by a look at
what is left to pack; at the end every bin shrinks to the shortest permitted length that holds its
contents. The same is done with every bin opened at one and the same length, and the cheapest outcome
of all, for the shard as a whole, stays.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPACE
from .common import in_batches, text_or_empty

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Tokens of a shard, about; a longer document is in a shard of its own.
SHARD_TOKENS = 1 << 22
#: Characters that are encoded at once, or as many as it takes to come to a blank that can be cut at.
_ENCODE = 1 << 16
#: Fixed value: how the tokenizer splits a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Between two words: a cut before such a blank changes no token.
_CUT = re.compile(r"(?<=\S) (?=\w)")
#: A run of blanks that is taken for one word, but for its last one, as any pattern of this kind does.
_BLANKS = re.compile("[" + SPACE + "]{4096,}")


@dataclass(frozen=True)
class Tokenizer:
    """Byte-level BPE from a file of ranks (a token in base64 and its rank in each line), readable on every executor."""

    file: str
    pattern: str = PATTERN

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, cut for encoding where no token crosses; a run without such a place is encoded whole."""
        ids, at = [], 0
        for run in _BLANKS.finditer(text):  # the library can't split so many by the pattern
            end = run.end() - (run.end() < len(text))  # the last blank goes with the word after it
            ids += self._ids(text[at : run.start()])
            ids.append(_encoding(self.file, self.pattern)._encode_single_piece(text[run.start() : end]))
            at = end
        return np.concatenate([*ids, *self._ids(text[at:])]).astype(np.int32)

    def _ids(self, text: str) -> Iterator[np.ndarray]:
        at, encoding = 0, _encoding(self.file, self.pattern)
        while len(text) - at > _ENCODE and (found := _CUT.search(text, at + _ENCODE)):
            yield encoding.encode_to_numpy(text[at : found.start()], disallowed_special=())
            at = found.start()
        yield encoding.encode_to_numpy(text[at:], disallowed_special=())

    def decode(self, ids: Sequence[int]) -> str:
        return _encoding(self.file, self.pattern).decode(list(ids))


@lru_cache(4)
def _encoding(file: str, pattern: str):  # noqa: ANN202
    import tiktoken

    with open(file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def sequence_cost(length: int) -> float:
    """Cost of a sequence: linear work, a quadratic share for attention, and a fixed overhead."""
    return length * (1 + length / 65536) + 64


@dataclass
class Packing:
    bin_of: list[int]  # of each item
    offset: list[int]
    lengths: list[int]  # of each bin

    def cost(self, cost: Callable[[int], float]) -> float:
        return sum(map(cost, self.lengths))


class _Left:
    """How many items of each size are still to be packed."""

    def __init__(self, sizes: list[int]) -> None:
        self.count = Counter(sizes)
        self.mask = 0  # bit s is set if an item of size s is left
        for s in self.count:
            self.mask |= 1 << s

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.mask &= ~(1 << size)

    def fill(self, space: int) -> int:
        """Tokens of the items that go into ``space``, the largest that fits first."""
        used, mask = 0, self.mask
        while fits := mask & ((1 << (space - used + 1)) - 1):
            s = fits.bit_length() - 1
            used += s * min(self.count[s], (space - used) // s)
            mask = fits & ~(1 << s)
        return used


def _best_fit(sizes: list[int], lengths: list[int], opened: Callable[[int, _Left], int]) -> Packing:
    left = _Left(sizes)
    free: dict[int, list[int]] = {}  # free space -> bins with just that much
    mask = 0  # bit s is set if a bin has s free
    used: list[int] = []
    bin_of, offset = [], []
    for size in sizes:
        left.take(size)
        fits = mask >> size
        if fits:  # the tightest bin
            space = size + (fits & -fits).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                mask &= ~(1 << space)
        else:
            space = opened(size, left)
            b = len(used)
            used.append(0)
        bin_of.append(b)
        offset.append(used[b])
        used[b] += size
        if space > size:
            free.setdefault(space - size, []).append(b)
            mask |= 1 << (space - size)
    return Packing(bin_of, offset, [next(c for c in lengths if c >= u) for u in used])


def best_fit(sizes: Iterable[int], lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = sequence_cost) -> Packing:
    """The cheapest of several best-fit packings of items in decreasing order of size, each from 1 to the longest length.

    Never dearer than opening every bin at one length (or the next that fits).
    """
    sizes, lengths = list(sizes), sorted(lengths)
    shrunk = lambda used: next(c for c in lengths if c >= used)

    def least(size: int, left: _Left) -> int:
        def price(c: int) -> tuple[float, int]:
            used = size + left.fill(c - size)
            return cost(shrunk(used)) / used, c

        return min(price(c) for c in lengths if c >= size)[1]

    rules = [least, *[lambda size, left, c=c: max(c, shrunk(size)) for c in lengths]]
    return min((_best_fit(sizes, lengths, rule) for rule in rules), key=lambda p: p.cost(cost))


def _shards(rows: Iterator[tuple[object, np.ndarray]], tokens: int) -> Iterator[list[tuple[object, np.ndarray]]]:
    shard, held = [], 0
    for id_, ids in rows:
        if shard and held + len(ids) > tokens:
            yield shard
            shard, held = [], 0
        shard.append((id_, ids))
        held += len(ids)
    if shard:
        yield shard


def pack(
    docs: DataFrame,
    lengths: Sequence[int] = LENGTHS,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: Tokenizer | None = None,
    shard_tokens: int = SHARD_TOKENS,
    cost: Callable[[int], float] = sequence_cost,
) -> DataFrame:
    """A row for each piece: ``id_col, piece, start, n_tokens, bin_id, bin_offset, bin_length, ids``.

    ``text_col`` is encoded by ``tokenizer``; without one it has the token ids (an array of integers).
    A document longer than the longest length becomes pieces of that length and a rest; ``ids`` are
    those of the piece, at ``bin_offset`` of its bin. Null and empty texts, and null ids in an array,
    give nothing to pack. Rows repeated with their id each come out; a null id is packed like another.
    An empty table gives no rows. Bins are numbered by partition, shard and bin.
    """
    longest = max(lengths)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["_id", "piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_length", "ids"]

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, np.ndarray]]:
        for batch in batches:
            for id_, x in zip(batch.column(0), batch.column(1)):
                if not x.is_valid:
                    continue
                ids = tokenizer.encode(x.as_py()) if tokenizer else x.values.drop_null().to_numpy().astype(np.int32)
                if len(ids):
                    yield id_, ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        id_type = pa.int64()
        for number, shard in enumerate(_shards(tokens(batches), shard_tokens)):
            id_type = shard[0][0].type
            pieces = [(i, at, min(longest, len(ids) - at)) for i, (_, ids) in enumerate(shard) for at in range(0, len(ids), longest)]
            pieces.sort(key=lambda p: -p[2])
            found = best_fit([n for _, _, n in pieces], lengths, cost)
            flat = np.concatenate([shard[i][1][at : at + n] for i, at, n in pieces])
            ends = np.concatenate([[0], np.cumsum([n for _, _, n in pieces])]).astype(np.int32)
            first = (task << 40) + (number << 24)
            columns = [
                pa.array([shard[i][0].as_py() for i, _, _ in pieces], id_type), pa.array([at // longest for _, at, _ in pieces], pa.int64()),
                pa.array([at for _, at, _ in pieces], pa.int64()), pa.array([n for _, _, n in pieces], pa.int64()),
                pa.array([first + b for b in found.bin_of], pa.int64()), pa.array(found.offset, pa.int64()),
                pa.array([found.lengths[b] for b in found.bin_of], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            ]
            whole = pa.RecordBatch.from_arrays(columns, names)
            for at in range(0, whole.num_rows, 1000):
                yield whole.slice(at, 1000)

    text = text_or_empty(text_col) if tokenizer else F.col(text_col).cast("array<int>")
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_x"))
    schema = f"_id {kind}, piece long, start long, n_tokens long, bin_id long, bin_offset long, bin_length long, ids array<int>"
    return in_batches(rows, run, schema).withColumnRenamed("_id", id_col)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each bin: ``bin_id, bin_length, n_tokens, ids, parts`` with the ids of its pieces one after the other.

    ``parts`` (id_col, piece, start, n_tokens) tells where one document ends and the next begins. A bin
    has no more pieces than tokens, so that groups are bounded by the longest length.
    """
    piece = F.struct("bin_offset", id_col, "piece", "start", "n_tokens", "ids")
    bins = packed.groupBy("bin_id").agg(F.first("bin_length").alias("bin_length"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(piece)).alias("_p"))
    part = lambda p: F.struct(p[id_col].alias(id_col), p["piece"].alias("piece"), p["start"].alias("start"), p["n_tokens"].alias("n_tokens"))
    return bins.select("bin_id", "bin_length", "n_tokens", F.flatten(F.transform("_p", lambda p: p["ids"])).alias("ids"), F.transform("_p", part).alias("parts"))
