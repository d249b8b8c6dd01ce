"""One date's rows sorted under many specs at once, with NumPy.

Specs that share a signal differ in the rows they leave out. So the rows of a date are sorted by the signal
once; under each spec the breakpoints are order statistics of the rows whose bit is set, the first portfolio
is a beginning of them and the last one an end, and only the rows of these two are looked at again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bits in a word, which is a long.
WORD = 62
#: What a block's columns may take in memory: a worker needs about three times as much.
BLOCK_BYTES = 120_000_000
#: Of each cohort's portfolio at each horizon: what :func:`cohorts` gives.
SCHEMA = "j int, regime string, ptf int, t int, h int, ew double, vw double"


@dataclass(frozen=True)
class Sort:
    """One spec of a block: its number and signal column; the columns of longs that tell who can be sorted, the bit of its
    rating, the bit of its filter in them and in the later rows, or the bounds that later returns are brought to."""

    j: int
    x: str
    ok: str | None = None
    rated: int | None = None
    mask: int | None = None
    clip: tuple[float | None, float | None] | None = None


@dataclass(frozen=True)
class Block:
    """What the sorts of a block are alike in, and the sorts; ``words`` is the number of longs that masks take."""

    nport: int
    holding: int
    dynamic: bool
    words: int
    sorts: tuple[Sort, ...]

    @property
    def longs(self) -> list[str]:
        ok = [o.format(w) for o in dict.fromkeys(s.ok for s in self.sorts if s.ok) for w in range(self.words)]
        later = [f"_later{h}_{w}" for h in range(1, self.holding + 1) for w in range(self.words)]
        return [*ok, *(["_rated"] if any(s.rated is not None for s in self.sorts) else []), *later]

    @property
    def columns(self) -> list[str]:
        K, signals = self.holding, dict.fromkeys(s.x for s in self.sorts)
        weights = [f"_vw{h}" for h in range(1, K)] if self.dynamic else []
        return ["t", *signals, "VW", *weights, *[f"_ret{h}" for h in range(1, K + 1)], *self.longs]


def bit_of(i: int) -> tuple[int, int]:
    """Word and bit of number i."""
    return i // WORD, 1 << i % WORD


def edges_of(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The inner breakpoints of ``x[at]``, which is in order, as :func:`inner_edges` has them."""
    place = (len(at) - 1) * np.array([i / n for i in range(1, n)])
    low, high = np.floor(place), np.ceil(place)
    a, b = x[at[low.astype(np.int64)]], x[at[high.astype(np.int64)]]
    return np.where((low == high) | (a == b), a, (high - place) * a + (place - low) * b)


def numbers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column, null as 0, and which are not null."""
    return np.asarray(column.fill_null(0)), np.asarray(column.is_valid())


def _clipped(r: np.ndarray, low: float | None, high: float | None) -> np.ndarray:
    r = r if high is None else np.where(r <= high, r, high)  # NaN is above all numbers
    return r if low is None else np.where(r < low, low, r)


def cohorts_of(block: Block) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """:func:`cohorts` for the rows of a group."""

    def dated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cohorts(block, batches)

    return dated


def cohorts(block: Block, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Returns of the first and the last portfolio of one date under all sorts of ``block``, at each horizon and regime."""
    table, K, n = pa.Table.from_batches(list(batches)), block.holding, block.nport
    size, t = table.num_rows, table["t"][0].as_py()
    # Return, return times weight, and weight, 0 where there is none; whether there is a return, and whether there is a weight.
    parts, there, weighed = np.zeros((size, K, 3)), np.zeros((size, K), bool), np.zeros((size, K), bool)
    for h in range(K):
        (r, there[:, h]), (w, weighed[:, h]) = numbers(table[f"_ret{h + 1}"]), numbers(table[f"_vw{h}" if h and block.dynamic else "VW"])
        there[:, h] &= weighed[:, h] | (not block.dynamic)
        weighed[:, h] &= there[:, h]
        parts[:, h, 0] = np.where(there[:, h], r, 0)
        parts[:, h, 1] = np.where(weighed[:, h], r, 0) * np.where(weighed[:, h], w, 0)
        parts[:, h, 2] = np.where(weighed[:, h], w, 0)
    later = [np.column_stack([table[f"_later{h}_{w}"].to_numpy() for h in range(1, K + 1)]) for w in range(block.words)]
    found: list[tuple] = []

    def add(s: Sort, regime: str, ptf: int, count: np.ndarray, sums: np.ndarray) -> None:
        for h in np.flatnonzero(count):
            r, rw, w = sums[h]
            found.append((s.j, regime, ptf, t, h + 1, r / count[h], rw / w if w else 0.0))

    for x in dict.fromkeys(s.x for s in block.sorts):
        values, known = numbers(table[x])
        order = np.flatnonzero(known)
        order = order[np.argsort(values[order])]
        sorts = [s for s in block.sorts if s.x == x]
        longs = {c: table[c].to_numpy()[order] for c in block.longs if not c.startswith("_later") and (c == "_rated" or any(s.ok and c in map(s.ok.format, range(block.words)) for s in sorts))}
        values = values[order]
        for s in sorts:
            able = np.ones(len(order), bool)
            if s.mask is not None:
                word, bit = bit_of(s.mask)
                able = (longs[s.ok.format(word)] & bit) != 0
            if s.rated is not None:
                able &= (longs["_rated"] & 1 << s.rated) != 0
            at = np.flatnonzero(able)
            if not len(at):
                continue
            edges = np.sort(edges_of(values, at, n))
            first, last = np.searchsorted(at, np.searchsorted(values, edges[[0, -1]], "right"))
            for ptf, rows in ((1, order[at[:first]]), (n, order[at[last:]])):
                own, has = parts[rows], there[rows]
                add(s, "ea", ptf, has.sum(0), own.sum(0))
                if s.mask is not None:
                    word, bit = bit_of(s.mask)
                    has = has & ((later[word][rows] & bit) != 0)
                    add(s, "ep", ptf, has.sum(0), np.where(has[:, :, None], own, 0).sum(0))
                elif s.clip is not None:
                    own[:, :, 0] = np.where(has, _clipped(own[:, :, 0], *s.clip), 0)
                    own[:, :, 1] = np.where(weighed[rows], own[:, :, 0], 0) * own[:, :, 2]
                    add(s, "ep", ptf, has.sum(0), own.sum(0))
    kinds = {"j": pa.int32(), "regime": pa.string(), "ptf": pa.int32(), "t": pa.int32(), "h": pa.int32(), "ew": pa.float64(), "vw": pa.float64()}
    each = list(zip(*found)) or [[]] * len(kinds)
    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(each, kinds.values())], names=list(kinds))
