"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

Merges apply in the order of the list, each from left to right. Whether two neighbouring bytes end up in
one token depends on what is left of them and on so many bytes to the right, as merges on the right can
take a symbol away before a later merge wants it. How many is a number of the list alone,
:attr:`Merges.lookahead`, found in one pass over it. The transducer holds a window of bytes, emits the
tokens that end at least that far before its end, and goes on from there: a word of any length is
encoded in constant memory, with the tokens that the whole word would get.

Decoding turns ids into bytes and those into text as they come; bytes of a character that is not over
wait for the next ids.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, text_or_empty

# White space, and how a text is split into words.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+"
)
#: Bytes that the transducer takes up beyond its lookahead before it emits.
STEP = 2_048
#: Characters of a text that are split into words at once.
WINDOW = 1 << 16
#: Words whose tokens a worker remembers, and characters of the longest of them.
KNOWN, KNOWN_LENGTH = 1 << 19, 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 itself, the others the letters after it in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def lookahead(merges: Iterable[tuple[bytes, bytes]]) -> int:
    """Bytes after a place that decide, together with what is before it, whether a token ends there.

    A merge of y and s is settled once it is known whether s is formed there, and is not taken by an
    earlier merge with something on its right, for which the same holds in turn. Ranks fall along such
    a chain, so one pass in the order of the list finds the longest. The parts of a merge have to be
    made by merges before it (or be bytes); another list is refused.
    """
    formed: dict[bytes, int] = {bytes([b]): 1 for b in range(256)}  # bytes from its start that tell whether a symbol is formed
    taken: dict[bytes, int] = {}  # bytes from its end that tell whether a merge so far takes it
    longest = 1
    for y, s in merges:
        if y not in formed or s not in formed:
            raise ValueError(f"the parts of the merge {y!r} {s!r} are not made before it")
        settled = max(formed[s], len(s) + taken.get(s, 0))
        whole = max(len(y) + settled, formed[y], len(y) + taken.get(y, 0))
        formed[y + s] = max(formed.get(y + s, 0), whole)
        taken[y] = max(taken.get(y, 0), settled)
        longest = max(longest, settled)
    return longest


class Merges:
    """A tokenizer file's vocabulary and merges."""

    def __init__(self, file: str) -> None:
        with open(file, encoding="utf-8") as lines:
            spec = json.load(lines)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or odd or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{file} is no plain byte-level BPE")
        added = spec.get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{file} has special tokens that take blanks or word ends into account")
        vocab = model["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda token: bytes(byte_of[c] for c in token)
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.lookahead = lookahead((raw(a), raw(b)) for a, b in pairs)
        self.longest = max(len(a) + len(b) for a, b in pairs) if pairs else 1
        self.byte_ids = [vocab[c] for c in byte_letters()]
        #: Two ids to the rank of their merge and the id it makes.
        self.merge = {}
        for rank, (a, b) in enumerate(pairs):
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in added}
        #: An id's bytes; a special token's are its text.
        self.token = {i: raw(t) if all(c in byte_of for c in t) else t.encode() for t, i in vocab.items()}
        self.token |= {i: t.encode() for t, i in self.special.items()}

    def merged(self, data: bytes) -> tuple[list[int], list[int]]:
        """Ids of ``data`` taken as a whole, and the length in bytes of each."""
        ids, n = [self.byte_ids[b] for b in data], len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        sizes = [1] * n
        queue = [(*found, i) for i in range(n - 1) if (found := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        pop, push, merge = heapq.heappop, heapq.heappush, self.merge
        while queue:
            rank, made, i = pop(queue)
            j = after[i]
            if j >= n or not sizes[i] or merge.get((ids[i], ids[j])) != (rank, made):
                continue  # one of the two has been merged meanwhile
            ids[i] = made
            sizes[i] += sizes[j]
            sizes[j] = 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merge.get((made, ids[k])):
                    push(queue, (*found, i))
            if (h := before[i]) >= 0 and (found := merge.get((ids[h], made))):
                push(queue, (*found, h))
        kept = [i for i in range(n) if sizes[i]]
        return [ids[i] for i in kept], [sizes[i] for i in kept]


@lru_cache(4)
def load(file: str) -> Merges:
    return Merges(file)


class Transducer:
    """Bytes of one word in, ids out as soon as nothing that follows can change them."""

    def __init__(self, merges: Merges, step: int = STEP) -> None:
        self.merges, self.held = merges, bytearray()
        self.window = merges.lookahead + merges.longest + step

    def feed(self, data: bytes) -> Iterator[int]:
        for at in range(0, len(data), self.window):
            self.held += data[at : at + self.window]
            while len(self.held) >= self.window:
                part = bytes(self.held[: self.window])
                stable, end = len(part) - self.merges.lookahead, 0
                for i, size in zip(*self.merges.merged(part)):
                    if end + size > stable:
                        break
                    end += size
                    yield i
                del self.held[:end]

    def finish(self) -> Iterator[int]:
        yield from self.merges.merged(bytes(self.held))[0]
        self.held.clear()


class _Known(dict):
    """Packed ids of words; those of short ones are remembered."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make = make

    def __missing__(self, part: str) -> bytes:
        found = self.make(part)
        if len(part) <= KNOWN_LENGTH:
            if len(self) >= KNOWN:
                self.clear()
            self[part] = found
        return found


def _packed(ids: Iterable[int]) -> bytes:
    return np.fromiter(ids, "<u4").tobytes()


def streamed(merges: Merges, parts: Iterable[str]) -> Iterator[bytes]:
    """Packed ids of one word that comes in parts."""
    machine = Transducer(merges)
    for part in parts:
        yield _packed(machine.feed(part.encode()))
    yield _packed(machine.finish())


class Encoder:
    """Texts to packed ids (32 bits each, little-endian), chunk by chunk."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.split = merges, regex.compile(WORDS)
        self.words = _Known(lambda word: b"".join(streamed(merges, [word])))
        longest_first = sorted(merges.special, key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None

    def encode(self, text: str) -> Iterator[bytes]:
        at = 0
        for m in self.specials.finditer(text) if self.specials else ():
            yield from self._words(text, at, m.start())
            yield _packed([self.merges.special[m[0]]])
            at = m.end()
        yield from self._words(text, at, len(text))

    def _words(self, text: str, at: int, stop: int) -> Iterator[bytes]:
        while at < stop:
            end = min(stop, at + WINDOW)
            found = self.split.findall(text, at, end)
            if end < stop:
                if len(found) <= 2:  # a word longer than the window
                    end = self.split.match(text, at, stop).end()
                    yield from streamed(self.merges, (text[i : min(end, i + WINDOW)] for i in range(at, end, WINDOW)))
                    at = end
                    continue
                # What follows can still join the last word, or make "'r" of the last two "'re".
                end -= len(found.pop()) + len(found.pop())
            yield b"".join(map(self.words.__getitem__, found))
            at = end


@lru_cache(4)
def encoder_of(file: str) -> Encoder:
    """One for all tasks of a worker, with the words that it knows."""
    return Encoder(load(file))


class Decoder:
    """Ids in, text out; unknown ids give nothing, bytes that are no UTF-8 the replacement character."""

    def __init__(self, merges: Merges) -> None:
        self.token = merges.token
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join([self.token.get(i, b"") for i in ids]))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def encode(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False) -> DataFrame:
    """``id_col, n_tokens, ids`` of each row: the token ids of its whole text, an array of integers.

    ``file`` is a tokenizer file (byte-level BPE as JSON) that every executor can read. Special tokens
    that are written out in a text become their ids; none are added. ``packed`` gives the ids as bytes
    instead, 32 bits each, little-endian. Null and empty texts have no tokens; null and repeated ids each
    come out; an empty table gives no rows. Other columns are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(file)
        for batch in batches:
            found = [b"".join(encoder.encode(x.as_py())) for x in batch.column(1)]
            sizes = [len(x) // 4 for x in found]
            if packed:
                ids = pa.array(found, pa.binary())
            else:
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), ids], ["_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    out = in_batches(rows, run, f"_id {kind}, n_tokens long, ids {'binary' if packed else 'array<int>'}")
    return out.withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, file: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``text``, what its ids stand for, in place of ``ids_col`` (an array, or packed bytes).

    Null ids, and nulls among them, give nothing; special tokens give their text. A column ``text`` that
    is there is replaced. An empty table gives no rows.
    """
    kept = [c for c in encoded.columns if c not in (ids_col, "text")]
    is_packed = dict(encoded.dtypes)[ids_col] == "binary"
    rest = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(True).alias("_"))
    rows = encoded.select(rest.alias("_rest"), F.col(f"`{ids_col}`").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = load(file)
        for batch in batches:
            texts = []
            for x in batch.column(1):
                decoder, parts = Decoder(merges), []
                if x.is_valid:
                    ids = np.frombuffer(x.as_buffer(), "<u4") if is_packed else x.values.drop_null().to_numpy()
                    parts = [decoder.feed(ids[at : at + WINDOW].tolist()) for at in range(0, len(ids), WINDOW)]
                texts.append("".join([*parts, decoder.finish()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_rest", "text"])

    schema = T.StructType([rows.schema["_rest"], T.StructField("text", T.StringType())])
    return in_batches(rows, run, schema).select(*[F.col("_rest")[c].alias(c) for c in kept], "text")
