"""N-best segmentation into the pieces of a SentencePiece model, and decoding.

A forward Viterbi pass over the lattice of pieces gives the best score from the start to every
place. These scores are exact heuristics for a backward A-star search from the end, which therefore
finds segmentations in order of score and touches little else. Where no piece of the model spans the
start of a blank run, the lattice falls into independent stretches. The forward pass gives each
stretch its best and second-best score; only the few stretches whose second best loses least can
differ from their best in one of the text's N best, and only these are searched backward.

Scores are those of the model file, added up. A unigram model has log-probabilities there, so rank 1
is the library's own encoding. A merge-ranked (BPE) model has the negative rank of each merge: rank 1
is then the segmentation with the smallest sum of ranks, which is not what merging in order gives.
All segmentations decode to the same text either way.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from array import array
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, text_or_empty

BLANK = "▁"
#: Bytes of solved stretches, and of searched ones, that a worker keeps for reuse; beyond them it starts afresh.
CACHE_BYTES, SEARCHED_BYTES = 192 << 20, 32 << 20
_ENTRY = 128  # bytes of an entry beside its key and ids
_LONG = 1 << 16  # stretches of more characters are solved in packed arrays
#: Below the lowest score of a piece by so much is a character that no piece covers.
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    """What segmentation needs of a model."""

    ids: dict[str, int]
    scores: tuple[float, ...]
    pieces: tuple[str, ...]
    known: dict[str, float | bool]  # score of a piece, or False for a beginning of one
    bytes_: tuple[int, ...]  # ids of the 256 byte pieces, or empty
    unknown: int
    unknown_score: float
    apart: bool  # no piece spans the start of a blank run
    lines: bool  # no piece has a line break
    longest: int  # characters of the longest piece

    @cached_property
    def texts(self) -> pa.LargeStringArray:
        """Texts of all pieces, ASCII byte pieces as their characters, and the same without a blank in front."""
        plain = [p.replace(BLANK, " ") for p in self.pieces]
        first = [p.removeprefix(" ") for p in plain]
        for b, i in enumerate(self.bytes_[:128]):
            plain[i] = first[i] = chr(b)
        return pa.array([*plain, *first], pa.large_string())

    @classmethod
    def load(cls, model_file: str) -> Vocabulary:
        """The pieces of a model; one that changes texts before it cuts them, or cuts them by other rules, is refused."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if odd := _unknown_rules(model.serialized_model_proto()):
            raise ValueError(f"{model_file}: {', '.join(odd)}")
        n = model.get_piece_size()
        pieces = tuple(model.id_to_piece(i) for i in range(n))
        scores = tuple(model.get_score(i) for i in range(n))
        usable = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        byte_ids = {pieces[i]: i for i in range(n) if model.is_byte(i)}
        return cls(
            ids={pieces[i]: i for i in usable},
            scores=scores,
            pieces=pieces,
            known={pieces[i][:k]: False for i in usable for k in range(1, len(pieces[i]))} | {pieces[i]: scores[i] for i in usable},
            bytes_=tuple(byte_ids[f"<0x{b:02X}>"] for b in range(256)) if len(byte_ids) == 256 else (),
            unknown=model.unk_id(),
            unknown_score=min((scores[i] for i in usable), default=0.0) - UNKNOWN_PENALTY,
            apart=not any(BLANK in pieces[i].lstrip(BLANK) for i in usable),
            lines=not any("\n" in pieces[i] for i in usable),
            longest=max((len(pieces[i]) for i in usable), default=1),
        )


def _unknown_rules(model: bytes) -> list[str]:
    """What a model asks for that this segmenter doesn't do: it would give other pieces without an error."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto.FromString(model)
    rules, kinds = spec.normalizer_spec, proto.ModelProto.SentencePiece
    return [
        what
        for what, found in (
            ("texts are normalised", bool(rules.precompiled_charsmap or rules.normalization_rule_tsv)),
            ("repeated blanks are removed", rules.remove_extra_whitespaces),
            ("no blank is put in front", not rules.add_dummy_prefix),
            ("blanks are no pieces' marks", not rules.escape_whitespaces),
            ("blanks end pieces", spec.trainer_spec.treat_whitespace_as_suffix),
            ("pieces are set by the user", any(p.type == kinds.USER_DEFINED for p in spec.pieces)),
            ("pieces are whole words or characters", spec.trainer_spec.model_type not in (1, 2)),
        )
        if found
    ]


Path = tuple[float, tuple[int, ...]]


def _table(value: float, size: int) -> list[float] | array:
    return array("d", [value]) * size if size > _LONG else [value] * size


def _forward(text: str, vocab: Vocabulary) -> list[float] | array:
    """Best score from the start to every place."""
    size, known, unknown = len(text), vocab.known.get, vocab.unknown_score
    best = _table(-np.inf, size + 1)
    best[0] = 0.0
    for i in range(size):
        base, j, step = best[i], i + 1, known(text[i])
        if step is None or step is False:
            best[j] = max(best[j], base + unknown)
        while step is not None:
            if step is not False and base + step > best[j]:
                best[j] = base + step
            j += 1
            step = known(text[i:j]) if j <= size else None
    return best


def n_best(text: str, vocab: Vocabulary, n: int) -> list[Path]:
    """The ``n`` best segmentations of a stretch (all, if fewer) by sum of scores, best first.

    Characters that no piece covers become byte pieces, or the unknown piece. Each place of the
    frontier stands for other segmentations and knows what the best of them loses, so only as many
    places as segmentations are still wanted need to be kept: time is in proportion to ``n`` and the
    length, whatever the ties.
    """
    size, best, ids = len(text), _forward(text, vocab), vocab.ids
    found: list[Path] = []
    frontier: list[tuple[float, int, int, tuple]] = [(0.0, size, 0, ())]
    tick = 0
    while frontier and len(found) < n:
        loss, at, _, path = frontier.pop(0)
        if at == 0:
            out: list[int] = []
            while path:
                out.extend(path[0])
                path = path[1]
            found.append((best[size] - loss, tuple(out)))
            continue
        left = n - len(found)
        for i in range(at - 1, max(-1, at - vocab.longest - 1), -1):
            p = ids.get(text[i:at])
            if p is not None:
                step, score = (p,), vocab.scores[p]
            elif i == at - 1:
                step, score = tuple(_uncovered(text[i], vocab)), vocab.unknown_score
            else:
                continue
            lost = loss + (best[at] - (best[i] + score))
            if len(frontier) < left or lost <= frontier[-1][0]:
                tick += 1
                insort(frontier, (lost, i, tick, (step, path)))
                del frontier[left:]
    return found


def best_two(text: str, vocab: Vocabulary) -> tuple[float, bytes, float]:
    """Best score, its ids as little-endian 32-bit integers, and how much the second best loses."""
    size, known, unknown = len(text), vocab.known.get, vocab.unknown_score
    low = -np.inf
    best, second = _table(low, size + 1), _table(low, size + 1)
    back = array("q", [0]) * (size + 1) if size > _LONG else [0] * (size + 1)
    best[0] = 0.0
    for i in range(size):
        one, two, j = best[i], second[i], i + 1
        score = known(text[i])
        if not score and (score is None or score is False):  # no piece covers this character alone
            step, longer = unknown, score is False
        else:
            step, longer = score, True
        while True:
            if step is not False:
                x, b = one + step, best[j]
                if x > b:
                    y = two + step
                    second[j] = b if b > y else y
                    best[j], back[j] = x, i
                elif x > second[j]:
                    second[j] = x
            j += 1
            if not longer or j > size:
                break
            step = known(text[i:j])
            if step is None:
                break
    out, j = [], size
    while j:
        i = back[j]
        p = vocab.ids.get(text[i:j])
        if p is not None:
            out.append(p)
        else:
            out.extend(reversed(_uncovered(text[i], vocab)))
        j = i
    out.reverse()
    return best[size], _packed(out), best[size] - second[size]


def _uncovered(char: str, vocab: Vocabulary) -> list[int]:
    return [vocab.bytes_[b] for b in char.encode()] if vocab.bytes_ else [vocab.unknown]


def _packed(ids: list[int] | tuple[int, ...]) -> bytes:
    return array("i", ids).tobytes() if _LITTLE else np.array(ids, "<i4").tobytes()


_LITTLE = array("i", [1]).tobytes() == b"\x01\0\0\0"
_STRETCH = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_MARK = "\n" + BLANK  # no line starts with a blank mark


class _Solved(dict):
    """Number of each stretch solved so far; what is known of it lies in arrays by that number."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.bytes = vocab, 0
        self.score, self.loss = np.empty(1 << 12), np.empty(1 << 12)
        self.start = np.zeros((1 << 12) + 1, np.int64)
        self.ids = np.empty(1 << 14, "<i4")

    def __missing__(self, key: str) -> int:
        n = len(self)
        if n == len(self.score):
            self.score, self.loss, self.start = np.resize(self.score, 2 * n), np.resize(self.loss, 2 * n), np.resize(self.start, 2 * n + 1)
        score, raw, loss = best_two(_stretch(key), self.vocab)
        at = int(self.start[n])
        end = at + len(raw) // 4
        while end > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[at:end] = np.frombuffer(raw, "<i4")
        self.score[n], self.loss[n], self.start[n + 1] = score, loss, end
        self[key] = n
        self.bytes += sys.getsizeof(key) + len(raw) + _ENTRY
        return n


def _stretch(key: str) -> str:
    return key.removeprefix(_MARK) if key.startswith("\n") else BLANK + key


class Segmenter:
    """N-best segmentation of whole texts, with a bounded memory of stretches.

    Stretches are known by keys: a word stands for itself with a blank in front, a line break and
    what follows for itself, and any other stretch comes after a mark of its own.
    """

    def __init__(self, vocab: Vocabulary, n: int) -> None:
        self.vocab, self.n = vocab, n
        self.solved = _Solved(vocab)
        self.searched: dict[str, list[tuple[float, bytes]]] = {}
        self.held = 0  # bytes of the latter

    def _others(self, key: str) -> list[tuple[float, bytes]]:
        """Loss and ids of a stretch's second best to N-th best segmentation."""
        got = self.searched.get(key)
        if got is None:
            if self.held > SEARCHED_BYTES:
                self.searched.clear()
                self.held = 0
            top, *rest = n_best(_stretch(key), self.vocab, self.n)
            got = self.searched[key] = [(top[0] - score, _packed(p)) for score, p in rest]
            self.held += sys.getsizeof(key) + sum(len(p) + _ENTRY for _, p in got)
        return got

    def _keys(self, text: str) -> list[str]:
        text = text.replace(BLANK, " ")
        if not self.vocab.apart:
            return [_MARK + BLANK + text.replace(" ", BLANK)]
        if self.vocab.lines:
            keys = text.split(" ")
            if "\n" in text:
                keys = text.replace("\n", " \n").split(" ") if "" not in keys and " \n" not in text else [""]
            if "" not in keys:
                return keys
        return [_MARK + x for x in _STRETCH.findall(BLANK + text.replace(" ", BLANK))]

    def __call__(self, text: str) -> list[tuple[float, int, bytes]]:
        """(score, pieces, ids as little-endian 32-bit integers) of the N best, best first."""
        if not text:
            return [(0.0, 0, b"")]
        keys = self._keys(text)
        if self.solved.bytes > CACHE_BYTES:
            self.solved = _Solved(self.vocab)
        known = self.solved
        which = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))
        base = float(known.score[which].sum())
        start, size = known.start[which], known.start[which + 1] - known.start[which]
        ends = np.cumsum(size)
        best = known.ids[np.repeat(start - ends + size, size) + np.arange(ends[-1])].tobytes()
        choices: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        others: dict[int, list[tuple[float, bytes]]] = {}
        if self.n > 1:
            losses = known.loss[which]
            k = min(self.n - 1, len(keys))
            least = np.partition(losses, k - 1)[k - 1]
            near = np.flatnonzero((losses <= least) & (losses < np.inf))
            for i in sorted(near[np.argsort(losses[near], kind="stable")][:k].tolist()):
                others[i] = self._others(keys[i])
                more = [(loss + x[0], (*picked, (i, j))) for loss, picked in choices for j, x in enumerate(others[i])]
                choices = heapq.nsmallest(self.n, choices + more)
        out = []
        for loss, picked in choices:
            parts, at = [], 0
            for i, j in picked:  # in the order of the text
                end = 4 * int(ends[i])
                parts += [best[at : end - 4 * int(size[i])], others[i][j][1]]
                at = end
            raw = b"".join([*parts, best[at:]])
            out.append((base - loss, len(raw) // 4, raw))
        return out


def decode_ids(ids: np.ndarray, vocab: Vocabulary) -> str:
    """The text of a segmentation; byte pieces become their bytes, blanks lose the added first one."""
    plain, byte_of = vocab.pieces, {p: b for b, p in enumerate(vocab.bytes_)}
    out, run = [], bytearray()
    for i in ids.tolist():
        b = byte_of.get(i)
        if b is not None:
            run.append(b)
            continue
        if run:
            out.append(run.decode("utf-8", "replace"))
            run.clear()
        out.append(plain[i])
    if run:
        out.append(run.decode("utf-8", "replace"))
    text = "".join(out)
    return text[1:].replace(BLANK, " ") if text.startswith(BLANK) else text.replace(BLANK, " ")


def decode_lists(lists: pa.ListArray, vocab: Vocabulary) -> pa.LargeStringArray:
    """:func:`decode_ids` of each list; only lists with byte pieces beyond ASCII are gone through one by one. Null gives null."""
    values = lists.flatten().to_numpy()
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy().astype(np.int64))])
    # The first piece of a list loses the blank that encoding puts in front: it is looked up in the second half.
    which = values.astype(np.int64)
    which[ends[:-1][ends[1:] > ends[:-1]]] += len(vocab.pieces)
    _, places, data = vocab.texts.take(pa.array(which)).buffers()
    places = np.frombuffer(places, np.int64)[ends] if len(which) else np.zeros(len(ends), np.int64)
    joined = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(places.copy()), data)
    if vocab.bytes_:
        at = np.flatnonzero(np.isin(values, vocab.bytes_[128:]))
        rows = np.unique(np.searchsorted(ends, at, side="right") - 1)
        if len(rows):
            mask = np.zeros(len(joined), bool)
            mask[rows] = True
            by_hand = [decode_ids(np.asarray(lists[i].values), vocab) for i in rows.tolist()]
            joined = pc.replace_with_mask(joined, pa.array(mask), pa.array(by_hand, pa.large_string()))
    return pc.if_else(lists.is_valid(), joined, None)


_loaded: dict[tuple[str, int], Segmenter] = {}


def _segmenter(model_file: str, n: int) -> Segmenter:
    """One for each Python worker: stretches solved in a task serve the next."""
    if (model_file, n) not in _loaded:
        _loaded[model_file, n] = Segmenter(Vocabulary.load(model_file), n)
    return _loaded[model_file, n]


def encode(
    docs: DataFrame, model_file: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, decoded: bool = False
) -> DataFrame:
    """A row for each of a text's ``n`` best segmentations: ``id_col, rank, score, n_pieces, ids, ids_sha256``.

    Rank counts from 1; of equal scores, changes in earlier stretches come first. ``ids`` is null if
    not asked for. With ``decoded`` the ids are decoded again where they are:
    ``text_sha256`` is the digest of that text and ``round_trip`` tells whether it is the one encoded. Null and empty texts have one
    segmentation, of no pieces. Whole texts of any length are segmented, with or without blanks;
    repeated rows each come out. The literal blank mark counts as a blank. ``model_file`` must be
    readable on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    fields = ["rank int", "score double", "n_pieces long", "ids array<int>", "ids_sha256 string"]
    fields += ["text_sha256 string", "round_trip boolean"] if decoded else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = _segmenter(model_file, n)
        for batch in batches:
            at, rank, score, count, raws = [], [], [], [], []
            held = 0

            def flush() -> pa.RecordBatch:
                rows = pa.array(at, pa.int64())
                lists = _lists(raws, count)
                sums = pa.array([hashlib.sha256(x).hexdigest() for x in raws], pa.string())
                columns = [batch.column(0).take(rows), pa.array(rank, pa.int32()), pa.array(score, pa.float64()), pa.array(count, pa.int64())]
                columns += [lists if ids else pa.nulls(len(rows), lists.type), sums]
                if decoded:
                    texts = decode_lists(lists, segment.vocab)
                    wanted = pc.replace_substring(batch.column(1), BLANK, " ").cast(pa.large_string()).take(rows)
                    columns += [_digests(texts), pc.equal(texts, wanted)]
                out = pa.RecordBatch.from_arrays(columns, ["_id", *[f.split()[0] for f in fields]])
                for x in (at, rank, score, count, raws):
                    x.clear()
                return out

            for i, text in enumerate(batch.column(1)):
                for r, (s, k, raw) in enumerate(segment(text.as_py()), 1):
                    at.append(i)
                    rank.append(r)
                    score.append(s)
                    count.append(k)
                    raws.append(raw)
                    held += len(raw)
                if held > 8 << 20:
                    yield flush()
                    held = 0
            yield flush()

    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    return in_batches(rows, run, ", ".join([f"_id {kind}", *fields])).withColumnRenamed("_id", id_col)


def _lists(raws: list[bytes], count: list[int]) -> pa.ListArray:
    """Lists of ids from their packed form."""
    ends = np.concatenate([[0], np.cumsum(np.array(count, np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raws), "<i4").astype(np.int32)))


def _digests(texts: pa.LargeStringArray) -> pa.StringArray:
    """SHA-256 of each text in UTF-8."""
    return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in texts], pa.string())


def decode(encoded: DataFrame, model_file: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ids; null ids give null, none an empty text."""

    @F.pandas_udf("string")
    def text_of(ids):  # noqa: ANN001, ANN202
        lists = pa.array([None if x is None else np.asarray(x, np.int32) for x in ids], pa.list_(pa.int32()))
        return decode_lists(lists, _segmenter(model_file, 1).vocab).to_pandas()

    return encoded.withColumn("decoded", text_of(F.col(ids_col)))
