"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) those of its
letters, each permuted by its place; a text's vector bundles (adds) those of its n-grams, and a
language's prototype the vectors of its training texts. The nearest prototype by cosine wins.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, give_back, in_batches, stash

DIMENSIONS = 1024
GRAM = 3
UNKNOWN = "und"
#: Rows of labelled text that training takes at most (one of each label, if there are more labels).
TRAIN_ROWS = 20_000
#: Labels that can be learnt: each has a prototype on the driver and on every executor.
MOST_LABELS = 1_000
_SLOTS = 1 << 12  # letters share a vector if their code points agree modulo this
_GROUP = 64  # texts whose n-gram counts are multiplied at once
_CHUNK = 1 << 19  # letters counted at once
#: A text of so many letters whose nearest prototype is within so many standard deviations of chance is in none of the
#: languages. Cosines of unrelated texts lie about 0 with a standard deviation of 1 / sqrt(DIMENSIONS).
SURE_LETTERS, CHANCE = 200, 5.0
_SCALE = 1 << 20  # training vectors are rounded to integers, so that their sums don't depend on order

_letter_vectors: np.ndarray | None = None
_is_letter: np.ndarray | None = None


def _vectors() -> np.ndarray:
    global _letter_vectors
    if _letter_vectors is None:
        rng = np.random.Generator(np.random.PCG64(11))
        _letter_vectors = rng.integers(0, 2, (_SLOTS, DIMENSIONS), dtype=np.int8) * np.int8(2) - np.int8(1)
    return _letter_vectors


def _letters() -> np.ndarray:
    global _is_letter
    if _is_letter is None:
        _is_letter = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _is_letter


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and number of each n-gram, gaps between words counting as one letter."""
    code = np.frombuffer(" ".join([*texts, ""]).lower().encode("utf-32-le", "replace"), np.uint32)
    text = np.repeat(np.arange(len(texts)), [len(t.lower()) + 1 for t in texts])
    letter = _letters()[code]
    # Of a run of gaps one stays: the first after a letter, or the first of its text.
    keep = letter | np.concatenate([[True], letter[:-1]]) | np.concatenate([[True], text[1:] != text[:-1]])
    slot = np.where(letter, code % (_SLOTS - 1) + 1, 0)[keep].astype(np.int64)
    text, letter = text[keep], letter[keep]
    n = max(0, len(slot) - GRAM + 1)
    number, any_letter = np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(GRAM):
        number = number * _SLOTS + slot[i : i + n]
        any_letter |= letter[i : i + n]
    inside = any_letter & (text[:n] == text[GRAM - 1 :][:n])
    return text[:n][inside], number[inside]


def _bound(number: np.ndarray) -> np.ndarray:
    out = np.ones((len(number), DIMENSIONS), np.int8)
    for i in range(GRAM):
        slot = (number // _SLOTS ** (GRAM - 1 - i)) % _SLOTS
        out *= np.roll(_vectors(), GRAM - 1 - i, axis=1)[slot]
    return out


def _long_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of a long text's n-grams, gone through in parts."""
    slots, letters = np.zeros(0, np.int64), np.zeros(0, bool)
    after, found = True, (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for at in range(0, len(text), _CHUNK):
        code = np.frombuffer(text[at : at + _CHUNK].lower().encode("utf-32-le", "replace"), np.uint32)
        letter = _letters()[code]
        keep = letter | np.concatenate([[after], letter[:-1]])
        after = bool(letter[-1])
        slots = np.concatenate([slots, np.where(letter, code % (_SLOTS - 1) + 1, 0)[keep]])
        letters = np.concatenate([letters, letter[keep]])
        n = max(0, len(slots) - GRAM + 1)
        number, any_letter = np.zeros(n, np.int64), np.zeros(n, bool)
        for i in range(GRAM):
            number = number * _SLOTS + slots[i : i + n]
            any_letter |= letters[i : i + n]
        both = np.concatenate([found[0], number[any_letter]])
        grams, which = np.unique(both, return_inverse=True)
        counts = np.bincount(which, np.concatenate([found[1], np.ones(len(both) - len(found[0]), np.int64)]), len(grams))
        found = grams, counts.astype(np.int64)
        slots, letters = slots[n:], letters[n:]
    return found


def bundles(texts: list[str]) -> Iterator[np.ndarray]:
    """Unit vectors of some dozen texts at a time; zeros for a text without letters.

    Any length: a long text is counted in parts.
    """
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and end - at < _GROUP and (size == 0 or size + len(texts[end]) <= _CHUNK):
            size += len(texts[end])
            end += 1
        if size > _CHUNK:  # one long text
            grams, counts = _long_grams(f" {texts[at]} ")
            table = lambda lo, width: counts[None, lo : lo + width]  # noqa: E731, B023
        else:
            text, number = _grams([f" {t}" for t in texts[at:end]])
            grams, which = np.unique(number, return_inverse=True)

            def table(lo: int, width: int) -> np.ndarray:
                some = (which >= lo) & (which < lo + width)  # noqa: B023
                return np.bincount(text[some] * width + which[some] - lo, minlength=(end - at) * width).reshape(end - at, width)  # noqa: B023

        out = np.zeros((end - at, DIMENSIONS), np.float64)
        for lo in range(0, len(grams), 4096):
            width = min(4096, len(grams) - lo)
            out += table(lo, width).astype(np.float32) @ _bound(grams[lo : lo + width]).astype(np.float32)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        yield out / np.where(norm == 0, 1, norm)
        at = end


def bundle(texts: list[str]) -> np.ndarray:
    return np.concatenate([np.zeros((0, DIMENSIONS)), *bundles(texts)])


@dataclass(frozen=True)
class Profiles:
    languages: tuple[str, ...]
    prototypes: np.ndarray  # one unit row for each language


def _quota(sizes: list[int], most: int) -> int:
    """The largest number of rows of each label, 1 at least, that gives ``most`` rows at most."""
    left = most
    for i, n in enumerate(sorted(sizes)):
        share = left // (len(sizes) - i)
        if n > share:
            return max(1, share)
        left -= n
    return max(1, most)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_rows: int = TRAIN_ROWS) -> Profiles:
    """Prototypes from distinct rows with a label and a text that has a letter, ``max_rows`` at most.

    All are taken if they are so few; else every label gives its lowest hashes, the same number of
    each label that has so many and at least one, so that a rare label is learnt from a table of any
    size. What reaches the driver has the size of the prototypes; more than ``MOST_LABELS`` different labels
    (free text instead of languages) are refused.
    """
    rows = labelled.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).where(
        "_text IS NOT NULL AND _lang IS NOT NULL"
    )
    rows = rows.where(F.col("_text").rlike(r"\p{L}")).withColumn("_hash", F.xxhash64("_lang", "_text"))
    hashes = stash(rows.select("_lang", "_hash").distinct(), "hashes")
    sizes = {r["_lang"]: r["n"] for r in hashes.groupBy("_lang").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"{lang_col} has more than {MOST_LABELS} different labels")
    quota = _quota(list(sizes.values()), max_rows)
    # hashes are spread evenly: those below the bound hold the quota's, and few more are sorted
    part = {k: min(1.0, (quota + 10 * quota**0.5 + 20) / n) for k, n in sizes.items()}
    bounds = [(k, min((1 << 63) - 1, int(x * (1 << 64)) - (1 << 63))) for k, x in part.items()]
    low = hashes.join(F.broadcast(labelled.sparkSession.createDataFrame(bounds, "_lang string, _bound long")), "_lang")
    low = low.where("_hash <= _bound").withColumn("_rank", F.row_number().over(Window.partitionBy("_lang").orderBy("_hash")))
    chosen = low.where(F.col("_rank") <= quota).select("_lang", "_hash")
    rows = rows.join(F.broadcast(chosen), ["_lang", "_hash"]).dropDuplicates(["_lang", "_hash"]).select("_text", "_lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = iter(batch.column(1).to_pylist())
            for vectors in bundles(batch.column(0).to_pylist()):
                for lang, v in zip(itertools.islice(langs, len(vectors)), np.rint(vectors * _SCALE).astype(np.int64)):
                    sums[lang] = sums.get(lang, 0) + v
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(v)], ["lang", "i", "x"]
            )

    summed = in_batches(rows, run, "lang string, i int, x long").groupBy("lang", "i").agg(F.sum("x").alias("x"))
    table: dict[str, np.ndarray] = {}
    for batch in summed.toArrow().to_batches():  # at most labels x DIMENSIONS rows
        for lang, i, x in zip(*[c.to_pylist() for c in batch.columns]):
            table.setdefault(lang, np.zeros(DIMENSIONS))[i] = x
    langs = tuple(sorted(k for k, v in table.items() if v.any()))
    protos = np.array([table[k] / np.linalg.norm(table[k]) for k in langs]).reshape(len(langs), DIMENSIONS)
    return Profiles(langs, protos)


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the cosine with the nearest prototype, at least 0.

    A null text, or one without letters, is ``und`` with score 0; so is every text if there are no
    prototypes. Ties go to the language that sorts first. Columns of ``docs`` with these names are
    replaced.
    """
    langs, protos = np.array([*profiles.languages, UNKNOWN]), profiles.prototypes
    bound_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def nearest(text):  # noqa: ANN001, ANN202 (Spark reads annotations of pandas UDFs)
        import pandas as pd

        best, score = [np.zeros(0, int)], [np.zeros(0)]
        for vectors in bundles([t or "" for t in text]):
            known = vectors.any(axis=1) & bool(len(protos))
            cosine = np.round(vectors @ protos.T, 12) if len(protos) else np.zeros((len(vectors), 1))
            best.append(np.where(known, cosine.argmax(axis=1), len(langs) - 1))
            score.append(np.where(known, np.clip(cosine.max(axis=1), 0, 1), 0.0))
        give_back()
        return pd.DataFrame({"lang_pred": langs[np.concatenate(best)], "score": np.concatenate(score)})

    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    # Not said to be deterministic: a filter on its result would have it worked out twice.
    return docs.withColumn("_near", nearest.asNondeterministic()(F.col(text_col))).select(*others, "_near.*")


def keep_known(
    docs: DataFrame,
    languages: Sequence[str] | None = None,
    text_col: str = "text",
    lang_col: str = "lang",
    max_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """The rows of ``docs`` whose text is in a language, by what is learnt from its labelled rows.

    Rejected are null texts, texts without letters, texts of at least ``SURE_LETTERS`` letters whose
    cosine with every prototype is within ``CHANCE`` standard deviations of chance, and with
    ``languages`` texts in others. Shorter texts have low cosines in any language and are not rejected
    by them. A row without a label gets the predicted one; all else is kept as it is.
    """
    profiles = fit(docs, text_col, lang_col, max_rows)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), F.col(text_col).alias("_text"))
    long = F.char_length(F.regexp_replace("_text", r"\P{L}+", "")) >= SURE_LETTERS
    near = F.col("score") > CHANCE / DIMENSIONS**0.5
    known = (F.col("lang_pred") != UNKNOWN) & (near | ~long)
    kept = predict(rows, profiles, "_text").where(known if languages is None else known & F.col("lang_pred").isin(*languages))
    label = F.coalesce(F.col("_all")[lang_col], F.col("lang_pred")).alias(lang_col)
    return kept.select(*[label if c == lang_col else F.col("_all")[c].alias(c) for c in docs.columns])
