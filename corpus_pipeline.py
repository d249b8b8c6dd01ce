"""The corpus pipeline: language, exact copies, near copies, repeated passages, packing.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir). All but the last return the
columns of ``documents``; what a stage drops or cuts is gone for those after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioframe.llm.common import stash, table
from folioframe.llm.content_sort import drop_copies
from folioframe.llm.langid import keep_known
from folioframe.llm.packing import Tokenizer, pack
from folioframe.llm.queries import BYTE_BPE
from folioframe.llm.simhash import drop_near_copies
from folioframe.llm.substring import drop_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language among the labelled ones; those without a label get one."""
    return keep_known(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of texts that are equal but for blanks."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: fingerprints linked through tables of distances, and similar shingles."""
    return drop_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has."""
    return drop_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, with their places in training sequences."""
    return pack(docs, tokenizer=Tokenizer(BYTE_BPE))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: Language ID, fingerprints and best-fit packing are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
