"""From raw documents to token ids: five stages, each over all that the one before it kept.

Language ID drops documents without a language and writes the language found into ``lang``, line dedup keeps the first of near-equal lines,
SimHash keeps one document of each near-duplicate group, mixing repeats or leaves out documents
until the sources have their target weights, and BPE encodes what is left. Each stage's result is
written and read back before the next one begins; what a stage wrote for itself goes then.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import bpe, language, lines, mixing, simhash
from shelfwise.llm.common import table
from shelfwise.session import cut_lineage, cuts_since, cuts_so_far, drop_these

VOCABULARY = "word_bpe_49k.json"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# copies that stages wrote for themselves, by application and stage
_copies: dict[tuple[str, str], list[str]] = {}


def after(stage_before: str | None, name: str, stage: Stage) -> tuple[str, Stage]:
    """``stage`` by its ``name``; the copies that the stage before wrote for itself go when it
    begins, for that one's result has been written by then. Other copies are not touched."""

    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application = spark.sparkContext.applicationId
        drop_these(spark, _copies.pop((application, stage_before), []))
        before = cuts_so_far(spark)
        result = stage(spark, docs, sf_dir)
        _copies.setdefault((application, name), []).extend(cuts_since(spark, before))
        return result

    return name, begun


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; ``lang`` is the one found, not the label."""
    return language.with_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that nearly repeat an earlier one."""
    return lines.without_duplicate_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights; documents repeat as often as they are taken."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return bpe.digests(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    after(None, "language_id", languages),
    after("language_id", "line_dedup", line_dedup),
    after("line_dedup", "simhash_near_dedup", near_dedup),
    after("simhash_near_dedup", "mixing", mix),
    after("mixing", "bpe", encode),
]
# language models, fingerprints and merges cannot be stated in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
