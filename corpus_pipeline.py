"""The corpus pipeline: stages over documents, each written and reread as the next one's input.

quality rules, line dedup, near-dedup, mixing, tokens. Every stage but the last returns the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from hypso.llm import common, mixing, neardup, pieces, quality, repeats


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_tables: common.Tables = []


def _tidy(stage: Stage) -> Stage:
    """The stage, which first removes the tables that the stage before it wrote on its way: its result is written."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.remove(_tables)
        with common.noted(_tables):
            return stage(spark, docs, sf_dir)

    return run


@_tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality.quality_stage(docs)


@_tidy
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines that occur earlier; documents with no word left go."""
    return repeats.line_stage(docs)


@_tidy
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.one_of_each(docs)


@_tidy
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: rows as often as they are taken, in the order of their positions."""
    return mixing.training_order(docs)


@_tidy
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with the text that they decode to in place of the text itself."""
    found = pieces.encoded(docs, keep=[c for c in docs.columns if c != "text"])
    return found.withColumnRenamed("decoded", "text")


STAGES = [
    ("quality", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("tokens", tokens),
]

#: The stages go beyond what SQL can state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder, and removed
    when the next one's is written (the last of them when the process ends)."""
    docs = common.table(spark, sf_dir, "documents")
    before: common.Tables = []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            after: common.Tables = []
            with common.noted(after):
                docs = common.written(docs)
            common.remove(before)
            before = after
    common.keep(before)
    return docs
