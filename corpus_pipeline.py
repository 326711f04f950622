"""A training corpus from raw documents, in five stages; each writes what the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm._work import Workspace, table
from skein.llm.language_id import filter_languages, train
from skein.llm.line_dedup import line_dedup
from skein.llm.mixing import mix_sources
from skein.llm.near_dedup import drop_near_duplicates
from skein.llm.packing import pack_documents


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letters, null and empty ones among them, or are long and like
    no learned language. If no row has a language there is nothing to compare with, and all go."""
    return filter_languages(docs, train(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later occurrences of three-line windows; a text may end up empty, no row goes. Null
    texts and rows with a null doc_id stay as they are."""
    return line_dedup(docs, counts=False)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the smallest doc_id: five-word shingles,
    similarity 0.8. Empty texts and rows with a null doc_id stay."""
    return drop_near_duplicates(docs, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in tempered shares; a document that two epochs take appears twice. A null source is
    a source, an empty text counts as one token."""
    return mix_sources(docs, places=False)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: a row for each piece of a document, with its place; an empty text
    is its end token alone."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mix_sources", mix_stage),
    ("best_fit_packing", pack_stage),
]

#: Language profiles, mixing and packing are beyond SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Workspace(spark, "pipeline") as w:
        for _, stage in STAGES[:-1]:
            docs = w.stage(stage(spark, docs, sf_dir))
        return w.keep(STAGES[-1][1](spark, docs, sf_dir))
