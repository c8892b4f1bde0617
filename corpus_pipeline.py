"""The corpus pipeline: identify languages, drop copies and near copies, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
``run`` writes every stage as Parquet in the shared folder and reads it again, so a lost
executor costs at most one stage. Extra columns, of any name, go through all stages but the
last; an empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamella.llm._shared import durable, read
from lamella.llm.exact_dedup import drop_exact_copies
from lamella.llm.language_id import keep_identified
from lamella.llm.mixing import mix
from lamella.llm.near_dedup import drop_near_copies
from lamella.llm.packing import packing


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified.

    Null, empty and letterless texts go, and texts beyond the calibrated limits of all languages;
    where no document is labelled, all go. Rows without an id or label are judged like others,
    repeated rows alike.
    """
    return keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id.

    Exactly one row of each text stays: of rows that repeat the id, or have none, the one whose whole
    row has the largest hash. Null texts equal empty ones.
    """
    return drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id.

    Exactly one row of each group stays; rows without an id come last, ties go by hashes of text
    and row. Texts without words are in no group and stay.
    """
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    The null source is one of its own, last in order. Texts without words are in no mix. Rows that
    repeat an id and length class are taken equally often.
    """
    return mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences.

    Repeated rows are numbered by ``copy`` and lie in different bins; ties go by id, copy and text
    hash. Rows without an id are packed like others.
    """
    return packing(docs)


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near),
    ("mixing", mix_sources),
    ("packing", pack),
]

# The language models and the solver of the mix have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
