"""The corpus pipeline: language ID, line dedup, near-dedup, mixing and packing of ``documents``.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it. All stages but the last
return the columns of ``docs``, whatever these are; all take empty tables (no rows) and nulls in any column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import langid, linededup, mixing, packing, simhash
from gridloom.llm.queries import tokenizer_path
from gridloom.llm.shared import held_out, unwrap, work_path, wrap


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter or unlike every language go.

    Null and empty texts have no letter. Repeated rows stay or go together. Where no language is labelled only texts
    without a letter go.
    """
    model = langid.fit(docs, ~held_out(docs["doc_id"]))
    rows = wrap(docs)
    return unwrap(langid.identify(rows, model, rows.columns).where("NOT rejected"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut from the texts; every row stays.

    Occurrences are ordered by doc_id (null last), a hash of the text and the place; rows of equal doc_id and text get
    the same cut. Null texts stay null; a text may become empty.
    """
    return unwrap(linededup.dedup_lines(wrap(docs)), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by five-word shingles: the smallest doc_id, nulls last.

    Of rows that repeat one stays. Null texts and texts without a word are copies of each other.
    """
    return simhash.keep_one(docs, size=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, none to two times, by a draw that depends on the doc_id.

    A null source is a source of its own; null texts have size 0 and are drawn like others of their source.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all rows in sequences of 2048; a null or empty text is its end mark alone, repeated rows stay."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Language models and tokens cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
