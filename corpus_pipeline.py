"""A training corpus from documents: language, shared lines, near-duplicates, benchmark leaks, packed sequences.

Each stage works on all that the one before has kept; between stages the
documents are written as Parquet. All but the last return the columns of
``documents``, whatever their names and number; a stage's own columns never
meet them. An empty table gives no rows in every stage. Rows are judged one by
one but for near-duplicates, where rows with the same id are one document.

* language: null and empty texts, and texts without letters, are rejected.
  Repeated rows get the same verdict. Documents without any label to learn from
  are refused with an error rather than all rejected.
* lines: null and empty texts stay as they are, as do rows without id.
  Repeated rows lose the same lines; the largest id keeps a shared line.
* near_duplicates: null and empty texts and rows without id are like nothing
  and stay. All rows with the kept id stay; of equally good ones the smallest id does.
* decontamination: null and empty texts hold no item and stay.
* packing: null and empty texts are a single end id; rows with the same id are
  separate documents, in ascending order of id.

Very long texts are read whole in every stage. Stages that run Python bound the
session's batches for it (``shared.small_batches``), unless it has its own bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, lang_id, line_dedup, near_dedup, packing
from quillon.llm.shared import materialize, small_batches
from quillon.llm.tokens import vocabulary

#: SQL can't express compression, signatures, edit distances or tokenizers; the tests hold the stages against brute force.
ORACLE_SQL = None


def _apart(docs: DataFrame) -> DataFrame:
    """Id and text, and the other columns as one, so that no stage's columns meet them."""
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("doc"))


def _whole(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin stay."""
    small_batches(spark)
    dictionaries = lang_id.learn(docs.where(~lang_id.held_out()))
    if dictionaries.isEmpty() and not docs.isEmpty():
        raise ValueError("no document has a label, so no language can be learned")
    return _whole(lang_id.identify(_apart(docs), dictionaries).where("accepted"), docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go, but for one of each."""
    return _whole(line_dedup.drop_shared_lines(_apart(docs)), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    small_batches(spark)
    gone = near_dedup.groups(docs, words=5, similarity=80).where(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct()
    return docs.alias("docs").join(gone.alias("gone"), F.col("docs.doc_id") == F.col("gone.id"), "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of fixed length."""
    small_batches(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
