"""A corpus pipeline: quality, near-duplicates, repeated passages, mixing, tokens.

Every stage takes null in any column, texts of any length, repeated rows, other columns (also ones named like those that
the operators make) and empty tables: blank texts are rejected by the first stage; a row without doc_id is a document of
its own, known by its text; rows that repeat a doc_id and a text are one from the second stage on; a null source is a source of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featsel.llm import bpe, minhash_dedup, quality, source_mixing, substring_dedup
from featsel.llm.common import Scratch, written


def _with_own_names(step, docs: DataFrame, made: tuple[str, ...]) -> DataFrame:
    """step(docs) with the columns of docs, also those that are named like columns that the step makes."""
    aside = {c: f"_aside_{c}" for c in made if c in docs.columns}
    out = step(docs.withColumnsRenamed(aside)).select([aside.get(c, c) for c in docs.columns])
    return out.withColumnsRenamed({v: k for k, v in aside.items()})


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps."""
    return _with_own_names(lambda d: quality.classify(d).where("kept"), docs, ("quality_score", "kept"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; repeated rows are copies too."""
    return minhash_dedup.one_of_each_group(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its words in passages that occur anywhere else; one that has no other words goes."""
    return substring_dedup.without_repeats(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the target shares of their sources and shuffled."""
    return _with_own_names(source_mixing.mix, docs, ("copy", "shuffle_key", "_source", "_rate", "_u", "_n"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens and what the ids decode to, one row a copy."""
    words = bpe.vocabulary()
    out = bpe.round_trip(docs.select("doc_id", "source", "text"), words).withColumn("text", F.decode("bytes", "UTF-8"))
    return out.drop("bytes").withColumn("n_tokens", F.size("ids"))


STAGES = [
    ("quality classifier", good_documents),
    ("MinHash near-dedup", one_of_each_group),
    ("substring dedup", without_repeats),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", encoded),
]

#: SQL can express neither the trained classifier nor the merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over `documents`, each written and read again; what a stage has read is deleted once its own
    rows are written. The last stage's input stays, as the result still reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        scratch = Scratch(spark)
        docs = written(stage(spark, docs, sf_dir), scratch)
        if before:
            before.drop()
        before = scratch
    return STAGES[-1][1](spark, docs, sf_dir)
