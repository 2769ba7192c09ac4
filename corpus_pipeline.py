"""A corpus pipeline of four stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import byte_bpe, crf_language, edit_match, lsh_forest
from geoloom.llm._shared import crc_mod, materialize, table
from geoloom.llm.queries import _tokenizer

#: Documents whose language has a smaller share of their words are rejected.
MIN_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or without a language that ``MIN_SHARE`` of their words have, go.

    The model learns from rows with text and language whose id is not in the held-out quarter; without
    such rows, all go; of an empty table nothing is left. Each row is judged by itself, whole, whatever its id, repeats and other columns.
    """
    model = crf_language.fit(docs.where(crc_mod("doc_id", 4) != 2))
    found = crf_language.predict(docs, model, label_col="__label", score_col="__share")
    return found.where((F.col("__label") != crf_language.UNKNOWN) & (F.col("__share") >= MIN_SHARE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest id.

    Null and empty texts are in no group. Rows without an id stay; of rows that share one, one stays.
    Whole texts are compared; all columns are kept. An empty table stays empty.
    """
    return lsh_forest.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, and so do rows that share an id with one.

    Null and empty texts and items hold nothing; an empty benchmark removes nothing. Whole texts
    are searched; all columns are kept. An empty table stays empty.
    """
    return edit_match.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_tokens, whole): token ids of each whole text, and whether they give it back.

    A null or empty text has no ids and is whole. Each row is coded by itself; other columns than these are left. An empty table gives an empty result.
    """
    ranks, pattern = _tokenizer()
    coded = byte_bpe.decode(byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, pattern), ranks)
    whole = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), whole.alias("whole"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]

#: No stage can be said in SQL; tests/llm/test_pipeline.py holds run() against a plain version of all four.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
