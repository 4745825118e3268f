"""A training-data pipeline over `documents`: quality, near-duplicates, repeated strings, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import importance, minhash, packing, suffix_dedup
from foliant.llm._common import by_position, materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps.

    A null or empty text, or one without words, digits or marks, is rejected; texts are read whole, however long; equal rows are
    drawn alike, ties by hash; an empty table gives an empty table; columns of any name come through as they are.
    """
    return importance.select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words and a similarity of 0.8, that of the smallest doc_id, then of the least hash.

    Of repeated rows one stays; texts without words, null ones too, are no duplicates and all stay; a null doc_id is no smallest one;
    texts are read whole; an empty table gives an empty table; columns of any name come through as they are.
    """
    return minhash.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that start more than once; n_chars follows the text, and documents of which nothing is left go.

    Null and empty texts, and those that are too short to have such a string, stay as they are; repeated rows lose what they share, like any
    others; texts are read whole; an empty table gives an empty table; columns of any name come through as they are.
    """
    base, at = by_position(docs), {n: f"c{i}" for i, n in enumerate(docs.columns)}
    left = suffix_dedup.clean(base, at["doc_id"], at["text"]).where("n_removed = 0 or n_removed < n_bytes")
    if n := at.get("n_chars"):
        left = left.withColumn(n, F.when(F.col("n_removed") > 0, F.char_length(at["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return left.select(*base.columns).toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens.

    A null or empty text is its end id alone; repeated rows are packed as often as they occur; texts are read whole; an empty table gives
    an empty table; only doc_id and text are read.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("packed", packed)]

#: Hashed models, signatures and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs if name == STAGES[-1][0] else materialise(docs)
    return docs
