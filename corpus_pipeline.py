"""From raw documents to packed training sequences: five stages, each one operator of quillspark.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``docs`` is what the stage before kept, as Parquet. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontamination, langid, minmax, packing, suffix_dedup
from quillspark.llm._stage import Stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach; those without letters or in no known language go."""
    return langid.keep_known(docs.select(*COLUMNS), langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8); rows that repeat a doc_id are judged by their texts."""
    return minmax.keep_one(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words, and the 400-byte strings, that occur more than once; n_chars follows."""
    cut = suffix_dedup.remove_repeats(docs, span=400, carry=("lang", "source"), words=51, as_text=True)
    cut = cut.select(F.col("kept").alias("text"), "doc_id", "carried.lang", "carried.source")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    found = decontamination.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = Stage(spark, "leaks").save(found.select("doc_id").distinct(), "found")
    return docs.select(*COLUMNS).join(found, "doc_id", "left_anti").select(*COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_languages),
    ("minhash_neardup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("best_fit_packing", packed_sequences),
]

#: Learned models, hashing and tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        out = step(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = stage.save(out, name)
    raise AssertionError("unreachable")
