"""A corpus pipeline of five operators. Each stage reads the documents its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. run() writes each stage's result to the shared folder and reads it
back, so a lost executor redoes one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import bpe, decontaminate, linededup, simhash, toxicity
from lakeloom.llm.common import forget, fresh, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity model rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete passages that an earlier document has; a document that loses all its words goes. n_chars follows the text."""
    names = fresh(docs, "lines_removed"), fresh(docs, "held_by")
    out = linededup.dedup_lines(docs, names=names)
    changed = F.col(names[0]) > 0
    out = out.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]") | F.col("text").isNull())
    return out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates: that with the smallest id."""
    return simhash.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of the bytes they decode to."""
    return bpe.tokenize(docs, *bpe.vocabulary())


STAGES = [
    ("toxicity", toxic),
    ("line_dedup", repeated_lines),
    ("simhash", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("bpe", tokens),
]

#: Trained models and alignments have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, table(stage(spark, docs, sf_dir))
        if number:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
