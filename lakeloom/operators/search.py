"""Search operators: an inverted index with ranking, and cosine neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.columns import words


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, doc_id, tf): partial counts before the shuffle."""
    return docs.select(doc_id, F.explode(words(F.col(text))).alias("word")).groupBy("word", doc_id).agg(F.count("*").alias("tf"))


def ranked(docs: DataFrame, terms: list[str], n: int) -> DataFrame:
    """Top documents by sum of tf * ln(1 + N / df). Only the query's words leave the scan."""
    hits = docs.select("doc_id", F.explode(F.filter(words(F.col("text")), lambda w: w.isin(terms))).alias("word")).groupBy("word", "doc_id").agg(F.count("*").alias("tf"))
    df = hits.groupBy("word").agg(F.count("*").alias("df"))  # a row for each term
    size = docs.agg(F.count("*").alias("n"))  # one row
    scored = hits.join(F.broadcast(df), "word").crossJoin(F.broadcast(size))
    return scored.groupBy("doc_id").agg(F.round(F.sum(F.col("tf") * F.ln(1 + F.col("n") / F.col("df"))), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(n)


def cosine_neighbours(vectors: DataFrame, vec_id: int, n: int) -> DataFrame:
    """Nearest vectors to one by cosine."""
    one = vectors.where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q")).limit(1)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    both = vectors.where(F.col("vec_id") != vec_id).crossJoin(F.broadcast(one))  # one row
    e, q = F.col("embedding"), F.col("q")
    norm = F.sqrt(dot(e, e)) * F.sqrt(dot(q, q))
    return both.select("vec_id", F.round(F.when(norm > 0, dot(e, q) / F.nullif(norm, F.lit(0.0))).otherwise(0.0), 6).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(n)
