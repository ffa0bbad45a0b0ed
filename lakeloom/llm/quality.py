"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of trusted against raw text.

Byte n-grams are hashed into a fixed number of buckets. Two multinomials are counted: over
a trusted sample (documents labelled good) and over the whole corpus. A text's score is the
mean over its n-grams of log p_trusted - log p_raw; every document at or above the threshold
is kept, so the verdict depends on the text and the model alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batches, bounded_ids, column, small_batches

GRAM, BUCKETS = 3, 1 << 15
#: Labelled documents that teach the trusted multinomial: at most this many.
TRUSTED = 50_000
MIN_WORDS, WINDOW, REPEATED = 20, 8, 30
#: Mean log ratio (nats an n-gram) from which a document is kept.
THRESHOLD = -0.5
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated 8-word windows)."""
    words = text.split()
    n = len(words)
    points = len(text.decode("utf-8", "replace")) - sum(map(text.count, (SPACES[i : i + 1] for i in range(6)))) if not text.isascii() else sum(map(len, words))
    symbols = sum(map(text.count, (SYMBOLS[i : i + 1] for i in range(8))))
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return n, points, symbols, len(lines) - len(set(lines)), _repeated(words)


def _repeated(words: list[bytes]) -> int:
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    windows, factor = np.zeros(n, np.uint64), 1
    for j in range(WINDOW):
        windows += hashes[j : j + n] * np.uint64(factor)
        factor = factor * 0x9E3779B97F4A7C15 % (1 << 64)
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(windows, twice))
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    return int((np.cumsum(step) > 0).sum())


def grams(text: bytes) -> np.ndarray:
    """Bucket of each byte n-gram of a text; all white space counts as one blank."""
    data = np.frombuffer(b" ".join([b"", *text.split(), b""]), np.uint8).astype(np.uint32)
    n = len(data) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    code = data[:n].copy()
    for j in range(1, GRAM):
        code <<= np.uint32(8)
        code |= data[j : j + n]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - (BUCKETS - 1).bit_length())


def fit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", bound: int = TRUSTED) -> np.ndarray:
    """Log ratio of each bucket: trusted documents (a bounded sample of those labelled good) against all documents."""
    trusted = bounded_ids(labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", bound)

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches(rows):
            for x, label in zip(as_bytes(b, "text"), column(b, "good").to_pylist()):
                counts = np.bincount(grams(x), minlength=BUCKETS)
                raw += counts
                if label:
                    good += counts
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "good"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(trusted.withColumn("good", F.lit(True))), "doc_id", "left").select("text", "good")
    total = small_batches(rows).mapInArrow(count, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw"), F.sum("good"))
    raw, good = np.ones(BUCKETS), np.ones(BUCKETS)
    for bucket, r, g in total.collect():  # at most BUCKETS rows
        raw[bucket] += r
        good[bucket] += g
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def score(text: bytes, ratio: np.ndarray) -> float:
    """Mean log ratio of a text's n-grams; 0 for a text without a word."""
    at = grams(text)
    return float(ratio[at].mean()) if len(at) else 0.0


def rate(df: DataFrame, ratio: np.ndarray, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, base_failed, score and kept of every row.

    A null or empty text has no words and fails. Repeated rows give repeated rows; other
    columns are not read. No shuffle.
    """
    model = df.sparkSession.sparkContext.broadcast(ratio)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            texts = as_bytes(b, "text")
            n, points, symbols, lines, repeats = (np.array(x, np.int64) for x in zip(*map(base_counts, texts)))
            failed = (n < MIN_WORDS) | (100 * repeats > REPEATED * n)
            scores = np.array([score(x, model.value) for x in texts])
            arrays = [column(b, "doc_id"), *map(pa.array, (n, points, symbols, lines, repeats, failed, ~failed & (scores >= threshold), scores))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"])

    rows = small_batches(df).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rate(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
