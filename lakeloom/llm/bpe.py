"""Byte-level BPE by a rank queue on a hierarchical bitmap, and its inverse.

A pre-token is a linked list of parts. Each adjacent pair that has a merge rank waits in
that rank's bucket, under the position of its left part. A two-level bitmap says which
buckets hold something: find-first-set, level by level, gives the lowest rank at once, so
n bytes take about n log n steps where a scan for the lowest pair takes n squared. Entries
whose pair has changed meanwhile are stale and skipped when met.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, batches, column, small_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens whose ids a worker remembers in each of two generations.
REMEMBERED = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the lowest rank merges first, the leftmost pair of it first.

    The queue is kept in local names, for speed: `buckets` maps a rank to a heap of
    positions; bit r of the bitmap says that bucket r holds something, in words of 256
    bits, and bit w of `top` that word w isn't zero.
    """
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    # the rank under which the pair that begins here waits; None if it can't merge
    waiting = [get(piece[i : i + 2]) for i in range(n)]
    waiting[-1] = None
    buckets: dict[int, list[int]] = {}
    low: dict[int, int] = {}
    top = 0
    for i, rank in enumerate(waiting):
        if rank is not None:
            if rank in buckets:
                buckets[rank].append(i)  # positions rise: the list is a heap already
            else:
                buckets[rank] = [i]
                word = rank >> 8
                if word in low:
                    low[word] |= 1 << (rank & 255)
                else:
                    low[word] = 1 << (rank & 255)
                    top |= 1 << word
    while top:
        # find first set, word by word
        word = (top & -top).bit_length() - 1
        bits = low[word]
        first = bits & -bits
        rank = (word << 8) + first.bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) > 1:
            i = heappop(bucket)
        else:
            i = bucket[0]
            del buckets[rank]
            if bits == first:
                del low[word]
                top &= top - 1
            else:
                low[word] = bits ^ first
        if waiting[i] != rank:  # stale: the pair has changed since
            continue
        j = end[i]
        stop = end[i] = end[j]
        waiting[j] = None
        if stop < n:
            before[stop] = i
            rank = waiting[i] = get(piece[i : end[stop]])
            if rank is not None:
                if rank in buckets:
                    heappush(buckets[rank], i)
                else:
                    buckets[rank] = [i]
                    word = rank >> 8
                    if word in low:
                        low[word] |= 1 << (rank & 255)
                    else:
                        low[word] = 1 << (rank & 255)
                        top |= 1 << word
        else:
            waiting[i] = None
        if i:
            h = before[i]
            rank = waiting[h] = get(piece[h:stop])
            if rank is not None:
                if rank in buckets:
                    heappush(buckets[rank], h)
                else:
                    buckets[rank] = [h]
                    word = rank >> 8
                    if word in low:
                        low[word] |= 1 << (rank & 255)
                    else:
                        low[word] = 1 << (rank & 255)
                        top |= 1 << word
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder(dict):
    """Pre-token -> its ids as little-endian bytes; remembers a bounded number, in two generations."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.old: dict[str, bytes] = {}
        self.parts = [b""] * (max(ranks.values()) + 1)
        for part, rank in ranks.items():
            self.parts[rank] = part

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(piece)
        if ids is None:
            ids = array("I", encode_piece(piece.encode("utf-8", "surrogatepass"), self.ranks)).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """All ids of a text, four bytes each."""
        return b"".join(map(self.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.parts.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: The encoder of this worker process, by vocabulary file and pattern.
_encoders: dict[str, Encoder] = {}


def tokenize(df: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of every row.

    ids is binary, four little-endian bytes a token. A null or empty text has no tokens.
    Repeated rows give repeated rows; other columns are not read. The vocabulary is
    broadcast: its size is that of a published file.
    """
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))
    tag = f"{ranks_path}:{pattern}"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _encoders:
            _encoders.clear()
            _encoders[tag] = Encoder(ranks.value, pattern)
        encoder = _encoders[tag]
        for b in batches(rows):
            ids = [encoder.encode(x) for x in as_text(b, "text")]
            yield pa.RecordBatch.from_arrays(
                [
                    column(b, "doc_id"),
                    pa.array(ids, pa.binary()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = small_batches(df).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(tokens: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """Add `text`: the bytes of the ids as UTF-8. Null ids give null."""
    ranks = load_ranks(ranks_path)
    parts = [b""] * (max(ranks.values()) + 1)
    for part, rank in ranks.items():
        parts[rank] = part
    shared = tokens.sparkSession.sparkContext.broadcast(parts)

    @F.pandas_udf("string")
    def back(series):
        part = shared.value.__getitem__
        return series.map(lambda x: None if x is None else b"".join(map(part, np.frombuffer(x, "<u4").tolist())).decode("utf-8", "replace"))

    return tokens.withColumn("text", back(ids))


def vocabulary() -> tuple[str, str]:
    """Path of the published rank file and its pre-token pattern."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    out = tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, pattern)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
