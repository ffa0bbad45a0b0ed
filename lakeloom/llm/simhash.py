"""SimHash near-duplicates through a Gray-order hierarchical index.

A text's fingerprint is the bitwise majority of its shingles' XXH64. Fingerprints within
`distance` bits are linked and components formed. To search, the 64 bits are cut into
segments; fingerprints that agree on enough whole segments meet in a bucket (by the
pigeonhole principle no link is missed). Within a bucket they are sorted by Gray rank, so
neighbours share bit patterns; every eight fingerprints get a node that holds the bits all
of them agree on (mask and pattern), every eight nodes get one above, and so on. A search
goes down the tree adding the differences on the bits new at each level and drops a whole
group once the sum exceeds the distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batches, column, forget, fresh, small_batches, table
from .components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
FAN = 8
#: Fingerprints in one block of a bucket; the pairs of a larger bucket's blocks are cells of their own.
CELL = 20_000
#: So many keys of larger buckets are broadcast (2 MB); more are joined.
HOT_KEYS = 100_000
#: (segments, segments that must agree) -> used while a bucket is expected to hold fewer random fingerprints than this.
EXPECTED = 2_000
CHUNK = 1 << 21


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority fingerprint of a UTF-8 text; 0 if it has no word. Fewer words than a shingle make one shingle."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -shingle])).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], np.uint64)
    votes = np.zeros(64, np.int64)
    for part in np.array_split(hashes, max(1, len(hashes) // 65536)):
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **more: Column) -> DataFrame:
    """(doc_id, fp), and more long columns between them: the signed 64-bit fingerprint of every row. A null text has no words: 0."""
    names = ["doc_id", *more]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            fps = np.array([fingerprint(x) for x in as_bytes(b, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in names), pa.array(fps)], [*names, "fp"])

    rows = small_batches(df).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *(c.alias(n) for n, c in more.items()))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "fp"]))


def segment_masks(n: int, distance: int) -> list[int]:
    """Masks of the agreeing segments, chosen so that a bucket expects under EXPECTED random fingerprints."""
    for free in range(1, 5):
        segments = distance + free
        cuts = [round(64 * i / segments) for i in range(segments + 1)]
        if n >> int(64 * free / segments) < EXPECTED:
            break
    one = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(one[i] for i in chosen) for chosen in combinations(range(segments), free)]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of a code in the Gray order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """The tree over fingerprints sorted by (bucket, Gray rank). Nodes never span two buckets."""

    def __init__(self, codes: np.ndarray, bucket: np.ndarray):
        ones = np.full(len(codes), np.uint64(2**64 - 1))
        self.codes, self.levels = codes, []  # of (pattern, mask, first child, end child, last code)
        low, high, owner = codes, codes, bucket
        last = np.arange(len(codes))
        self.levels.append((codes, ones, None, None, last))
        while True:
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
            starts = np.flatnonzero(place % FAN == 0)
            ends = np.append(starts[1:], len(owner))
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            owner, last = owner[starts], last[ends - 1]
            self.levels.append((low, ~(low ^ high), starts, ends, last))
            if len(np.unique(owner)) == len(owner):
                break
        self.root = np.searchsorted(owner, bucket)

    def pairs(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j), i < j, of codes in one bucket within the distance; in bounded pieces."""
        top = len(self.levels) - 1
        every = np.arange(len(self.codes))
        stack = [(top, every[a : a + CHUNK], self.root[a : a + CHUNK], np.zeros(len(every[a : a + CHUNK]), np.uint8)) for a in range(0, len(every), CHUNK)]
        while stack:
            level, query, node, gone = stack.pop()
            if level == 0:
                yield query, node
                continue
            _, above, starts, ends, _ = self.levels[level]
            pattern, mask, _, _, last = self.levels[level - 1]
            width = ends[node] - starts[node]
            if len(node) > 1 and width.sum() > CHUNK:
                half = len(node) // 2
                stack += [(level, query[:half], node[:half], gone[:half]), (level, query[half:], node[half:], gone[half:])]
                continue
            offset = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            child = np.repeat(starts[node], width) + offset
            q = np.repeat(query, width)
            new = mask[child] & ~np.repeat(above[node], width)  # bits that the level above hasn't compared
            d = np.repeat(gone, width) + np.bitwise_count((self.codes[q] ^ pattern[child]) & new)
            keep = (d <= distance) & (last[child] > q)
            stack.append((level - 1, q[keep], child[keep], d[keep]))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index reachable from each of n points over the pairs."""
    label = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label = up
    return label


def _links(rows: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket parts, fp) sorted by bucket -> a spanning forest of each bucket's links."""

    def solve(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((gray_rank(fp), bucket))
        bucket, fp = bucket[order], fp[order]
        root = forest(len(fp), GrayIndex(fp, bucket).pairs(distance))
        hooked = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[root[hooked]].view(np.int64)), pa.array(fp[hooked].view(np.int64))], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    count, number, before = 0, 0, None
    for b in batches(rows):
        keys = np.stack([column(b, x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("t", "key", "x", "y")])
        fp = column(b, "fp").to_numpy().view(np.uint64)
        changes = np.any(keys[:, 1:] != keys[:, :-1], axis=0)
        starts_new = before is not None and bool((keys[:, 0] != before).any())
        ids = number + starts_new + np.concatenate(([0], np.cumsum(changes)))
        before, number = keys[:, -1], int(ids[-1])
        if count > 200_000:  # enough for one go: all but the bucket that may go on
            cut = int(np.searchsorted(ids, held[-1][0][-1], side="right"))
            if cut < len(ids):
                held.append((ids[:cut], fp[:cut]))
                yield solve(*(np.concatenate(x) for x in zip(*held)))
                held, count, ids, fp = [], 0, ids[cut:], fp[cut:]
        held.append((ids, fp))
        count += len(ids)
    if held:
        yield solve(*(np.concatenate(x) for x in zip(*held)))


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Distinct (fp) -> (a, b): links that join all that is within the distance, at most n - 1 a bucket.

    Buckets over CELL fingerprints are cut into blocks of about CELL; each pair of blocks is
    a cell of its own, so no task holds more than two blocks at a time, however large the input.
    """
    masks = segment_masks(fps.count(), distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)])).alias("k")).select("k.t", "k.key", "fp")
    hot = table(keyed.groupBy("t", "key").count().where(F.col("count") > CELL).select("t", "key", F.ceil(F.col("count") / CELL).cast("int").alias("blocks")))
    cells = keyed.join(F.broadcast(hot) if hot.count() <= HOT_KEYS else hot, ["t", "key"], "left").withColumn("own", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")))
    others = F.transform(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1), lambda o: F.struct(F.least(F.col("own"), o).alias("x"), F.greatest(F.col("own"), o).alias("y")))
    cells = cells.select("t", "key", "fp", F.explode(others).alias("c")).select("t", "key", "c.x", "c.y", "fp")
    cells = cells.repartition("t", "key", "x", "y").sortWithinPartitions("t", "key", "x", "y")
    return cells.mapInArrow(lambda rows: _links(rows, distance), "a long, b long")


def _rooted(points: DataFrame, distance: int) -> DataFrame:
    """points (fp, ...) with the root of each fingerprint's component, a fingerprint of it."""
    roots = components(links(points.select("fp"), distance))
    return table(points.join(roots, points.fp == roots.node, "left").select(*points.columns, F.coalesce("root", "fp").alias("root")))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id linked through fingerprints.

    Nulls: a null text has fingerprint 0 and is linked like any other; a row with null
    doc_id keeps its fingerprint and links, and never names a component unless all its
    members lack an id (then component_id is null). Repeated rows give repeated rows. Other
    columns are not read. Equal fingerprints are one point of the search, so a group of
    copies of any size costs one.
    """
    docs = table(fingerprints(df, doc_id, text))
    points = table(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    rooted = _rooted(points, distance)
    forget(points)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The rows of df, all columns, one of each component of near duplicates.

    That with the smallest doc_id stays; of several such rows (ids may repeat) that with the
    smallest hash of all its columns. Rows without an id stay only if no row of the
    component has one. Rows alike in every column count as one. Unrelated texts under one
    doc_id are different documents and both stay.
    """
    names = [fresh(df, f"row_key_{k}") for k in (1, 2)]  # 128 bits
    whole = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    keyed = df.withColumns({n: F.xxhash64(F.lit(n), *whole) for n in names})
    docs = table(fingerprints(keyed, doc_id, text, a=F.col(names[0]), b=F.col(names[1])))
    points = table(docs.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "a", "b")).alias("first")))
    forget(docs)
    chosen = _rooted(points, distance).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.a").alias(names[0]), F.col("first.b").alias(names[1]))
    return keyed.join(chosen, names, "left_semi").dropDuplicates(names).select(*[F.col(f"`{c}`") for c in df.columns])


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
