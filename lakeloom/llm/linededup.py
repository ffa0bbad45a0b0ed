"""Line dedup by pairwise alignment.

A line here is a run of BLOCK_WORDS words, wherever it begins: texts wrap their lines
differently. Documents meet through winnowed line hashes, the lowest among each WINDOW
neighbouring ones: documents that share a passage of BLOCK_WORDS + WINDOW - 1 words share all
its windows, hence a hash. Hashes of one document alone go before the join. Of those that
several share, the document with the smallest id holds the original, and a later document is
paired with the holders of its hashes: as many pairs as shared hashes at most, however many
documents share one, and none that has nothing to delete. Each pair is aligned by patience
diff on the lines that occur once on both sides, and the aligned common blocks are deleted
from the later document, to the last word. What an alignment leaves, moved blocks, is aligned
again, and repetitions of an aligned block go with it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, batches, column, fresh, small_batches, table

#: Words of the runs that pair documents, and of a common run that is deleted.
BLOCK_WORDS = 25
#: Neighbouring runs of words of which the lowest pairs documents: no common passage of 40 words is missed.
WINDOW = 16
#: Fewer words than this that a holder adds to the passage of a smaller one are neighbours by chance, and stay.
CHANCE = 5
#: Alignments of a pair; blocks that cross each other more often are taken one by one.
ROUNDS = 32
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of a text, and where each \\n-split line ends, counted in words."""
    hashes, ends = [], []
    for line in text.split(b"\n"):
        hashes.extend(map(xxhash.xxh3_64_intdigest, line.split()))
        ends.append(len(hashes))
    return np.array(hashes, np.uint64), np.array(ends, np.int64)


def word_runs(h: np.ndarray) -> np.ndarray:
    """The key of each run of BLOCK_WORDS words."""
    n = len(h) - BLOCK_WORDS + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    power, back = _powers(len(h))
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum((h ^ (h >> np.uint64(31))) * power[: len(h)])))
    key = (prefix[BLOCK_WORDS:] - prefix[:n]) * back[:n]
    key ^= key >> np.uint64(32)
    return (key * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def winnowed(keys: np.ndarray) -> np.ndarray:
    """The distinct lowest keys of all WINDOW neighbours; all keys where there are fewer."""
    if len(keys) < WINDOW:
        return np.unique(keys)
    low, size = keys, 1
    while size < WINDOW:
        step = min(size, WINDOW - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    return np.unique(low)


class Lines:
    """The line hashes of an earlier document, in order of the hash: each with its first place and its number."""

    def __init__(self, runs: np.ndarray):
        self.runs = runs
        self.known, self.first, self.number = np.unique(runs, return_index=True, return_counts=True)


def common_words(a: Lines, b: np.ndarray) -> np.ndarray:
    """Flags of the words of b, the hashes of the later document's words, in blocks aligned with a."""
    runs = word_runs(b)
    if not len(a.known) or not len(runs):
        return np.zeros(len(b), bool)
    at = np.minimum(np.searchsorted(a.known, runs), len(a.known) - 1)
    starts = left = np.flatnonzero(a.known[at] == runs)
    aligned = np.zeros(len(a.known), bool)
    for _ in range(ROUNDS):
        if not len(left):
            break
        anchors = _anchors(a, at, left)
        if (np.diff(anchors[:, 0]) <= 0).any():
            anchors = anchors[_rising(anchors[:, 0].tolist())]
        aligned[at[anchors[:, 1]]] = True
        left = left[~aligned[at[left]]]  # repetitions of what is aligned go with it
    gone = np.concatenate((starts[aligned[at[starts]]], left))
    return _cover(gone, gone + BLOCK_WORDS, len(b))


def _anchors(a: Lines, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """(place in a, place in b) of equal lines, by place in b: of those that occur once on both sides, or, if there are none, the first occurrence of each with the first, the second with the second, and so on. at: which of a's lines each line of b is; left: the places of b."""
    line, place, number = np.unique(at[left], return_index=True, return_counts=True)
    once = (number == 1) & (a.number[line] == 1)
    if once.any():
        pairs = np.column_stack((a.first[line[once]], left[place[once]]))
        return pairs[np.argsort(pairs[:, 1])]
    places: dict[int, list[int]] = {}
    for k, x in enumerate(a.runs.tolist()):
        places.setdefault(x, []).append(k)
    seen: dict[int, int] = {}
    out = []
    for k, x in zip(left.tolist(), a.known[at[left]].tolist()):
        nth = seen[x] = seen.get(x, -1) + 1
        if nth < len(places[x]):
            out.append((places[x][nth], k))
    return np.array(out)


def _rising(places: list[int]) -> list[int]:
    """Where the members of a longest rising subsequence stand, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(places)
    for k, x in enumerate(places):
        at = bisect_left(tops, x)
        if at == len(tops):
            tops.append(x)
            piles.append(k)
        else:
            tops[at], piles[at] = x, k
        back[k] = piles[at - 1] if at else -1
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


_made: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, or more, of an odd base and of its inverse, modulo 2 ** 64; some are remembered."""
    known = _made.get("powers")
    if known is None or len(known[0]) < n:
        base = 0x9E3779B97F4A7C15
        known = tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n, 1 << 12), x, np.uint64)))) for x in (base, pow(base, -1, 1 << 64)))
        if n <= 1 << 16:
            _made["powers"] = known
    return known


def _cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Flags of the n positions in any of the ranges."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def signatures(df: DataFrame) -> DataFrame:
    """(doc_id, runs): the distinct winnowed runs of every row. df: doc_id, text."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            runs = [winnowed(word_runs(word_hashes(t)[0])) for t in as_bytes(b, "text")]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(runs, pa.list_(pa.int64()))], ["doc_id", "runs"])

    return small_batches(df).mapInArrow(run, "doc_id long, runs array<long>")


def deletions(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lines, passages, sources): for each document that repeats an earlier one, the numbers of the \\n-split lines that lose words, the words to delete as ranges [start, stop) and the earlier ids.

    Rows without an id or a word take no part. Rows that share an id are one document: each
    of their texts is compared, and a position is deleted in all of them.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL")
    each = table(signatures(rows)).select("doc_id", F.explode("runs").alias("h"))
    shared = each.groupBy("h").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("other")).where("holder < other").select("h", "holder")
    pairs = table(each.join(shared, "h").where("holder < doc_id").select("doc_id", "holder").distinct())
    later = pairs.join(_perhaps(rows, pairs.select("doc_id")), "doc_id")
    held = _perhaps(rows, pairs.select(F.col("holder").alias("doc_id"))).select(F.col("doc_id").alias("holder"), F.col("text").alias("earlier"))
    both = later.join(held, "holder")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for b in batches(rows):
            ended, spans = [], []
            for earlier, text in zip(as_bytes(b, "earlier"), as_bytes(b, "text")):
                if known is None or earlier != last:
                    last, known = earlier, Lines(word_runs(word_hashes(earlier)[0]))
                h, ends = word_hashes(text)
                ended.append(ends.astype(np.int32))
                spans.append([{"start": x, "stop": y} for x, y in _ranges(common_words(known, h))])
            span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "holder"), pa.array(ended, pa.list_(pa.int32())), pa.array(spans, pa.list_(span))], ["doc_id", "holder", "ends", "passages"])

    cut = small_batches(both.select("doc_id", "holder", "earlier", "text")).mapInArrow(run, "doc_id long, holder long, ends array<int>, passages array<struct<start:int,stop:int>>").where(F.size("passages") > 0)
    # a document has at most as many holders as runs
    held = cut.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("holder", "ends", "passages"))).alias("held"))

    def merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            found = list(map(merged, column(b, "held").to_pylist()))
            span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
            spans = [[{"start": x, "stop": y} for x, y in f[1]] for f in found]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array(spans, pa.list_(span)), pa.array([f[2] for f in found], pa.list_(pa.int64()))], ["doc_id", "lines", "passages", "sources"])

    return small_batches(held).mapInArrow(merge, "doc_id long, lines array<int>, passages array<struct<start:int,stop:int>>, sources array<long>")


def _perhaps(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is among the ids, and few others: a bitmap of hashed ids, 8 MB at most, keeps texts that no pair needs out of the shuffle."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 26))
    bits = ids.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    asked = rows.withColumn("p", place).join(F.broadcast(bits), F.expr("bitmap_bucket_number(p) = bucket"))
    byte = F.expr("cast(conv(hex(substring(bits, cast(bitmap_bit_position(p) div 8 + 1 as int), 1)), 16, 10) as int)")
    return asked.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(p) % 8 as int))")) != 0).select(*rows.columns)


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])))).tolist()
    return list(zip(edges[::2], edges[1::2]))


def merged(held: list[dict]) -> tuple[list[int], list[tuple[int, int]], list[int]]:
    """(lines, passages, sources) of a document from what it shares with each holder, the smallest id first."""
    gone = np.zeros(max(p["stop"] for x in held for p in x["passages"]), bool)
    touched, sources = set(), []
    for x in held:
        new = np.zeros(len(gone), bool)
        for p in x["passages"]:
            new[p["start"] : p["stop"]] = True
        for a, b in _ranges(new & ~gone):
            if b - a >= CHANCE or not gone[max(a - 1, 0) : b + 1].any():
                gone[a:b] = True
                touched.update(np.searchsorted(x["ends"], np.arange(a, b), side="right").tolist())
                if x["holder"] not in sources:
                    sources.append(x["holder"])
    return sorted(touched), _ranges(gone), sources


def cut_words(text: bytes, passages: list[tuple[int, int]]) -> bytes:
    """The text without the words of these ranges; a line of the text that loses all its words goes whole."""
    gone = np.zeros(len(text.split()), bool)
    for a, b in passages:
        gone[a:b] = True
    out, i = [], 0
    for line in text.split(b"\n"):
        spans = [m.span() for m in WORD.finditer(line)]
        flags = gone[i : i + len(spans)]
        i += len(spans)
        if not flags.any():
            out.append(line)
        elif not flags.all():
            kept, at = [], 0
            for k, (a, b) in enumerate(spans):
                if flags[k]:
                    kept.append(line[at:a])
                    at = spans[k + 1][0] if k + 1 < len(spans) else b
            kept.append(line[at:])
            out.append(b"".join(kept))
    return b"\n".join(out)


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", names: tuple[str, str] | None = None) -> DataFrame:
    """df with a new text, and two more columns: how many lines lost words (long), and the ids that hold them (array<long>).

    The columns are called `names`, which df must not have; by default lines_removed and
    sources, with underscores while df has a column of that name. Null texts and rows
    without an id stay as they are. Repeated rows stay repeated. An empty table stays empty.
    """
    lost, holders = names or (fresh(df, "lines_removed"), fresh(df, "sources"))
    if lost == holders or {lost.lower(), holders.lower()} & {c.lower() for c in df.columns}:
        raise ValueError(f"the names {lost} and {holders} are taken")
    columns = df.columns
    own = {x: fresh(df, x) for x in ("found_id", "found_lines", "found_passages", "found_sources")}
    found = deletions(df, doc_id, text).select(*[c.alias(n) for c, n in zip((F.col("doc_id"), F.size("lines"), F.col("passages"), F.col("sources")), own.values())])

    def rewrite(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            cuts, texts = [[(p["start"], p["stop"]) for p in x or ()] for x in column(b, own["found_passages"]).to_pylist()], column(b, text)
            if any(cuts):
                kept = [cut_words(x.encode("utf-8", "surrogatepass"), c).decode("utf-8", "surrogatepass") if c and x is not None else x for x, c in zip(texts.to_pylist(), cuts)]
                texts = pa.array(kept, texts.type)
            gone = pa.array([n or 0 for n in column(b, own["found_lines"]).to_pylist()], pa.int64())
            held = pa.array([x or [] for x in column(b, own["found_sources"]).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(texts if c == text else column(b, c) for c in columns), gone, held], [*columns, lost, holders])

    joined = small_batches(df).join(found, F.col(doc_id).cast("long") == F.col(own["found_id"]), "left").drop(own["found_id"])
    schema = T.StructType([*df.schema, T.StructField(lost, T.LongType()), T.StructField(holders, T.ArrayType(T.LongType()))])
    return joined.mapInArrow(rewrite, schema)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document: how many lines lose words, which, the words that go, and the ids of the documents that hold them already."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = deletions(docs)
    empty = F.expr("cast(array() as array<int>)")
    return docs.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id",
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("lines_removed"),
        F.array_join(F.coalesce("lines", empty).cast("array<string>"), ",").alias("removed"),
        F.coalesce(F.array_join(F.transform("passages", lambda p: F.concat_ws("-", p["start"], p["stop"])), ","), F.lit("")).alias("passages"),
        F.coalesce("sources", F.expr("cast(array() as array<bigint>)")).alias("sources"),
    )
