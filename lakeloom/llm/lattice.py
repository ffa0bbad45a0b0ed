"""Language-model scores by subword lattices.

The vocabulary and its scores exist: a published file's pieces, whose score is minus their
rank, weigh a piece by Zipf's law. Under these weights every segmentation of the training
words counts, in proportion to its probability (forward-backward over the lattice), and the
expected counts give the pieces' log-probabilities. The sum over all segmentations of a
word comes from a forward recursion in log space. A word of the training texts has one more
arc, over the whole of it: its count less a discount, over all tokens; what the discounts
leave is the weight of the pieces. A text's probability is the product over its words and
one end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batches, column, remainder, small_batches, table

FOLD, HELD, ALPHA = 10, 0, 0.1
VOCABULARY = "piece_bpe_32k.model"
#: Most frequent words whose counts and scores are broadcast; the others are joined.
HEAD = 150_000
#: Up to this many characters a word's expected counts are found with plain probabilities, if none vanishes.
SHORT = 48
SPACE, END = "▁", "</s>"
#: A text's end as a token: it holds a blank, so it is no word.
END_TOKEN = " end"
FLUSH = 300_000


@dataclass
class Pieces:
    """Natural log-probability of each piece, of each spelled byte and of a text's end.

    plain: the pieces' probabilities. reach: the length of the longest piece that ends in
    these three characters; where none does, no piece that ends there has more than two.
    """

    logp: dict[str, float]
    bytes: list[float]
    end: float
    longest: int
    plain: dict[str, float]
    reach: dict[str, int]

    def char(self, c: str) -> float:
        """A character without a piece is spelled by its bytes."""
        return sum(self.bytes[b] for b in c.encode("utf-8", "surrogatepass"))


def load_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the file, byte pieces and </s> included, other control pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not model.is_unknown(i) and model.id_to_piece(i) != "<s>" and model.get_score(i) > -1e8]


def zipf(pieces: list[tuple[str, float]]) -> dict[str, float]:
    """Weights of the existing scores: 1 / (rank + 3); byte pieces weigh like the last rank."""
    last = max(-s for _, s in pieces) + 3
    return {p: 1 / (last if _byte(p) is not None else 3 - s) for p, s in pieces}


def _byte(piece: str) -> int | None:
    return int(piece[3:5], 16) if len(piece) == 6 and piece.startswith("<0x") else None


def normalise(weights: dict[str, float]) -> Pieces:
    total = math.log(sum(weights.values()))
    logp = {p: math.log(w) - total for p, w in weights.items()}
    spelled = [logp.pop(f"<0x{b:02X}>") for b in range(256)]
    end = logp.pop(END)
    reach: dict[str, int] = {}
    for p in logp:
        if len(p) > 2:
            reach[p[-3:]] = max(reach.get(p[-3:], 0), len(p))
    return Pieces(logp, spelled, end, max(map(len, logp)), {p: math.exp(x) for p, x in logp.items()}, reach)


def log_probability(word: str, pieces: Pieces) -> float:
    """Natural log of the word's probability, summed over all segmentations."""
    s = SPACE + word
    get, reach, exp, log = pieces.logp.get, pieces.reach.get, math.exp, math.log
    alpha = [0.0]
    for j in range(1, len(s) + 1):
        terms = [alpha[i] + p for i in range(max(0, j - reach(s[max(0, j - 3) : j], 2)), j) if (p := get(s[i:j])) is not None]
        if s[j - 1] not in pieces.logp:
            terms.append(alpha[j - 1] + pieces.char(s[j - 1]))
        top = max(terms)
        alpha.append(top if len(terms) == 1 else top + log(sum([exp(x - top) for x in terms])))
    return alpha[-1]


def discount(once: int, twice: int) -> float:
    """What an arc over a whole word gives up: the share of words seen once that Ney's estimate takes, never 0 or 1."""
    return (once + 1) / (once + 2 * twice + 2)


def with_whole(logp: float, count: int, tokens: int, words: int, less: float) -> float:
    """Natural log of the pieces' probability and the whole word's arc together; the pieces' alone if nothing was taught."""
    if not tokens:
        return logp
    spelled = logp + math.log(less * words / tokens)
    if count <= 0:
        return spelled
    whole = math.log((count - less) / tokens)
    top = max(spelled, whole)
    return top + math.log1p(math.exp(min(spelled, whole) - top))


def expected(word: str, pieces: Pieces, count: float, into: dict[str, float]) -> None:
    """Add the expected number of each piece over the word's segmentations."""
    s = SPACE + word
    if len(s) > SHORT or not _expected_short(s, pieces, count, into):
        _expected_long(s, pieces, count, into)


def _spell(c: str, share: float, into: dict[str, float]) -> None:
    for b in c.encode("utf-8", "surrogatepass"):
        into[f"<0x{b:02X}>"] = into.get(f"<0x{b:02X}>", 0.0) + share


def _expected_short(s: str, pieces: Pieces, count: float, into: dict[str, float]) -> bool:
    """Forward-backward with plain probabilities; False, and nothing added, if the whole is too small for them."""
    get, reach = pieces.plain.get, pieces.reach.get
    alpha, arcs = [1.0], []
    for j in range(1, len(s) + 1):
        total = 0.0
        for i in range(max(0, j - reach(s[max(0, j - 3) : j], 2)), j):
            p = get(s[i:j])
            if p is not None:
                total += alpha[i] * p
                arcs.append((i, j, p, True))
        if s[j - 1] not in pieces.plain:
            p = math.exp(pieces.char(s[j - 1]))
            total += alpha[j - 1] * p
            arcs.append((j - 1, j, p, False))
        alpha.append(total)
    if alpha[-1] < 1e-280:
        return False
    beta = [0.0] * len(s) + [count / alpha[-1]]
    for i, j, p, known in reversed(arcs):
        step = p * beta[j]
        beta[i] += step
        piece = s[i:j]
        if known:
            into[piece] = into.get(piece, 0.0) + alpha[i] * step
        else:
            _spell(piece, alpha[i] * step, into)
    return True


def _expected_long(s: str, pieces: Pieces, count: float, into: dict[str, float]) -> None:
    """Forward-backward in log space; keeps a number a character, however long the word."""
    get, reach, n = pieces.logp.get, pieces.reach.get, len(s)

    def plus(a: float, b: float) -> float:
        if a < b:
            a, b = b, a
        return a if b == -math.inf else a + math.log1p(math.exp(b - a))

    def arcs(j: int) -> Iterator[tuple[int, float, bool]]:
        for i in range(max(0, j - reach(s[max(0, j - 3) : j], 2)), j):
            p = get(s[i:j])
            if p is not None:
                yield i, p, True
        if s[j - 1] not in pieces.logp:
            yield j - 1, pieces.char(s[j - 1]), False

    alpha, beta = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for j in range(1, n + 1):
        for i, p, _ in arcs(j):
            alpha[j] = plus(alpha[j], alpha[i] + p)
    for j in range(n, 0, -1):
        for i, p, known in arcs(j):
            beta[i] = plus(beta[i], p + beta[j])
            share = count * math.exp(alpha[i] + p + beta[j] - alpha[n])
            if known:
                into[s[i:j]] = into.get(s[i:j], 0.0) + share
            else:
                _spell(s[i], share, into)


def word_counts(rows: DataFrame) -> DataFrame:
    """(doc_id, text, train) -> (word, c): distinct words of all texts with their count in training texts."""

    def flush(seen: Counter, held: set[bytes]) -> pa.RecordBatch:
        words = list(seen) + [w for w in held if w not in seen]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([seen.get(w, 0) for w in words], pa.int64())], ["word", "c"])

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        held: set[bytes] = set()
        ends = 0
        for b in batches(parts):
            for x, train in zip(as_bytes(b, "text"), column(b, "train").to_pylist()):
                if train:
                    ends += 1
                    seen.update(x.lower().split())
                else:
                    held.update(x.lower().split())
                if len(seen) + len(held) > FLUSH:
                    yield flush(seen, held)
                    seen, held = Counter(), set()
        if ends:
            seen[END_TOKEN.encode()] = ends
        if seen or held:
            yield flush(seen, held)

    return small_batches(rows).mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit_pieces(words: DataFrame, ends: int, path: str) -> Pieces:
    """Piece log-probabilities from the existing scores, re-weighted by the expected counts in all training words."""
    spark = words.sparkSession
    weights = zipf(load_pieces(path))
    start = spark.sparkContext.broadcast(normalise(weights))

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into: dict[str, float] = {}
        for b in batches(parts):
            for w, c in zip(column(b, "word").to_pylist(), column(b, "c").to_pylist()):
                expected(w, start.value, c, into)
        yield pa.RecordBatch.from_arrays([pa.array(list(into), pa.string()), pa.array(list(into.values()), pa.float64())], ["piece", "n"])

    taught = words.where((F.col("c") > 0) & (F.col("word") != END_TOKEN))
    found = taught.mapInArrow(gather, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    got = {r["piece"]: r["n"] for r in found.collect()}  # at most the vocabulary
    scale = sum(got.values()) or 1.0
    total = sum(weights.values())
    # the existing weights stay as a prior worth a thousandth of the counts, or one token
    prior = max(1.0, scale / 1000) / total
    counted = {p: got.get(p, 0.0) + prior * w for p, w in weights.items()}
    counted[END] = max(float(ends), prior)
    return normalise(counted)


def score(df: DataFrame, train, pieces_path: str, doc_id: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row; train is a boolean column.

    base_score is the smoothed unigram score of the words, score the log10 probability of
    the words' lattices, arcs over whole training words included, and the end. A null or empty text is the end alone. Repeated rows
    give repeated rows; other columns are not read. The most frequent words are looked up
    where a text is read; rarer ones are joined by word, so the vocabulary may grow without
    bound, and each distinct word's lattice is run once. An empty training set leaves
    N = V = 0, every token unknown.
    """
    spark = df.sparkSession
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), train.alias("train"))
    words = table(word_counts(rows.select("text", "train")))
    total = words.where("c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    n, v, less = total["n"] or 0, total["v"] or 0, discount(total["once"], total["twice"])
    ends = words.where(F.col("word") == END_TOKEN).select("c").first()
    ends = ends["c"] if ends else 0
    pieces = spark.sparkContext.broadcast(fit_pieces(words, ends, pieces_path))
    norm = math.log10(n + ALPHA * (v + 1)) if n or v else math.log10(ALPHA)

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            p = [with_whole(log_probability(w, pieces.value), c, n, v, less) / math.log(10) for w, c in zip(column(b, "word").to_pylist(), column(b, "c").to_pylist())]
            yield pa.RecordBatch.from_arrays([column(b, "word"), column(b, "c"), pa.array(p, pa.float64())], ["word", "c", "p"])

    scored = table(words.where(F.col("word") != END_TOKEN).mapInArrow(add, "word string, c long, p double"))
    frequent = scored.orderBy(F.desc("c"), "word").limit(head).toPandas()  # head rows
    known = spark.sparkContext.broadcast({w.encode("utf-8", "surrogatepass"): (int(c > 0), math.log10(c + ALPHA) - norm, p) for w, c, p in frequent.itertuples(index=False)})
    end_known, end_base, end_p = int(ends > 0), math.log10(ends + ALPHA) - norm, with_whole(pieces.value.end, ends, n, v, less) / math.log(10)

    def look_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = known.value
        get = table_of.get
        for b in batches(parts):
            out: list[tuple] = []
            for row, doc, x in zip(column(b, "row").to_pylist(), column(b, "doc_id").to_pylist(), as_bytes(b, "text")):
                tokens = x.lower().split()
                found = list(map(get, tokens))
                hits = [f for f in found if f is not None]
                kn, base, p = map(sum, zip(*hits)) if hits else (0, 0.0, 0.0)
                # a text's own row meets no word: its key holds a blank
                out.append((row, f" {row}", doc, len(tokens) + 1, kn + end_known, base + end_base, p + end_p, 1))
                if len(hits) < len(tokens):
                    rare = Counter(t for t, f in zip(tokens, found) if f is None)
                    out.extend((row, t.decode("utf-8", "replace"), None, k, 0, 0.0, 0.0, 0) for t, k in rare.items())
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32())
            for i in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 50_000]), kinds)], ["row", "word", "doc_id", "k", "known", "base", "p", "own"])

    looked = small_batches(rows.select("row", "doc_id", "text")).mapInArrow(look_up, "row long, word string, doc_id long, k long, known long, base double, p double, own int")
    met = looked.join(scored.select("word", F.col("c").alias("wc"), F.col("p").alias("wp")), "word", "left")
    rare = (F.col("own") == 0).cast("int")
    wc = F.coalesce("wc", F.lit(0))
    return (
        met.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.sum(F.when(F.col("own") == 1, F.col("k")).otherwise(0)).alias("n_tokens"),
            F.sum(F.col("known") + rare * F.col("k") * (wc > 0).cast("int")).alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            F.sum(F.col("base") + rare * F.col("k") * (F.log10(wc + ALPHA) - norm)).alias("base_score"),
            F.sum(F.col("p") + rare * F.col("k") * F.coalesce("wp", F.lit(0.0))).alias("score"),
        )
        .drop("row")
    )


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op7_lattice(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, remainder("doc_id", FOLD) != HELD, pieces_path())
    return out.select("doc_id", (remainder("doc_id", FOLD) == HELD).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
