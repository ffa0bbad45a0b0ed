"""Toxic spans by a linear-chain conditional random field over tokens.

Token labels come from labelled documents: a word (or its prefix) that is far more frequent
in toxic than in clean documents is a toxic token there. The field has two tags, hashed
word and prefix features, and tag-to-tag weights. It is fitted by gradient on its
pseudo-likelihood: each tag given its word and its neighbours' tags, so all sentences of
all labelled documents come down to counts of (word, tags), and each step of the gradient
is a pass over these. On all documents the marginals of the toxic tag are
computed for all sentences of a batch at once; their sum, density and maximum give the
document's score by a logistic model, and runs of likely tokens the offending offsets.
"""

from __future__ import annotations

import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batches, column, forget, remainder, small_batches, table

FOLD, HELD = 3, 1
#: A longer sentence is cut into chains of so many words.
SENTENCE_WORDS = 100
SLOTS, PREFIXES = 1 << 18, (4, 5)
#: A word teaches the toxic tag if its odds in toxic documents are LIFT times those in clean ones and SHARE of the toxic ones have it.
LIFT, SHARE, FEWEST = 25.0, 0.015, 3
CUT = 0.7
STEPS, RATE, DECAY = 60, 0.3, 1e-4
#: Counts read at a time in a step.
PIECE = 1 << 18
REMEMBERED = 300_000
ENDS = (b".", b"!", b"?")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def normal(token: bytes) -> str:
    """A token in lower case without punctuation at its ends."""
    return token.decode("utf-8", "replace").lower().strip("\"'.,;:!?()[]{}<>#$%&*|-_")


def features(word: str) -> list[int]:
    """Hashed features of a word: itself and its prefixes."""
    if not word:
        return [0]
    names = [f"w:{word}", *(f"p{n}:{word[:n]}" for n in PREFIXES if len(word) > n)]
    return [1 + xxhash.xxh3_64_intdigest(x) % (SLOTS - 1) for x in names]


@dataclass
class Model:
    """Emission weights of the toxic tag against the clean one, tag transitions, document weights."""

    weights: np.ndarray
    bias: float
    steps: np.ndarray  # 2 x 2, log weights
    document: np.ndarray  # of (1, log sum, log density, maximum)


class Emissions(dict):
    """Token -> emission, plus 1000 if a sentence ends with it; remembers a bounded number."""

    def __init__(self, model: Model):
        self.weights, self.bias = model.weights.tolist(), float(model.bias)

    def __missing__(self, token: bytes) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        weights = self.weights
        value = min(30.0, max(-30.0, self.bias + sum([weights[f] for f in features(normal(token))]))) + 1000.0 * token.endswith(ENDS)
        if len(token) <= 64:
            self[token] = value
        return value


def marginals(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """P(toxic) of every token. e: emissions of all chains, laid end to end."""
    forward, backward = _forward_backward(e, starts, lengths, steps)
    one = forward * backward
    return one / (one + (1 - forward) * (1 - backward))


def pair_marginals(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, steps: np.ndarray, at: np.ndarray) -> np.ndarray:
    """P(tag before, tag) of the tokens `at`, none of which begins a chain: tokens x 2 x 2."""
    forward, backward = _forward_backward(e, starts, lengths, steps)
    before = np.stack([1 - forward[at - 1], forward[at - 1]], 1)
    after = np.stack([1 - backward[at], np.exp(e[at]) * backward[at]], 1)
    joint = before[:, :, None] * np.exp(steps) * after[:, None, :]
    return joint / joint.sum((1, 2), keepdims=True)


def _forward_backward(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The toxic tag's share of the messages from either side, over all chains together, longest first."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    alive = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
    odds, t = np.exp(e), np.exp(steps)
    forward, backward = np.empty(len(e)), np.empty(len(e))
    a = None
    for i, k in enumerate(alive):
        at = starts[:k] + i
        if a is None:
            zero, one = np.ones(k), odds[at]
        else:
            a = a[:k]
            zero = (1 - a) * t[0, 0] + a * t[1, 0]
            one = ((1 - a) * t[0, 1] + a * t[1, 1]) * odds[at]
        a = one / (zero + one)
        forward[at] = a
    b, before = np.empty(0), 0
    for i in range(len(alive) - 1, -1, -1):
        k = alive[i]
        at = starts[:k] + i
        now = np.full(k, 0.5)
        if before:
            after = odds[starts[:before] + i + 1] * b
            zero = t[0, 0] * (1 - b) + t[0, 1] * after
            one = t[1, 0] * (1 - b) + t[1, 1] * after
            now[:before] = one / (zero + one)
        b, before = now, k
        backward[at] = now
    return forward, backward


def tag(tokens: list[list[bytes]], emissions: Emissions, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginal of every token of every document, end to end; the documents' starts and end)."""
    sizes = np.array([len(x) for x in tokens], np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    raw = np.fromiter((v for x in tokens for v in map(emissions.__getitem__, x)), np.float64, int(bounds[-1]))
    last = raw > 500
    e = np.where(last, raw - 1000.0, raw)
    first = np.zeros(len(e) + 1, bool)
    first[bounds[:-1]] = True
    first[1:] |= np.append(last, False)[: len(e)]
    starts = np.flatnonzero(first[: len(e)])
    return marginals(e, starts, np.diff(np.append(starts, len(e))), steps), bounds


def summary(p: np.ndarray) -> tuple[float, float, float]:
    """What a document's marginals amount to: log of their sum, log of their density, their maximum.

    Only likely tokens add up, so many unlikely ones make no long text toxic.
    """
    if not len(p):
        return 0.0, 0.0, 0.0
    total = float(p[p >= 0.5].sum())
    return float(np.log1p(total)), float(np.log1p(1000 * total / len(p))), float(p.max())


def _key(word: str, tag: int, before: int, after: int) -> int:
    """A word's features, its tag and its neighbours' (2: none) in one integer."""
    slots = features(word)
    for f in slots + [SLOTS] * (3 - len(slots)):
        tag = tag << 19 | f
    return tag << 4 | before << 2 | after


def _parts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(three slots a row, tag, tag before, tag after) of keys."""
    slots = np.stack([key >> shift & (1 << 19) - 1 for shift in (4, 23, 42)])
    return slots, key >> 61, key >> 2 & 3, key & 3


def chain_gradient(key: np.ndarray, n: np.ndarray, weights: np.ndarray, bias: float, steps: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """The pseudo-likelihood's gradient by slot weights, bias and transitions, over keys that occur n times."""
    slots, tag, before, after = _parts(key)
    left, right = np.append(steps[:, 1] - steps[:, 0], 0.0), np.append(steps[1] - steps[0], 0.0)
    held = np.append(weights, 0.0)
    e = np.clip(held[slots].sum(0) + bias, -30, 30) + left[before] + right[after]
    off = n * (tag - 1 / (1 + np.exp(-np.clip(e, -60, 60))))
    grad = sum(np.bincount(x, off, SLOTS + 1) for x in slots)[:SLOTS]
    moved = np.zeros((2, 2))
    by_left, by_right = np.bincount(before, off, 3)[:2], np.bincount(after, off, 3)[:2]
    moved[:, 1] += by_left
    moved[:, 0] -= by_left
    moved[1] += by_right
    moved[0] -= by_right
    return grad, float(off.sum()), moved


def _total(df: DataFrame, f) -> np.ndarray:
    """f, of an Arrow batch, summed over all batches. A row a task, as many tasks as cores."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = sum(map(f, batches(rows)))
        if isinstance(out, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["data"])

    got = df.coalesce(df.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "data binary").collect()
    return sum(np.frombuffer(r["data"], np.float64) for r in got)


def _learn_chain(counted: DataFrame) -> tuple[np.ndarray, float, np.ndarray]:
    """Gradient ascent (Adam) over all counts: keys and n, as packed integers.

    One task takes the steps: the counts are a small part of the texts. It keeps them in
    files of its own, so its memory doesn't grow with them, and the driver gets the weights.
    """

    def learn(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryFile() as keys, tempfile.TemporaryFile() as counts:
            for b in batches(rows):
                for name, file in (("keys", keys), ("n", counts)):
                    for x in column(b, name):
                        file.write(x.as_buffer())
            weights, bias, steps = _ascend(lambda: _read(keys, counts))
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([weights, [bias], steps.ravel()]).tobytes()], pa.binary())], ["data"])

    got = np.frombuffer(counted.coalesce(1).mapInArrow(learn, "data binary").first()["data"], np.float64)
    return got[:SLOTS].copy(), float(got[SLOTS]), got[SLOTS + 1 :].reshape(2, 2).copy()


def _read(keys, counts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The files' (keys, n), PIECE at a time."""
    keys.seek(0)
    counts.seek(0)
    while raw := keys.read(8 * PIECE):
        yield np.frombuffer(raw, np.int64), np.frombuffer(counts.read(8 * PIECE), np.int64)


def _ascend(pieces) -> tuple[np.ndarray, float, np.ndarray]:
    """Adam's steps. pieces() gives all (keys, n)."""
    tokens = pairs = 0
    for key, n in pieces():
        tokens += int(n.sum())
        pairs += int(n[(key >> 2 & 3) < 2].sum())
    weights, bias, steps = np.zeros(SLOTS), -2.0, np.zeros((2, 2))
    m, moved = [np.zeros(SLOTS), np.zeros(SLOTS), 0.0, 0.0], [np.zeros((2, 2)), np.zeros((2, 2))]
    for n in range(1, STEPS + 1):
        grad, g, turn = np.zeros(SLOTS), 0.0, np.zeros((2, 2))
        for piece in pieces():
            x, y, z = chain_gradient(*piece, weights, bias, steps)
            grad += x
            g += y
            turn += z
        grad -= DECAY * tokens * weights / SLOTS
        m[0] = 0.9 * m[0] + 0.1 * grad
        m[1] = 0.99 * m[1] + 0.01 * grad**2
        weights = weights + RATE * (m[0] / (1 - 0.9**n)) / (np.sqrt(m[1] / (1 - 0.99**n)) + 1e-8)
        weights *= 1 - 1e-3
        m[2], m[3] = 0.9 * m[2] + 0.1 * g, 0.99 * m[3] + 0.01 * g * g
        bias += 0.5 * RATE * (m[2] / (1 - 0.9**n)) / (np.sqrt(m[3] / (1 - 0.99**n)) + 1e-8)
        turn = turn / max(1, pairs) - DECAY * steps
        moved[0], moved[1] = 0.9 * moved[0] + 0.1 * turn, 0.99 * moved[1] + 0.01 * turn**2
        steps = steps + 0.5 * RATE * (moved[0] / (1 - 0.9**n)) / (np.sqrt(moved[1] / (1 - 0.99**n)) + 1e-8)
    return weights, bias, steps


def _learn_document(measured: DataFrame, clean: int, toxic: int) -> np.ndarray:
    """Logistic weights by Newton steps with a ridge; the two labels weigh alike. A pass over the measured documents a step."""
    w = np.zeros(4)
    share = np.array([0.5 / max(1, clean), 0.5 / max(1, toxic)]) * (clean + toxic)
    for _ in range(30):

        def newton(b: pa.RecordBatch) -> np.ndarray:
            y = column(b, "toxic").to_numpy()
            x = np.column_stack([np.ones(len(y)), *(column(b, c).to_numpy() for c in ("total", "density", "top"))])
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            return np.concatenate([((x * (share[y] * p * (1 - p))[:, None]).T @ x).ravel(), x.T @ (share[y] * (y - p))])

        got = _total(measured, newton)
        move = np.linalg.solve(got[:16].reshape(4, 4) + 0.5 * np.eye(4), got[16:] - 0.5 * w)
        w = w + move
        if np.abs(move).max() < 1e-9:
            break
    return w


def fit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", fold: bool = True) -> Model:
    """Learn from all labelled documents outside the held-out fold, equal texts once. Their ids are broadcast, so that texts aren't shuffled."""
    spark = df.sparkSession
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    if fold:
        known = known.where(remainder("doc_id", FOLD) != HELD)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    once = table(rows.join(F.broadcast(known.distinct()), "doc_id").select("doc_id", "toxic", F.xxhash64("text").alias("h")).groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic"))
    taught = table(rows.join(F.broadcast(once), "doc_id"))
    none = Model(np.zeros(SLOTS), -6.0, np.zeros((2, 2)), np.array([-4.0, 0, 0, 0]))
    try:
        return _fit(spark, small_batches(taught), none)
    finally:
        forget(once, taught)


def _fit(spark, taught: DataFrame, none: Model) -> Model:
    """The model of the taught documents (text, toxic); none if they show no toxic word."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for b in batches(parts):
            for x, y in zip(as_bytes(b, "text"), column(b, "toxic").to_pylist()):
                words = set(map(normal, set(x.split())))
                seen[y].update(words)
                seen[y].update({f"{w[: PREFIXES[-1]]}\n" for w in words if len(w) > PREFIXES[-1]})
            if len(seen[0]) + len(seen[1]) > 300_000:
                yield _counts(seen)
                seen = Counter(), Counter()
        yield _counts(seen)

    sizes = {r["toxic"]: r["count"] for r in taught.groupBy("toxic").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not toxic:
        return none
    counted = taught.mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lift = ((F.col("toxic") + 0.1) / (toxic + 1)) / ((F.col("clean") + 0.1) / (clean + 1))
    # at most a toxic document's mean number of words, over SHARE
    lexicon = {r["word"] for r in counted.where((F.col("toxic") >= max(FEWEST, SHARE * toxic)) & (lift >= LIFT)).select("word").collect()}
    if not lexicon:
        return none
    lexicons = spark.sparkContext.broadcast(lexicon)

    def tagged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lexicons.value
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = [_key(*x) for x in seen]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(list(seen.values()), pa.int64())], ["key", "n"])

        for b in batches(parts):
            for x, y in zip(as_bytes(b, "text"), column(b, "toxic").to_pylist()):
                for words in _chains(x):
                    tags = [int(w in held or (len(w) > PREFIXES[-1] and f"{w[: PREFIXES[-1]]}\n" in held)) for w in words] if y else [0] * len(words)
                    seen.update(zip(words, tags, [2, *tags[:-1]], [*tags[1:], 2]))
                if len(seen) > 300_000:
                    yield flush()
                    seen.clear()
        yield flush()

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            yield pa.RecordBatch.from_arrays([pa.array([column(b, c).to_numpy().tobytes()], pa.binary()) for c in ("key", "n")], ["keys", "n"])

    tags = table(taught.mapInArrow(tagged, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).mapInArrow(pack, "keys binary, n binary"))
    model = Model(*_learn_chain(tags), np.zeros(4))
    forget(tags)
    shared = spark.sparkContext.broadcast(model)

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(shared.value)
        for b in batches(parts):
            p, bounds = tag([x.split() for x in as_bytes(b, "text")], emissions, shared.value.steps)
            found = [summary(p[i:j]) for i, j in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([column(b, "toxic"), *(pa.array([x[i] for x in found], pa.float64()) for i in range(3))], ["toxic", "total", "density", "top"])

    measured = table(taught.mapInArrow(measure, "toxic int, total double, density double, top double"))
    model.document = _learn_document(measured, clean, toxic)
    forget(measured)
    return model


def _chains(text: bytes) -> Iterator[list[str]]:
    """The normal words of each sentence, long ones in pieces of SENTENCE_WORDS."""
    for sentence in re.split(rb"(?<=[.!?])[\x20\x09-\x0D]+", text):
        words = list(map(normal, sentence.split()))
        for i in range(0, len(words), SENTENCE_WORDS):
            yield words[i : i + SENTENCE_WORDS]


def _counts(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
    words = list(seen[0].keys() | seen[1].keys())
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in seen)], ["word", "clean", "toxic"])


def spans(text: bytes, p: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
    """Offsets, in code points, of the runs of tokens with marginals of at least 0.5; end exclusive."""
    if not len(p) or p.max() < least:
        return []
    out, run = [], None
    for i, m in enumerate(WORD.finditer(text)):
        if p[i] >= least:
            run = (run[0], m.end()) if run else (m.start(), m.end())
        elif run:
            out.append(run)
            run = None
    if run:
        out.append(run)
    return [(len(text[:a].decode("utf-8", "replace")), len(text[:b].decode("utf-8", "replace"))) for a, b in out]


def score(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted, spans) of every row; spans lists the offending offsets as array<struct<start,end>>.

    A null or empty text has no tokens: its score is the logistic model's at zero
    evidence. Repeated rows give repeated rows; other columns are not read. No shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions, w = Emissions(shared.value), shared.value.document
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches(rows):
            texts = as_bytes(b, "text")
            p, bounds = tag([x.split() for x in texts], emissions, shared.value.steps)
            found, where = [], []
            for x, i, j in zip(texts, bounds, bounds[1:]):
                found.append(_logistic(w, p[i:j]))
                where.append([{"start": s, "end": e} for s, e in spans(x, p[i:j])])
            s = np.array(found)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(s), pa.array((s >= CUT).astype(np.int32)), pa.array(where, kind)], ["doc_id", "score", "predicted", "spans"])

    rows = small_batches(df).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, spans array<struct<start:int,end:int>>")


def without_toxic(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df without the rows whose text the model rejects (score of at least CUT). All columns stay; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions, w = Emissions(shared.value), shared.value.document
        for b in batches(rows):
            p, bounds = tag([x.split() for x in as_bytes(b, text)], emissions, shared.value.steps)
            yield b.filter(pa.array([_logistic(w, p[i:j]) < CUT for i, j in zip(bounds, bounds[1:])]))

    return small_batches(df).mapInArrow(run, df.schema)


def _logistic(w: np.ndarray, p: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(w[0] + np.dot(w[1:], summary(p)), -30, 30))))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    said = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("doc_id", (remainder("doc_id", FOLD) == HELD).alias("held_out"), "score", "predicted", said.alias("spans"))
