"""Language identification by bit-sliced Bloom filters of n-grams.

One array of slots serves all languages: each slot is a bitmask with one bit a language, in
as many 64-bit words as the languages need, so
the AND of an n-gram's slots is the set of all languages whose filter holds it. A text's
n-grams are looked up, their masks counted, and each language gets the number of n-grams it
holds. A filter with fill f answers yes to an unknown n-gram with probability f to the power
of the hash count; that share is taken off before the languages are compared.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, batches, column, remainder, small_batches, table

GRAM, SLOTS, HASHES = 4, 1 << 20, 2
#: More values of the language column than this are no languages: an error. The filter takes 8 MB for 64.
LANGUAGES = 2048
#: Documents of each language that teach its n-grams: about this many at most.
TAUGHT = 20_000
#: n-grams of each language kept: the most frequent ones that no other language uses RIVAL times as often.
KEPT, RIVAL, RARE = 40_000, 1.5, 2
FOLD = 5

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """64-bit codes of the n-grams over lower-case letters; each run of other characters is one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[points]
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    if not letter.any():
        return np.zeros(0, np.uint64)
    points = np.concatenate(([32], points[keep], [32])).astype(np.uint64)
    points = np.concatenate((points, np.full(max(0, GRAM - len(points)), 32, np.uint64)))  # a lone letter at the end
    n = len(points) - GRAM + 1
    code = np.zeros(n, np.uint64)
    for j in range(GRAM):
        code = (code ^ points[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code


def _slots(codes: np.ndarray) -> list[np.ndarray]:
    return [((codes * np.uint64(m)) >> np.uint64(44)) & np.uint64(SLOTS - 1) for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)][:HASHES]


class LanguageFilter:
    """The slots and, for each language, the false-positive rate of its slice."""

    def __init__(self, names: list[str], known: dict[str, np.ndarray]):
        self.names = names
        self.slots = np.zeros((len(names) + 63 >> 6, SLOTS), np.uint64)
        fill = []
        for i, name in enumerate(names):
            word, bit = self.slots[i >> 6], np.uint64(1 << (i & 63))
            for at in _slots(known[name]):
                np.bitwise_or.at(word, at, bit)
            fill.append(np.count_nonzero(word & bit) / SLOTS)
        self.false = np.array(fill) ** HASHES

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """For each 64 languages a row: for each n-gram, those of them that hold it."""
        a, *more = _slots(codes)
        found = self.slots[:, a]
        for at in more:
            found = found & self.slots[:, at]
        return found

    def predict(self, text: str) -> tuple[str, float]:
        """(language, share of it among the corrected counts); ("und", 0) without a letter or a known language."""
        codes = grams(text)
        if not len(codes) or not self.names:
            return "und", 0.0
        found = self.masks(codes)
        held = np.array([np.count_nonzero(found[i >> 6] & np.uint64(1 << (i & 63))) for i in range(len(self.names))], float)
        held = np.maximum(0.0, (held - len(codes) * self.false) / (1.0 - self.false))
        if held.sum() <= 0:
            return self.names[0], 0.0
        best = int(held.argmax())
        return self.names[best], float(held[best] / held.sum())


def fit(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageFilter:
    """Learn from rows with a language and a text whose crc32 fold is not 0, every language there is."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").where(remainder("doc_id", FOLD) != 0)
    sizes = {x["lang"]: x["count"] for x in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"{lang} has more than {LANGUAGES} values")
    names = sorted(sizes)
    # a hash of the id picks the sample: the same rows on every run
    share = F.create_map(*[F.lit(x) for name in names for x in (name, min(1_000_000, TAUGHT * 1_000_000 // sizes[name]))]) if names else None
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] if names else F.lit(False)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in batches(parts):
            for name, x in zip(column(b, "lang").to_pylist(), as_text(b, "text")):
                codes, n = np.unique(grams(x), return_counts=True)
                seen.setdefault(name, Counter()).update(dict(zip(codes.tolist(), n.tolist())))
            if sum(map(len, seen.values())) > 500_000:
                yield _counted(seen)
                seen = {}
        if seen:
            yield _counted(seen)

    counted = table(small_batches(rows.where(pick).select("lang", "text")).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    rate = counted.where(F.col("n") >= RARE).join(F.broadcast(total), "lang").select("lang", "gram", "n", (F.col("n") / F.col("total")).alias("p"))
    top = rate.groupBy("gram").agg(F.max("p").alias("best"), F.collect_list(F.struct("lang", "n", "p")).alias("every"))  # one for each language
    # a language holds a gram unless another uses it RIVAL times as often
    mine = table(top.select("gram", F.explode(F.filter("every", lambda x: x["p"] * RIVAL >= F.col("best"))).alias("x")).select("gram", "x.lang", "x.n"))
    known: dict[str, np.ndarray] = {}
    for name in names:  # KEPT rows each: bounded
        got = mine.where(F.col("lang") == name).orderBy(F.desc("n"), "gram").limit(KEPT).select("gram").toPandas()["gram"]
        known[name] = got.to_numpy(np.int64).view(np.uint64)
    return LanguageFilter(names, known)


def _counted(seen: dict[str, Counter]) -> pa.RecordBatch:
    names = [x for x, c in seen.items() for _ in range(len(c))]
    codes = np.fromiter((g for c in seen.values() for g in c), np.uint64, len(names)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(codes), pa.array([n for c in seen.values() for n in c.values()], pa.int64())], ["lang", "gram", "n"])


def predict(df: DataFrame, model: LanguageFilter, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; `und` and 0 for a null text or one without a letter.

    Ties go to the first language by name. Repeated rows give repeated rows; other columns
    are not read. No shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            said = [shared.value.predict(x) for x in as_text(b, "text")]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array([x for x, _ in said], pa.string()), pa.array([s for _, s in said], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = small_batches(df).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", (remainder("doc_id", FOLD) == 0).alias("held_out"), "lang_pred", "score")
