"""Secret scanning in DataFrame functions only: patterns, and sliding-window entropy of candidate strings.

Candidates are maximal runs of key characters in what the patterns left of the text: those
that hold a letter and a digit, or letters of both cases. A window of WINDOW characters
slides over each one. How often each character occurs in the window is kept in a string with
a letter for each; the character that enters and the one that leaves change two of these
counts, and the sum of c*log2(c) changes by those terms alone. The Shannon entropy is
log2(W) - sum/W. A candidate with a window that reaches the threshold of its character class
is a span, unless the allow-list knows it; windows are tried CHUNK at a time until one does.

Everything is linear in the text: positions are prefix sums by blocks, and no pattern
repeats a group in a way that the regular-expression engine walks by recursion.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the maximal runs of 32 or more
#: From where no key character comes before: a digit and a letter, or letters of both cases, among WINDOW characters or more.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?:(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])|(?=[a-z0-9+/_=-]*+[A-Z])(?=[A-Z0-9+/_=-]*+[a-z]))[A-Za-z0-9+/_=-]{20,}+"
MIN_ASSIGN, MIN_ACCESS, WINDOW = 8, 16, 20
KINDS = ("assign", "access", "hex", "entropy")
#: Bits a window needs, by the class of the candidate's characters: what nine of ten random strings of 24 such characters reach, or more.
CLASSES = ((r"^([0-9a-f]+|[0-9A-F]+)$", 2.8), (r"^[A-Za-z+/_=-]+$", 3.8), (r"^[A-Za-z0-9]+$", 3.6), (r"", 3.9))
#: Strings that look random but are known not to be secrets. Repeated groups are possessive, so the engine walks them in a loop.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    r"(?i)example|placeholder|changeme|dummy|your[_-]?(api|key|token|secret)",
    r"(?i)abcdefghij|0123456789|1234567890|qwertyuiop",
    r"^(.{1,8}?)\1++=*$",  # a repeated unit
    r"^/?[a-z]++(?:[-_/](?:[a-z]++|[0-9]{1,8}+))++/?$",  # slug or path of words and numbers
    r"^[A-Z]++(?:_(?:[A-Z]++|[0-9]{1,8}+))++$",  # constant name
    r"^[A-Z]?[a-z]++(?:[A-Z][a-z]{2,}+)++$",  # words run together, a capital each
)
#: Prefix sums go block by block, windows chunk by chunk.
BLOCK, CHUNK = 256, 64
#: Key characters lie between '+' and 'z'.
LOWEST, HIGHEST = ord("+"), ord("z")
#: What the sum of c*log2(c) gains when a count rises to c.
GAIN = [0.0, 0.0, *(c * math.log2(c) - (c - 1) * math.log2(c - 1) for c in range(2, WINDOW + 1))]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value found once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(lengths: Column) -> Column:
    """The sum of what comes before each element: block by block, as each append copies what there is."""
    none = F.expr("cast(array() as array<int>)")

    def sums(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda part: F.aggregate(part, F.lit(0), lambda a, n: a + n))
        return F.flatten(F.zip_with(F.transform(blocks, sums), sums(totals), lambda part, more: F.transform(part, lambda x: x + more)))

    def cut(held: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / BLOCK).cast("int"))
        return F.when(F.size(held) == 0, none).otherwise(_let(F.transform(numbers, lambda k: F.slice(held, k * BLOCK + 1, F.lit(BLOCK))), joined))

    return _let(lengths, cut)


def _spans(text: Column, pattern: str, kind: int, size_of: int = 0, least: int = 0) -> Column:
    """array<struct<start,kind,end,s,n>> of the pattern's non-overlapping matches, in code points; n is the length of the match's group `size_of`, `least` or more.

    split() gives what lies between the matches; lengths of both add up to the positions.
    """
    matches = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    rows = F.zip_with(F.zip_with(matches(0), F.transform(matches(size_of), lambda x: F.length(x)), lambda s, n: F.struct(s.alias("s"), n.alias("n"))), gaps, lambda m, g: F.struct(m["s"].alias("s"), m["n"].alias("n"), g.alias("gap")))

    def placed(found: Column) -> Column:
        before = _before(F.transform(found, lambda m: m["gap"] + F.length(m["s"])))
        return F.zip_with(
            found,
            before,
            lambda m, at: F.struct((at + m["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + m["gap"] + F.length(m["s"])).alias("end"), m["s"].alias("s"), m["n"].alias("n")),
        )

    # behind the last match there is a gap and no match
    all_spans = _let(F.filter(rows, lambda m: m["s"].isNotNull()), placed)
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,s:string,n:int>>)")
    return F.when(text.rlike(pattern), F.filter(all_spans, lambda x: x["n"] >= least)).otherwise(none)


def _blanked(text: Column, pattern: str, size_of: int = 0, least: int = 0) -> Column:
    """The text with blanks in place of the matches whose group is long enough."""
    matches = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    said = F.zip_with(matches(0), matches(size_of), lambda s, g: F.when(F.length(g) >= least, F.repeat(F.lit(" "), F.length(s))).otherwise(s))
    whole = F.array_join(F.zip_with(F.split(text, pattern, -1), said, lambda gap, s: F.concat(gap, F.coalesce(s, F.lit("")))), "")
    return F.when(text.rlike(pattern), whole).otherwise(text)


def _least(part: Column, window: int) -> Column:
    """The lowest sum of c*log2(c) over the windows of an array of characters; null if it is shorter than a window.

    The counts are a string with one letter for each key character: A for none, B for one.
    Each step overlays the letter of the character that goes and of the one that comes.
    """
    held = lambda a, c: F.ascii(F.substring(a["counts"], c + 1, 1)) - ord("A")
    put = lambda counts, c, n: F.overlay(counts, F.char(n + ord("A")), c + 1, F.lit(1))

    def step(a: Column, x: Column) -> Column:
        come, gone = x["come"], x["gone"]
        lost = F.coalesce(put(a["counts"], gone, held(a, gone) - 1), a["counts"])
        change = F.get(F.lit(GAIN), held(a, come) + 1) - F.coalesce(F.get(F.lit(GAIN), held(a, gone)), F.lit(0.0))
        same = F.coalesce(come == gone, F.lit(False))
        return F.struct(
            F.when(same, a["counts"]).otherwise(put(lost, come, held(a, come) + 1)).alias("counts"),
            (a["total"] + F.when(same, F.lit(0.0)).otherwise(change)).alias("total"),
            x["full"].alias("full"),
            lowest(a).alias("least"),
        )

    # the lowest total is brought up to date a step later, so that a total is found once
    lowest = lambda a: F.when(a["full"], F.least(a["least"], a["total"])).otherwise(a["least"])
    start = F.struct(F.lit("A" * (HIGHEST - LOWEST + 1)).alias("counts"), F.lit(0.0).alias("total"), F.lit(False).alias("full"), F.lit(None).cast("double").alias("least"))
    steps = F.transform(part, lambda c, i: F.struct(c.alias("come"), F.get(part, i - window).alias("gone"), (i >= window - 1).alias("full")))
    return F.aggregate(steps, start, step, lowest)


def _chunks(s: Column, window: int) -> Column:
    """The characters of a string of key characters, as arrays that hold CHUNK windows each, less at the end; no chunk if there is no window."""
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c) - LOWEST)
    starts = F.sequence(F.lit(0), F.floor((F.length(s) - window) / CHUNK).cast("int"))
    cut = lambda held: F.transform(starts, lambda k: F.slice(held, k * CHUNK + 1, F.lit(CHUNK + window - 1)))
    return F.when(F.length(s) >= window, _let(codes, cut)).otherwise(F.expr("cast(array() as array<array<int>>)"))


def window_entropy(s: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, over all windows of a string of key characters; 0 if it is shorter than a window."""
    lowest = F.array_min(F.transform(_chunks(s, window), lambda part: _least(part, window)))
    return F.coalesce(F.lit(math.log2(window)) - lowest / window, F.lit(0.0))


def reaches(s: Column, bits: Column, window: int = WINDOW) -> Column:
    """Whether some window has that entropy. No chunk is looked at after the first one that has, nor one with too few different characters to have it."""
    most = (F.lit(math.log2(window)) - bits) * window + 1e-9
    return F.exists(_chunks(s, window), lambda part: (F.log2(F.size(F.array_distinct(part)).cast("double")) >= bits - 1e-9) & (_least(part, window) <= most))


def _secret(s: Column) -> Column:
    """Whether a candidate's entropy reaches its class's threshold and no allow-list entry matches."""
    need = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        need = F.when(s.rlike(pattern), bits).otherwise(need)
    known = F.lit(False)
    for pattern in ALLOWED:
        known = known | s.rlike(pattern)
    return ~known & reaches(s, need)


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, added): sorted spans struct<start,kind,end> of every row; kind is an index into KINDS.

    base are the pattern matches. added are the high-entropy candidates in the text once
    base spans are blanked; runs of fewer than WINDOW characters hold no window and are
    none, nor are runs of digits, or of letters of one case. Offsets count code points,
    end exclusive. A null text is empty: no spans. Repeated rows give repeated rows; other
    columns are not read. No shuffle: each row is scanned where it is read.
    """
    bare = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    t = F.col("text")
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.array_sort(bare(F.concat(_spans(t, ASSIGN, 0, 2, MIN_ASSIGN), _spans(t, ACCESS, 1, 0, MIN_ACCESS), _spans(t, HEX, 2)))).alias("base"), _blanked(t, ASSIGN, 2, MIN_ASSIGN).alias("text"))
    rows = rows.select("doc_id", "base", _blanked(t, ACCESS, 0, MIN_ACCESS).alias("text"))
    rows = rows.select("doc_id", "base", _blanked(t, HEX).alias("text"))
    return rows.select("doc_id", "base", bare(F.filter(_spans(t, CANDIDATE, 3), lambda c: _secret(c["s"]))).alias("added"))


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array(*map(F.lit, KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{KINDS[i]}") for i in range(3)),
        F.sha2(said(F.col("base")), 256).alias("base_sha256"),
        said(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
