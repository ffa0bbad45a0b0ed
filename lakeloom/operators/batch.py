"""MapReduce jobs and cleaning."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lakeloom.functions.columns import title_case, whole_number, words


def word_count(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def log_status(df: DataFrame, position: int = 8, line: str = "line") -> DataFrame:
    """Lines by the token at a position, counted from 0; shorter lines are left out."""
    t = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    return df.select(t.alias("t")).where(F.size("t") > position).groupBy(F.get("t", F.lit(position)).alias("status")).agg(F.count("*").alias("n"))


def sales_by_region(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("region", F.lit("unknown")).alias("region")).agg(F.sum(F.coalesce("amount", F.lit(0.0))).alias("amount"))


def activity_by_user(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce(F.col("user_id").cast("string"), F.lit("unknown")).alias("user_id")).agg(F.count("*").alias("n"))


#: Keys that a map task holds before it passes their accumulators on.
HELD_KEYS = 200_000


def map_reduce(df: DataFrame, mapper: Callable[[Any], Iterable[tuple]], create: Callable, merge: Callable, combine: Callable, reducer: Callable[[Any, Any], Any], schema: str) -> DataFrame:
    """Opaque functions as a job: row -> (key, value) pairs, a mergeable accumulator a key, then (key, accumulator) -> result.

    Accumulators are combined before the shuffle, so a hot key sends one from each task;
    after it they come sorted by key and are combined as they stream by. Only jobs without
    a column expression need this.
    """
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def mapped(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(map(pickle.dumps, x)), pa.binary()) for x in (held.keys(), held.values())], ["key", "held"])

        for b in rows:
            for row in b.to_pylist():
                for key, value in mapper(Row(**row)):
                    held[key] = merge(held[key], value) if key in held else create(value)
            if len(held) > HELD_KEYS:
                yield passed()
                held.clear()
        yield passed()

    def reduced(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        out: list = []
        for b in rows:
            for key, value in zip(b.column(0).to_pylist(), map(pickle.loads, b.column(1).to_pylist())):
                if key == last:
                    held = combine(held, value)
                    continue
                if last is not None:
                    out.append((pickle.loads(last), held))
                last, held = key, value
            if out:
                yield results(out)
                out = []
        if last is not None:
            yield results([(pickle.loads(last), held)])

    def results(pairs: list) -> pa.RecordBatch:
        said = [(k, reducer(k, x)) for k, x in pairs]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*said), kind)], schema=kind)

    pairs = df.mapInArrow(mapped, "key binary, held binary")
    return pairs.repartition("key").sortWithinPartitions("key").mapInArrow(reduced, schema)


def clean_users(df: DataFrame) -> DataFrame:
    """Drop empty names; title-case the name, lower the mail, age as int if all digits."""
    return df.where("name IS NOT NULL AND name <> ''").select("id", title_case(F.col("name")).alias("name"), F.lower("email").alias("email"), whole_number(F.col("age")).alias("age"))


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, rows): how many rows break each SQL condition; null breaks it."""
    broken = df.agg(*[F.count_if(~F.coalesce(F.expr(sql), F.lit(False))).alias(name) for name, sql in rules.items()])
    return broken.select(F.explode(F.create_map(*[x for name in rules for x in (F.lit(name), F.col(name))])).alias("rule", "rows"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference has no target."""
    return child.join(parent.select(F.col(parent_key).alias("__p")).distinct(), F.col(key) == F.col("__p"), "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def sorted_partitions(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key and sorted within each part, as reducers see them."""
    return df.repartition(key).sortWithinPartitions(key)
