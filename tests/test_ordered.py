"""Cell-wise windows against plain ones, on a hot key, sparse cells, ties and nulls."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.operators import ordered

ORDER = ("ts", "id")


@pytest.fixture(scope="module")
def points(spark):
    draw = random.Random(7)
    rows = []
    for i in range(1500):
        key = draw.choice(["hot", "hot", "hot", "cold", None]) if i % 50 else f"rare{i}"
        at = None if draw.random() < 0.01 else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(draw.choice([draw.random() ** 4 * 400_000, draw.randrange(50) * 600])))
        rows.append((i, key, at, None if draw.random() < 0.05 else float(draw.choice([draw.randrange(5), draw.gauss(0, 100) // 1]))))
    return spark.createDataFrame(rows, "id long, key string, ts timestamp, v double").cache()


def same(got, want):
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("rows", [1, 4, 10])
def test_preceding_rows(points, rows):
    def sums(w):
        w = w.rowsBetween(-rows, -1)
        return {"s": F.sum("v").over(w), "n": F.count("*").over(w)}

    want = points.withColumns(sums(Window.partitionBy("key").orderBy(*ORDER)))
    for cell_s in (60, 3600, 10_000_000):
        same(ordered.over_preceding(points, ["key"], ORDER, rows, sums, cell_s), want)


def test_running_sum(points):
    w = Window.partitionBy("key").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    for cell_s in (60, 3600):
        same(ordered.running_sum(points, ["key"], ORDER, "v", "s", cell_s), points.withColumn("s", F.sum("v").over(w)))


@pytest.mark.parametrize("length_s", [1, 300, 5000])
def test_trailing(points, length_s):
    def sums(w):
        return {"s": F.sum("v").over(w), "n": F.count("*").over(w)}

    w = Window.partitionBy("key").orderBy("us").rangeBetween(-(length_s * 1_000_000 - 1), 0)
    want = points.withColumn("us", F.unix_micros("ts")).withColumns(sums(w)).drop("us")
    for cell_s in (60, 3600):
        same(ordered.over_trailing(points, ["key"], "ts", length_s, sums, cell_s), want)


def test_ranked_values(spark, points):
    ps = [0, 1, 50, 95, 99, 100]
    got = {r["key"]: r for r in ordered.ranked_values(points, ["key"], "v", ps).collect()}
    groups = {}
    for r in points.collect():
        groups.setdefault(r["key"], []).append(r["v"])
    assert got.keys() == groups.keys()
    for key, found in groups.items():
        held = sorted(x for x in found if x is not None)
        for p in ps:
            assert got[key][f"p{p}"] == (held[min(len(held) * p // 100, len(held) - 1)] if held else None)


def test_ranked_values_of_many(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("a").alias("key"), F.when(F.col("id") % 3 == 0, 1.0).otherwise((F.col("id") * 7919) % n).cast("double").alias("v"))
    held = sorted(1.0 if i % 3 == 0 else float(i * 7919 % n) for i in range(n))
    row = ordered.ranked_values(df, ["key"], "v", [10, 50, 99]).first()
    assert [row[f"p{p}"] for p in (10, 50, 99)] == [held[n * p // 100] for p in (10, 50, 99)]


def test_empty(spark, points):
    none = points.limit(0)
    assert ordered.ranked_values(none, ["key"], "v", [50]).count() == 0
    assert ordered.running_sum(none, ["key"], ORDER, "v", "s").columns == [*points.columns, "s"]
    assert ordered.over_preceding(none, ["key"], ORDER, 2, lambda w: {"p": F.lag("v").over(w)}).count() == 0
