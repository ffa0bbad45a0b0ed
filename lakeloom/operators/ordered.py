"""Ordered windows over groups too large for one task.

A group is cut into cells of equal time. Rows meet inside a cell; across cells only what is
small does: sums of cells, or the few rows at a cell's ends. A key with a third of all rows
is so spread over as many tasks as it has cells. `ts` may be null: those rows are a cell of
their own, the first. The order must be total, ties broken by an id, for results to repeat.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CELL_S = 3600


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def cell_of(ts: str, length_s: int) -> Column:
    return F.floor(micros(ts) / F.lit(length_s * 1_000_000)).cast("long")


def same(left: str, right: str, names: list[str]) -> Column:
    """Equality of columns of two aliases, nulls included."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{left}.`{n}`").eqNullSafe(F.col(f"{right}.`{n}`"))
    return out


def over_preceding(df: DataFrame, keys: list[str], order: tuple[str, ...], rows: int, columns: Callable[[WindowSpec], dict[str, Column]], cell_s: int = CELL_S) -> DataFrame:
    """df with columns that look at no more than `rows` rows before a row; order[0] is the time.

    All but the first `rows` rows of a cell look inside it. The first look at the ends of cells
    alone, 2 x `rows` rows a cell: the `rows` rows before a cell's start are always among them.
    """
    cut = df.withColumn("__cell", cell_of(order[0], cell_s))
    cell = Window.partitionBy(*keys, "__cell")
    cut = cut.withColumn("__rn", F.row_number().over(cell.orderBy(*order))).withColumn("__size", F.count("*").over(cell))
    first, last = F.col("__rn") <= rows, F.col("__size") - F.col("__rn") < rows
    inner = cut.withColumns(columns(cell.orderBy(*order))).where(~first)
    ends = cut.where(first | last).withColumns(columns(Window.partitionBy(*keys).orderBy(*order))).where(first)
    return inner.unionByName(ends).drop("__cell", "__rn", "__size")


def running_sum(df: DataFrame, keys: list[str], order: tuple[str, ...], value: str, name: str, cell_s: int = CELL_S) -> DataFrame:
    """df with `name`, the sum of value from the group's first row to this one: the sum inside the cell and that of all cells before. Null until the first value."""
    cut = df.withColumn("__cell", cell_of(order[0], cell_s))
    sums = cut.groupBy(*keys, "__cell").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # a row a cell
    sums = sums.withColumn("__before", F.sum("__sum").over(before)).drop("__sum")
    inside = F.sum(value).over(Window.partitionBy(*keys, "__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = cut.withColumn("__inside", inside).alias("l").join(sums.alias("r"), same("l", "r", [*keys, "__cell"]))
    total = F.coalesce(F.col("__inside") + F.col("__before"), F.col("__inside"), F.col("__before"))
    return both.select(*[F.col(f"l.`{c}`") for c in df.columns], total.alias(name))


def over_trailing(df: DataFrame, keys: list[str], ts: str, length_s: int, columns: Callable[[WindowSpec], dict[str, Column]], cell_s: int = CELL_S) -> DataFrame:
    """df with columns over the rows newer than `length_s` before each row; `__us` is the time there.

    A cell is no shorter than the window, so a row is wanted in its own cell and in the next one if it lies near its end.
    """
    size = max(cell_s, length_s)
    near = F.col("__us") > (F.col("__own") + 1) * (size * 1_000_000) - length_s * 1_000_000
    cells = F.when(near, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))
    cut = df.withColumn("__us", micros(ts)).withColumn("__own", cell_of(ts, size)).withColumn("__cell", F.explode(cells))
    w = Window.partitionBy(*keys, "__cell").orderBy("__us").rangeBetween(-(length_s * 1_000_000 - 1), 0)
    return cut.withColumns(columns(w)).where(F.col("__cell").eqNullSafe(F.col("__own"))).drop("__us", "__own", "__cell")


def ranked_values(df: DataFrame, keys: list[str], value: str, ps: list[int], accuracy: int = 10_000) -> DataFrame:
    """For each group and p the value at rank min(floor(n p / 100), n - 1) of its n non-null values; null if there are none.

    A quantile sketch brackets each rank; values under the bracket are only counted, those in it
    counted each, some thousandth of the group. A rank outside its bracket, which the sketch's bound rules out, is an error.
    """
    margin = 5 / accuracy
    marks = [min(1.0, max(0.0, p / 100 + side * margin)) for p in ps for side in (-1, 1)]
    groups = df.groupBy(*keys).agg(F.percentile_approx(value, marks, accuracy).alias("__marks"), F.count(value).alias("__n"))
    both = df.select(*keys, F.col(value).alias("__v")).alias("l").join(groups.alias("r"), same("l", "r", keys))
    asked = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col("__marks")[2 * i].alias("lo"), F.col("__marks")[2 * i + 1].alias("hi")) for i, p in enumerate(ps)]))
    rows = both.select(*[F.col(f"l.`{k}`") for k in keys], "__v", "__n", asked.alias("__p")).where("__v IS NULL OR __v <= __p.hi")
    counted = rows.groupBy(*keys, "__n", F.col("__p.p").alias("__p"), F.when(F.col("__v") >= F.col("__p.lo"), F.col("__v")).alias("__v")).agg(F.count("__v").alias("__k"))
    upto = F.sum("__k").over(Window.partitionBy(*keys, "__p").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))  # nulls, those below, first
    at = F.least(F.floor(F.col("__n") * F.col("__p") / 100), F.col("__n") - 1)
    hit = counted.withColumn("__hit", upto > at).groupBy(*keys, "__p").agg(F.max("__n").alias("__n"), F.min(F.when(F.col("__hit"), F.col("__v"))).alias("__v"), F.bool_or(F.col("__hit") & F.col("__v").isNull()).alias("__off"))
    sure = F.when((F.col("__n") > 0) & (F.col("__off") | F.col("__v").isNull()), F.raise_error(F.lit("a rank lies outside its bracket"))).otherwise(F.col("__v"))
    return hit.withColumn("__v", sure).groupBy(*keys).agg(*[F.max(F.when(F.col("__p") == p, F.col("__v"))).alias(f"p{p}") for p in ps])
