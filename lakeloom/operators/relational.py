"""Relational and document operators: repositories, nested rows, trees, event patterns, interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def find_many(df: DataFrame, wanted: dict, key: str, skip: int = 0, limit: int = 20) -> DataFrame:
    """Rows equal to the wanted values, paged in the key's order."""
    for name, value in wanted.items():
        df = df.where(F.col(name) == F.lit(value))
    return df.orderBy(key).offset(skip).limit(limit)


def find_by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).limit(1)


def update(df: DataFrame, key: str, value, changes: dict) -> DataFrame:
    """df with fields set where the key matches."""
    hit = F.col(key) == F.lit(value)
    return df.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()})


def delete(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(~F.col(key).eqNullSafe(F.lit(value)))


def with_author(posts: DataFrame, users: DataFrame, key: str = "author", user_key: str = "id") -> DataFrame:
    """Posts with the author as a struct."""
    u = users.select(F.col(user_key).alias("__id"), F.struct("*").alias("author_row"))
    return posts.join(u, F.col(key) == F.col("__id")).drop("__id")


def tree_depth(comments: DataFrame) -> DataFrame:
    """Depth of each comment of (conv_id, turn) whose parent is turn - 1; a comment without its parent is a root.

    A recursive query in one statement.
    """
    spark = comments.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(
        """
        WITH RECURSIVE c AS (SELECT DISTINCT conv_id, turn FROM {comments}),
        tree(conv_id, turn, depth) AS (
            SELECT a.conv_id, a.turn, 0 FROM c a LEFT ANTI JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1
            UNION ALL
            SELECT c.conv_id, c.turn, t.depth + 1 FROM tree t JOIN c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1
        )
        SELECT conv_id, turn, depth FROM tree
        """,
        comments=comments.select("conv_id", "turn"),
    )


def followed_by(acts: DataFrame, first: str, then: list[str], within_s: int) -> DataFrame:
    """Users with an action `first` and, later by at most within_s seconds, one of `then`."""
    a = acts.where(F.col("action") == first).select("user_id", F.col("ts").alias("t0"))
    b = acts.where(F.col("action").isin(then)).select(F.col("user_id").alias("u"), F.col("ts").alias("t1"))
    cond = (F.col("user_id") == F.col("u")) & (F.col("t1") > F.col("t0")) & (F.col("t1") <= F.col("t0") + F.make_dt_interval(secs=F.lit(within_s)))
    return a.join(b, cond, "left_semi").select("user_id").distinct()


def interval_join(left: DataFrame, right: DataFrame, key: str, within_s: int, ts: str = "ts") -> DataFrame:
    """Equal keys and times at most within_s apart, both ends included. Time buckets join the equality, so a hot key is spread over them."""
    width = within_s * 1_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    a = left.select(F.struct(*left.columns).alias("l"), F.col(key).alias("k1"), micros(ts).alias("t1")).withColumn("b", F.floor(F.col("t1") / width))
    b = right.select(F.struct(*right.columns).alias("r"), F.col(key).alias("k2"), micros(ts).alias("t2")).withColumn("b0", F.floor(F.col("t2") / width))
    b = b.withColumn("b2", F.explode(F.array(F.col("b0") - 1, F.col("b0"), F.col("b0") + 1)))
    return a.join(b, (F.col("k1") == F.col("k2")) & (F.col("b") == F.col("b2"))).where(F.abs(F.col("t1") - F.col("t2")) <= width).select("l", "r")


def create(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """df with new documents; a key that is there already is left as it is."""
    return df.unionByName(rows.join(df.select(key), key, "left_anti"), allowMissingColumns=True)


def count(df: DataFrame, wanted: dict) -> DataFrame:
    """One row: how many rows equal the wanted values."""
    for name, value in wanted.items():
        df = df.where(F.col(name) == F.lit(value))
    return df.agg(F.count("*").alias("n"))


def last_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows of a log, in its order."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)


def after(df: DataFrame, order: str, value, n: int = 100) -> DataFrame:
    """The first n rows of a log after a position."""
    return df.where(F.col(order) > F.lit(value)).orderBy(order).limit(n)


def holding(df: DataFrame, column: str, wanted: list, every: bool = False) -> DataFrame:
    """Rows whose array holds one, or every one, of the wanted values."""
    held = [F.array_contains(column, w) for w in wanted]
    return df.where(F.forall(F.array(*held), lambda x: x) if every else F.arrays_overlap(column, F.array(*map(F.lit, wanted))))
