"""Monitoring operators on metric points (metric_name, ts, value, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators import ordered


def last_points(df: DataFrame, n: int = 1000) -> DataFrame:
    """The newest n points of each metric."""
    w = Window.partitionBy("metric_name").orderBy(F.desc("ts"), F.desc("event_id"))
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def statistics(df: DataFrame, n: int = 1000) -> DataFrame:
    at = F.struct("ts", "event_id")
    return last_points(df, n).groupBy("metric_name").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"), F.max_by("value", at).alias("latest"), F.min_by("value", at).alias("first"))


def running_counter(df: DataFrame) -> DataFrame:
    """Counter totals: by name over all labels, and by name and label."""
    df = df.select("event_id", "metric_name", "k", "ts", "value")
    out = ordered.running_sum(df, ["metric_name"], ("ts", "event_id"), "value", "total")
    return ordered.running_sum(out, ["metric_name", "k"], ("ts", "event_id"), "value", "label_total").drop("ts", "value")


def error_rates(df: DataFrame) -> DataFrame:
    return df.groupBy("endpoint").agg(F.count("*").alias("requests"), F.count_if(F.col("status_code") >= 400).alias("errors"), F.avg("response_time").alias("mean_ms"), F.countDistinct("user_id").alias("users")).withColumn("error_rate", F.col("errors") / F.greatest("requests", F.lit(1)))


def health(df: DataFrame, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """Latest value of each metric classified by (warning, critical) thresholds."""
    latest = df.groupBy("metric_name").agg(F.max_by("value", F.struct("ts", "event_id")).alias("latest"))
    status = F.lit("ok")
    for name, (warn, bad) in rules.items():
        status = F.when((F.col("metric_name") == name) & (F.col("latest") >= bad), "critical").when((F.col("metric_name") == name) & (F.col("latest") >= warn), "warning").otherwise(status)
    return latest.withColumn("status", status)


def cumulative_users(df: DataFrame) -> DataFrame:
    """Distinct users so far, by day: each user counts on the day first seen."""
    first = df.groupBy("user_id").agg(F.min("ts").alias("ts")).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("new_users"))
    return first.withColumn("users", F.sum("new_users").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))  # a row a day


def deltas(df: DataFrame) -> DataFrame:
    """A cumulative gauge as increments."""
    return ordered.over_preceding(df, ["metric_name"], ("ts", "event_id"), 1, lambda w: {"delta": F.col("value") - F.lag("value").over(w)})


def exposition(df: DataFrame) -> DataFrame:
    """Text lines: help, type and the latest sample of each metric."""
    latest = df.groupBy("metric_name").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    name = F.col("metric_name")
    return latest.select(F.explode(F.array(F.concat(F.lit("# HELP "), name, F.lit(" "), name), F.concat(F.lit("# TYPE "), name, F.lit(" gauge")), F.concat(name, F.lit(" "), F.col("v").cast("string")))).alias("line"))


def catalogue(rows: DataFrame) -> DataFrame:
    """Registered metrics: (name, type, description, unit), the first registration of a name stays. rows also has seq."""
    return rows.groupBy("name").agg(F.min_by(F.struct("type", "description", "unit"), "seq").alias("m")).select("name", "m.*")


def record(points: DataFrame, known: DataFrame, kind: str) -> DataFrame:
    """The points of metrics registered under that type; others are ignored."""
    return points.join(F.broadcast(known.where(F.col("type") == kind).select(F.col("name").alias("metric_name"))), "metric_name", "left_semi")


def histogram(df: DataFrame, lo: float, hi: float, buckets: int) -> DataFrame:
    """Points of each metric by equal buckets of [lo, hi); 0 lies below and buckets + 1 above."""
    return df.groupBy("metric_name", F.expr(f"width_bucket(value, {float(lo)}D, {float(hi)}D, {int(buckets)})").alias("bucket")).agg(F.count("*").alias("n"))


def selected(df: DataFrame, names: list[str], n: int = 1000) -> DataFrame:
    """statistics() of the named metrics; unknown names give no row."""
    return statistics(df.where(F.col("metric_name").isin(names)), n)


def period(df: DataFrame, start, end) -> DataFrame:
    """The points of [start, end] of each metric, in order of time."""
    held = df.where(F.col("ts").between(F.lit(start), F.lit(end)))
    return held.groupBy("metric_name").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("points"))


def dashboard(df: DataFrame, hours: int = 1) -> DataFrame:
    """The latest value of each metric, and how many points, and what mean, it had in the last hours before the newest point of all."""
    newest = df.agg(F.max("ts").alias("newest"))  # one row
    near = F.col("ts") >= F.col("newest") - F.make_dt_interval(hours=F.lit(hours))
    return df.crossJoin(F.broadcast(newest)).groupBy("metric_name").agg(F.max_by("value", F.struct("ts", "event_id")).alias("latest"), F.count_if(near).alias("points"), F.avg(F.when(near, F.col("value"))).alias("mean"))
