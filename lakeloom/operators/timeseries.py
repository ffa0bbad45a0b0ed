"""Time-series operators: downsampling, sessions, anomalies, trailing windows, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators import ordered


def downsample(df: DataFrame, interval: str, keys: list[str], value: str = "value", ts: str = "ts", function: str = "avg") -> DataFrame:
    """Bucket by an epoch-aligned interval and aggregate: sum, avg, min, max or count; always with the count."""
    agg = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[function]
    out = df.groupBy(*keys, F.window(ts, interval).alias("w")).agg(agg(value).alias("value"), F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("bucket"), "value", "n")


def query(df: DataFrame, metric: str | None = None, start=None, end=None, interval: str = "5 minutes", function: str = "avg", filters: dict | None = None, group_by: list[str] | None = None) -> DataFrame:
    """The time-series query contract: filter by metric, time and tags, bucket, group by tags."""
    if metric is not None:
        df = df.where(F.col("metric_name") == metric)
    if start is not None:
        df = df.where(F.col("ts") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("ts") <= F.lit(end))
    for name, wanted in (filters or {}).items():
        df = df.where(F.col(name) == wanted)
    if function.startswith("p") and function[1:].isdigit():
        keyed = df.withColumn("bucket", F.window("ts", interval)["start"])
        return ordered.ranked_values(keyed, ["metric_name", *(group_by or []), "bucket"], "value", [int(function[1:])])
    return downsample(df, interval, ["metric_name", *(group_by or [])], function=function)


def sessions(df: DataFrame, gap: str, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Sessions by gap: start, last event, events and duration in seconds. Events exactly a gap apart belong together."""
    out = df.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))
    return out.select(user, "first_ts", "last_ts", "n", seconds("last_ts", "first_ts").alias("duration"))


def seconds(later: str, earlier: str) -> Column:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def anomalies(df: DataFrame, keys: list[str], window: int = 10, threshold: float = 2.0, order: tuple[str, ...] = ("ts", "event_id"), value: str = "value") -> DataFrame:
    """Rows further than threshold population deviations from the mean of the `window` rows before them."""
    def before(w):
        w = w.rowsBetween(-window, -1)
        return {"mean": F.avg(value).over(w), "dev": F.stddev_pop(value).over(w), "held": F.count(value).over(w)}

    out = ordered.over_preceding(df, keys, order, window, before)
    return out.where((F.col("held") == window) & (F.abs(F.col(value) - F.col("mean")) > threshold * F.col("dev"))).drop("held")


def trailing(df: DataFrame, keys: list[str], length_s: int = 300, ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean and rate over the rows newer than `length_s` before each row; the rate needs two rows and a span."""

    def near(w):
        span = (F.max("__us").over(w) - F.min("__us").over(w)) / F.lit(1e6)
        n = F.count("*").over(w)
        return {"current_avg": F.avg(value).over(w), "current_rate": F.when((n >= 2) & (span > 0), n / F.nullif(span, F.lit(0.0)))}

    return ordered.over_trailing(df, keys, ts, length_s, near)


def bounce_rate(found: DataFrame) -> DataFrame:
    """The share of sessions with one event; 0 without sessions."""
    return found.agg(F.coalesce(F.avg(F.when(F.col("n") == 1, 1.0).otherwise(0.0)), F.lit(0.0)).alias("bounce_rate"), F.count("*").alias("sessions"))


def popular_pages(acts: DataFrame) -> DataFrame:
    seen = acts.where("action = 'view_page' AND page_url IS NOT NULL AND page_url <> ''")
    return seen.groupBy("page_url").agg(F.count("*").alias("views")).orderBy(F.desc("views"), "page_url")


def journeys(acts: DataFrame) -> DataFrame:
    """Each user's viewed pages in order of time."""
    seen = acts.where("action = 'view_page' AND page_url IS NOT NULL")
    steps = F.array_sort(F.collect_list(F.struct("ts", "event_id", "page_url")))
    return seen.groupBy("user_id").agg(F.transform(steps, lambda x: x["page_url"]).alias("pages"))


def availability(df: DataFrame, keys: list[str], threshold: float, value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.when(F.col(value) >= threshold, 1.0).otherwise(0.0)).alias("availability"))


def recent_activity(df: DataFrame, seconds_back: int, action: str = "action", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """(action, n, users): actions and distinct users of the rows at most so many seconds older than the newest; a row with a null action counts all."""
    newest = df.agg(F.max(ts).alias("__newest"))  # one row
    near = df.crossJoin(F.broadcast(newest)).where(F.col(ts) >= F.col("__newest") - F.make_dt_interval(secs=F.lit(seconds_back)))
    return near.rollup(action).agg(F.count("*").alias("n"), F.countDistinct(user).alias("users"))
