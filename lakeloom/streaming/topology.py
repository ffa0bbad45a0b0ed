"""Streams: sources, keyed windows, joins, folds and sinks over Structured Streaming.

The transforms are the batch ones: the same function takes a batch or a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Topology:
    """Named streams, a chain of operators for each processor, and the queries that run them."""

    def __init__(self, spark: SparkSession, checkpoint_dir: str):
        self.spark, self.checkpoint_dir = spark, checkpoint_dir
        self.streams: dict[str, DataFrame] = {}
        self.queries: dict[str, object] = {}

    def stream(self, name: str, df: DataFrame) -> DataFrame:
        self.streams[name] = df
        return df

    def process(self, source: str, name: str, *operators: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A chain of operators, left to right, on a stream; the result is a stream too."""
        if source not in self.streams:
            raise ValueError(f"no stream {source}")
        df = self.streams[source]
        for operator in operators:
            df = df.transform(operator)
        return self.stream(name, df)

    def publish(self, name: str, path: str, mode: str = "append") -> None:
        """Run a stream into parquet files, exactly once: replayable source, idempotent sink, own checkpoint."""
        writer = self.streams[name].writeStream.format("parquet").option("path", path)
        self._start(name, writer, mode)

    def consume(self, name: str, handlers: dict[str, Callable[[DataFrame], None]], kind: str = "event_type") -> None:
        """Give each micro-batch's rows to the handler of their type; "*" takes the rest, rows without a type among them."""

        def dispatch(batch: DataFrame, _: int) -> None:
            batch.persist()
            for wanted, handler in handlers.items():
                handler(batch.where(~F.coalesce(F.col(kind).isin([h for h in handlers if h != "*"]), F.lit(False))) if wanted == "*" else batch.where(F.col(kind) == wanted))
            batch.unpersist()

        self._start(name, self.streams[name].writeStream.foreachBatch(dispatch), "append")

    def _start(self, name: str, writer, mode: str) -> None:
        self.queries[name] = writer.outputMode(mode).option("checkpointLocation", f"{self.checkpoint_dir}/{name}").trigger(availableNow=True).start()

    def stop_all(self) -> None:
        for q in self.queries.values():
            q.stop()

    def await_all(self) -> None:
        for q in self.queries.values():
            q.awaitTermination()

    def stats(self) -> dict[str, dict]:
        """Rows read by each query, and rows dropped as late."""
        out = {}
        for name, q in self.queries.items():
            progress = q.recentProgress
            out[name] = {"rows": sum(p["numInputRows"] for p in progress), "late": sum(s.get("numRowsDroppedByWatermark", 0) for p in progress for s in p["stateOperators"])}
        return out

    def watermark(self, name: str) -> str | None:
        """The event-time watermark that a query has reached, as its last progress tells."""
        told = [p["eventTime"].get("watermark") for p in self.queries[name].recentProgress if p["eventTime"]]
        return told[-1] if told else None


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream, ts as a timestamp."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rpartition("/")
    # a table may be one file: the stream then watches its folder for that name
    df = reader.option("pathGlobFilter", name).parquet(folder) if not _is_folder(spark, path) else reader.parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in schema.names else df


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def user_action(users: DataFrame) -> DataFrame:
    """Envelopes of user actions: event type, key and JSON data."""
    return users.select(F.lit("user_action").alias("event_type"), F.col("user_id").cast("string").alias("partition_key"), "ts", F.to_json(F.struct("*")).alias("data"))


def system_event(df: DataFrame, component: str) -> DataFrame:
    """Envelopes of system events: keyed by the component."""
    return df.select(F.lit("system_event").alias("event_type"), F.lit(component).alias("partition_key"), "ts", F.to_json(F.struct("*")).alias("data"))


def opened(envelopes: DataFrame, schema: str) -> DataFrame:
    """The data of envelopes, back from JSON."""
    return envelopes.select("event_type", "partition_key", F.from_json("data", schema).alias("d")).select("event_type", "partition_key", "d.*")


def with_partition(df: DataFrame, key: str, n: int = 16) -> DataFrame:
    """The partition of any key, numeric or not."""
    return df.withColumn("partition", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def tumbling(df: DataFrame, keys: list[str], size: str, delay: str = "10 seconds", slide: str | None = None) -> DataFrame:
    """Sum and count by key over tumbling, or with a slide sliding, event-time windows."""
    if df.isStreaming:
        df = df.withWatermark("ts", delay)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = df.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "total")


def sessions(df: DataFrame, keys: list[str], gap: str, delay: str = "10 seconds") -> DataFrame:
    if df.isStreaming:
        df = df.withWatermark("ts", delay)
    out = df.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def join_within(left: DataFrame, right: DataFrame, key: str, within: str, delay: str = "10 seconds") -> DataFrame:
    """Pairs with equal keys and times at most `within` apart, in order (left, right)."""
    a = left.select(F.col(key).alias("k"), F.col("event_id").alias("left_id"), F.col("ts").alias("left_ts"))
    b = right.select(F.col(key).alias("k2"), F.col("event_id").alias("right_id"), F.col("ts").alias("right_ts"))
    if left.isStreaming:
        a, b = a.withWatermark("left_ts", delay), b.withWatermark("right_ts", delay)
    near = F.expr(f"k = k2 AND right_ts BETWEEN left_ts - INTERVAL {within} AND left_ts + INTERVAL {within}")
    return a.join(b, near).select("k", "left_id", "right_id")


class Fold(StatefulProcessor):
    """A keyed fold of (state, value) in order of (ts, event_id) within a micro-batch; each batch gives the new state."""

    def __init__(self, step: Callable[[float, float], float], start: float):
        self.step, self.start = step, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", "total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total = self.state.get()[0] if self.state.exists() else self.start
        for v in pd.concat(list(rows)).sort_values(["ts", "event_id"])["value"]:
            total = self.step(total, float(v))
        self.state.update((total,))
        yield pd.DataFrame({"key": [key[0]], "total": [total]})

    def close(self) -> None:
        pass


def fold(df: DataFrame, key: str, step: Callable[[float, float], float], start: float = 0.0) -> DataFrame:
    """Run an arbitrary fold by key with managed state; needs the RocksDB state store."""
    rows = df.select(F.col(key).cast("string").alias("key"), "ts", "event_id", "value")
    return rows.groupBy("key").transformWithStateInPandas(Fold(step, start), outputStructType="key string, total double", outputMode="Update", timeMode="None")


class Idle(StatefulProcessor):
    """Counts a key's rows, and tells of a key once nothing has come for `gap_ms` of event time: the timer of its last row expires."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "n long, last_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, last = self.state.get() if self.state.exists() else (0, 0)
        told = []
        if n:
            self.handle.deleteTimer(last + self.gap_ms)
            if last + self.gap_ms <= timerValues.getCurrentWatermarkInMs():  # it had expired before these rows came
                told, n = [(key[0], n, last)], 0
        for part in rows:
            newest = int(part["ms"].max())
            n, last = n + len(part), max(last, newest) if n else newest
        self.state.update((n, last))
        self.handle.registerTimer(last + self.gap_ms)
        yield pd.DataFrame(told, columns=["key", "n", "last_ms"]).astype({"key": object, "n": "int64", "last_ms": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, last = self.state.get()
        self.state.clear()
        yield pd.DataFrame({"key": [key[0]], "n": [n], "last_ms": [last]})

    def close(self) -> None:
        pass


def idle(df: DataFrame, key: str, gap_s: int, delay: str = "10 seconds") -> DataFrame:
    """(key, n, last_ms) of each key that fell silent for gap_s seconds of event time, by timers; needs the RocksDB state store.

    Rows without a time are left out; a null key is a key. What has been told is forgotten, so the state holds live keys only.
    """
    rows = df.where("ts IS NOT NULL").withWatermark("ts", delay).select(F.col(key).cast("string").alias("key"), F.unix_millis("ts").alias("ms"), "ts")
    return rows.groupBy("key").transformWithStateInPandas(Idle(gap_s * 1000), outputStructType="key string, n long, last_ms long", outputMode="Append", timeMode="EventTime")


def run_to_table(df: DataFrame, folder: str, mode: str = "append", keep_last: str | None = None) -> DataFrame:
    """Run a stream over all there is and read its sink back. With keep_last, an updated key's last row counts.

    In append mode the windows after the last watermark are still open and not in the sink.
    """
    spark = df.sparkSession
    path = f"{folder}/out"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(path).drop("batch")
    if keep_last:
        keys = keep_last.split(",")
        rest = [c for c in out.columns if c not in keys and c != "epoch"]
        out = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("r")).select(*keys, "r.*")
    return out.drop("epoch")
