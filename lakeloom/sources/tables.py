"""Readers of the tables, and the social-media views derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all is one process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lakeloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_date_partition(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add the partition columns of time-series tables: date_partition (yyyy-MM-dd) and hour_partition."""
    return df.withColumn("date_partition", F.date_format(ts, "yyyy-MM-dd")).withColumn("hour_partition", F.hour(ts))


def time_range(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Rows of [start, end], with the partition predicate that lets a partitioned table skip whole days."""
    out = df.where(F.col(ts).between(F.lit(start), F.lit(end)))
    if "date_partition" in df.columns:
        out = out.where(F.col("date_partition").between(F.date_format(F.lit(start).cast("timestamp"), "yyyy-MM-dd"), F.date_format(F.lit(end).cast("timestamp"), "yyyy-MM-dd")))
    return out


def write_points(df: DataFrame, path: str, ts: str = "ts", mode: str = "append") -> None:
    """Append points to a table partitioned by day."""
    with_date_partition(df, ts).write.mode(mode).partitionBy("date_partition").parquet(path)


def delete_older(df: DataFrame, days: int, ts: str = "ts", anchor=None) -> DataFrame:
    """Retention: rows not older than `days` before the anchor, by default the newest row."""
    newest = df.agg(F.max(ts).alias("__newest")) if anchor is None else df.sparkSession.range(1).select(F.lit(anchor).cast("timestamp_ntz").alias("__newest"))
    return df.crossJoin(F.broadcast(newest)).where(F.col(ts) >= F.col("__newest") - F.make_dt_interval(F.lit(days))).drop("__newest")  # one row


def _k() -> Column:
    return F.get_json_object("props", "$.k")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User activity: events with their action and page."""
    action = F.when(F.col("event_type") == "view", "view_page").when(F.col("event_type") == "signup", "login").when(F.col("event_type") == "click", "like_post").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", action.alias("action"), F.concat(F.lit("/p/"), _k()).alias("page_url"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric points: name, ts, value and the tag k."""
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("metric_name"), "ts", "value", _k().alias("k"))


def perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request metrics: endpoint, response time, status."""
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.concat(F.lit("/"), "event_type").alias("endpoint"), F.col("value").alias("response_time"), status.alias("status_code"))


def _edges(spark: SparkSession, sf_dir: str, first_lines: bool) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    users = table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))  # one row
    if first_lines:
        lines = lines.where("l_linenumber = 1")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).crossJoin(F.broadcast(users)).where("l_partkey < n AND l_partkey <> o_custkey")
    return joined.select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, False)


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, True)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("post_id"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("published_at"))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.col("l_orderkey").alias("post"), F.col("p_brand").alias("tag")).distinct()


def likes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("user"), F.col("l_orderkey").alias("post")).distinct()


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key-value operation log: seq breaks ties of ts."""
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("user:"), F.col("o_custkey").cast("string")).alias("key"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") == "P").alias("deleted"), "o_orderstatus")


def tx_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "read").when(F.col("l_returnflag") == "A", "write").otherwise("delete")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tx"), F.col("l_partkey").alias("resource"), kind.alias("type"), F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"), "l_extendedprice")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {x: table(spark, sf_dir, x) for x in ("orders", "customer", "nation", "region")}
    return t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), F.col("o_totalprice").alias("amount"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access-log lines in the combined format, ten tokens with date and zone."""
    p = perf(spark, sf_dir)
    return p.select(F.format_string('h - u [%s +0000] "GET %s HTTP/1.1" %d %d', F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), "endpoint", "status_code", F.col("event_id").cast("int")).alias("line"))


#: The views' SQL in DuckDB, for the oracles.
VIEW_SQL = {
    "activity": "SELECT event_id, ts, user_id, value, CASE event_type WHEN 'view' THEN 'view_page' WHEN 'signup' THEN 'login' WHEN 'click' THEN 'like_post' ELSE event_type END AS action, '/p/' || json_extract_string(props, '$.k') AS page_url FROM events",
    "metrics": "SELECT event_id, event_type AS metric_name, ts, value, json_extract_string(props, '$.k') AS k FROM events",
    "perf": "SELECT event_id, ts, user_id, '/' || event_type AS endpoint, value AS response_time, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code FROM events",
    "follows": "SELECT DISTINCT o_custkey AS src, l_partkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey < (SELECT count(*) FROM customer) AND l_partkey <> o_custkey",
    "shares": "SELECT DISTINCT o_custkey AS src, l_partkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND l_partkey < (SELECT count(*) FROM customer) AND l_partkey <> o_custkey",
    "posts": "SELECT o_orderkey AS post_id, o_custkey AS author, o_orderdate AS published_at FROM orders",
    "tagged": "SELECT DISTINCT l_orderkey AS post, p_brand AS tag FROM lineitem JOIN part ON l_partkey = p_partkey",
    "likes": 'SELECT DISTINCT l_suppkey AS "user", l_orderkey AS post FROM lineitem',
    "kv_log": "SELECT 'user:' || o_custkey AS key, o_totalprice AS value, o_orderdate AS ts, o_orderkey AS seq, o_orderstatus = 'P' AS deleted, o_orderstatus FROM orders",
    "tx_ops": "SELECT l_orderkey AS tx, l_partkey AS resource, CASE l_returnflag WHEN 'R' THEN 'read' WHEN 'A' THEN 'write' ELSE 'delete' END AS type, l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem",
    "sales": "SELECT r_name AS region, o_totalprice AS amount FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
}


def sql(views: str, query: str) -> str:
    """A DuckDB query over the named views."""
    return "WITH " + ", ".join(f"{v} AS ({VIEW_SQL[v]})" for v in views.split()) + " " + query
