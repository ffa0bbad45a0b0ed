"""Key-value operators: folds of an append-only operation log (key, value, ts, seq, deleted)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.columns import bloom_positions, md5_mod


def latest(log: DataFrame) -> DataFrame:
    """The newest live version of each key; ties of ts by seq. A tombstone hides the key."""
    newest = log.groupBy("key").agg(F.max_by(F.struct("value", "deleted", "ts", "seq"), F.struct("ts", "seq")).alias("v"))
    return newest.select("key", "v.*").where("NOT deleted").drop("deleted")


def get(log: DataFrame, key: str) -> DataFrame:
    return latest(log.where(F.col("key") == key))


def scan(log: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Live keys of [start, end], both inclusive, in order."""
    if start is not None:
        log = log.where(F.col("key") >= start)
    if end is not None:
        log = log.where(F.col("key") <= end)
    return latest(log).orderBy("key")


def put(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Append versions; rows has key, value, ts and seq."""
    return log.unionByName(rows.withColumn("deleted", F.lit(False)), allowMissingColumns=True)


def delete(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Append tombstones; rows has key, ts and seq."""
    return log.unionByName(rows.withColumn("value", F.lit(None)).withColumn("deleted", F.lit(True)), allowMissingColumns=True)


def compact(runs: list[DataFrame], path: str, partitions: int | None = None) -> None:
    """Merge runs, newest version first, drop tombstones, write sorted files."""
    whole = runs[0]
    for run in runs[1:]:
        whole = whole.unionByName(run)
    kept = latest(whole)
    spread = kept.repartitionByRange(partitions, "key") if partitions else kept.repartitionByRange("key")
    spread.sortWithinPartitions("key").write.mode("overwrite").parquet(path)


def compaction_plan(files: DataFrame, most: int = 4) -> DataFrame:
    """Levels that have enough files: level = trunc(log2(size / 1024)), 0 for an empty one."""
    level = F.when(F.col("size") <= 0, 0).otherwise(F.log2(F.greatest("size", F.lit(1)) / F.lit(1024.0)).cast("int"))
    return files.groupBy(level.alias("level")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).where(F.col("files") >= most)


def bloom(items: DataFrame, column: str, bits: int, hashes: int, mod=md5_mod) -> DataFrame:
    """The set positions of a Bloom filter over a column. mod: how an item's digest becomes a position."""
    return items.select(F.explode(bloom_positions(F.col(column), bits, hashes, mod)).alias("position")).distinct()


def bloom_contains(probe: DataFrame, column: str, positions: DataFrame, bits: int, hashes: int, mod=md5_mod) -> DataFrame:
    """Add `maybe`: whether all positions of an item are set, null for a null item. mod: as bloom() had it."""
    asked = probe.select(column).where(F.col(column).isNotNull()).distinct().select(column, F.explode(bloom_positions(F.col(column), bits, hashes, mod)).alias("position"))
    hit = asked.join(positions.withColumn("set", F.lit(1)), "position", "left").groupBy(column).agg((F.count("set") == F.count("*")).alias("maybe"))
    return probe.join(hit, column, "left")


def clear(log: DataFrame) -> DataFrame:
    """An empty store of the same columns."""
    return log.where(F.lit(False))


def lookup(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The live value of each asked key, null if it has none."""
    return keys.select("key").join(latest(log).select("key", "value"), "key", "left")


def select_files(files: DataFrame, most: int = 4) -> DataFrame:
    """The files of the lowest level that is due for compaction. files: file, size."""
    level = F.when(F.col("size") <= 0, 0).otherwise(F.log2(F.greatest("size", F.lit(1)) / F.lit(1024.0)).cast("int"))
    due = compaction_plan(files, most).agg(F.min("level").alias("due"))  # one row
    return files.withColumn("level", level).crossJoin(F.broadcast(due)).where("level = due").drop("due")


def stats(files: DataFrame, bits: int, hashes: int) -> DataFrame:
    """Runs, their bytes, and the mean false-positive rate of their filters. files: size, keys."""
    from lakeloom.functions.columns import bloom_false_positive_rate

    return files.agg(F.count("*").alias("runs"), F.sum("size").alias("bytes"), F.avg(bloom_false_positive_rate(F.col("keys"), bits, hashes)).alias("mean_fpr"))
