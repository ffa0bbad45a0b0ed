"""Partition operators: assignment by hash, range and ring, balance, hot spots, moves."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.columns import hash_range_partition, md5_mod, md5_position


def by_hash_mod(df: DataFrame, key: Column, n: int) -> DataFrame:
    return df.withColumn("pid", md5_mod(key, n))


def by_hash_range(df: DataFrame, key: Column, n: int) -> DataFrame:
    return df.withColumn("pid", hash_range_partition(key, n))


def by_range(df: DataFrame, key: Column, splits: list) -> DataFrame:
    """Half-open ranges between sorted split points."""
    pid = F.lit(0)
    for s in splits:
        pid = pid + (key >= F.lit(s)).cast("int")
    return df.withColumn("pid", pid)


def range_query(df: DataFrame, key: Column, start, end) -> DataFrame:
    return df.where((key >= F.lit(start)) & (key < F.lit(end)))


def ring(nodes: list[str], virtual: int = 256) -> list[tuple[int, str]]:
    """Sorted (position, node); of virtual nodes at one position the last one stays."""
    places = {int(hashlib.md5(f"{n}:{i}".encode()).hexdigest()[-8:], 16): n for n in nodes for i in range(virtual)}
    return sorted(places.items())


def by_ring(df: DataFrame, key: Column, nodes: list[str], virtual: int = 256) -> DataFrame:
    """Node of the first ring position strictly above the key's, wrapping round. The ring is a literal: nodes x virtual entries."""
    r = ring(nodes, virtual)
    positions, names = np.array([p for p, _ in r], np.int64), np.array([n for _, n in r], object)

    @F.pandas_udf("string")
    def find(at: pd.Series) -> pd.Series:
        known = at.notna().to_numpy()
        out = np.full(len(at), None, object)
        out[known] = names[np.searchsorted(positions, at[known].to_numpy(np.int64), side="right") % len(names)]
        return pd.Series(out, dtype=object)

    return df.withColumn("node", find(md5_position(key)))


def walks(r: list[tuple[int, str]], count: int) -> list[list[str]]:
    """For each position of a ring the first `count` distinct nodes from there on, found once."""
    names = [n for _, n in r]
    out: list[list[str]] = []
    for start in range(len(names)):
        seen: list[str] = []
        for i in range(len(names)):
            node = names[(start + i) % len(names)]
            if node not in seen:
                seen.append(node)
                if len(seen) == count:
                    break
        out.append(seen)
    return out


def replicas(df: DataFrame, key: Column, nodes: list[str], count: int = 3, virtual: int = 256) -> DataFrame:
    """The first `count` distinct nodes on the walk round the ring."""
    r = ring(nodes, virtual)
    positions, lists = np.array([p for p, _ in r], np.int64), np.empty(len(r), object)
    lists[:] = walks(r, count)

    @F.pandas_udf("array<string>")
    def walk(at: pd.Series) -> pd.Series:
        known = at.notna().to_numpy()
        out = np.full(len(at), None, object)
        out[known] = lists[np.searchsorted(positions, at[known].to_numpy(np.int64), side="right") % len(lists)]
        return pd.Series(out, dtype=object)

    return df.withColumn("nodes", walk(md5_position(key)))


def ring_join(df: DataFrame, key: Column, ring_rows: DataFrame) -> DataFrame:
    """by_ring for rings too large for a literal: (position, node) rows are cut into 256 arcs by the high byte, and each key meets its arc only.

    An arc also holds the first position after it, so the next one above a key is always
    there; the last arc goes on at the ring's beginning.
    """
    from functools import reduce

    arcs, size = 256, 1 << 24
    spare = [f"ring_{x}{'_' * sum(c.startswith('ring_') for c in df.columns)}" for x in ("at", "arc")]
    held = ring_rows.select(F.col("position").cast("long").alias("position"), "node", F.floor(F.col("position") / size).cast("int").alias("arc"))
    own = held.groupBy("arc").agg(F.array_sort(F.collect_list(F.struct("position", "node"))).alias("own"), F.min_by("node", "position").alias("first"))
    every = ring_rows.sparkSession.range(arcs).select(F.col("id").cast("int").alias("arc")).join(own, "arc", "left")
    w = Window.orderBy("arc").rowsBetween(1, Window.unboundedFollowing)  # 256 rows
    start = F.first("first", ignorenulls=True).over(Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    arcs_of = every.select(F.col("arc").alias(spare[1]), "own", F.coalesce(F.first("first", ignorenulls=True).over(w), start).alias("beyond"))
    placed = df.withColumn(spare[0], md5_position(key)).withColumn(spare[1], F.floor(F.col(spare[0]) / size).cast("int"))
    above = F.filter("own", lambda x: x["position"] > F.col(spare[0]))
    joined = placed.join(arcs_of, spare[1], "left")
    node = F.when(F.col(spare[0]).isNotNull(), F.coalesce(F.get(above, F.lit(0))["node"], F.col("beyond")))
    return reduce(lambda d, c: d.drop(c), [*spare, "own", "beyond"], joined.withColumn("node", node))


def distribution(df: DataFrame, by: str = "pid") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("records"))


def balance(counts: DataFrame, most: float = 0.5) -> DataFrame:
    """imbalance = (max - min) / mean, balanced up to `most`; score = 1 - (max - min) / max."""
    a = counts.agg(F.max("records").alias("hi"), F.min("records").alias("lo"), F.avg("records").alias("mean"))
    imbalance = (F.col("hi") - F.col("lo")) / F.col("mean")
    return a.select("hi", "lo", F.round(imbalance, 6).alias("imbalance"), (imbalance <= most).alias("balanced"), F.round(1 - (F.col("hi") - F.col("lo")) / F.col("hi"), 6).alias("score"))


def rebalance_advice(counts: DataFrame, by: str = "node") -> DataFrame:
    """Nodes above 1.5 or below 0.5 of the mean."""
    mean = F.avg("records").over(Window.partitionBy())
    out = counts.withColumn("mean", mean)  # a row for each node
    return out.select(by, "records", F.when(F.col("records") > 1.5 * F.col("mean"), "overloaded").when(F.col("records") < 0.5 * F.col("mean"), "underloaded").otherwise("ok").alias("advice"))


def hotspots(df: DataFrame, reads: int = 1000, writes: int = 500) -> DataFrame:
    """Partitions with many reads or writes; df has pid and op."""
    n = df.groupBy("pid").agg(F.count_if(F.col("op") == "read").alias("reads"), F.count_if(F.col("op") == "write").alias("writes"))
    kinds = F.filter(F.array(F.when(F.col("reads") > reads, "read"), F.when(F.col("writes") > writes, "write")), lambda x: x.isNotNull())
    return n.select("pid", "reads", "writes", F.explode(kinds).alias("kind"))


def suggest_split(df: DataFrame, records: int = 10_000, reads: int = 5_000) -> DataFrame:
    """Partitions to be split, and why: too many records, or else too many reads. df has pid and op."""
    n = df.groupBy("pid").agg(F.count("*").alias("records"), F.count_if(F.col("op") == "read").alias("reads"))
    return n.withColumn("reason", F.when(F.col("records") > records, "records").when(F.col("reads") > reads, "reads")).where("reason IS NOT NULL")


def suggest_scaling(counts: DataFrame) -> DataFrame:
    """scale_out above 10,000 records a node, scale_in below 1,000 with more than one node."""
    a = counts.agg(F.sum("records").alias("total"), F.count("*").alias("nodes"))
    mean = F.col("total") / F.col("nodes")
    return a.select(
        "total", "nodes",
        F.when(mean > 10_000, "scale_out").when((mean < 1_000) & (F.col("nodes") > 1), "scale_in").otherwise("none").alias("action"),
        F.when(mean > 10_000, F.greatest(F.lit(1), F.floor(F.col("total") / 10_000) - F.col("nodes"))).when((mean < 1_000) & (F.col("nodes") > 1), F.greatest(F.lit(1), F.floor(F.col("total") / 1_000))).otherwise(0).alias("count"),
    )


def moves(df: DataFrame, key: Column, before: list[str], after: list[str], virtual: int = 256) -> DataFrame:
    """Rows whose node changes with the ring."""
    both = by_ring(by_ring(df, key, before, virtual).withColumnRenamed("node", "from_node"), key, after, virtual).withColumnRenamed("node", "to_node")
    return both.where("from_node <> to_node")


def routing_stats(df: DataFrame, key: str) -> DataFrame:
    """Distinct routed keys of each partition."""
    return df.groupBy("pid").agg(F.countDistinct(key).alias("routes"))


def on_node(df: DataFrame, nodes: list[str], by: str = "pid") -> DataFrame:
    """The node of each partition: nodes[pid mod their number]."""
    return df.withColumn("node", F.get(F.array(*map(F.lit, nodes)), (F.col(by) % len(nodes)).cast("int")))


def node_stats(df: DataFrame, nodes: list[str]) -> DataFrame:
    """Partitions, records, reads, writes and bytes of each node. df: pid, op, size."""
    n = df.groupBy("pid").agg(F.count("*").alias("records"), F.count_if(F.col("op") == "read").alias("reads"), F.count_if(F.col("op") == "write").alias("writes"), F.sum("size").alias("storage"))
    return on_node(n, nodes).groupBy("node").agg(F.count("*").alias("partitions"), *[F.sum(c).alias(c) for c in ("records", "reads", "writes", "storage")])


def reassigned(df: DataFrame, before: list[str], after: list[str]) -> DataFrame:
    """Partitions whose node changes with the list of nodes. df: pid."""
    old = on_node(df.select("pid").distinct(), before).withColumnRenamed("node", "from_node")
    return on_node(old, after).withColumnRenamed("node", "to_node").where("from_node <> to_node")


def ring_stats(df: DataFrame, key: Column, nodes: list[str], virtual: int = 256) -> DataFrame:
    """Virtual nodes and records of each physical node."""
    virtuals: dict[str, int] = {}
    for _, n in ring(nodes, virtual):
        virtuals[n] = virtuals.get(n, 0) + 1
    held = df.sparkSession.createDataFrame(sorted(virtuals.items()), "node string, virtual_nodes long")
    return held.join(distribution(by_ring(df, key, nodes, virtual), "node"), "node", "left").na.fill(0)


def scaling_advice(df: DataFrame, reads: int = 1000, writes: int = 500) -> DataFrame:
    """(kind, pids): the partitions to scale for reads and those for writes."""
    return hotspots(df, reads, writes).groupBy("kind").agg(F.array_sort(F.collect_set("pid")).alias("pids"))


def split_range(splits: list, at) -> list:
    """Split points with one more; the upper part of the range that held it is new. A point that is there already splits nothing."""
    return sorted({*splits, at})


def overlapping(splits: list, start, end) -> list[int]:
    """The ranges that [start, end) meets: what a scan has to read."""
    bounds = [None, *splits, None]
    return [i for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])) if (lo is None or lo < end) and (hi is None or start < hi) and start < end]


def routed(df: DataFrame, key: Column, partitions: int, nodes: list[str]) -> DataFrame:
    """The partition and node that a request for each key goes to."""
    return on_node(by_hash_mod(df, key, partitions), nodes)


def replicated(df: DataFrame, key: Column, nodes: list[str], count: int = 3, virtual: int = 256) -> DataFrame:
    """A row for each copy: node, and its place on the key's walk, 0 the one that is read first."""
    return replicas(df, key, nodes, count, virtual).select(*df.columns, F.posexplode("nodes").alias("place", "node"))


def read_replica(copies: DataFrame, key: str, value: str, down: list[str]) -> DataFrame:
    """Each key's value from the first replica that answers."""
    up = copies.where(~F.col("node").isin(down)) if down else copies
    return up.groupBy(key).agg(F.min_by(F.struct("node", value), "place").alias("r")).select(key, "r.*")


def audit(df: DataFrame, key: Column, before: list[str], after: list[str], virtual: int = 256) -> DataFrame:
    """Records of each node before and after the nodes change."""
    old, new = (distribution(by_ring(df, key, x, virtual), "node").withColumnRenamed("records", n) for x, n in ((before, "before"), (after, "after")))
    return old.join(new, "node", "full").na.fill(0, ["before", "after"])
