"""Transaction and replication operators as folds over logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators import graph


def commit_state(ops: DataFrame, aborted: DataFrame | None = None) -> DataFrame:
    """State after the transactions that were not aborted: the last write or delete of each resource in order `at`; deletes hide it."""
    if aborted is not None:
        ops = ops.join(aborted.select("tx"), "tx", "left_anti")
    last = ops.where("type <> 'read'").groupBy("resource").agg(F.max_by(F.struct("type", "value", "tx"), F.col("at")).alias("o"))
    return last.where("o.type = 'write'").select("resource", "o.value", "o.tx")


def read_uncommitted(versions: DataFrame) -> DataFrame:
    return versions.groupBy("key").agg(F.max_by("value", "version").alias("value"), F.max("version").alias("version"))


def read_committed(versions: DataFrame, own: Column | None = None) -> DataFrame:
    """The greatest version of each key that is committed, or the reader's own."""
    seen = F.col("committed") if own is None else F.col("committed") | own
    return read_uncommitted(versions.where(seen))


def repeatable_read(reads: DataFrame, versions: DataFrame) -> DataFrame:
    """The version each read sees: what the first successful read of (tx, key) saw stays pinned.

    reads: tx, key, seq. versions: key, version, seq, committed, transaction.
    """
    v = versions.select(F.col("key").alias("vk"), F.col("version").alias("v"), F.col("seq").alias("vs"), "committed", "transaction")
    cond = (F.col("key") == F.col("vk")) & (F.col("vs") < F.col("seq")) & (F.col("committed") | (F.col("transaction") == F.col("tx")))
    now = reads.join(v, cond, "left").groupBy("tx", "key", "seq").agg(F.max("v").alias("visible"))
    pinned = F.first("visible", ignorenulls=True).over(Window.partitionBy("tx", "key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return now.select("tx", "key", "seq", pinned.alias("version"))


def conflicts(ops: DataFrame) -> DataFrame:
    """Pairs of transactions, one of which reads what the other writes, with the number of such resources.

    Distinct sets are joined by resource; a hot resource is an equi-join key that the
    runtime can split.
    """
    reads = ops.where("type = 'read'").select(F.col("tx").alias("reader"), "resource").distinct()
    writes = ops.where("type = 'write'").select(F.col("tx").alias("writer"), "resource").distinct()
    return reads.join(writes, "resource").where("reader <> writer").groupBy("reader", "writer").agg(F.count("*").alias("resources"))


def lock_conflicts(locks: DataFrame) -> DataFrame:
    """Overlapping holds of one resource by two transactions, unless both are shared. locks: tx, resource, kind, start, end."""
    other = locks.select(*[F.col(c).alias(f"o_{c}") for c in locks.columns])
    cond = (F.col("resource") == F.col("o_resource")) & (F.col("tx") < F.col("o_tx")) & (F.col("start") < F.col("o_end")) & (F.col("o_start") < F.col("end"))
    return locks.join(other, cond).where("NOT (kind = 'shared' AND o_kind = 'shared')").select("resource", "tx", "o_tx")


def has_cycle(waits: DataFrame) -> bool:
    """Whether any transactions wait for each other in a circle of any length. waits: src, dst."""
    return not graph.cyclic_core(waits).isEmpty()


def deadlocks(waits: DataFrame) -> DataFrame:
    """Each deadlock once: a cycle of any length, the victim (the largest id) and how many transactions are on cycles with it. waits: src, dst."""
    return graph.component_cycles(waits).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("cycle"), F.col("component").alias("victim"), "members")


def two_phase_outcome(votes: DataFrame) -> DataFrame:
    """Commit if all participants vote yes."""
    return votes.groupBy("tx").agg(F.bool_and("vote").alias("committed"), F.count("*").alias("participants"))


def replica_state(log: DataFrame, lsn: int) -> DataFrame:
    """State of a replica that has applied the log up to a sequence number."""
    last = log.where(F.col("seq") <= lsn).groupBy("key").agg(F.max_by(F.struct("value", "deleted"), "seq").alias("v"), F.max("seq").alias("seq"))
    return last.where("NOT v.deleted").select("key", "v.value", "seq")


def replica_health(lag: DataFrame) -> DataFrame:
    """FAILED after 30 s of silence, LAGGING beyond 5,000 ms, else HEALTHY."""
    return lag.withColumn("health", F.when(F.col("silent_s") > 30, "FAILED").when(F.col("lag_ms") > 5000, "LAGGING").otherwise("HEALTHY"))


def read_from(nodes: DataFrame, tie: str = "node") -> DataFrame:
    """The healthy secondary with the least lag, of several that with the smallest `tie`, else the primary. Nodes without a name or a lag are left out."""
    fit = (F.col("role") == "secondary") & (F.col("health") == "HEALTHY") & F.col("node").isNotNull() & F.col("lag_ms").isNotNull()
    return nodes.agg(F.coalesce(F.min_by("node", F.when(fit, F.struct("lag_ms", tie))), F.max(F.when(F.col("role") == "primary", F.col("node")))).alias("node"))


def last_write_wins(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))


def gcounter(rows: DataFrame) -> DataFrame:
    """A grow-only counter: the maximum of each replica, summed."""
    return rows.groupBy("key", "replica").agg(F.max("n").alias("n")).groupBy("key").agg(F.sum("n").alias("n"))


def dominated(clocks: DataFrame) -> DataFrame:
    """Versions whose vector clock another version of the key dominates. clocks: key, version, clock map<string,long>."""
    o = clocks.select(F.col("key").alias("ok"), F.col("version").alias("ov"), F.col("clock").alias("oc"))
    at = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0))
    nodes = F.array_union(F.map_keys("clock"), F.map_keys("oc"))
    below = F.forall(nodes, lambda k: at(F.col("clock"), k) <= at(F.col("oc"), k)) & F.exists(nodes, lambda k: at(F.col("clock"), k) < at(F.col("oc"), k))
    return clocks.join(o, (F.col("key") == F.col("ok")) & (F.col("version") != F.col("ov"))).where(below).select("key", "version").distinct()


def states(rows: DataFrame, state: str = "state") -> DataFrame:
    """How many transactions, jobs or participants are in each state."""
    return rows.groupBy(state).agg(F.count("*").alias("n"))


def access_sets(ops: DataFrame) -> DataFrame:
    """The read set and the write set of each transaction, sorted."""
    collected = lambda kinds: F.array_sort(F.collect_set(F.when(F.col("type").isin(kinds), F.col("resource"))))
    return ops.groupBy("tx").agg(collected(["read"]).alias("reads"), collected(["write", "delete"]).alias("writes"))


def log_of(ops: DataFrame) -> DataFrame:
    """The log of each transaction: BEGIN, its writes and deletes in order, COMMIT. (tx, n, entry, resource); n counts from 0."""
    changed = ops.where("type <> 'read'").select("tx", F.row_number().over(Window.partitionBy("tx").orderBy("at")).alias("n"), F.upper("type").alias("entry"), "resource")
    ends = ops.groupBy("tx").agg(F.count_if(F.col("type") != "read").alias("c"))
    framed = ends.select("tx", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.lit("BEGIN").alias("entry")), F.struct((F.col("c") + 1).cast("int").alias("n"), F.lit("COMMIT").alias("entry")))).alias("e")).select("tx", "e.n", "e.entry", F.lit(None).cast("bigint").alias("resource"))
    return framed.unionByName(changed.withColumn("resource", F.col("resource").cast("bigint")))


def grant_locks(requests: DataFrame) -> DataFrame:
    """requests (tx, resource, kind, at) with `granted`, as if asked in order and never released.

    The first request for a resource is granted. If its transaction asks for an exclusive
    lock before anyone else shares the resource, the resource is its own: all it asks for is
    granted, and nothing to others. Otherwise every shared lock is granted and no exclusive
    one. So two aggregates a resource tell, without walking the queue.
    """
    first = requests.groupBy("resource").agg(F.min_by("tx", "at").alias("owner"))
    known = requests.join(first, "resource")
    mine = F.col("tx") == F.col("owner")
    turns = known.groupBy("resource").agg(F.min(F.when(mine & (F.col("kind") == "exclusive"), F.col("at"))).alias("taken"), F.min(F.when(~mine & (F.col("kind") == "shared"), F.col("at"))).alias("shared"))
    owned = F.col("taken").isNotNull() & (F.col("shared").isNull() | (F.col("taken") < F.col("shared")))
    return known.join(turns, "resource").select(*requests.columns, F.when(owned, mine).otherwise(F.col("kind") == "shared").alias("granted"))


def release(held: DataFrame, tx) -> DataFrame:
    """The queue after a transaction lets go: its requests are gone, what was granted stays, the others are asked again in order. held: grant_locks()."""
    rest = held.where(~F.col("tx").eqNullSafe(F.lit(tx)))
    again = grant_locks(rest.select("tx", "resource", "kind", F.struct(~F.col("granted"), "at").alias("at")))
    return again.select("tx", "resource", "kind", again["at"]["at"].alias("at"), "granted")


def lock_info(held: DataFrame) -> DataFrame:
    """Active locks and waiting requests of each resource."""
    return held.groupBy("resource").agg(F.count_if("granted").alias("active"), F.count_if(~F.col("granted")).alias("waiting"))


def prepare(ops: DataFrame, store: DataFrame) -> DataFrame:
    """Each participant's vote on a transaction: no if it deletes what isn't there. ops: tx, type, resource; store: resource."""
    there = store.select(F.col("resource").alias("r"), F.lit(True).alias("there")).distinct()
    asked = ops.join(there, ops.resource == there.r, "left")
    return asked.groupBy("tx").agg(F.bool_and((F.col("type") != "delete") | F.coalesce("there", F.lit(False))).alias("vote"))


def with_checksum(log: DataFrame) -> DataFrame:
    """A replication log with the md5 of each entry's position, key and value."""
    return log.withColumn("checksum", F.md5(F.concat_ws("|", F.col("seq").cast("string"), "key", F.col("value").cast("decimal(20,2)").cast("string")).cast("binary")))


def intact(log: DataFrame) -> DataFrame:
    """The entries whose checksum is right; a replica applies no others."""
    return with_checksum(log.withColumnRenamed("checksum", "said")).where("checksum = said").drop("said")


def sync_acks(acks: DataFrame, least: int) -> DataFrame:
    """Whether enough replicas have confirmed each entry. acks: seq, acked."""
    return acks.groupBy("seq").agg(F.count_if("acked").alias("acks")).withColumn("durable", F.col("acks") >= least)


def cluster_status(nodes: DataFrame) -> DataFrame:
    """Secondaries, the healthy ones among them, and their mean lag. nodes: role, health, lag_ms."""
    second = F.col("role") == "secondary"
    return nodes.agg(F.count_if(second).alias("secondaries"), F.count_if(second & (F.col("health") == "HEALTHY")).alias("healthy"), F.coalesce(F.avg(F.when(second, F.col("lag_ms"))), F.lit(0.0)).alias("mean_lag_ms"))


def failover(nodes: DataFrame) -> DataFrame:
    """nodes after the primary is lost: the healthy secondary that has applied most, the first by name on a tie, is primary; the rest follow it. nodes: node, role, health, applied."""
    best = nodes.where("role = 'secondary' AND health = 'HEALTHY'").agg(F.min(F.struct((-F.col("applied")).alias("a"), "node")).alias("b")).select(F.col("b.node").alias("chosen"))  # one row
    left = nodes.where("role <> 'primary'").crossJoin(F.broadcast(best))
    return left.select("node", F.when(F.col("node") == F.col("chosen"), "primary").otherwise("secondary").alias("role"), F.when(F.col("node") != F.col("chosen"), F.col("chosen")).alias("follows"))
