"""Connected components by contraction: distributed, in about log(n) rounds, nothing collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, table


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, root): every node of an edge and one root per component.

    Each round hooks every node to its smallest neighbour, shortens the chains by two
    pointer jumps and contracts the edges; edges within a node vanish. Ids should be in no
    particular order (hashes), so chains of smallest neighbours stay short. Self links and
    null ends are dropped; an empty input gives an empty result. Hot nodes: the minimum is
    pre-aggregated before the shuffle; relabelling is an equi-join that AQE can split.
    """
    left = table(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not left.isEmpty():
        both = left.select("a", "b").unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = table(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m")))
        hook = near
        for _ in range(2):
            up = hook.select(F.col("u").alias("m"), F.col("m").alias("mm"))
            hook = hook.join(up, "m", "left").select("u", F.coalesce("mm", "m").alias("m"))
        hook = table(hook)
        old = [near, left]
        if labels is None:
            labels = table(hook.select(F.col("u").alias("node"), F.col("m").alias("root")))
        else:
            old.append(labels)
            labels = table(labels.join(hook.select(F.col("u").alias("root"), "m"), "root", "left").select("node", F.coalesce("m", "root").alias("root")))
        met = left.join(hook.select(F.col("u").alias("a"), F.col("m").alias("ma")), "a").join(hook.select(F.col("u").alias("b"), F.col("m").alias("mb")), "b")
        left = table(met.where("ma <> mb").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct())
        forget(*old, hook)  # all that follows is written
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    forget(left)
    return labels
