"""Property-graph operators on edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.sources.tables import shared_folder


def keep(df: DataFrame) -> DataFrame:
    """Cut lineage between rounds: a reliable checkpoint in the shared folder of spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def mutual(edges: DataFrame, a: int, b: int) -> DataFrame:
    """Whom both follow."""
    return edges.where(F.col("src") == a).select("dst").join(edges.where(F.col("src") == b).select("dst"), "dst", "left_semi").distinct()


def influencers(users: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """Most followed users; users without followers count 0."""
    followers = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("followers"))
    return users.select("id").join(followers, "id", "left").select("id", F.coalesce("followers", F.lit(0)).alias("followers")).orderBy(F.desc("followers"), "id").limit(n)


def recommend(edges: DataFrame, user: int, n: int) -> DataFrame:
    """Friends of friends by the number of paths, without the user and whom they follow."""
    mine = edges.where(F.col("src") == user).select(F.col("dst").alias("via"))
    paths = edges.join(mine, edges.src == mine.via).where(F.col("dst") != user).select("dst")
    return paths.join(mine, paths.dst == mine.via, "left_anti").groupBy("dst").agg(F.count("*").alias("score")).orderBy(F.desc("score"), "dst").limit(n)


def trending(posts: DataFrame, tagged: DataFrame, days: int, n: int) -> DataFrame:
    """Most used tags of the posts newer than `days` before the newest one."""
    newest = posts.agg(F.max("published_at").alias("newest"))  # one row
    recent = posts.crossJoin(F.broadcast(newest)).where(F.col("published_at") > F.col("newest") - F.make_dt_interval(F.lit(days))).select("post_id")
    return tagged.join(recent, tagged.post == recent.post_id).groupBy("tag").agg(F.count("*").alias("usage")).orderBy(F.desc("usage"), "tag").limit(n)


def user_influence(users: DataFrame, edges: DataFrame, posts: DataFrame, likes: DataFrame) -> DataFrame:
    """Followers, following, posts and distinct likers of every user, each counted on its own, and the score."""
    count = lambda df, key, name: df.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))
    likers = likes.join(posts, likes.post == posts.post_id).select("author", "user").distinct()
    out = users.select("id")
    for df, key, name in ((edges, "dst", "followers"), (edges, "src", "following"), (posts, "author", "posts"), (likers, "author", "distinct_likers")):
        out = out.join(count(df, key, name), "id", "left")
    out = out.na.fill(0)
    score = F.col("followers") * 0.4 + F.col("followers") / (F.col("following") + 1) * 0.3 + F.col("distinct_likers") / (F.col("posts") + 1) * 0.3
    return out.withColumn("score", score)


def opinion_leaders(tag: str, posts: DataFrame, tagged: DataFrame, likes: DataFrame, shares: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """Authors of posts with a tag: likes + 2 shares + 0.1 followers; authors without followers are left out."""
    about = posts.join(tagged.where(F.col("tag") == tag).select("post"), posts.post_id == F.col("post")).select("post_id", "author")
    liked = likes.groupBy("post").agg(F.count("*").alias("l"))
    by = about.join(liked, about.post_id == liked.post, "left").groupBy("author").agg(F.count("*").alias("posts"), F.coalesce(F.sum("l"), F.lit(0)).alias("likes"))
    shared = shares.groupBy(F.col("dst").alias("author")).agg(F.count("*").alias("shares"))
    followers = edges.groupBy(F.col("dst").alias("author")).agg(F.count("*").alias("followers"))
    out = by.join(shared, "author", "left").join(followers, "author").na.fill(0)
    return out.withColumn("score", F.col("likes") + 2 * F.col("shares") + 0.1 * F.col("followers")).orderBy(F.desc("score"), "author").limit(n)


def spread(edges: DataFrame, node: int, hops: int = 3) -> DataFrame:
    """Inbound paths of up to `hops` edges, none used twice: how many, the longest and the mean length."""
    e = edges.select("src", "dst")
    step = e.where(F.col("dst") == node).select("src", F.array(F.struct("src", "dst")).alias("path"))
    out = step
    for _ in range(hops - 1):
        up = e.select(F.col("src").alias("s"), F.col("dst").alias("d"))
        step = step.join(up, step.src == up.d).where(~F.array_contains("path", F.struct(F.col("s").alias("src"), F.col("d").alias("dst")))).select(F.col("s").alias("src"), F.array_append("path", F.struct(F.col("s").alias("src"), F.col("d").alias("dst"))).alias("path"))
        out = out.unionAll(step)
    return out.agg(F.count("*").alias("paths"), F.max(F.size("path")).alias("max_depth"), F.avg(F.size("path")).alias("avg_depth"))


def hops(edges: DataFrame, a: int, limit: int = 6) -> DataFrame:
    """Fewest undirected hops from a node to every node within the limit."""
    e = keep(both_ways(edges))
    front = e.sparkSession.range(1).select(F.lit(a).cast("long").alias("id"), F.lit(0).alias("hops"))
    seen = front
    for k in range(1, limit + 1):
        front = keep(front.join(e, front.id == e.src).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(k)))
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
    return seen


def weak_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable. Smallest label of the neighbours, then of the label itself, until nothing changes."""
    e = keep(both_ways(edges))
    labels = keep(e.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        near = e.join(labels, e.dst == labels.id).groupBy("src").agg(F.min("component").alias("near"))
        new = labels.join(near, labels.id == near.src).select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = new.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = keep(new.join(jump, "component", "left").select("id", "was", F.least("component", F.coalesce("up", "component")).alias("component")))
        labels = new.select("id", "component")
        if new.where("was <> component").isEmpty():
            break
    return labels


def pagerank(users: DataFrame, edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """Fixed rounds from a uniform start; what nodes without edges hold is spread over all."""
    nodes = users.select("id")
    size = nodes.agg(F.count("*").alias("n"))  # one row
    out = edges.groupBy("src").agg(F.count("*").alias("degree"))
    e = keep(edges.join(out, "src").select("src", "dst", "degree"))
    base = nodes.join(out.select(F.col("src").alias("id"), "degree"), "id", "left").crossJoin(F.broadcast(size))
    base = keep(base)
    rank = base.select("id", (F.lit(1.0) / F.col("n")).alias("rank"))
    for _ in range(rounds):
        gained = e.join(rank, e.src == rank.id).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("g"))
        lost = base.where("degree IS NULL").join(rank, "id").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))  # one row
        rank = base.select("id", "n").join(gained, "id", "left").crossJoin(F.broadcast(lost))
        rank = keep(rank.select("id", ((1 - damping) / F.col("n") + damping * (F.coalesce("g", F.lit(0.0)) + F.col("lost") / F.col("n"))).alias("rank")))
    return rank


def degrees(users: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges at each node in either direction, 0 included."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return users.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Deterministic label propagation: the most frequent label among neighbours, the smallest on a tie."""
    e = keep(both_ways(edges))
    labels = e.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = e.join(labels, e.dst == labels.id).groupBy("src", "label").agg(F.count("*").alias("n"))
        labels = keep(votes.groupBy(F.col("src").alias("id")).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label")))
    names = labels.groupBy("label").agg(F.min("id").alias("community"))
    return labels.join(names, "label").select("id", "community")


def cycles(edges: DataFrame, longest: int = 4) -> DataFrame:
    """Elementary cycles of bounded length, each told from its smallest node."""
    e = edges.select("src", "dst")
    paths = e.where("dst > src").select(F.col("src").alias("start"), F.col("dst").alias("cur"), F.array("src", "dst").alias("path"))
    found = None
    for _ in range(longest - 1):
        step = paths.join(e, paths.cur == e.src)
        closed = step.where(F.col("dst") == F.col("start")).select("path")
        found = closed if found is None else found.unionAll(closed)
        paths = step.where((F.col("dst") > F.col("start")) & ~F.array_contains("path", F.col("dst"))).select("start", F.col("dst").alias("cur"), F.array_append("path", F.col("dst")).alias("path"))
    return found


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The edges left when nodes without incoming or without outgoing edges are removed to a fixed point: empty without a cycle."""
    e = keep(edges.select("src", "dst").distinct())
    n = e.count()
    while n:
        e = keep(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        was, n = n, e.count()
        if n == was:
            break
    return e


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): nodes on a cycle with the largest id of their strongly connected component.

    Each round gives every node the largest id that reaches it. Nodes with their own id are
    roots; what reaches a root within its colour is its component, and goes. Rounds end when no cycle is left.
    """
    done, e = None, cyclic_core(edges)
    while not e.isEmpty():
        colour = keep(e.select(F.col("src").alias("id")).distinct().withColumn("colour", F.col("id")))
        while True:
            high = e.join(colour, e.src == colour.id).groupBy("dst").agg(F.max("colour").alias("high"))
            new = keep(colour.join(high, colour.id == high.dst, "left").select("id", F.col("colour").alias("was"), F.greatest("colour", "high").alias("colour")))
            colour = new.select("id", "colour")
            if new.where("was <> colour").isEmpty():
                break
        ends = colour.select(F.col("id").alias("dst"), F.col("colour").alias("c"))
        same = keep(e.join(colour.withColumnRenamed("id", "src"), "src").join(ends, "dst").where("colour = c").select("src", "dst", "colour"))
        front = found = colour.where("id = colour")
        while not front.isEmpty():
            up = same.join(front.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), "colour").distinct()
            front = keep(up.join(found.select("id"), "id", "left_anti"))
            found = keep(found.unionAll(front))
        # a root without a cycle of its own is no component
        inner = same.join(found.select(F.col("id").alias("src")), "src", "left_semi").join(found.select(F.col("id").alias("dst")), "dst", "left_semi")
        on = inner.select(F.col("src").alias("id"), F.col("colour").alias("component")).distinct()
        done = keep(on if done is None else done.unionAll(on))
        e = cyclic_core(e.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti"))
    return edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0) if done is None else done


def component_cycles(edges: DataFrame) -> DataFrame:
    """(component, members, path): for each strongly connected component a shortest cycle through its largest node, of any length, from that node on."""
    comps = keep(strong_components(edges))
    end = comps.select(F.col("id").alias("dst"), F.col("component").alias("c"))
    e = keep(edges.select("src", "dst").distinct().join(comps.withColumnRenamed("id", "src"), "src").join(end, "dst").where("component = c").select("component", "src", "dst"))
    # the way back to the largest node: the hop that each node takes, level by level
    front = e.where("dst = component").groupBy("component", F.col("src").alias("id")).agg(F.min("dst").alias("next"))
    known = front = keep(front)
    while not front.isEmpty():
        step = e.join(front.select("component", F.col("id").alias("dst")), ["component", "dst"]).groupBy("component", F.col("src").alias("id")).agg(F.min("dst").alias("next"))
        front = keep(step.join(known.select("component", "id"), ["component", "id"], "left_anti"))
        known = keep(known.unionAll(front))
    hop = known.select("component", F.col("id").alias("cur"), "next")
    paths = comps.select("component").distinct().select("component", F.col("component").alias("cur"), F.array("component").alias("path"))
    out = None
    while True:
        paths = keep(paths.join(hop, ["component", "cur"]).select("component", F.col("next").alias("cur"), F.when(F.col("next") == F.col("component"), F.col("path")).otherwise(F.array_append("path", F.col("next"))).alias("path")))
        closed = paths.where("cur = component").select("component", "path")
        out = closed if out is None else out.unionAll(closed)
        paths = paths.where("cur <> component")
        if paths.isEmpty():
            break
    return comps.groupBy("component").agg(F.count("*").alias("members")).join(out, "component")


def betweenness(edges: DataFrame, sources: list[int] | None = None, parts: int = 64) -> DataFrame:
    """Brandes' dependencies summed over the given sources, by default every node. The sources are dealt over parts, each with the whole adjacency; a source costs only its own component."""
    import numpy as np
    import pyarrow as pa

    e = keep(both_ways(edges).where("src IS NOT NULL AND dst IS NOT NULL").select(F.col("src").cast("long"), F.col("dst").cast("long")))
    wanted = e.select(F.col("src").alias("source")).distinct() if sources is None else e.sparkSession.createDataFrame([(s,) for s in sources], "source long")
    wanted = wanted.select("source", F.pmod(F.xxhash64("source"), F.lit(parts)).alias("part"))

    def pack(rows):
        for b in rows:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([b.column(i).to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for i in (0, 1)], ["src", "dst"])

    def joined(table: pa.Table, name: str, dtype):
        return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)

    def lay_out(packed: pa.Table) -> pa.Table:
        """The nodes component by component, each with its neighbours' places in the component."""
        src, dst = joined(packed, "src", np.int64), joined(packed, "dst", np.int64)
        order = np.argsort(src, kind="stable")
        ids, first = np.unique(src[order], return_index=True)
        dst, n, degree = np.searchsorted(ids, dst[order]), len(ids), np.diff(first, append=len(src))
        label, was = np.arange(n), None
        while was is None or not np.array_equal(label, was):
            was, low = label, np.minimum(label, np.minimum.reduceat(label[dst], first))
            label = low.copy()
            np.minimum.at(label, was, low)  # the root hears of what its nodes see
            while not np.array_equal(label, label[label]):
                label = label[label]
        order = np.argsort(label, kind="stable")
        label, size = label[order], degree[order]
        start, place = np.searchsorted(label, label), np.empty(n, np.int64)
        place[order] = np.arange(n)
        end = size.cumsum()
        dst = (place[dst[np.repeat(first[order] - end + size, size) + np.arange(len(dst))]] - np.repeat(start, size)).astype(np.int32)
        end, step = np.append(0, end), 1 << 14
        cuts = [(a, min(a + step, n)) for a in range(0, n, step)]
        nodes = {k: pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for k, x in (("id", ids[order]), ("degree", size), ("start", start))}
        return pa.table({"at": [a for a, _ in cuts], **nodes, "dst": pa.array([dst[end[a] : end[b]].tobytes() for a, b in cuts], pa.binary())})

    packed = e.mapInArrow(pack, "src binary, dst binary")  # thousands of edges a row
    laid = packed.groupBy().applyInArrow(lay_out, "at long, id binary, degree binary, start binary, dst binary").repartition(parts, "at")
    sized = laid.crossJoin(F.broadcast(e.sparkSession.range(parts).withColumnRenamed("id", "part")))  # the adjacency once a part

    def brandes(ours: pa.Table, adjacency: pa.Table) -> pa.Table:
        adjacency = adjacency.sort_by("at")
        ids, sizes, start = (joined(adjacency, c, np.int64) for c in ("id", "degree", "start"))
        ends, begin = joined(adjacency, "dst", np.int32).astype(np.int64), np.append(0, sizes.cumsum())
        heads, which = np.unique(start, return_inverse=True)
        tails, last = np.append(heads[1:], len(ids)), None
        total, reached, places = np.zeros(len(ids)), np.zeros(len(ids), bool), np.arange(len(ends))

        def pick(x, at):
            return x.take(at, mode="wrap")  # three times as fast as with bounds checked

        def around(nodes):
            """The nodes' edges, as (owner, neighbour)."""
            size = pick(degree, nodes)
            at = np.repeat(pick(first, nodes) - size.cumsum() + size, size)
            at += places[: len(at)]
            return np.repeat(nodes, size), pick(dst, at)

        for place in np.sort(np.intersect1d(ids, ours.column("source").to_numpy(), return_indices=True)[1]):
            if which[place] != last:
                last = which[place]
                a, b = heads[last], tails[last]
                first, degree, dst, n = begin[a:b] - begin[a], sizes[a:b], ends[begin[a] : begin[b]], b - a
            s = place - a
            far, ways, steps = np.full(n, -1, np.int32), np.zeros(n), []
            far[s], ways[s], front = 0, 1.0, np.array([s])
            out, rest, left = degree[s], len(dst) - degree[s], n - 1  # edges that leave the front, and the nodes not reached yet; these nodes
            while left:
                if out <= rest:
                    v, w = around(front)
                    down = np.flatnonzero(pick(far, w) < 0)
                else:  # fewer edges seen from the other side
                    w, v = around(np.flatnonzero(far < 0))
                    down = np.flatnonzero(pick(far, v) == len(steps))
                v, w = pick(v, down), pick(w, down)
                steps.append((v, w))
                np.add.at(ways, w, pick(ways, v))
                far[w] = len(steps)
                front = np.unique(w) if 16 * len(w) < n else np.flatnonzero(far == len(steps))
                out = pick(degree, front).sum()
                rest -= out
                left -= len(front)
            each = 1 / ways  # (1 + dependency) / ways
            for v, w in reversed(steps):
                np.add.at(each, v, pick(each, w))
            share, known = each * ways - 1, reached[place]
            share[s] = 0.0
            total[a:b] += share
            reached[a:b], reached[place] = True, known
        return pa.table({"id": ids[reached], "dependency": total[reached]})

    out = wanted.groupBy("part").cogroup(sized.groupBy("part")).applyInArrow(brandes, "id long, dependency double")
    return out.groupBy("id").agg(F.sum("dependency").alias("betweenness"))


def create_nodes(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """nodes with new ones; an id that is there already is left as it is."""
    return nodes.unionByName(rows.dropDuplicates(["id"]).join(nodes.select("id"), "id", "left_anti"), allowMissingColumns=True)


def create_relations(edges: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with new ones; a relation whose source or target is missing makes none."""
    ends = nodes.select("id").distinct()
    both = rows.join(ends, rows.src == ends.id, "left_semi").join(ends, rows.dst == ends.id, "left_semi")
    return edges.unionByName(both, allowMissingColumns=True)


def shortest_path(edges: DataFrame, a: int, b: int, limit: int = 6) -> DataFrame:
    """(step, id): the nodes of a shortest undirected path from a to b, of several the one whose nodes are smallest seen from b; no rows beyond the limit."""
    e = keep(both_ways(edges))
    found = keep(hops(edges, a, limit))
    walk = found.where(F.col("id") == F.lit(b)).select(F.col("hops").alias("step"), "id")
    out = step = keep(walk)
    for _ in range(limit):
        before = step.select(F.col("id").alias("src"), "step").join(e, "src").select(F.col("dst").alias("id"), (F.col("step") - 1).alias("step"))
        step = before.join(found.select("id", F.col("hops").alias("step")), ["id", "step"]).groupBy("step").agg(F.min("id").alias("id"))
        step = keep(step)
        if step.isEmpty():
            break
        out = out.unionAll(step.select("step", "id"))
    return out
