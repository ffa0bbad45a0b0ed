"""K-d tree sharding: recursive splits at distributed weighted medians along the widest dimension.

A node that is to give k shards splits into halves of k // 2 and k - k // 2 of them, at the
point of its widest dimension where the bytes divide in that proportion; leaves are single
shards, of the target bytes each. One pass over a narrow table of points makes histograms of
every dimension for all nodes of a level: they tell the nodes' weights and extents and, in
the widest dimension, the bin that holds the median. Where that bin is heavier than the
tolerance it is cut into finer bins by another pass. Only bins reach the driver, about
2 * BINS a pass and dimension; the cuts go back as literals.

Rows are ordered by the dimension, then by the text's hash, then by the row's own hash, so
any group of ties can be divided. Equal texts have equal dimensions and hash: a cut falls
between such groups unless the group weighs more than the tolerance; then the cut goes
through it. Dimensions are therefore taken from the text by default: a dimension that
differs among copies, such as their source, would part them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, table

SHARDS = 40
#: Bins of all nodes of a level together.
BINS = 1 << 14
#: A cut may miss its median by this share of a shard.
TOLERANCE = 0.02
#: Rows about a median that are looked at one by one.
FEW = 300
#: Rows of a shard numbered by one task.
SLOT_ROWS = 50_000
#: Sort keys have three parts: the quantised dimension, the text's hash, the row's hash.
PARTS = ("dim", "text_key", "row_key")
SPAN = 1 << 40


@dataclass
class Node:
    """A node of the current level; its rows belong to shards [first, first + shards)."""

    first: int
    shards: int
    weight: int = 0
    dim: int = 0
    cut: tuple = (0, 0, 0)
    #: The extent of each dimension, as far as it is known.
    box: list = field(default_factory=list)


def _keys(dims: list[str], bounds: list[tuple[float, float]]) -> list[Column]:
    """Each dimension scaled to [0, SPAN] by its range over all rows; null is lowest."""
    return [F.when(F.col(d).isNull(), F.lit(0)).otherwise(((F.col(d).cast("double") - lo) / (hi - lo) * SPAN).cast("long")) if hi > lo else F.lit(0).cast("long") for d, (lo, hi) in zip(dims, bounds)]


def _of(values: list) -> Column:
    """The value of a row's node, from a list with one for each node."""
    return F.get(F.lit(values), F.col("node"))


def _dim_key(nodes: list[Node], dims: int) -> Column:
    """A row's key in the dimension that its node is split along."""
    return F.get(F.array(*[f"k{i}" for i in range(dims)]), _of([x.dim for x in nodes]))


def _binned(rows: DataFrame, *keys: str) -> dict[tuple, list]:
    """Bins (number, weight, rows, lowest, highest) by the keys, in order. rows: keys, low, width, value, size."""
    found: dict[tuple, list] = {}
    held = rows.groupBy(*keys, F.floor((F.col("value") - F.col("low")) / F.col("width")).cast("int").alias("bin"))
    for r in held.agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("value").alias("a"), F.max("value").alias("b")).collect():  # at most BINS and a few for each node
        found.setdefault(tuple(r[k] for k in keys), []).append((r["bin"], r["w"], r["n"], r["a"], r["b"]))
    return {k: sorted(v) for k, v in found.items()}


def _survey(points: DataFrame, nodes: list[Node], dims: int) -> dict[int, list]:
    """Weight, extents and widest dimension of every node that is to be split; its bins along that dimension."""
    busy = [x.shards > 1 for x in nodes]
    bins = max(256, BINS // sum(busy))
    low, width = [], []
    for x in nodes:
        for lo, hi in x.box:
            low.append(int(lo))
            width.append(int(max(1, -(-(hi - lo + 1) // bins))))
    at = F.col("node") * dims + F.col("v.dim")
    spread = points.where(_of(busy)).select("node", "size", F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(f"k{i}").alias("value")) for i in range(dims)])).alias("v"))
    rows = spread.select("node", "size", F.col("v.dim").alias("dim"), F.col("v.value").alias("value"), F.get(F.lit(low), at).alias("low"), F.get(F.lit(width), at).alias("width"))
    found = _binned(rows, "node", "dim")
    for i, x in enumerate(nodes):
        if busy[i] and (i, 0) in found:
            x.box = [(min(b[3] for b in found[i, d]), max(b[4] for b in found[i, d])) for d in range(dims)]
            x.weight = sum(b[1] for b in found[i, 0])
            x.dim = max(range(dims), key=lambda d: (x.box[d][1] - x.box[d][0], -d))
    return {i: found[i, x.dim] for i, x in enumerate(nodes) if (i, 0) in found}


def _refine(points: DataFrame, nodes: list[Node], dims: int, tolerance: float) -> None:
    """Set the cut of every node that is to be split, a histogram pass at a time, part after part of the key."""
    at = {i: {"part": 0, "under": 0, "fixed": []} for i, x in enumerate(nodes) if x.shards > 1}
    found = _survey(points, nodes, dims)
    while True:
        for i in list(at):
            if _narrow(nodes[i], at[i], found.get(i, []), tolerance):
                del at[i]
        if not at:
            return
        idle = {"part": -1, "lo": 0, "hi": -1, "fixed": []}
        states = [at.get(i, idle) for i in range(len(nodes))]
        bins = max(256, BINS // len(at))
        width = [max(1, -(-(s["hi"] - s["lo"] + 1) // bins)) for s in states]
        held = [[*s["fixed"], 0, 0][:2] for s in states]
        part, low, high = (_of([int(s[x]) for s in states]) for x in ("part", "lo", "hi"))
        key = F.col("key")
        value = F.when(part == 0, key).when(part == 1, F.col("text_key")).otherwise(F.col("row_key"))
        mine = (part >= 0) & ((part < 1) | (key == _of([int(x[0]) for x in held]))) & ((part < 2) | (F.col("text_key") == _of([int(x[1]) for x in held])))
        rows = points.withColumn("key", _dim_key(nodes, dims)).withColumn("value", value).where(mine & F.col("value").between(low, high))
        few = [i for i, s in at.items() if s["rows"] <= FEW]
        if few:  # what is left is short enough to be looked at
            near: dict[int, list] = {i: [] for i in few}
            for r in rows.where(F.col("node").isin(few)).select("node", "key", "text_key", "row_key", "size").collect():
                near[r["node"]].append(tuple(r)[1:])
            for i in few:
                nodes[i].cut = _nearest(sorted(near[i]), _goal(nodes[i]) - at[i]["under"], tolerance, at[i])
                del at[i]
        if not at:
            return
        rows = rows.where(F.col("node").isin(list(at))).select("node", "size", "value", low.alias("low"), _of([int(x) for x in width]).alias("width"))
        found = {k[0]: v for k, v in _binned(rows, "node").items()}


def _narrow(node: Node, s: dict, bins: list, tolerance: float) -> bool:
    """Whether the bins settle a node's cut; if not, the state says where to look closer."""
    goal, total, chosen = _goal(node), s["under"], None
    for chosen in bins:
        if total + chosen[1] > goal:
            break
        total += chosen[1]
    if chosen is None:  # no rows
        return True
    _, w, n, lo, hi = chosen
    if total + w <= goal or total == s["under"] + sum(b[1] for b in bins):  # the last bin, and all of it comes before
        total -= w
    if goal - total <= tolerance:  # before this bin
        node.cut = tuple([*s["fixed"], lo, 0, 0][:3])
    elif abs(total + w - goal) <= tolerance:  # after it
        node.cut = tuple([*s["fixed"], hi + 1, 0, 0][:3])
    elif hi > lo:
        s.update(lo=lo, hi=hi, under=total, rows=n)
        return False
    elif s["part"] < 2:  # a group of ties: go on by the next part of the key
        s.update(part=s["part"] + 1, lo=0, hi=SPAN, under=total, fixed=[*s["fixed"], lo], rows=n)
        return False
    else:  # rows alike in every part: the nearer side
        node.cut = tuple([*s["fixed"], lo if goal - total <= total + w - goal else lo + 1])
    return True


def _goal(node: Node) -> float:
    """Bytes that are to come before a node's cut."""
    return node.weight * (node.shards // 2) / node.shards


def _nearest(rows: list[tuple], goal: float, tolerance: float, state: dict) -> tuple:
    """The cut among sorted (key, text_key, row_key, size) nearest to the goal; between equal texts only if none else will do."""
    if not rows:
        return tuple([*state["fixed"], state["lo"], 0, 0][:3])
    end = (rows[-1][0], rows[-1][1], rows[-1][2] + 1)
    cuts, total = [], 0
    for before, row in zip([None, *rows], [*rows, None]):
        at = row[:3] if row else end
        cuts.append((abs(goal - total), before is not None and row is not None and before[:2] == row[:2], at))
        total += row[3] if row else 0
    best = min(cuts)
    whole = min((c for c in cuts if not c[1]), default=best)
    return (whole if whole[0] <= best[0] + tolerance else best)[2]


def _split(nodes: list[Node]) -> tuple[list[Node], Column]:
    """The next level's nodes, and the node there of each row."""
    after, left, right = [], [], []
    for x in nodes:
        left.append(len(after))
        if x.shards == 1:
            after.append(Node(x.first, 1, box=x.box))
        else:
            half = x.shards // 2
            after += [Node(x.first, half, box=list(x.box)), Node(x.first + half, x.shards - half, box=list(x.box))]
            if x.box:
                lo, hi = x.box[x.dim]
                after[-2].box[x.dim], after[-1].box[x.dim] = (lo, max(lo, min(hi, x.cut[0]))), (min(hi, max(lo, x.cut[0])), hi)
        right.append(len(after) - 1)
    a, b, c = (_of([int(x.cut[i]) for x in nodes]) for i in range(3))
    key, text, row = F.col("key"), F.col("text_key"), F.col("row_key")
    before = (key < a) | ((key == a) & ((text < b) | ((text == b) & (row < c))))
    return after, F.when(before, _of(left)).otherwise(_of(right)).cast("int")


def kd_shards(df: DataFrame, shards: int = SHARDS, dims: list[str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards of nearly equal bytes, slots gapless from 0.

    size is the text's UTF-8 bytes (null: none) plus 16. dims are numeric metadata columns
    of df; by default bytes, lines and the share of multi-byte characters. Null metadata
    sorts lowest; repeated rows are distinct points that may share a shard; an empty table
    gives no rows. Only points of a few numbers are shuffled or kept, never texts.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = {} if dims else {"d0": F.log2(F.octet_length(t) + 1.0), "d1": F.log2(F.length(t) - F.length(F.replace(t, F.lit("\n"))) + 1.0), "d2": F.octet_length(t) / F.greatest(F.length(t), F.lit(1))}
    named = {f"d{i}": F.col(d).cast("double") for i, d in enumerate(dims)} if dims else own
    key = lambda x: F.shiftrightunsigned(x, 24)  # noqa: E731  40 bits of a hash
    points = df.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(t) + 16).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        key(F.xxhash64(t)).alias("text_key"),
        key(F.xxhash64(F.col(doc_id), F.monotonically_increasing_id())).alias("row_key"),
        *[c.cast("double").alias(n) for n, c in named.items()],
    )
    stored = points = table(points)
    names = list(named)
    whole = points.agg(F.sum("size").alias("w"), F.count("*").alias("n"), *[f(n).alias(f"{n}_{f.__name__}") for n in names for f in (F.min, F.max)]).first()
    rows = whole["n"]
    bounds = [(whole[f"{n}_min"] or 0.0, whole[f"{n}_max"] or 0.0) for n in names]
    points = points.select("doc_id", "size", "text_crc32", "text_key", "row_key", F.lit(0).alias("node"), *[k.alias(f"k{i}") for i, k in enumerate(_keys(names, bounds))])
    nodes = [Node(0, shards, box=[(0, SPAN)] * len(names))]
    tolerance = TOLERANCE * (whole["w"] or 0) / shards
    while rows and any(x.shards > 1 for x in nodes):
        _refine(points, nodes, len(names), tolerance)
        after, where = _split(nodes)
        # written: nested cuts would make the plan grow with the power of the level
        before, points = stored, table(points.withColumn("key", _dim_key(nodes, len(names))).withColumn("node", where).drop("key"))
        forget(before)
        stored, nodes = points, after
    return _slots(points.select("doc_id", "size", "text_crc32", "text_key", "row_key", F.col("node").alias("shard")), rows, shards)


def _slots(placed: DataFrame, rows: int, shards: int) -> DataFrame:
    """Number the rows of each shard from 0: within buckets of bounded size, then by the buckets' offsets."""
    buckets = max(1, rows // (SLOT_ROWS * shards) + 1)
    placed = placed.withColumn("bucket", F.pmod("row_key", F.lit(buckets)).cast("int"))
    counts = placed.groupBy("shard", "bucket").count()  # shards x buckets rows: one for each SLOT_ROWS rows
    offsets = counts.select("shard", "bucket", (F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("offset"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("row_key", "doc_id", "text_key"))
    placed = placed.withColumn("number", number).join(offsets, ["shard", "bucket"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("number") - 1).alias("slot"))


def op1_kd_sharding(spark, sf_dir: str) -> DataFrame:
    out = kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
