"""Small examples worked by hand, and properties."""

import datetime as dt
import hashlib
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import columns as fn
from lakeloom.operators import batch, graph, kv, ordered, partitioning, relational, timeseries, txn
from lakeloom.streaming import topology

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_haversine(spark):
    km = one(spark, fn.haversine(*map(F.lit, (52.52, 13.405, 48.8566, 2.3522))))[0]
    assert abs(km - 877.46) < 0.5


def test_names_tags_and_numbers(spark):
    df = spark.createDataFrame([("Ann", "Lee", "al"), ("", "Lee", "al"), (None, "", "al")], "f string, l string, u string")
    assert [r[0] for r in df.select(fn.full_name(F.col("f"), F.col("l"), F.col("u"))).collect()] == ["Ann Lee", "Lee", "al"]
    r = one(spark, fn.hashtag(F.lit("##Sp#ark#")), fn.title_case(F.lit("o'neil MC-donald")), fn.whole_number(F.lit("42")), fn.whole_number(F.lit("4x")), fn.valid_email(F.lit("a@b.co")), fn.valid_email(F.lit("a@b")))
    assert list(r) == ["sp#ark", "O'Neil Mc-Donald", 42, None, True, False]


def test_engagement_without_views(spark):
    assert one(spark, fn.engagement_rate(*map(F.lit, (1, 2, 3, 4, 0))))[0] == 0.0
    assert one(spark, fn.engagement_rate(*map(F.lit, (1, 2, 3, 4, 20))))[0] == 0.5


def test_md5_arithmetic(spark):
    keys = [f"k{i}" for i in range(200)]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", fn.md5_mod(F.col("k"), 7), fn.md5_position(F.col("k"))).collect()
    for k, m, p in got:
        n = int(hashlib.md5(k.encode()).hexdigest(), 16)
        assert (m, p) == (n % 7, n % 2**32)


def test_bloom(spark):
    bits, hashes = fn.bloom_shape(10_000, 0.01)
    assert (bits, hashes) == (95850, 6)
    members = spark.createDataFrame([(f"m{i}",) for i in range(50)], "x string")
    positions = kv.bloom(members, "x", bits, hashes)
    assert kv.bloom_contains(members, "x", positions, bits, hashes).where("NOT maybe").count() == 0
    others = spark.createDataFrame([(f"o{i}",) for i in range(50)], "x string")
    assert kv.bloom_contains(others, "x", positions, bits, hashes).where("maybe").count() < 3


def test_percentiles_take_the_lower_rank(spark):
    df = spark.createDataFrame([("a", float(i), i) for i in range(1, 11)], "g string, v double, id long")
    assert ordered.ranked_values(df, ["g"], "v", [50, 95, 99]).first()[1:] == (6.0, 10.0, 10.0)


def test_constant_window_flags_any_change(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("m", t + dt.timedelta(seconds=i), i, 5.0 if i < 10 else 6.0) for i in range(11)]
    df = spark.createDataFrame(rows, "event_type string, ts timestamp_ntz, event_id long, value double")
    assert [r["event_id"] for r in timeseries.anomalies(df, ["event_type"]).collect()] == [10]


def test_kv_newest_wins_and_tombstones(spark, tmp_path):
    t = [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i) for i in range(4)]
    rows = [("a", 1.0, t[0], 1, False), ("a", 2.0, t[1], 2, False), ("b", 3.0, t[0], 3, False), ("b", None, t[2], 4, True), ("c", 4.0, t[3], 5, False), ("c", 5.0, t[3], 6, False)]
    log = spark.createDataFrame(rows, "key string, value double, ts timestamp_ntz, seq long, deleted boolean")
    assert {r["key"]: r["value"] for r in kv.latest(log).collect()} == {"a": 2.0, "c": 5.0}
    assert [r["key"] for r in kv.scan(log, "a", "c").collect()] == ["a", "c"]
    kv.compact([log.where("seq < 3"), log.where("seq >= 3")], str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run")).count() == 2


def test_ring_moves_only_to_the_new_node(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("key"))
    old, new = ["a", "b", "c"], ["a", "b", "c", "d"]
    moved = partitioning.moves(df, F.col("key"), old, new).collect()
    assert moved and {r["to_node"] for r in moved} == {"d"}
    ring = spark.createDataFrame(partitioning.ring(old, 32), "position long, node string")
    a = {r["key"]: r["node"] for r in partitioning.by_ring(df, F.col("key"), old, 32).collect()}
    b = {r["key"]: r["node"] for r in partitioning.ring_join(df, F.col("key"), ring).collect()}
    assert a == b


def test_range_query_filters_rows(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert partitioning.range_query(df, F.col("k"), 2, 5).count() == 3
    assert [r["pid"] for r in partitioning.by_range(df, F.col("k"), [3, 7]).orderBy("k").collect()] == [0] * 3 + [1] * 4 + [2] * 3


def test_weak_components_give_the_smallest_id(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (33, 31)], "src long, dst long")
    got = {r["id"]: r["component"] for r in graph.weak_components(edges).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 30: 30, 31: 30, 33: 30}


def test_hops_and_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4)], "src long, dst long")
    assert {r["id"]: r["hops"] for r in graph.hops(edges, 1).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}
    assert sorted(tuple(r["path"]) for r in graph.cycles(edges).collect()) == [(1, 2, 3), (4, 5)]


def test_pagerank_sums_to_one(spark):
    users = spark.createDataFrame([(i,) for i in range(5)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 0)], "src long, dst long")
    assert abs(graph.pagerank(users, edges).agg(F.sum("rank")).first()[0] - 1) < 1e-9


def test_betweenness_of_a_path(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    assert {r["id"]: r["betweenness"] for r in graph.betweenness(edges, [0, 1, 2]).collect()} == {0: 0.0, 1: 2.0, 2: 0.0}


def test_repeatable_read_pins_the_first_version(spark):
    versions = spark.createDataFrame([("k", 1, 1, True, 100), ("k", 2, 5, True, 101)], "key string, version int, seq long, committed boolean, transaction long")
    reads = spark.createDataFrame([(7, "k", 0), (7, "k", 3), (7, "k", 9)], "tx long, key string, seq long")
    assert [r["version"] for r in txn.repeatable_read(reads, versions).orderBy("seq").collect()] == [None, 1, 1]


def test_money_is_conserved(spark):
    ops = spark.createDataFrame([(1, "a", "write", 1000, 1), (1, "b", "write", 500, 2), (2, "a", "write", 800, 3), (2, "b", "write", 700, 4), (3, "a", "write", 0, 5)], "tx long, resource string, type string, value int, at int")
    state = txn.commit_state(ops, spark.createDataFrame([(3,)], "tx long"))
    assert state.agg(F.sum("value")).first()[0] == 1500


def test_vector_clocks_and_counter(spark):
    rows = [("k", 1, {"a": 1}), ("k", 2, {"a": 2, "b": 1}), ("k", 3, {"c": 1})]
    clocks = spark.createDataFrame(rows, "key string, version int, clock map<string,long>")
    assert [r["version"] for r in txn.dominated(clocks).collect()] == [1]
    n = spark.createDataFrame([("k", "a", 2), ("k", "a", 5), ("k", "b", 1)], "key string, replica string, n long")
    assert txn.gcounter(n).first()["n"] == 6


def test_interval_join_bounds_are_closed(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("u", t, 1), ("u", t + dt.timedelta(seconds=60), 2), ("u", t + dt.timedelta(seconds=61), 3)]
    df = spark.createDataFrame(rows, "user_id string, ts timestamp_ntz, event_id long")
    out = relational.interval_join(df.where("event_id = 1"), df.where("event_id > 1"), "user_id", 60)
    assert [r["r"]["event_id"] for r in out.collect()] == [2]


def test_clean_users_and_rules(spark):
    raw = spark.createDataFrame([(1, "ann lee", "A@B.CO", "33"), (2, "", "x", "1"), (3, "bob", "C@D.EF", "old")], "id int, name string, email string, age string")
    assert [tuple(r) for r in batch.clean_users(raw).orderBy("id").collect()] == [(1, "Ann Lee", "a@b.co", 33), (3, "Bob", "c@d.ef", None)]
    assert {r["rule"]: r["rows"] for r in batch.violations(raw, {"age": "age RLIKE '^[0-9]+$'", "name": "name <> ''"}).collect()} == {"age": 1, "name": 1}


def test_document_repository(spark):
    df = spark.range(10).withColumn("kind", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    assert [r["id"] for r in relational.find_many(df, {"kind": "odd"}, "id", 1, 2).collect()] == [3, 5]
    assert relational.update(df, "id", 3, {"kind": "x"}).where("kind = 'x'").count() == 1
    assert relational.delete(df, "id", 3).count() == 9


def test_late_rows_are_dropped_in_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp_ntz, event_type string, user_id long, value double"
    for n, rows in enumerate([[(1, t, "a", 1, 1.0), (2, t + dt.timedelta(hours=1), "a", 1, 1.0)], [(3, t + dt.timedelta(hours=2), "a", 1, 1.0)], [(4, t, "a", 1, 1.0), (5, t + dt.timedelta(hours=5), "a", 1, 1.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = topology.file_stream(spark, str(tmp_path / "in"), 1)
    top = topology.Topology(spark, str(tmp_path / "ck"))
    top.stream("events", stream)
    top.process("events", "windows", lambda d: topology.tumbling(d, ["event_type"], "5 minutes"))
    top.publish("windows", str(tmp_path / "out"))
    top.await_all()
    assert top.stats()["windows"]["rows"] == 5
    first = spark.read.parquet(str(tmp_path / "out")).where(F.col("window_start") == F.lit(t)).collect()
    assert len(first) == 1 and first[0]["n"] in (1, 2)
    top.stop_all()


def test_partitioned_points(spark, tmp_path):
    from lakeloom.sources import tables

    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, t + dt.timedelta(days=i)) for i in range(5)], "id int, ts timestamp_ntz")
    tables.write_points(df, str(tmp_path / "p"))
    back = tables.time_range(spark.read.parquet(str(tmp_path / "p")), t + dt.timedelta(days=1), t + dt.timedelta(days=2))
    assert back.count() == 2 and "PartitionFilters: [isnotnull(date_partition" in back._jdf.queryExecution().toString()
    assert tables.delete_older(df, 2).count() == 3


def test_betweenness_of_every_node_equals_brute_force(spark):
    rng = random.Random(5)
    edges = list({(a, b) for a, b in ((rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(90)) if a != b})
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def paths(s, t):
        """All shortest paths."""
        found = [[s]]
        seen = {s}
        while found and t not in seen:
            found = [[*p, w] for p in found for w in near[p[-1]] if w not in seen]
            seen.update(p[-1] for p in found)
        return [p for p in found if p[-1] == t]

    want = dict.fromkeys(near, 0.0)
    for s in near:
        for t in near:
            through = paths(s, t) if s != t else []
            for p in through:
                for v in p[1:-1]:
                    want[v] += 1 / len(through)
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(spark.createDataFrame(edges, "src long, dst long"), parts=5).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)


def whole_shares(spark, sf):
    from lakeloom.sources import tables

    return [tuple(r) for r in tables.shares(spark, sf).collect()]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_whole_graph_queries_have_every_customer(spark):
    from lakeloom.plans.catalogue import QUERIES

    edges = whole_shares(spark, SF)
    nodes = {v for e in edges for v in e}
    label = {v: v for v in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert {r["id"]: r["component"] for r in QUERIES["graph_wcc"](spark, SF).collect()} == label
    assert {r["id"] for r in QUERIES["graph_betweenness"](spark, SF).collect()} == nodes and max(nodes) > 40


def test_deadlocks_of_any_length(spark):
    """Against reachability by brute force: every strongly connected component gets one cycle."""
    rng = random.Random(6)
    ring = [(i, i % 7 + 1) for i in range(1, 8)]
    cases = [ring, [(1, 2), (2, 3), (3, 4), (1, 4)], [*ring, (7, 20), (20, 21), (21, 20), (21, 30), (30, 31), (40, 1), (50, 50)]]
    cases += [list({(rng.randrange(25), rng.randrange(25)) for _ in range(30)}) for _ in range(2)]
    for edges in cases:
        reach = set(edges)
        while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
            reach |= more
        groups = {frozenset(w for w in {x for e in edges for x in e} if (v, w) in reach and (w, v) in reach) for v in {x for e in edges for x in e} if (v, v) in reach}
        df = spark.createDataFrame(edges, "src long, dst long")
        assert txn.has_cycle(df) == bool(groups)
        got = txn.deadlocks(df).collect()
        assert {r["victim"]: r["members"] for r in got} == {max(g): len(g) for g in groups} and len(got) == len(groups)
        for r in got:
            path = [int(x) for x in r["cycle"].split(">")]
            assert r["victim"] == path[0] and len(set(path)) == len(path) and all(e in edges for e in zip(path, [*path[1:], path[0]]))


def test_betweenness_seen_from_either_side(spark):
    """Dense parts, where unreached nodes have fewer edges than the front, beside a long path, a node of its own and edges without an end."""
    rng = random.Random(8)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(150)] + [(i, i + 1) for i in range(29, 45)] + [(60, 60), (50, 51)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = dict.fromkeys(near, 0.0)
    for s in near:
        far, ways, order = {s: 0}, dict.fromkeys(near, 0), [s]
        ways[s] = 1
        for v in order:
            for w in near[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    order.append(w)
                if far[w] == far[v] + 1:
                    ways[w] += ways[v]
        share = dict.fromkeys(near, 0.0)
        for w in reversed(order[1:]):
            for v in near[w]:
                if far[v] == far[w] - 1:
                    share[v] += ways[v] / ways[w] * (1 + share[w])
            want[w] += share[w]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "src long, dst long")
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(df, parts=3).collect()}
    assert got.keys() == near.keys() - {60} and all(abs(got[v] - want[v]) < 1e-6 for v in got)


def test_betweenness_costs_a_source_its_own_component(spark):
    """80,000 paths of three nodes, their ids interleaved: minutes if every source walked arrays of all nodes."""
    k = 80_000
    edges = spark.range(k).selectExpr("id AS src", f"id + {k} AS dst").unionAll(spark.range(k).selectExpr(f"id + {k} AS src", f"id + {2 * k} AS dst"))
    began = time.monotonic()
    got = graph.betweenness(edges).toPandas()
    assert time.monotonic() - began < 90
    assert len(got) == 3 * k and set(got["id"]) == set(range(3 * k))
    assert (got["betweenness"] == got["id"].between(k, 2 * k - 1) * 2.0).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_bloom_probe_asks_every_customer(spark):
    from lakeloom.plans.catalogue import QUERIES

    ids = [r[0] for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()]
    members = [i for i in ids if i % 10 == 0]
    bits, hashes = fn.bloom_shape(len(members), 0.01)
    places = lambda i: {int(hashlib.md5(f"{i}{k}".encode()).hexdigest(), 16) % bits for k in range(hashes)}
    filled = set().union(*map(places, members))
    got = {r["id"]: r["maybe"] for r in QUERIES["kv_bloom_probe"](spark, SF).collect()}
    assert got == {i: places(i) <= filled for i in ids} and len(got) > len(members) and not all(got.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_bloom_probe_places_items_as_its_sql_does(spark, tmp_path):
    """More customers than the smallest tables have, and odd ones: a null, a repeated and a negative id."""
    import duckdb

    from lakeloom.plans.catalogue import ORACLE_SQL, QUERIES

    spark.range(1500).unionByName(spark.createDataFrame([(None,), (7,), (20,), (-30,)], "id long")).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["kv_bloom_probe"](spark, str(tmp_path)).collect()]
    want = con.sql(ORACLE_SQL["kv_bloom_probe"]).fetchall()
    assert set(got) == set(want) and len(got) == len(want) == 1502


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_read_from_the_first_of_equal_lags(spark, tmp_path):
    """20,000 suppliers: keys 9,000 apart lag alike."""
    import duckdb

    from lakeloom.plans.catalogue import ORACLE_SQL, QUERIES

    rows = spark.range(2, 20_000).unionByName(spark.createDataFrame([(None,)], "id long"))
    rows.select(F.col("id").alias("s_suppkey"), F.when(F.col("id") % 4500 > 0, F.concat(F.lit("s"), F.col("id"))).alias("s_name")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    for name in ("replica_read_from", "replica_cluster_status"):
        assert [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()] == con.sql(ORACLE_SQL[name]).fetchall()
    spark.createDataFrame([(1, "s1"), (31, "s31")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/few/supplier.parquet")
    con.sql(f"CREATE OR REPLACE VIEW supplier AS SELECT * FROM '{tmp_path}/few/supplier.parquet/*.parquet'")
    assert [tuple(r) for r in QUERIES["replica_read_from"](spark, f"{tmp_path}/few").collect()] == con.sql(ORACLE_SQL["replica_read_from"]).fetchall() == [(None,)]
    nodes = spark.createDataFrame([("p", "primary", "HEALTHY", 0), ("b", "secondary", "HEALTHY", 5), ("a", "secondary", "HEALTHY", 5), ("c", "secondary", "FAILED", 1)], "node string, role string, health string, lag_ms int")
    assert [txn.read_from(x).first()[0] for x in (nodes, nodes.where("lag_ms < 5"))] == ["a", "p"]


def test_locks_are_granted_in_order(spark):
    """The closed form against a queue walked by hand."""
    rng = random.Random(21)
    rows = [(rng.randint(1, 4), r, rng.choice(["shared", "shared", "exclusive"]), i) for r in range(150) for i in range(rng.randint(1, 6))]
    want = {}
    for tx, resource, kind, at in sorted(rows, key=lambda x: (x[1], x[3])):
        held = [(t, k) for (t, r, k, _), g in want.items() if g and r == resource]
        want[tx, resource, kind, at] = all(t == tx or (k == kind == "shared") for t, k in held)
    df = txn.grant_locks(spark.createDataFrame(rows, "tx long, resource long, kind string, at long"))
    assert {tuple(r)[:4]: r["granted"] for r in df.collect()} == want
    left = {tuple(r)[:4]: r["granted"] for r in txn.release(df, 1).collect()}
    assert not any(k[0] == 1 for k in left) and len(left) == sum(r[0] != 1 for r in rows)
    # what was granted and isn't the leaver's stays granted; each resource that has a request holds one
    assert all(left[k] for k, g in want.items() if g and k[0] != 1)
    assert {k[1] for k, g in left.items() if g} == {k[1] for k in left}


def test_ring_in_a_table_equals_the_literal(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("key")).unionByName(spark.createDataFrame([(None,)], "key string"))
    for nodes, virtual in ((["a"], 1), (["a", "b", "c"], 2), ([f"n{i}" for i in range(20)], 256)):
        ring = spark.createDataFrame(partitioning.ring(nodes, virtual), "position long, node string")
        a, b = ({r["key"]: r["node"] for r in d.collect()} for d in (partitioning.by_ring(df, F.col("key"), nodes, virtual), partitioning.ring_join(df, F.col("key"), ring)))
        assert a == b and len(a) == 3001


def test_map_reduce_by_hand(spark):
    df = spark.createDataFrame([(i % 7, float(i)) for i in range(1000)] + [(3, float(i)) for i in range(5000)], "k long, v double").repartition(5)
    out = batch.map_reduce(df, lambda r: [(str(r.k), r.v), ("all", r.v)], lambda v: (v, 1), lambda a, v: (a[0] + v, a[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda k, a: a[1], "key string, n long")
    got = {r["key"]: r["n"] for r in out.collect()}
    assert got["all"] == 6000 and got["3"] == 5143 and len(got) == 8
    assert batch.map_reduce(df.where("false"), lambda r: [(str(r.k), 1)], lambda v: v, max, max, lambda k, a: a, "key string, n long").collect() == []


def test_shortest_path_and_graph_writes(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 3), (1, 4), (4, 5), (8, 9)], "src long, dst long")
    assert sorted(tuple(r) for r in graph.shortest_path(edges, 1, 5).collect()) == [(0, 1), (1, 4), (2, 5)]
    assert graph.shortest_path(edges, 1, 9).collect() == [] and [tuple(r) for r in graph.shortest_path(edges, 2, 2).collect()] == [(0, 2)]
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    assert graph.create_relations(edges.limit(0), spark.createDataFrame([(1, 2), (1, 7), (7, 2)], "src long, dst long"), nodes).collect() == [(1, 2)]
    assert sorted(r["id"] for r in graph.create_nodes(nodes, spark.createDataFrame([(2,), (3,), (3,)], "id long")).collect()) == [1, 2, 3]


def test_ranges(spark):
    assert partitioning.split_range([10, 20], 15) == [10, 15, 20] and partitioning.split_range([10], 10) == [10]
    assert partitioning.overlapping([10, 20], 12, 20) == [1] and partitioning.overlapping([10, 20], 5, 21) == [0, 1, 2] and partitioning.overlapping([10], 4, 4) == []


def test_rows_without_a_type_reach_the_last_handler(spark, tmp_path):
    spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (3, "b", 3.0)], "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/in")
    t = topology.Topology(spark, f"{tmp_path}/checkpoint")
    t.stream("s", topology.file_stream(spark, f"{tmp_path}/in"))
    seen = {}
    t.consume("s", {"a": lambda b: seen.setdefault("a", [r["event_id"] for r in b.collect()]), "*": lambda b: seen.setdefault("*", sorted(r["event_id"] for r in b.collect()))})
    t.await_all()
    assert seen == {"a": [1], "*": [2, 3]}


def test_watermark_is_told(spark, tmp_path):
    rows = [(i, "a", float(i), dt.datetime(2024, 1, 1, 0, i)) for i in range(30)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double, ts timestamp").write.parquet(f"{tmp_path}/in")
    t = topology.Topology(spark, f"{tmp_path}/checkpoint")
    t.stream("s", topology.tumbling(topology.file_stream(spark, f"{tmp_path}/in"), ["event_type"], "5 minutes"))
    t.publish("s", f"{tmp_path}/out")
    t.await_all()
    assert t.watermark("s") == "2024-01-01T00:28:50.000Z"


def test_failover_takes_the_replica_that_has_most(spark):
    nodes = spark.createDataFrame([("p", "primary", "FAILED", 9), ("a", "secondary", "HEALTHY", 5), ("b", "secondary", "HEALTHY", 7), ("c", "secondary", "FAILED", 8), ("d", "secondary", "HEALTHY", 7)], "node string, role string, health string, applied long")
    assert {r["node"]: (r["role"], r["follows"]) for r in txn.failover(nodes).collect()} == {"a": ("secondary", "b"), "b": ("primary", None), "c": ("secondary", "b"), "d": ("secondary", "b")}


def test_communities_by_hand(spark):
    rng = random.Random(22)
    edges = [(rng.randint(0, 9) + 20 * (i % 2), rng.randint(0, 9) + 20 * (i % 2)) for i in range(60)] + [(3, 25)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    label = {v: v for v in near}
    for _ in range(5):
        votes = {v: [label[u] for u in near[v]] for v in near}
        label = {v: min(x, key=lambda c: (-x.count(c), c)) for v, x in votes.items()}
    want = {v: min(u for u in label if label[u] == c) for v, c in label.items()}
    got = graph.communities(spark.createDataFrame(edges, "src long, dst long"))
    assert {r["id"]: r["community"] for r in got.collect()} == want


def test_collectors(spark):
    from lakeloom.sources import collectors

    given = {"b": lambda: [("x", 1), ("y", None), ("x", 1)], "a": lambda: [], "c": lambda: iter([(None, 2.5)])}
    got = collectors.collect(spark, given)
    assert sorted(map(tuple, got.collect()), key=str) == [("b", "x", 1.0), ("b", "x", 1.0), ("b", "y", None), ("c", None, 2.5)]
    assert [r["metric_name"] for r in spark.read.format("collectors").option("only", "c").load().collect()] == [None]
    assert spark.read.format("collectors").option("only", "none").load().collect() == []
    assert collectors.collect(spark, {}).collect() == []


def test_idle_keys_are_told_once_their_timer_expires(spark, tmp_path):
    """Two files, one after the other: a key that falls silent is told with the first, and anew when it comes back."""
    from lakeloom.plans.catalogue import _rocksdb

    schema = "k string, ts timestamp"
    rows = [[("a", 9000), ("a", 9005), (None, 9001), ("b", 9400), ("b", None)], [("a", 9500), ("c", 10000)]]
    for i, part in enumerate(rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        made = spark.createDataFrame(part, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
        made.coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        (file,) = (tmp_path / f"part{i}").glob("*.parquet")
        file.rename(tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_000 + i, 1_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with _rocksdb(spark):
        out = topology.run_to_table(topology.idle(stream, "k", 100), str(tmp_path / "run"))
    told = sorted((tuple(r) for r in out.collect()), key=str)
    assert told == sorted([("a", 2, 9_005_000), (None, 1, 9_001_000), ("b", 1, 9_400_000), ("a", 1, 9_500_000)], key=str)
