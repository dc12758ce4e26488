import random

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import graph

ITEM = "key long, name string, krate int, is_local boolean, is_fn_like boolean, kind string, in_reachable_set boolean, is_entry boolean, trait_key long, trait_dyn_compatible boolean, scid string, lo string, " + ", ".join(
    f"{x} boolean" for x in ("no_mangle", "used_linker", "has_symbol_name", "has_linkage", "is_drop_impl", "requires_mono", "is_async")
)


def keys(df):
    return {r.key for r in df.collect()}


def items(spark, *names, entry="main", **over):
    rows = [(i, n, 1, True, True, "Fn", False, n == entry, None, False, "01", f"{i:02x}", *[False] * 7) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, ITEM)
    for column, value in over.items():
        df = df.withColumn(column, value)
    return df


def test_cycle_disconnected_dangling_and_null(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 99), (7, 8), (None, 1), (1, None), (1, 2)], "src long, dst long")
    seeds = spark.createDataFrame([(1,), (None,), (1,)], "key long")
    assert keys(graph.reachable(edges, seeds)) == {1, 2, 3, 99}
    assert keys(graph.reachable(edges, seeds.limit(0))) == set()
    assert keys(graph.reachable(edges, seeds, spark.createDataFrame([(1,)], "key long"))) == {1, 2}


def test_long_chain_is_compacted(spark):
    edges = spark.range(25).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert keys(graph.reachable(edges, spark.createDataFrame([(0,)], "key long"))) == set(range(26))


def test_unused_function_goes(spark):
    fns = items(spark, "main", "helper", "unused")
    none, traits = spark.createDataFrame([], "key long"), spark.createDataFrame([], "trait_key long")
    seeds = graph.collect_seeds(fns, traits, spark.createDataFrame([(1,)], "key long"))
    reached = graph.reachable(spark.createDataFrame([(0, 50)], "src long, dst long"), seeds)
    assert keys(reached) == {0, 1, 50}
    assert keys(graph.eliminable(fns, reached, none, traits)) == {2}
    assert keys(graph.eliminable(fns, reached, spark.createDataFrame([(2,)], "key long"), traits)) == set()
    assert graph.unreached_exports(fns, reached).count() == 0


def test_unknown_attributes_keep(spark):
    none, traits = spark.createDataFrame([], "key long"), spark.createDataFrame([(5,)], "trait_key long")
    for column in ("is_async", "no_mangle", "kind"):
        assert keys(graph.eliminable(items(spark, "a", **{column: F.lit(None)}), none, none, traits)) == set()
    dispatched = items(spark, "a", trait_key=F.lit(5).cast("long"), trait_dyn_compatible=F.lit(True))
    assert keys(graph.eliminable(dispatched, none, none, traits)) == set()
    assert keys(graph.eliminable(items(spark, "a", entry=""), none, none, traits)) == {0}


def test_seeded_and_units(spark):
    traits = spark.createDataFrame([], "trait_key long")
    keep = spark.createDataFrame([("01", "00")], "scid string, lo string")
    assert keys(graph.seeded_elimination(items(spark, "a", "b", entry=""), keep, traits)) == {1}
    units = spark.createDataFrame([("u", 1, True, True, False, 10), ("u", 2, True, True, True, 5), ("u", 3, False, True, False, 7)], "cgu string, item long, is_fn boolean, is_local boolean, inlined boolean, size long")
    gone = spark.createDataFrame([(1,), (2,)], "key long")
    assert graph.codegen_units(units, gone).collect()[0].size == 12


def test_levels_and_critical_path(spark):
    deps = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (5, 6), (6, 5)], "src long, dst long")
    nodes = spark.createDataFrame([(i, float(i)) for i in range(1, 7)], "key long, weight double")
    assert {r.key: r.level for r in graph.topological_levels(nodes, deps).collect()} == {1: 2, 2: 1, 3: 0, 4: 0, 5: None, 6: None}
    assert {r.key: r.cp for r in graph.critical_path(nodes, deps).collect()} == {1: 7.0, 2: 6.0, 3: 3.0, 4: 4.0}


def test_greedy_order_and_weights(spark):
    needs = spark.createDataFrame([("a", "x", 5.0), ("a", "y", 5.0), ("b", "z", 9.0), ("c", "y", 2.0)], "project string, dep string, weight double")
    assert graph.greedy_overlap_order(needs) == ["a", "c", "b"]
    got = spark.createDataFrame([(10_000,), (1_048_576,), (100_000_000,)], "s long").select(graph.weight_ms(F.col("s")).alias("w")).collect()
    assert [round(r.w) for r in got] == [100, 2996, 60000]


def test_reduction(spark):
    fns = items(spark, "a", "b", "c", "d")
    row = graph.reduction_by(fns, spark.createDataFrame([(0,), (0,), (3,)], "key long"), "krate").collect()[0]
    assert (row.n_items, row.n_marked, row.removed, row.skip) == (4, 2, 2, False)


@pytest.mark.parametrize("small", [0, 1_000_000])
def test_walks_beside_brute_force(spark, monkeypatch, small):
    """Random graphs with a hub, cycles, loops, repeated edges and null ends; frontiers broadcast and joined with salts."""
    monkeypatch.setattr(graph, "SMALL", small)
    monkeypatch.setattr(graph, "COMPACT", 2)
    r = random.Random(small)
    pairs = [(0, k) for k in range(1, 30)] + [(r.randrange(60), r.randrange(60)) for _ in range(50)] + [(5, 5), (0, 1), (None, 3), (3, None)] + [(40 + k, 41 + k) for k in range(9)]
    known = {p for p in pairs if None not in p}
    edges = spark.createDataFrame(pairs, "src long, dst long")
    reach = {k: {k} for k in range(60)}
    for _ in range(60):
        for a, b in known:
            reach[a] |= reach[b]
    got = {x.key for x in graph.reachable(edges, spark.createDataFrame([(0,), (40,)], "key long")).collect()}
    assert got == reach[0] | reach[40]

    nodes = spark.createDataFrame([(k, float(k % 7)) for k in range(60)], "key long, weight double")
    level, cost = {}, {}
    for _ in range(60):
        for k in range(60):
            out = {b for a, b in known if a == k}
            if k not in level and out <= level.keys():
                level[k] = 1 + max((level[x] for x in out), default=-1)
                cost[k] = k % 7 + max((cost[x] for x in out), default=0)
    assert {x.key: x.level for x in graph.topological_levels(nodes, edges).collect()} == {k: level.get(k) for k in range(60)}
    assert {x.key: x.cp for x in graph.critical_path(nodes, edges).collect()} == cost

    circle = {k for k in range(60) if any(k in reach[b] for a, b in known if a == k)}
    got = {x.key: x.component for x in graph.strong_components(edges).collect()}
    assert got == {k: max(j for j in circle if j in reach[k] and k in reach[j]) for k in circle}
    parts = {x.key: x.part for x in graph.independent_parts(edges, nodes.filter("key <> 0").select("key")).collect()}
    side = {k: k for k in range(1, 60)}
    for _ in range(60):
        for a, b in known:
            if a and b:
                side[a] = side[b] = min(side[a], side[b])
    assert parts == side
