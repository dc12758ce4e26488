"""Chains, cycles, bounded parts, ranks and quantiles against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.operators import chains, cycles, graph, measurements, ranks
from tests.test_walks import frame, keys, reach, size  # noqa: F401


def jobs(spark, name, work):
    """Spark jobs that ``work`` started."""
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        work()
        return len(context.statusTracker().getJobIdsForGroup(name))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def paths_by_hand(weights, deps):
    of, left, out = {}, dict(weights), {}
    for a, b in deps:
        of.setdefault(a, set()).add(b)
    while True:
        ready = [k for k in left if all(d in out for d in of.get(k, ()))]
        if not ready:
            return out
        for k in ready:
            out[k] = left.pop(k) + max((out[d] for d in of.get(k, ())), default=0.0)


@pytest.mark.parametrize("seed", [1])
def test_deep_paths_and_walks(spark, size, seed):  # noqa: F811
    """Chains of different lengths that meet, a ring of links, a loop, edges to unknown nodes."""
    r = random.Random(seed)
    deps = [(i, i + 1) for i in range(0, 25)] + [(i, i + 1) for i in range(30, 50)] + [(50, 12), (26, 0), (26, 33), (27, 26), (27, 40)]
    deps += [(60, 61), (61, 62), (62, 60), (63, 60), (64, 64), (65, 63), (70, 999), (71, 70)] + [(r.randrange(72, 80), r.randrange(80, 90)) for _ in range(8)] + [(None, 1), (1, None)]
    weights = [(k, float(r.randrange(9))) for k in range(95)] + [(None, 1.0), (3, 1.0)][:1]
    clean = [d for d in deps if None not in d]
    got = chains.deep_critical_path(spark.createDataFrame(weights, "key long, weight double"), frame(spark, deps, "src", "dst")).collect()
    want = paths_by_hand({k: w for k, w in weights if k is not None}, clean)
    assert {x.key: x.cp for x in got} == want and len(got) == len(want)
    nodes = frame(spark, [(k,) for k in range(95)], "key")
    level = {x.key: x.level for x in chains.deep_levels(nodes, frame(spark, deps, "src", "dst")).collect()}
    ones = paths_by_hand({k: 1.0 for k in range(95)}, clean)
    assert level == {k: int(ones[k]) - 1 if k in ones else None for k in range(95)}
    seeds = r.sample(range(80), 4) + [61]
    assert keys(chains.deep_reachable(frame(spark, deps, "src", "dst"), frame(spark, [(s,) for s in seeds], "key"))) == reach(clean, seeds)


def test_a_chain_of_100000_nodes(spark):
    """Jobs grow with the logarithm: 17 doublings of a chain of 100,000 nodes, each a few jobs."""
    n = 100_000
    deps = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = {}
    count = jobs(spark, "chain", lambda: found.update(paths=chains.deep_critical_path(spark.range(n).select(F.col("id").alias("key"), F.lit(1.0).alias("weight")), deps).agg(F.min("cp"), F.max("cp"), F.count("*")).first()))
    assert tuple(found["paths"]) == (1.0, float(n), n)
    assert count < 250
    count = jobs(spark, "walk", lambda: found.update(walk=chains.deep_reachable(deps, frame(spark, [(40_000,)], "key")).agg(F.min("key"), F.count("*")).first()))
    assert tuple(found["walk"]) == (40_000, 60_000)
    assert count < 250


def acyclic(edges):
    return len(paths_by_hand({k: 0.0 for e in edges for k in e}, edges)) == len({k for e in edges for k in e})


def test_cycle_cut(spark):
    """Rings lose one edge each, whichever way they run; dense components at most half; no cycle stays."""
    r = random.Random(2)
    rings = [(b * 10 + i, b * 10 + (i + (1 if b % 2 else 4)) % 5) for b in range(4) for i in range(5)]
    dense = [(r.randrange(100, 106), r.randrange(100, 106)) for _ in range(20)]
    bridges, loops = [(0, 10), (12, 100), (100, 200), (200, 201)], [(7, 7), (103, 103)]
    edges = sorted(set(rings + dense + bridges + loops))
    nodes = frame(spark, [(k,) for k in sorted({k for e in edges for k in e})], "key")
    gone = {(x.src, x.dst) for x in cycles.cycle_cut(nodes, frame(spark, edges + edges[:3] + [(None, 1)], "src", "dst")).collect()}
    assert gone <= set(edges) and acyclic([e for e in edges if e not in gone])
    assert len([e for e in gone if e in rings]) == 4 and not gone & set(bridges)
    inside = [e for e in edges if e in dense and e[0] != e[1]]
    assert len([e for e in gone if e in inside]) <= len(inside) // 2
    up = [(a, b) for a, b in rings if b > a]
    assert len(up) > 4  # what keeping edges to smaller keys would cut


@pytest.mark.parametrize("most", [4, 12])
def test_bounded_parts(spark, most):
    """Cliques of four in a row and a hub: parts of the given size at most, each node once; cliques stay together where they fit."""
    cliques = [(b * 4 + i, b * 4 + j) for b in range(12) for i in range(4) for j in range(i)]
    row = [(b * 4 + 3, b * 4 + 4) for b in range(11)]
    hub = [(100, 101 + i) for i in range(40)]
    nodes = list(range(48)) + [100] + [101 + i for i in range(40)] + [500]
    edges = frame(spark, cliques + row + hub + [(1, 900), (None, 3), (5, 5)], "src", "dst")
    parts = cycles.bounded_parts(edges, frame(spark, [(k,) for k in nodes] + [(None,), (3,)], "key"), most)
    rows = {x.key: (x.part, x.size) for x in parts.collect()}
    assert sorted(rows) == sorted(nodes)
    members = {}
    for k, (part, n) in rows.items():
        members.setdefault(part, []).append(k)
        assert part in nodes and n <= most
    assert all(len(m) == rows[m[0]][1] for m in members.values())
    between = cycles.edges_between(edges, parts).count()
    assert between == sum(rows[a][0] != rows[b][0] for a, b in cliques + row + hub)
    if most == 12:
        assert between < 0.5 * len(cliques + row + hub)


def test_quantiles(spark, size):  # noqa: F811
    """A value that fills a group, nulls as group and as value, groups of one."""
    r = random.Random(6)
    rows = [("a", r.choice([1.5, r.random()])) for _ in range(301)] + [("hot", 7.0)] * 500 + [("hot", float(i)) for i in range(40)] + [(None, 1.0), (None, 2.0), ("one", 3.25), ("none", None), ("a", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, speedup double").repartition(7)
    at = {"low": 0.0, "p10": 0.1, "median": 0.5, "p99": 0.99, "high": 1.0}
    got = {x.g: x for x in ranks.quantiles(df, "g", "speedup", at).collect()}
    for g in {"a", "hot", None, "one"}:
        own = [v for k, v in rows if k == g and v is not None]
        for name, q in at.items():
            assert got[g][name] == pytest.approx(float(np.quantile(own, q)))
    assert "none" not in got
    table = {x.g: x for x in measurements.percentiles(df, "g").collect()}
    assert table["none"].n == 1 and table["none"].median is None and table["a"].n == 302
    assert {x.g: x.runs for x in measurements.repeated_runs(df, "g", "speedup").collect()}["a"] == 301
    assert ranks.quantiles(df.limit(0), "g", "speedup", at).count() == 0


def test_ranks_and_blocks(spark, size):  # noqa: F811
    rows = [(i % 3 if i % 7 else None, i * 37 % 101, i) for i in range(150)] + [(1, None, 900), (1, None, 901)]
    df = spark.createDataFrame(rows, "g int, v int, id int").repartition(5)
    got = {x.id: x["rank"] for x in measurements.ranked(df, "g", "v", "id").collect()}
    for g in (0, 1, 2, None):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))
        assert [got[x[2]] for x in own] == list(range(1, len(own) + 1))
    pairs = frame(spark, [(1, k) for k in range(25)] + [(1, 3), (2, 9), (None, 1), (2, None)], "src", "dst")
    lists = sorted((x.src, x.block, list(x["items"]), x.n) for x in ranks.blocked_lists(pairs, "src", "dst", 10).collect())
    assert lists == [(1, 0, list(range(10)), 10), (1, 1, list(range(10, 20)), 10), (1, 2, list(range(20, 25)), 5), (2, 0, [9], 1)]
    assert graph.SMALL in (0, 1_000_000)
