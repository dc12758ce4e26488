"""What larger tables bring: several records of one group, long chains, many small texts, wide label sets."""

import random
import re
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwell.operators import blocks, chains, graph, walks
from tarnwell.sources import files
from tests.test_deep import jobs
from tests.test_walks import frame, keys, live_by_hand, reach


def test_records_of_one_crate_do_not_mix(spark):
    records = [
        ("c", "[DEFINED_ITEMS]\na\n\nCALL_EDGES:\n a -> b\nNO_MANGLE\r\na"), ("c", "loose\n  NO_MANGLE\nx\nOTHER\ny\n[DEFINED_ITEMS]\nz -> w -> v"),
        ("d", "none"), ("d", None), ("d", "STATICS"),
    ]
    got = files.analysis_rows(spark.createDataFrame(records, "crate string, text string").repartition(1)).collect()
    want = [("c", "CALL_EDGES", "a", "b"), ("c", "DEFINED_ITEMS", "a", None), ("c", "DEFINED_ITEMS", "z", "w -> v"), ("c", "NO_MANGLE", "a", None), ("c", "NO_MANGLE", "x", None)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_small_texts_share_batches():
    from tarnwell.sources import names, parsers

    texts = pa.record_batch({"key": ["a", "b", "c"], "text": ["fn x() { y(); }", None, "fn y() {}"]})
    (facts,) = parsers._run(parsers.PARSERS["braces"])(iter([texts, texts]))
    assert facts.num_rows == 6
    (found,) = names._read(iter([texts.rename_columns(["path", "text"])] * 2))
    assert found.num_rows == 2 * sum(len(names.read_names(t or "")) for t in texts.column("text").to_pylist())
    assert list(parsers._run(parsers.PARSERS["lines"])(iter([texts.slice(1, 1)]))) == []


def chain_by_hand(to, weights, start):
    """Weights from ``start`` to the end of its chain; None in a ring or from where one weight is missing."""
    seen, total = set(), 0.0
    while start in weights:
        if start in seen or weights[start] is None:
            return None
        seen.add(start)
        total += weights[start]
        start = to.get(start)
    return total


@pytest.mark.parametrize("width", [5, 200_000])
def test_chains_across_ranges(spark, monkeypatch, width):
    """Chains along keys, against them and at random, rings in a range and across, nodes without a weight."""
    monkeypatch.setattr(chains, "RANGE", width)
    to = {i: i + 1 for i in range(40)} | {i: i - 1 for i in range(60, 90)} | {100: 101, 101: 102, 102: 100, 103: 101, 110: 150, 150: 110, 130: 110, 45: 20, 46: 45, 47: 45, 200: 210, 210: 205, 205: 203, 203: 220}
    weights = {k: float(k % 7) for k in {*to, *to.values()}} | {15: None}
    got = chains.deep_critical_path(spark.createDataFrame(list(weights.items()), "key long, weight double"), spark.createDataFrame(list(to.items()), "src long, dst long")).collect()
    ring = {k for k in weights if k >= 100 and k < 200}
    assert {x.key: x.cp for x in got} == {k: chain_by_hand(to, weights, k) for k in weights if k not in ring}
    for seeds in ([46, 75], [103, 203], [130], [0]):
        want = set(seeds)
        for k in seeds:
            while (k := to.get(k)) is not None and k not in want:
                want.add(k)
        found = [x.key for x in chains.deep_reachable(spark.createDataFrame(list(to.items()), "src long, dst long"), spark.createDataFrame([(k,) for k in seeds], "key long")).collect()]
        assert sorted(found) == sorted(want)


def test_a_chain_along_keys_takes_few_jobs(spark):
    n = 100_000
    deps = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    weights = spark.range(n).select(F.col("id").alias("key"), F.lit(1.0).alias("weight"))
    assert jobs(spark, "along keys", lambda: chains.deep_critical_path(weights, deps).agg(F.max("cp")).first()) < 40


def test_shortcuts_of_a_labelled_walk(spark):
    """Pairs up to four edges apart, and none where a hub would bring many."""
    line = spark.range(20).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {(r.src, r.dst) for r in walks._with_shortcuts(line).collect()} == {(i, i + k) for i in range(20) for k in range(1, 5) if i + k <= 20}
    hub = spark.range(30).select(F.col("id").alias("src"), F.lit(100).cast("long").alias("dst")).union(spark.range(30).select(F.lit(100).cast("long"), F.col("id") + 200))
    assert walks._with_shortcuts(hub).count() == 60


def test_crates_are_found_for_folders(spark):
    """A source has one row, however deep it lies: its folder is looked up, not all folders above it."""
    from tarnwell.sources import parsers

    manifests = spark.createDataFrame([("/a/Cargo.toml", 'name = "a-b"'), ("/a/b/c/Cargo.toml", 'name = "c"'), ("Cargo.toml", "[workspace]")], "path string, text string")
    sources = spark.range(3000).select(F.concat(F.lit("/a/b"), F.when(F.col("id") % 2 == 0, "/c/d/e").otherwise(""), F.lit("/f"), F.col("id"), F.lit(".rs")).alias("path"), F.lit("x").alias("text"))
    sources = sources.union(spark.createDataFrame([("/z/x.rs", "x"), ("x.rs", "x"), (None, "x"), ("/a/b/f1.rs", "x")], "path string, text string"))
    rows = parsers.crate_sources(manifests, sources)
    assert {(r.crate, r["count"]) for r in rows.groupBy("crate").count().collect()} == {("a_b", 1501), ("c", 1500)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join Inner, \(path#\d+ = path#\d+\)", plan)  # all sources are looked up by their folder


@pytest.mark.parametrize("small, hub", [(1_000_000, 3), (0, 3), (0, 100_000)])
def test_three_dispatch_walks_in_one(spark, monkeypatch, small, hub):
    """Each way against a loop of its own, with hubs, nulls, and methods that only the wider ways reach."""
    monkeypatch.setattr(graph, "SMALL", small)
    monkeypatch.setattr(graph, "HUB", hub)
    r = random.Random(11)
    pick = r.randrange
    edges = [(pick(80), pick(80)) for _ in range(30)] + [(7, k) for k in range(20, 30)] + [(None, 1), (0, None)]
    builds, calls = [(pick(80), pick(15)) for _ in range(25)] + [(7, 3), (7, None)], [(pick(80), pick(9)) for _ in range(20)] + [(7, None)]
    methods = [(pick(15), pick(9), pick(80)) for _ in range(40)] + [(3, None, 70), (3, 1, 71), (14, 1, 72), (None, 1, 79), (1, 1, None)]
    seeds, clean = [0, 7, 7], [e for e in edges if None not in e]
    got = walks.dispatch_ways(frame(spark, edges, "src", "dst"), frame(spark, [(s,) for s in seeds], "key"), frame(spark, builds, "src", "vtable"), frame(spark, methods, "vtable", "slot", "dst"), frame(spark, calls, "src", "slot"))
    whole = [m for m in methods if m[0] is not None and m[2] is not None]
    builds, calls = [b for b in builds if None not in b], [c for c in calls if None not in c]
    want = [live_by_hand(clean, seeds, builds, [m for m in whole if m[1] is not None], calls)[0], live_by_hand(clean, seeds, builds, whole, None)[0], reach(clean, seeds + [m[2] for m in methods if m[2] is not None])]
    assert [keys(df) for df in got] == want
    assert want[0] < want[1] < want[2]


def test_only_hubs_are_copied(spark, monkeypatch):
    """Nodes that are no hubs go to one task each, and rows that are dealt already don't move when many nodes enter them."""
    monkeypatch.setattr(graph, "SMALL", 0)
    rows = spark.range(400).select((F.col("id") % 50).alias("key"), F.col("id").alias("to"))
    dealt = walks._Dealt(rows, ["key"], "to")
    found = dealt.entered(spark.range(10).select(F.col("id").alias("key")), 10)
    assert found.count() == 80
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and re.search(r"SortMergeJoin.*\n\W*Filter.*\n\W*InMemoryTableScan", plan)  # neither exchanged nor sorted
    dealt.release()
    monkeypatch.setattr(graph, "HUB", 100)
    dealt = walks._Dealt(rows.union(spark.range(300).select(F.lit(7).cast("long"), F.col("id") + 1000)), ["key"], "to")
    assert [r.key for r in dealt.hubs.collect()] == [7]
    assert dealt.entered(spark.range(6, 9).select(F.col("id").alias("key")), 3).count() == 324
    assert dealt.heavy.select("salt").distinct().count() == 8
    dealt.release()


def test_met_tables_stay_few(spark):
    met = walks._Met(["key"])
    for i in range(12):
        assert met.new(spark.range(i * 5, i * 5 + 10).select(F.col("id").alias("key")))[1] == (10 if i == 0 else 5)
    assert met.n == 65 == met.all().distinct().count() and len(met.parts) <= graph.COMPACT


@pytest.mark.parametrize("edges_in_block", [1_000_000, 3])
def test_components_inside_blocks_and_between(spark, monkeypatch, edges_in_block):
    """Cycles inside blocks of four keys, through several blocks, in blocks that are not contracted, with loops, nulls and negative keys."""
    monkeypatch.setattr(blocks, "BITS", 2)
    monkeypatch.setattr(blocks, "EDGES", edges_in_block)
    r = random.Random(4)
    edges = [(r.randrange(-20, 60), r.randrange(-20, 60)) for _ in range(75)] + [(100, 101), (101, 100), (101, 110), (110, 111), (111, 100), (120, 120), (130, 131), (131, 140), (None, 1), (2, None), (100, 101)]
    clean = {e for e in edges if None not in e}
    to = {}
    for a, b in clean:
        to.setdefault(a, set()).add(b)
    behind = {}
    for k in {k for e in clean for k in e}:
        met, todo = set(), list(to.get(k, ()))
        while todo:
            if (at := todo.pop()) not in met:
                met.add(at)
                todo += to.get(at, ())
        behind[k] = met
    want = {k: max(x for x in behind[k] if k in behind[x]) for k in behind if k in behind[k]}
    got = graph.strong_components(frame(spark, edges, "src", "dst")).collect()
    assert len(got) == len(want) and {x.key: x.component for x in got} == want
    assert len(set(want.values())) < len(want)


def test_rings_along_keys_take_few_jobs(spark):
    """Small rings in a row with edges on to the next; some lie across the borders of blocks."""
    k = F.col("id")
    deps = spark.range(300_000).select(k.alias("src"), F.when(k % 3 == 2, k - 2).otherwise(k + 1).alias("dst")).union(spark.range(0, 299_997, 300).select(k, k + 3))
    assert jobs(spark, "rings", lambda: graph.strong_components(deps).agg(F.count("*"), F.count_distinct("component")).first()) < 200
    assert tuple(graph.strong_components(deps).agg(F.count("*"), F.count_distinct("component")).first()) == (300_000, 100_000)


def test_a_walk_of_many_labels_leaves_little_on_disk(spark):
    """Ten labels begin at each of 20,000 nodes: what leads to what is written, not sets of labels at every step."""
    k = F.col("id")
    edges = spark.range(20_000).select(k.alias("src"), (k * 2).alias("dst")).union(spark.range(0, 20_000, 5).select(k, F.floor(k / 3)))
    seeds = spark.range(200_000).select((k % 20_000).alias("key"), (F.floor(k / 20_000) * 100 + k % 100).alias("label"))
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    sets = walks.labelled_walk(edges, seeds)
    assert size() - before < 3_000_000
    assert sets.filter("key = 39998").agg(F.sum(F.bit_count("bits"))).first()[0] == 10  # of node 19999, to which nothing leads
