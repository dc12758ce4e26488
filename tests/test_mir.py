"""Dumps of bodies to tables of statements, edges and casts."""

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import extraction, graph
from tarnwell.sources import mir

DUMP = """// MIR for `main`
fn main() -> () {
    let mut _0: ();
    let _1: i32;

    bb0: {
        _1 = helper(const 1_i32) -> [return: bb1, unwind continue];
    }

    bb1: {
        _2 = util::map::<i32, fn(i32) -> i32 {double}>(move _1, double) -> [return: bb2, unwind: bb9];
    }

    bb2: {
        _3 = taken as fn() (PointerCoercion(ReifyFnPointer, Implicit));
        _4 = {closure@src/main.rs:3:5: 3:8} { x: copy _1 };
        _5 = move _3(copy _4) -> [return: bb3, unwind continue];
    }

    bb3: {
        _6 = move _4 as &dyn std::fmt::Debug (PointerCoercion(Unsize, Implicit));
        _7 = Add(copy _1, const 2_i32);
        _8 = [const a_fn, b_fn];
        _9 = <Foo as Clone>::clone(copy _1) -> [return: bb4, unwind continue];
        return;
    }
}

fn main::{closure#0}(_1: &{closure@src/main.rs:3:5: 3:8}) -> () {
    bb0: {
        _0 = inner::<u8>() -> [return: bb1, unwind continue];
    }
}

fn helper(_1: i32) -> i32 {
    bb0: {
        _0 = copy _1;
        return;
    }
}

fn unused() -> () {
    bb0: {
        _1 = helper(const 2_i32) -> [return: bb1, unwind continue];
    }
}
"""


@pytest.fixture(scope="module")
def bodies(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("mir")
    (folder / "main.mir").write_text(DUMP)
    (folder / "empty.mir").write_text("")
    return mir.read_mir(spark, f"file://{folder}")


def test_functions(bodies):
    assert {(r.name, r.place) for r in mir.functions(bodies).collect()} == {("main", None), ("main::{closure#0}", "src/main.rs:3:5: 3:8"), ("helper", None), ("unused", None)}


def test_edges_by_name(spark, bodies):
    names = ["main", "main::{closure#0}", "helper", "unused", "util::map", "double", "taken", "a_fn", "b_fn", "inner", "<Foo as Clone>::clone"]
    key = {r.k: r.n for r in spark.createDataFrame([(n,) for n in names], "n string").selectExpr("n", "xxhash64(n) as k").collect()}
    edges = extraction.body_edges(mir.statements(bodies))
    got = {(key.get(r.src), key.get(r.dst)) for r in edges.collect()}
    main = {"helper", "util::map", "double", "taken", "main::{closure#0}", "a_fn", "b_fn", "<Foo as Clone>::clone"}
    assert got == {("main", x) for x in main} | {("main::{closure#0}", "inner"), ("unused", "helper")}
    seeds = mir.functions(bodies).filter("name = 'main'").select("key")
    reached = {key.get(r.key) for r in graph.reachable(edges, seeds).collect()}
    assert "unused" not in reached and {"helper", "inner"} <= reached


def test_casts(bodies):
    dynamic, taken = extraction.cast_facts(mir.casts(bodies))
    assert dynamic.count() == 1 and taken.count() == 1


def test_statements_without_a_place_are_dealt_over_all_tasks(spark):
    body = "fn f{}() -> () {{\n    bb0: {{\n        _1 = f{}() -> [return: bb1, unwind continue];\n        _2 = {{closure@src/a.rs:{}:1: 1:9}} {{ x: copy _1 }};\n    }}"
    closure = "fn f{}::{{closure#0}}(_1: &{{closure@src/a.rs:{}:1: 1:9}}) -> () {{\n    bb0: {{\n        _0 = copy _1;\n    }}"
    bodies = spark.createDataFrame([(t,) for k in range(400) for t in (body.format(k, k + 1, k), closure.format(k, k))], "body string")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = mir.statements(bodies)
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 1200 and max(sizes) < 600
        assert extraction.body_edges(rows).count() == 800
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
