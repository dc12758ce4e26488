"""Extraction, policies, orders, parsers and sinks on small tables."""

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import extraction, graph, measurements, policies
from tarnwell.plans.numbering import numbered
from tarnwell.sources import files, parsers


def keys(df, name="key"):
    return {r[name] for r in df.collect()}


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


STATEMENTS = "src long, kind string, target long, rvalue string, operands array<struct<kind: string, target: long>>"


def test_edges_of_bodies(spark):
    rows = [
        (1, "call", 2, None, None), (1, "call", None, None, None), (1, "closure", 3, None, None), (2, "other", 9, None, None),
        (2, "assign", None, "Use", [("fn", 4), ("fn", 5)]), (2, "assign", None, "BinaryOp", [("fn", 6), ("place", 7), ("fn", 8)]),
        (3, "assign", None, "Aggregate", [("fn", 1), ("fn", 2), ("fn", None)]), (3, "assign", None, "Len", [("fn", 9)]), (3, "assign", None, "Use", None),
    ]
    statements = frame(spark, rows, STATEMENTS)
    edges = extraction.body_edges(statements)
    assert {tuple(r) for r in edges.collect()} == {(1, 2), (1, 3), (2, 4), (2, 6), (3, 1), (3, 2)}
    assert {(r.src, tuple(r.targets), r.n) for r in extraction.adjacency(edges).collect()} == {(1, (2, 3), 2), (2, (4, 6), 2), (3, (1, 2), 2)}
    assert extraction.body_edges(statements.limit(0)).isEmpty()


def test_constants_casts_and_types(spark):
    constants = frame(spark, [(1, False, False), (2, True, False), (3, False, True), (4, None, False)], "owner long, is_generic boolean, failed boolean")
    values = frame(spark, [(1, "Indirect", [10]), (1, "Scalar", [19]), (2, "Slice", [20]), (3, "Pointer", [20]), (4, "Pointer", [20])], "owner long, kind string, prov array<long>")
    allocs = frame(spark, [(10, "Memory", None), (11, "Function", 100), (12, "Memory", None), (13, "VTable", 7), (14, "Function", 101), (20, "Function", 102)], "id long, kind string, target long")
    inner = frame(spark, [(10, 11), (10, 12), (12, 13), (12, 10), (11, 14)], "src long, dst long")
    traits, fns = extraction.constant_allocations(constants, values, allocs, inner)
    assert keys(traits, "trait_key") == {7} and keys(fns) == {100}
    casts = frame(spark, [("Unsize", None, False, 5), ("ReifyFnPointer", 3, True, None), ("ReifyFnPointer", 4, False, None), ("Ptr", 6, True, 8)], "kind string, target long, is_fn boolean, type_id long")
    dynamic, taken = extraction.cast_facts(casts)
    assert keys(dynamic, "type_id") == {5} and keys(taken) == {3}
    types = frame(spark, [(5, "Ref", None, 6), (6, "RawPtr", None, 7), (7, "Dynamic", 70, None), (8, "Dynamic", 80, None), (9, "Adt", None, 8)], "type_id long, kind string, principal long, inner long")
    assert keys(extraction.dynamic_traits(types, dynamic), "trait_key") == {70}
    assert keys(extraction.asm_symbols(frame(spark, [("SymFn", 1), ("Const", 2), ("SymFn", None)], "kind string, target long"))) == {1}


ITEM = "key long, is_local boolean, is_fn_like boolean, kind string, is_public boolean, is_entry boolean, in_reachable_set boolean, trait_key long, trait_dyn_compatible boolean, scid string, lo string"
FLAGS = ("no_mangle", "used_linker", "has_symbol_name", "has_linkage", "is_drop_impl", "requires_mono", "is_async")


def items_of(spark, rows):
    out = frame(spark, [(k, local, fn, kind, public, entry, entry, None, False, "a", str(k)) for k, local, fn, kind, public, entry in rows], ITEM)
    return out.withColumns({f: F.lit(False) for f in FLAGS})


def test_policies(spark):
    items = items_of(spark, [(1, True, True, "Fn", False, True), (2, True, True, "Fn", False, False), (3, True, True, "Fn", True, False), (4, True, False, "Const", False, False), (5, False, True, "Fn", False, False), (6, True, True, "Fn", False, False)])
    reached, mono, traits = frame(spark, [(1,)], "key long"), frame(spark, [(6,)], "key long"), frame(spark, [], "trait_key long")
    got = [keys(policies.deletable(items, reached, mono, traits, policies.Policy(level=k))) for k in range(5)]
    assert got == [set(), {2}, {2, 4}, {2, 3, 4}, {2, 3, 4, 6}]
    kept = items.withColumn("is_unsafe", F.when(F.col("key") == 2, True).when(F.col("key") == 3, False))
    assert keys(policies.deletable(kept, reached, mono, traits, policies.Policy(keep=("is_unsafe",)))) == {3}
    with pytest.raises(ValueError):
        policies.may_go(policies.Policy(keep=("unknown",)))
    flagged = policies.with_flags(policies.Policy(), ["-fa", "-fb", "-fno-a", "-O2"], {2: ["trial"]})
    assert (flagged.level, flagged.features, policies.default_level(True)) == (2, {"b", "trial"}, 1)
    with pytest.raises(ValueError):
        policies.with_flags(policies.Policy(), ["--x"])
    assert {r.lo for r in policies.emitted_keep(items, mono, traits).collect()} == {"1", "6"}
    fns = frame(spark, [(1, "s1", "a", False, True), (2, "s2", "a", False, True), (3, "s3", "a", True, True), (4, "s4", "b", False, True), (5, None, "a", False, True)], "key long, symbol string, crate string, is_trait_impl boolean, is_fn_like boolean")
    assert keys(policies.unlinked(fns, frame(spark, [("s1",)], "symbol string"), frame(spark, [("b",)], "crate string"))) == {2}


def test_analysis_of_a_partition(spark):
    items = items_of(spark, [(1, True, True, "Fn", False, True), (2, True, True, "Fn", False, False), (3, True, True, "Fn", False, False)])
    edges, none, traits = frame(spark, [(1, 2)], "src long, dst long"), frame(spark, [], "key long"), frame(spark, [], "trait_key long")
    out = graph.analyse(items, edges, traits, none, none)
    assert keys(out.gone) == {3} and keys(out.reached) == {1, 2} and keys(out.seeds) == {1}
    keep = frame(spark, [("a", "3")], "scid string, lo string")
    assert keys(graph.analyse(items, edges, traits, none, none, keep).gone) == {2}
    assert keys(graph.analyse(items.filter("key > 1"), edges, traits, none, none).gone) == set()
    assert keys(graph.feedback_seeds(keep, items)) == {3}
    assert keys(graph.forced_elimination(items, out.reached, frame(spark, [(3,)], "key long"), none, traits)) == set()
    assert {tuple(r) for r in graph.codegened(items, out.gone, frame(spark, [(1,), (3,)], "key long")).collect()} == {(1, True), (2, False), (3, False)}
    counts = measurements.elimination_counters(items, out.reached, out.gone, "scid").first()
    assert tuple(counts) == ("a", 3, 1, 2, 1)


def test_orders_and_cycles(spark):
    nodes = frame(spark, [(k,) for k in range(1, 9)], "key long")
    deps = frame(spark, [(1, 2), (2, 3), (3, 2), (4, 1), (5, 6), (6, 7), (7, 8), (3, 8)], "src long, dst long")
    assert keys(graph.cyclic(nodes, deps)) == {2, 3}
    loose = graph.without_cycles(nodes, deps)
    assert {tuple(r) for r in loose.collect()} == {tuple(r) for r in deps.collect()} - {(2, 3)}
    order = {r.key: r.position for r in graph.topological_order(nodes, loose, frame(spark, [(4,)], "key long")).collect()}
    assert set(order) == {1, 2, 3, 5, 6, 7, 8} and (order[2], order[8]) == (1, 2) and sorted(order.values()) == [1, 2, 3, 4, 5, 7, 8]
    assert all(order[r.src] > order[r.dst] for r in loose.collect() if r.src != 4)
    assert {tuple(r) for r in graph.degrees(nodes, deps).filter("key in (2, 4, 8)").collect()} == {(2, 1, 2), (4, 1, 0), (8, 0, 2)}
    waves = graph.admission(frame(spark, [(1, 5.0), (2, 9.0), (3, 5.0), (4, 1.0)], "key long, cp double"), 2)
    assert {(r.key, r.rank, r.wave) for r in waves.collect()} == {(2, 1, 1), (1, 2, 1), (3, 3, 2), (4, 4, 2)}
    phases, waits = graph.phase_graph(frame(spark, [(1, True), (2, False), (3, False)], "unit long, is_binary boolean"), frame(spark, [(1, 2), (2, 3)], "src long, dst long"))
    assert {tuple(r) for r in waits.collect()} == {(5, 4), (9, 8), (13, 12), (9, 10), (13, 14), (6, 4), (4, 8), (8, 12), (10, 6), (14, 10)}
    assert graph.topological_levels(phases, waits).filter("level is null").isEmpty() and phases.count() == 9
    units = frame(spark, [(1, "registry+x", "syn"), (2, None, "own"), (3, "path", "syn")], "unit long, source string, crate string")
    assert keys(graph.scheduled(units), "unit") == {2, 3}
    tiers = frame(spark, [("syn", 2), ("syn", 1)], "crate string, tier int")
    assert {(r.unit, r.tier) for r in graph.with_tier(units, tiers).collect()} == {(1, 1), (2, None), (3, 1)}
    assert sorted(r.n for r in numbered(spark.range(50).repartition(7), ["id"], "n").filter("n = id + 1").collect()) == list(range(1, 51))
    assert numbered(spark.range(0), ["id"], "n").count() == 0


def test_more_measurements(spark):
    size = "crate string, loc long"
    out = measurements.size_reduction(frame(spark, [("a", 10), ("a", 30), ("b", 0)], size), frame(spark, [("a", 10), ("c", 1)], size), "crate", "loc")
    assert {tuple(r) for r in out.collect()} == {("a", 40, 10, 75.0), ("b", 0, 0, None), ("c", 0, 1, None)}
    texts = frame(spark, [("a", "x\ny\n"), ("b", "z"), ("c", None), ("d", "q\nr")], "path string, text string")
    assert tuple(measurements.source_size(texts, "path").first()) == (4, 5) and tuple(measurements.source_size(texts, "path", 2).first()) == (2, 3)
    assert tuple(measurements.source_size(texts.limit(0), "path").first()) == (0, 0)
    runs = frame(spark, [("u", 1, "baseline", 4.0), ("u", 1, "treated", 2.0), ("u", 2, "baseline", 9.0), ("u", 2, "treated", 3.0), ("u", 3, "treated", 3.0)], "unit string, round int, leg string, secs double")
    assert {(r["round"], r.speedup) for r in measurements.pair_rounds(runs, "unit", "round", "leg", "secs").collect()} == {(1, 2.0), (2, 3.0)}
    assert tuple(measurements.repeated_runs(runs.filter("leg = 'treated'"), "unit", "secs").first()) == ("u", 3, pytest.approx(8 / 3), 3.0)
    assert [r.secs for r in measurements.ranked(runs, "unit", "secs", "round").filter("rank <= 2").orderBy("rank").collect()] == [9.0, 4.0]
    assert {(r.side, r.secs) for r in measurements.top_and_bottom(runs, "secs", "round", 1, 1).collect()} == {("saved", 9.0), ("regressed", 2.0)}
    assert [r["round"] for r in measurements.newest(runs.filter("leg = 'treated'"), "round", "unit", 2).collect()] == [3, 2]
    bench = frame(spark, [("baseline", 4.0, True), ("treated", 2.0, True), ("broken", 1.0, False)], "name string, duration_secs double, success boolean")
    assert {(r.name, r.status, r.speedup) for r in measurements.benchmark_summary(bench).collect()} == {("baseline", "OK", 1.0), ("treated", "OK", 2.0), ("broken", "FAIL", None)}


SOURCE = '''// fn no() {
mod m {
    pub struct S { a: u8 }
    impl Show for S {
        fn show(&self) -> String { let s = "fn x() { y() }"; helper(s); other::helper(1) }
    }
    /* fn gone() { /* nested */ } */
    fn helper(x: &str) { if (true) { println(x) } }
}
pub const fn three() -> u8 { '{'; r#"} " fn z"#; m::helper("q"); 3 }
const N: u8 = 3;
'''


def test_parsers(spark):
    got = {(f[0], f[1]) for f in parsers.by_lines(SOURCE)}
    assert got == {("mod", "m"), ("struct", "S"), ("fn", "show"), ("fn", "helper"), ("fn", "three"), ("const", "N")}
    tree = list(parsers.by_tree(SOURCE))
    assert [(k, n) for k, n, *_ in tree if k != "call"] == [("mod", "m"), ("struct", "m::S"), ("fn", "m::S::show"), ("fn", "m::helper"), ("fn", "three"), ("const", "N")]
    assert [(f[3], f[4]) for f in tree if f[0] == "call"] == [("m::S::show", "helper"), ("m::S::show", "other::helper"), ("m::helper", "println"), ("three", "m::helper")]
    assert [(f[3], f[4]) for f in parsers.by_braces(SOURCE) if f[0] == "call"] == [("show", "helper"), ("show", "helper"), ("helper", "println"), ("three", "helper")]
    assert list(parsers.by_tree("")) == [] and list(parsers.by_tree("}}}} /* open \" fn a(")) == []
    texts = frame(spark, [("f", SOURCE), ("g", None), ("h", "fn helper() {}")], "path string, text string")
    facts = parsers.parse_sources(texts, "path")
    items, calls = parsers.call_graph(facts, "path")
    names = {r.id: r.name for r in items.collect()}
    assert {(names[r.src], names[r.dst]) for r in calls.collect()} == {("m::S::show", "m::helper"), ("three", "m::helper")}
    assert parsers.parse_sources(texts, "path", lambda text: [("len", str(len(text)), 0, None, None)]).count() == 3


def test_reports_and_state(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "t.html").write_text('<script>\nconst UNIT_DATA = [{"i": 0, "name": "syn", "version": "2", "mode": "todo", "start": 0.5, "duration": 1.25, "rmeta_time": null}];\nconst X = [];</script>')
    assert [(r.unit, r.name, r.started, r.secs) for r in files.read_timings(spark, at("t.html")).collect()] == [(0, "syn", 0.5, 1.25)]
    for crate in ("a", "b"):
        (tmp_path / "bench" / crate).mkdir(parents=True)
        (tmp_path / "bench" / crate / "bench.json").write_text('{"name": "x", "duration_secs": 2.0, "success": true}\n{"name": "y", "duration_secs": 4.0, "success": false}\n')
    assert {tuple(r) for r in files.read_bench_reports(spark, at("bench")).collect()} == {("a", 2, 3.0, 1), ("b", 2, 3.0, 1)}
    items = frame(spark, [("2", "1", "b::c"), ("1", "1", "a")], "scid string, lo string, path string")
    files.write_named_dump(items.coalesce(1), at("dump"))
    assert [r.value for r in spark.read.text(at("dump")).collect()] == ["1:1 a", "2:1 b::c"]
    lines = frame(spark, [("l", 2, "error: b"), ("l", 1, "warning: a")], "log string, n int, line string")
    assert files.write_diagnostics(lines, at("log")) and not files.write_diagnostics(lines.limit(0), at("none"))
    assert not (tmp_path / "none").exists()
    files.write_symbols(frame(spark, [("b",), ("a",), ("a",)], "symbol string"), at("sym"))
    assert [r.value.strip() for r in spark.read.text(at("sym")).collect()] == ["{", "global:", "a;", "b;", "local: *;", "};"]
    state = frame(spark, [("a", 1), ("b", 2)], "crate string, key long")
    files.write_state(state, at("state"), "crate")
    files.write_state(frame(spark, [("b", 3)], "crate string, key long"), at("state"), "crate")
    assert {(r.crate, r.key) for r in files.read_state(spark, at("state")).collect()} == {("a", 1), ("b", 3)}
    results = frame(spark, [("p", 1.0)], "project string, secs double")
    files.append_results(results, at("res"))
    files.append_results(results, at("res"))
    assert spark.read.parquet(at("res")).count() == 2
    files.write_report(frame(spark, [("a<b", 1)], "name string, n int"), at("html"), "t", ["name", "n"])
    assert any("<td>a&lt;b</td><td>1</td>" in r.value for r in spark.read.text(at("html")).collect())
