"""Walks that carry tables, labels or changes, against plain loops."""

import random

import pytest

from tarnwell.operators import graph, walks


def frame(spark, rows, *names):
    return spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))


def keys(df):
    out = [r[0] for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.fixture(params=[graph.SMALL, 0], ids=["broadcast", "shuffled"])
def size(request, monkeypatch):
    monkeypatch.setattr(graph, "SMALL", request.param)


def reach(edges, seeds):
    met, todo = set(seeds), list(seeds)
    while todo:
        at = todo.pop()
        for a, b in edges:
            if a == at and b not in met:
                met.add(b)
                todo.append(b)
    return met


def live_by_hand(edges, seeds, builds, methods, calls):
    met, tables, slots = set(seeds), set(), set()
    while True:
        before = len(met), len(tables), len(slots)
        met |= {b for a, b in edges if a in met}
        tables |= {v for a, v in builds if a in met}
        slots |= {s for a, s in calls or () if a in met}
        met |= {d for v, s, d in methods if v in tables and (calls is None or s in slots)}
        if before == (len(met), len(tables), len(slots)):
            return met, tables, slots


@pytest.mark.parametrize("called", [True, False])
def test_live_dispatch(spark, size, called):
    r = random.Random(5)
    pick = lambda n: r.randrange(n)
    edges = [(pick(60), pick(60)) for _ in range(30)] + [(None, 1), (0, None)]
    builds, methods = [(pick(60), pick(12)) for _ in range(25)], [(pick(12), pick(9), pick(60)) for _ in range(40)] + [(None, 1, 59), (1, 1, None)]
    calls = [(pick(60), pick(9)) for _ in range(30)] if called else None
    seeds = [0, 7, 7]
    got = walks.live_dispatch(frame(spark, edges, "src", "dst"), frame(spark, [(s,) for s in seeds], "key"), frame(spark, builds, "src", "vtable"), frame(spark, methods, "vtable", "slot", "dst"), frame(spark, calls, "src", "slot") if called else None)
    clean = [e for e in edges if None not in e]
    want = live_by_hand(clean, seeds, builds, [m for m in methods if m[0] is not None and m[2] is not None], calls)
    assert (keys(got.reached), keys(got.tables), keys(got.slots)) == want
    assert want[0] < reach(clean + [(0, m[2]) for m in methods if m[2] is not None], seeds)  # fewer than with all tables


def test_a_table_that_nothing_reached_builds_keeps_no_method(spark):
    """main builds A's table and calls slot 1; B's table is built by a function that only B's own method calls."""
    edges = frame(spark, [(1, 2), (20, 3)], "src", "dst")
    builds, methods = frame(spark, [(2, 100), (3, 200)], "src", "vtable"), frame(spark, [(100, 1, 10), (100, 2, 11), (200, 1, 20)], "vtable", "slot", "dst")
    seeds, calls = frame(spark, [(1,)], "key"), frame(spark, [(2, 1)], "src", "slot")
    got = walks.live_dispatch(edges, seeds, builds, methods, calls)
    assert keys(got.reached) == {1, 2, 10} and keys(got.tables) == {100} and keys(got.slots) == {1}
    assert keys(walks.live_dispatch(edges, seeds, builds, methods).reached) == {1, 2, 10, 11}
    none = walks.live_dispatch(edges, seeds.limit(0), builds, methods, calls)
    assert not keys(none.reached) and not keys(none.tables)


def test_labels(spark, size):
    """130 labels, in three words; nodes are reached by some early and by others late."""
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(15)] + [(r.randrange(40), r.randrange(40)) for _ in range(30)]
    seeds = [(r.randrange(40), label) for label in range(130)] + [(3, 64), (3, 64), (None, 1), (4, None), (5, -1)]
    sets = walks.labelled_walk(frame(spark, edges, "src", "dst"), frame(spark, seeds, "key", "label"))
    want = {}
    for key, label in seeds:
        if key is not None and label is not None and label >= 0:
            for k in reach(edges, [key]):
                want.setdefault(k, set()).add(label)
    assert {r.key: list(r.labels) for r in walks.label_lists(sets).collect()} == {k: sorted(v) for k, v in want.items()}
    assert {(r.key, r.label) for r in walks.labels_of(sets).collect()} == {(k, x) for k, v in want.items() for x in v}

    items = [(k, k % 3, k % 2 == 0, k % 5 > 0) for k in range(45)]
    table = spark.createDataFrame(items, "key long, krate int, is_public boolean, in_library boolean")
    got = {(r.krate, r.label): (r.n_items, r.n_marked, r.skip) for r in walks.marks_by_label(table, sets, "krate").collect()}
    of = lambda c, x: sum(1 for k, krate, *_ in items if krate == c and x in want.get(k, ()))
    assert got == {(c, x): (15, of(c, x), of(c, x) == 15) for c in range(3) for x in range(130) if of(c, x)}
    public = {k for k, _, public, library in items if public and library and k in want}
    assert {r.key for r in walks.seeds_by_library(table, sets).collect()} == public


def test_worked_example_of_two_binaries(spark):
    """main -> wrap -> used -> private_used of a library; a second binary calls unused only."""
    names = ["main", "wrap", "used", "private_used", "unused", "private_unused", "main2"]
    at = {n: i for i, n in enumerate(names)}
    edges = frame(spark, [(at[a], at[b]) for a, b in (("main", "wrap"), ("wrap", "used"), ("used", "private_used"), ("main2", "unused"))], "src", "dst")
    sets = walks.label_lists(walks.labelled_walk(edges, frame(spark, [(at["main"], 0), (at["main2"], 1)], "key", "label")))
    got = {names[r.key]: list(r.labels) for r in sets.collect()}
    assert got == {"main": [0], "wrap": [0], "used": [0], "private_used": [0], "unused": [1], "main2": [1]}


@pytest.mark.parametrize("seed", range(2))
def test_changes_against_a_new_walk(spark, size, seed):
    r = random.Random(seed)
    nodes = 40
    pairs = {(r.randrange(nodes), r.randrange(nodes)) for _ in range(55)} | {(0, 1), (1, 2), (2, 0)}
    seeds = {0, r.randrange(nodes), r.randrange(nodes)}
    reached = frame(spark, [(k,) for k in reach(pairs, seeds)], "key")
    removed, added = set(r.sample(sorted(pairs), 15)) | {(90, 91)}, {(r.randrange(nodes), r.randrange(nodes)) for _ in range(8)}
    after = (pairs - removed) | added
    gone = {0} if seed else set()
    rows = lambda pairs: frame(spark, sorted(pairs) + [(None, 3)], "src", "dst")
    got = walks.changed_walk(rows(pairs), reached, frame(spark, [(k,) for k in (seeds - gone) | {39}], "key"), rows(added), rows(removed), frame(spark, [(k,) for k in gone], "key"))
    assert keys(got) == reach(after, (seeds - gone) | {39})


def test_a_cycle_without_a_seed_is_lost(spark):
    edges = frame(spark, [(0, 1), (1, 2), (2, 1), (2, 3)], "src", "dst")
    none, reached = frame(spark, [], "src", "dst"), frame(spark, [(0,), (1,), (2,), (3,)], "key")
    assert keys(walks.changed_walk(edges, reached, frame(spark, [(0,)], "key"), none, frame(spark, [(0, 1)], "src", "dst"))) == {0}
    assert keys(walks.changed_walk(edges, reached, frame(spark, [(1,)], "key"), none, none, frame(spark, [(0,)], "key"))) == {1, 2, 3}


@pytest.mark.parametrize("spread", [walks.SPREAD, 0], ids=["pairs", "sets"])
def test_labels_of_the_nodes_asked_for(spark, monkeypatch, spread):
    """By pairs of nodes and by sets: cycles, loops, a long way, keys that are in two partitions or twice in one."""
    monkeypatch.setattr(walks, "SPREAD", spread)
    monkeypatch.setattr(graph, "SMALL", 500 if spread else 0)
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(9)] + [(20, 21), (21, 22), (22, 20), (7, 7), (None, 3)] + [(r.randrange(30), r.randrange(30)) for _ in range(12)]
    seeds = [(r.randrange(30), r.randrange(200)) for _ in range(60)] + [(50, 5), (50, 63), (50, 64), (None, 1)]
    pairs = walks._leading(frame(spark, sorted({e for e in edges if None not in e}), "src", "dst"), spread * len(seeds))
    assert (pairs is None) == (spread == 0)
    if pairs is not None:
        clean = [e for e in edges if None not in e]
        assert {(x.at, x.key) for x in pairs.collect()} == {(a, k) for a in range(30) for k in reach(clean, [a]) - {a}}
    want = {(k, label) for key, label in seeds if key is not None for k in reach(edges, [key])}
    asked = [(k, k % 4) for k in range(0, 60, 2)] + [(8, 9), (8, 0), (None, 2)]
    items = spark.createDataFrame(asked, "key int, krate int")
    got = walks.labelled_walk(frame(spark, edges, "src", "dst"), frame(spark, seeds, "key", "label"), walks.placed(items, "krate"))
    assert got.columns == ["key", "krate", "n", "word", "bits"]
    assert {(x.key, x.label) for x in walks.labels_of(got).collect()} == {(k, x) for k, x in want if (k, k % 4) in asked}
    marks = {(x.krate, x.label): (x.n_items, x.n_marked) for x in walks.marks_by_label(items, got, "krate").collect()}
    every = {}
    for k, krate in asked:
        for x in {x for key, x in want if key == k}:
            every[krate, x] = every.get((krate, x), 0) + 1
    assert marks == {at: (sum(1 for _, c in asked if c == at[0]), n) for at, n in every.items()}


def test_places_in_words(spark):
    rows = [(1, 0, 1), (2, 0, 2**62), (3, 1, -(2**63)), (4, 0, -(2**63) + 5), (5, 2, 2**62 + 1)]
    got = {(x.key, x.label) for x in walks.labels_of(frame(spark, rows, "key", "word", "bits")).collect()}
    assert got == {(1, 0), (2, 62), (3, 127), (4, 0), (4, 2), (4, 63), (5, 128), (5, 190)}
